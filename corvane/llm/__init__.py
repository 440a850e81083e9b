"""Training-data operators: sharding, scoring, deduplication, packing, search."""
