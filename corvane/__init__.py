"""corvane: trust-aware retrieval and analytics as Spark dataflow."""

__version__ = "0.1.0"
