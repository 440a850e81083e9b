"""Ingest: label documents, skip known ones, chunk, check tiers, report.

The batch is validated before anything is written: a tier conflict leaves every table
as it was. Skipping happens before chunking, so known documents cost a narrow join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.lattice import tier_label
from corvane.operators.chunking import Chunker, chunk
from corvane.sources.policy import Policy


class TierConflict(ValueError):
    """The same chunk arrived under two trust tiers."""


@dataclass
class Ingest:
    """What a batch comes to: its chunks, its registry rows and its counts."""

    chunks: DataFrame
    registry: DataFrame
    skipped: DataFrame


def label(docs: DataFrame, policy: Policy) -> DataFrame:
    """identity, sha256 and tier of documents (text, source_uri, doc_id[, metadata])."""
    identity = F.coalesce(F.when(F.col("doc_id").cast("string") != "", F.col("doc_id").cast("string")), F.col("source_uri"))
    return docs.withColumn("identity", identity).withColumn("doc_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("tier", policy.tier(F.col("source_uri")))


def new_documents(labelled: DataFrame, registry: DataFrame | None, order: str = "identity") -> DataFrame:
    """Rows whose (identity, source_uri, sha256) is new; of repeated ones the first by ``order``."""
    key = ["identity", "source_uri", "doc_sha256"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    fresh = labelled.withColumn("_n", first).where("_n = 1").drop("_n")
    return fresh if registry is None else fresh.join(registry.select(*key), key, "left_anti")


def to_chunks(docs: DataFrame, chunker: Chunker = Chunker()) -> DataFrame:
    rows = chunk(docs, chunker)
    ident = F.concat(F.col("identity"), F.lit("#"), F.col("ordinal").cast("string"), F.lit(":"), F.substring(F.sha2("chunk_text", 256), 1, 12))
    kept = [F.col("identity").alias("doc_id"), "ordinal", "heading", F.col("chunk_text").alias("text"), "tier", "source_uri", "doc_sha256"]
    if "metadata" in docs.columns:
        kept.append("metadata")
    return rows.select(ident.alias("chunk_id"), *kept)


def tier_conflicts(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunk_id, tier and known_tier of chunks that are known under another tier."""
    old = known.select("chunk_id", F.col("tier").alias("known_tier")).distinct()
    return chunks.select("chunk_id", "tier").join(old, "chunk_id").where("tier <> known_tier").distinct()


def new_chunks(chunks: DataFrame, known: DataFrame | None) -> DataFrame:
    """The chunks of a batch that are not known, each once."""
    once = chunks.dropDuplicates(["chunk_id"])
    return once if known is None else once.join(known.select("chunk_id"), "chunk_id", "left_anti")


def ingest(docs: DataFrame, policy: Policy, registry: DataFrame | None = None, known: DataFrame | None = None, chunker: Chunker = Chunker(), order: str = "identity") -> Ingest:
    """Raises TierConflict before anything could be written."""
    labelled = label(docs, policy)
    fresh = new_documents(labelled, registry, order)
    chunks = to_chunks(fresh, chunker)
    held = chunks.select("chunk_id", "tier") if known is None else chunks.select("chunk_id", "tier").unionByName(known.select("chunk_id", "tier"))
    clash = held.groupBy("chunk_id").agg(F.min("tier").alias("a"), F.max("tier").alias("b")).where("a <> b").limit(3).collect()
    if clash:
        raise TierConflict(f"chunks under two tiers: {', '.join(r['chunk_id'] for r in clash)}")
    skipped = chunks.limit(0) if known is None else chunks.join(known.select("chunk_id"), "chunk_id", "left_semi")
    return Ingest(new_chunks(chunks, known), fresh.select("identity", "source_uri", "doc_sha256"), skipped)


def report(chunks: DataFrame) -> DataFrame:
    """Chunks by tier label."""
    return chunks.groupBy(tier_label(F.col("tier")).alias("tier_label")).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def summary(docs: DataFrame, policy: Policy, batch: Ingest, registry: DataFrame | None = None) -> DataFrame:
    """One row on what a batch did: documents ingested, updated (ingested, and known before under
    another text) and skipped, chunks added and skipped, and the chunks added by tier label.

    A batch of nothing gives zeros and an empty map.
    """
    key = ["identity", "source_uri"]
    seen = label(docs, policy).agg(F.count(F.lit(1)).alias("documents"))
    fresh = batch.registry.agg(F.count(F.lit(1)).alias("documents_ingested"))
    updated = F.lit(0).cast("long").alias("documents_updated")
    changed = fresh.select(updated) if registry is None else batch.registry.join(registry.select(*key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("documents_updated"))
    tiers = batch.chunks.groupBy(tier_label(F.col("tier")).alias("tier_label")).agg(F.count(F.lit(1)).alias("n"))
    tiers = tiers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_added"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier_label", "n")))).alias("chunks_by_tier"))
    skipped = batch.skipped.agg(F.count(F.lit(1)).alias("chunks_skipped"))
    rows = seen.crossJoin(fresh).crossJoin(changed).crossJoin(tiers).crossJoin(skipped)  # one row each
    left = (F.col("documents") - F.col("documents_ingested")).alias("documents_skipped")
    return rows.select("documents_ingested", "documents_updated", left, "chunks_added", "chunks_skipped", "chunks_by_tier")


def append(spark: SparkSession, batch: Ingest, root: str) -> None:
    """Appends a batch to the corpus tables under ``root``."""
    batch.chunks.write.mode("append").parquet(f"{root}/chunks")
    batch.registry.write.mode("append").parquet(f"{root}/registry")
