"""Evaluation of retrieval arms on a golden set: ingest, index once, score every arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluation, ingest, retrieval
from corvane.operators.chunking import Chunker
from corvane.sources import files
from corvane.sources import policy as policies
from corvane.sources.store import cut, new_path

ARMS = retrieval.NAMED_ARMS


def evaluate(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """Per arm and query: recall, precision, rr, ndcg and hit at k."""
    docs, queries, settings = files.load_golden(spark, path)
    docs = docs.select("text", F.concat(F.lit("kb://"), "doc_id").alias("source_uri"), "doc_id")
    chunks = ingest.ingest(docs, policies.load(), chunker=Chunker(**settings)).chunks
    keyed = chunks.withColumn("key", F.concat("doc_id", F.lit("#"), F.col("ordinal").cast("string")))
    keyed = cut(keyed, "golden-chunks")
    labelled = queries.select(F.explode("relevant_chunk_ids").alias("key")).distinct()
    lost = [r["key"] for r in labelled.join(keyed, "key", "left_anti").limit(3).collect()]
    if lost:
        raise files.SourceError(f"labelled chunks that the corpus does not have: {lost}")
    index = retrieval.save_index(keyed, new_path(spark, "golden-index"), "key", retrieval.searchable(F.col("heading"), F.col("text")))
    asked = queries.select("query_id", "query")
    truth = queries.select("query_id", F.col("relevant_chunk_ids").alias("relevant"))
    out = None
    for arm, config in ARMS.items():
        ranked = retrieval.retrieve(index, asked, config, limit=max(50, k)).select("query_id", F.col("chunk_id").alias("item"), "rank")
        rows = evaluation.score_queries(truth, ranked, k).withColumn("arm", F.lit(arm))
        out = rows if out is None else out.unionByName(rows)
    return out


def ablation(scores: DataFrame) -> DataFrame:
    """One row per arm: macro-averages, hits and their Wilson interval."""
    rows = evaluation.summarize(scores, "arm").withColumn("hits", F.round(F.col("hit") * F.col("n_queries")).cast("long"))
    low, high, _ = evaluation.wilson(F.col("hits"), F.col("n_queries"))
    return rows.withColumn("hit_low", low).withColumn("hit_high", high)


def paired_hits(scores: DataFrame, a: str, b: str) -> DataFrame:
    """McNemar's test of two arms' hits on the same queries."""
    side = lambda arm: scores.where(F.col("arm") == arm).select(F.col("query_id").alias("key"), (F.col("hit") > 0).alias("passed"))
    return evaluation.pair_counts(evaluation.paired(side(a), side(b)))
