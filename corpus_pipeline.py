"""The corpus pipeline: documents through five stages, each written and read again.

Quality rules, line dedup, MinHash near-dedup, mixing sources to target weights and
best-fit packing. Every stage but the last returns the columns of its documents; the
last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from corvane.llm.shared import WHITE, new_path

#: No document repeats: the mix takes whole documents of each source at most once, and
#: at least nine tenths of all tokens (``least``), however scarce a source is.
MIX = mixing.Mix(target_entropy=0.95, max_repeat=1.0, budget=None)


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` as row (all columns), doc_id and text: no column can meet an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _unpacked(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` in the columns of ``docs``, with the text and n_chars (if there is one) as they now are."""
    out = []
    for c, kind in docs.dtypes:
        if c == "n_chars":
            out.append(F.coalesce(F.length(text), F.lit(0)).cast(kind).alias(c))
        else:
            out.append(F.col(text).alias(c) if c == "text" else F.col(f"row.`{c}`"))
    return rows.select(*out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return _unpacked(quality_rules.keep(_packed(docs)), docs, "clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document left without words goes."""
    rows = line_dedup.dedup(_packed(docs), exact_chars=1)
    empty = F.length(F.btrim("text", F.lit(WHITE))) == 0
    return _unpacked(rows.where((F.col("n_dropped") == 0) | ~F.coalesce(empty, F.lit(False))), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the tempered source weights."""
    return mixing.apply(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL cannot express the mixing and packing stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
