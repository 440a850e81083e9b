"""How sources of a language differ in their words: a divergence of every pair, and the words that stand out.

Plain relational. Texts are cut into terms by one pattern and counted by (lang, source)
in one pass, occurrences and documents at once, some megabytes of text at a time in the
tasks that read them; a language keeps the terms that enough of its documents hold. Groups are
crossed with their language's kept terms, so that terms a group lacks count zero; a term's
smoothed share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)). The table of shares meets
itself on (lang, term), which gives each pair of sources the sum of
floor((p - q)^2 / (p + q)); against the shares of the whole language a window ranks the
terms that stand out. Products are decimals and all divisions whole, so results are exact.

Scale: counts are aggregated in each task before anything moves, so a hot source sends
one row per term and task. The crossing is an equi-join on the language with salted
terms (a language has few distinct keys). A pair is computed once and mirrored: rows made
are terms times pairs of sources of a language, which is what the densified form asks for,
and they are summed where they are made. The ranking drops rows beyond ``top`` per task
before it shuffles.

Defined cases: null texts, langs and sources are empty strings; a group without terms has
zeros for every kept term; a language that keeps no term gives its pairs the value 0; a
language of one source has no pairs; every row is a document, repeated rows too; very long
texts are split like all others; an empty table gives an empty result; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import beside, cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of ASCII letters and of any characters beyond ASCII.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: UTF-8 bytes as they stand in terms; those that stand between terms become spaces.
TERM_BYTES = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
#: Bytes of text that a task counts at once; a longer text is counted alone.
COUNTED_BYTES = 16 << 20
SCALE = 1_000_000_000


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), exactly."""
    top = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to lang, source, term, n occurrences and docs, the number of rows that hold it;
    partial counts, a set for each ``COUNTED_BYTES``.

    No byte of a character beyond ASCII is an ASCII byte, so terms are found byte by byte.
    """
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy()), 0
        while at < batch.num_rows:
            size = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED_BYTES, "right")) - at)
            yield _counted(batch.slice(at, size))
            at += size


def _counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    text = rows.column("text")
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: len(text) + 1]
    held = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    spaced = pa.StringArray.from_buffers(len(text), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(TERM_BYTES[held]))
    parts = pc.ascii_split_whitespace(spaced)
    place, words = pc.list_parent_indices(parts).to_numpy(), parts.flatten().dictionary_encode()
    terms, codes = words.dictionary, words.indices.to_numpy()
    wide = max(1, len(terms))
    pairs, n = np.unique(place * wide + codes, return_counts=True)  # of a row and a term
    langs, sources = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
    groups, first, group = np.unique(group, return_index=True, return_inverse=True)
    keys, at, docs = np.unique(group[pairs // wide] * wide + pairs % wide, return_inverse=True, return_counts=True)
    n = np.bincount(at, n, len(keys)).astype(np.int64)
    of, term = pa.array(first[keys // wide]), terms.take(pa.array(keys % wide))
    out = [rows.column("lang").take(of), rows.column("source").take(of), term, pa.array(n), pa.array(docs.astype(np.int64))]
    out = pa.RecordBatch.from_arrays(out, ["lang", "source", "term", "n", "docs"])
    return out.filter(pc.not_equal(term, ""))


def audit(
    docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """lang, source, part (pair or term), item (the other source, or the term), value, rank."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    texts = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    groups = texts.select("lang", "source").distinct()
    every = texts.mapInArrow(count_terms, "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term")
    every = cut(every.agg(F.sum("n").alias("n"), F.sum("docs").alias("_docs")), "all-terms")
    held = every.groupBy("lang", "term").agg(F.sum("_docs").alias("_docs"))
    kept = cut(held.where(F.col("_docs") >= min_docs).select("lang", "term"), "kept-terms")
    counts = cut(every.drop("_docs").join(kept, ["lang", "term"], "left_semi"), "term-counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept")]), "term-groups")

    crossed = beside(kept, groups, "lang", "term")
    p = share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("kept")).alias("p")
    dense = crossed.join(counts, ["lang", "source", "term"], "left").select("lang", "source", "term", p)
    dense = cut(dense, "term-shares")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = dense.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(apart(F.col("p"), F.col("q"))).alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    couples = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = couples.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    words = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    rows = counts.join(words, ["lang", "term"])
    rows = beside(rows, groups.join(langs, "lang").withColumnRenamed("source", "_source"), "lang", "term").where(F.col("source") == F.col("_source"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q"))
    rows = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("p"), F.col("q")).alias("value"))

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return ranked(pairs).unionByName(ranked(rows).where(F.col("rank") <= top))
