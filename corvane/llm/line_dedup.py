"""Line deduplication by deletion neighbourhoods (native: DataFrame functions only).

A line is dropped if an earlier line of the corpus (by document id, then line
number) is equal to it or within one edit (an inserted, deleted or changed
character). Lines are compared without the white space around them. Lines shorter
than ``min_chars`` are dropped for equality alone, from ``exact_chars`` characters on;
shorter ones are left alone (by default all that are shorter than ``min_chars``).

Two texts within one edit share a variant: the one of length m that is left when at
most one character is deleted from each. A line of n characters has n variants of
length n-1 and is itself one of length n. Variants are emitted as hashed keys in three
steps, each for those lines alone whose coarser key another line shares:

1. all variants with the deletion in one half share the other half: two keys per
   length and line stand for all of them;
2. half of a line is cut into segments of about the square root of its width: one
   key, for what stands before and after it, stands for the segment's variants;
3. single variants, keyed by their text (and by the deleted position).

Lines that share a variant and the deleted position differ in that character alone,
so all of them are neighbours: each is linked to the earliest, no pairs are made. A
line that is itself a variant is linked to those it is a variant of, in the same way.
Links are verified with the edit distance of the texts.

Scale: copies collapse into one row per distinct line before anything is joined, and
what moves is hashes; texts move only for lines with a shared key. Counts by key are
pre-aggregated; joins with a hot key have one row per key on the other side, which
adaptive execution splits.

Defined cases: null texts stay null and have no lines; an empty text is one empty line;
a very long text or line is handled whole, its lines as rows of their own and its text in
one value; equal lines of one document tie by their number; rows that repeat an id
(null too, which sorts first) count as one document and lose the same lines, so ids should
be distinct; an empty table gives an empty result; columns that clash with a result column
are replaced, all others pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import WHITE, cut, free_name, key128

LINE = ["k1", "k2"]


def _after(s: Column, m: Column, skip: Column) -> Column:
    """The last ``m - skip`` characters of ``s``."""
    keep = m - skip
    return F.when(keep <= 0, "").otherwise(F.substring(s, F.length(s) - keep + 1, keep))


def half_keys(s: Column, n: Column) -> Column:
    """For the variants of length n-1 and n: one key for each half that is kept."""
    keys = []
    for role, m in ((0, n - 1), (1, n)):
        h = F.floor(m / 2).cast("int")
        for side, part in ((0, F.substring(s, F.lit(1), h)), (1, _after(s, m, h))):
            keys.append(F.struct(F.xxhash64(F.lit(side), m, part).alias("key"), F.lit(role).alias("role"), F.lit(side).alias("side")))
    return F.array(*keys)


def shared_only(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key at least two distinct lines have."""
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return rows.join(often, key, "left_semi")


def lines_of(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """doc_id, line_no, s (the trimmed line), n for each line that takes part."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "line_no", F.btrim("line", F.lit(WHITE)).alias("s"))
    return rows.withColumn("n", F.length("s")).where(F.col("n") >= least)


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, s of the ``wanted`` lines (k1, k2, first), one row per line."""
    at = wanted.select(F.col("first.doc_id").alias("_id"), F.col("first.line_no").alias("_no"))
    at = at.groupBy("_id").agg(F.collect_list("_no").alias("_lines"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = rows.join(at.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")))
    rows = rows.select("_lines", F.split("_text", "\n").alias("_all"))
    rows = rows.select(F.explode(F.transform("_lines", lambda i: F.get(F.col("_all"), i))).alias("line"))
    rows = rows.select(F.btrim("line", F.lit(WHITE)).alias("s"))
    k1, k2 = key128(F.col("s"))
    return rows.select(k1.alias("k1"), k2.alias("k2"), "s").dropDuplicates(LINE)


def near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 of the distinct lines that have an earlier line within one edit."""
    keyed = distinct.select("k1", "k2", F.explode("halves").alias("h")).select("k1", "k2", "h.key", "h.role", "h.side")
    halves = cut(shared_only(keyed, "key").select("k1", "k2", "role", "side"), "line-halves")
    lines = distinct.join(halves.select(*LINE).distinct(), LINE, "left_semi").select("k1", "k2", "first")
    lines = cut(lines, "line-firsts")
    texts = cut(texts_of(docs, lines, id_col, text_col), "line-texts")
    rows = halves.join(texts, LINE).withColumn("m", F.length("s") - 1 + F.col("role"))
    # positions of the deleted character, counted in the longer text
    h = F.floor(F.col("m") / 2).cast("int")
    rows = rows.select("*", F.when(F.col("side") == 0, h + 1).otherwise(1).alias("lo"), F.when(F.col("side") == 0, F.col("m") + 1).otherwise(h).alias("hi"))
    rows = rows.withColumn("w", F.greatest(F.lit(16), F.ceil(F.sqrt(F.col("hi") - F.col("lo") + 1)).cast("int")))
    rows = rows.where("hi >= lo").select("*", F.explode(F.sequence("lo", "hi", "w")).alias("a"))
    rows = rows.withColumn("b", F.least(F.col("a") + F.col("w") - 1, F.col("hi")))
    before = F.substring(F.col("s"), F.lit(1), F.col("a") - 1)
    rows = rows.select("k1", "k2", "role", "m", "a", "b", F.xxhash64("m", "a", before, _after(F.col("s"), F.col("m"), F.col("b") - 1)).alias("key"))
    segments = cut(shared_only(rows, "key").drop("key"), "line-segments").join(texts, LINE)
    variant = lambda i: F.xxhash64(F.concat(F.substring(F.col("s"), F.lit(1), i - 1), F.substring(F.col("s"), i + 1, F.col("m"))))
    made = F.when(
        F.col("role") == 0, F.transform(F.sequence("a", "b"), lambda i: F.struct(variant(i).alias("v"), i.alias("at")))
    ).otherwise(F.array(F.struct(F.xxhash64("s").alias("v"), F.lit(0).alias("at"))))
    members = segments.select("k1", "k2", F.explode(made).alias("x")).select("k1", "k2", "x.v", "x.at").distinct()
    members = cut(members.join(lines, LINE), "line-variants")  # k1, k2, v, at (0: the line itself), first
    who = F.struct("first", "k1", "k2")
    changed = members.where("at > 0").groupBy("v", "at").agg(F.min(who).alias("lead"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    links = members.join(changed, ["v", "at"]).select("k1", "k2", "first", "lead")
    itself = members.where("at = 0").groupBy("v").agg(F.min(who).alias("lead"))
    links = links.unionByName(members.where("at > 0").join(itself, "v").select("k1", "k2", "first", "lead"))
    longer = members.where("at > 0").groupBy("v").agg(F.min(who).alias("lead"))
    links = links.unionByName(members.where("at = 0").join(longer, "v").select("k1", "k2", "first", "lead"))
    links = links.where(F.col("lead.first") < F.col("first")).select("k1", "k2", F.col("lead.k1").alias("o1"), F.col("lead.k2").alias("o2")).distinct()
    other = texts.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("s").alias("other"))
    checked = links.join(texts, LINE).join(other, ["o1", "o2"])
    return checked.where(F.levenshtein("s", "other", 1).between(0, 1)).select(*LINE).distinct()


def dropped_lines(
    docs: DataFrame, min_chars: int = 30, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None
) -> DataFrame:
    """doc_id and dropped (the numbers, from 0, of its lines to drop, ascending)."""
    rows = lines_of(docs, id_col, text_col, min_chars if exact_chars is None else min(exact_chars, min_chars))
    k1, k2 = key128(F.col("s"))
    halves = half_keys(F.col("s"), F.col("n"))
    if exact_chars is not None:
        halves = F.when(F.col("n") >= min_chars, halves)
    found = cut(rows.select("doc_id", "line_no", k1.alias("k1"), k2.alias("k2"), halves.alias("halves")), "line-rows")
    place = F.struct("doc_id", "line_no")
    distinct = found.groupBy(*LINE).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("halves").alias("halves"))
    distinct = cut(distinct, "line-distinct")
    near = near_lines(docs, distinct, id_col, text_col).withColumn("near", F.lit(True))
    marked = distinct.select("k1", "k2", "first", "last").join(near, LINE, "left").where("near or first < last")
    drops = found.select("doc_id", "line_no", "k1", "k2").join(marked.select("k1", "k2", "first", "near"), LINE)
    drops = drops.where(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "line_no") > F.col("first")))
    lists = drops.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    return cut(lists, "line-drops")


def dedup(
    docs: DataFrame, min_chars: int = 30, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None
) -> DataFrame:
    """``docs`` with the text without dropped lines, n_lines and n_dropped (long)."""
    added = ["n_lines", "n_dropped"]
    names = [c for c in docs.columns if c.lower() not in added]
    own, gone = free_name(docs, "id"), free_name(docs, "gone")
    lists = dropped_lines(docs, min_chars, id_col, text_col, exact_chars).select(F.col("doc_id").alias(own), F.col("dropped").alias(gone))
    rows = docs.join(lists.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col(own)), "left")
    text = F.col(f"`{text_col}`").cast("string")
    parts, dropped = F.split(text, "\n"), F.col(gone)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), dropped)
    kept = F.get(F.transform(F.array(parts), lambda all_: F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n")), F.lit(0))
    out = F.when(dropped.isNull(), text).otherwise(kept)
    cols = [out.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in names]
    n_lines, n_dropped = F.coalesce(F.size(parts), F.lit(0)), F.coalesce(F.size(dropped), F.lit(0))
    return rows.select(*cols, F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.greatest(n_dropped, F.lit(0)).cast("long").alias("n_dropped"))
