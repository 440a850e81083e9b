"""Taint tracing in batch: which arguments of a call come from which tool outputs.

Events of a conversation are ordered by seq. An output event carries the
evidence a tool returned; a call event carries its arguments. A turn whose progress is
not above what was processed starts the conversation anew (its earlier records no
longer count). A call sees the outputs before it in its segment.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions import detect, spotlight
from corvane.functions.gate import ARG
from corvane.functions.lattice import UNTRUSTED, USER, union_in_order
from corvane.functions.text import normalise, needles

#: Adds signals, score, verdict and flags to a table, by its text column and the tools' names.
Detector = Callable[[DataFrame, str, tuple[str, ...]], DataFrame]
SEGMENT = ["conversation_id", "segment"]
USER_SOURCE, CONTEXT_ARG = "session://user-turn", "<conversation>"


def conversation_key(query, first):
    """sha256 of the request and, where there is one, the first user message."""
    return F.sha2(F.concat(query, F.coalesce(F.concat(F.lit("\x00"), first), F.lit(""))), 256)


def segments(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``turns`` (key, seq, progress, marks) with reset and segment (numbered from 1).

    A fold over each conversation's ordered turns: a turn resets where its progress is
    not above what the segment has processed; only marking turns move that forward. A
    conversation is one agent session, whose turns are bounded by the session.
    """
    kind = dict(turns.dtypes)[key]

    def fold(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("seq", "ascending"), ("progress", "ascending")])
        done, segment, resets, segments_ = 0, 0, [], []
        for progress, marks in zip(rows.column("progress").to_pylist(), rows.column("marks").to_pylist()):
            reset = segment == 0 or progress <= done
            if reset:
                done, segment = 0, segment + 1
            if marks:
                done = max(done, progress)
            resets.append(reset)
            segments_.append(segment)
        values = [rows.column(key), rows.column("seq").cast(pa.int64()), pa.array(resets, pa.bool_()), pa.array(segments_, pa.int32())]
        return pa.table(values, names=[key, "seq", "reset", "segment"])

    slim = turns.select(key, "seq", "progress", "marks")
    return slim.groupBy(key).applyInArrow(fold, f"`{key}` {kind}, seq long, reset boolean, segment int")


def segments_by_lag(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``segments`` where every turn marks: a turn resets unless it is above the one before,
    so two windows over one sort do, and a long conversation is not held in a task."""
    w = Window.partitionBy(key).orderBy("seq", "progress")
    before = F.lag("progress").over(w)
    marked = turns.withColumn("reset", before.isNull() | (F.col("progress") <= F.greatest(before, F.lit(0))))
    return marked.select(key, "seq", "reset", F.sum(F.col("reset").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("segment"))


def guard(outputs: DataFrame, tools: tuple[str, ...] = (), detector: Detector = detect.scan, assessor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tool outputs as records: scanned raw, untrusted, with the form they are matched in.

    ``detector`` adds flags to a table by its text column; ``assessor`` (a quarantined
    model) adds quarantine_flags from the column ``evidence``, and what it adds is kept
    whether it found an instruction or was unavailable.
    """
    scanned = detector(outputs, "evidence", tools)
    if assessor is not None:
        scanned = assessor(scanned).withColumn("flags", union_in_order(F.col("flags"), F.col("quarantine_flags")))
    source = F.concat(F.lit("tool:"), F.col("tool"))
    spans = ["spans"] if "spans" in outputs.columns else []
    return scanned.select("conversation_id", "segment", "seq", source.alias("source"), F.lit(UNTRUSTED).alias("tier"), "flags", normalise(F.col("evidence")).alias("norm"), *spans)


def rendered(records: DataFrame, style: str, nonce: Column, enabled: bool = True) -> DataFrame:
    """``records`` with each of their ``spans`` marked on its own: after scanning, never before."""
    return records.withColumn("spans", F.transform("spans", lambda s: spotlight.wrap(s, style, nonce, enabled=enabled)))


def unprocessed(messages: DataFrame) -> DataFrame:
    """The messages (position, processed) that were not guarded in an earlier turn."""
    return messages.where(F.col("position") > F.col("processed"))


def flags_seen(records: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the distinct flags raised there, in the order first seen."""
    each = records.select(*by, "seq", F.posexplode("flags").alias("pos", "flag")).groupBy(*by, "flag").agg(F.min(F.struct("seq", "pos")).alias("first"))
    found = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("first", "flag"))).alias("f")).select(*by, F.transform("f", lambda x: x["flag"]).alias("flags"))
    return records.select(*by).distinct().join(found, by, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def trace(decided: DataFrame) -> DataFrame:
    """One row per argument of each decided call: its tier, flags, sources and the codes raised on it."""
    rows = decided.select("conversation_id", "segment", "seq", "tool", "verdict", "violations", F.posexplode("args").alias("pos", "_arg"))
    codes = F.transform(F.filter("violations", lambda v: v["arg"] == F.col("_arg.name")), lambda v: v["code"])
    return rows.select("conversation_id", "segment", "seq", "tool", "verdict", "pos", F.col("_arg.name").alias("arg"), F.col("_arg.tier").alias("tier"), F.col("_arg.flags").alias("flags"), F.col("_arg.sources").alias("sources"), codes.alias("codes"))


def refusals(ledger: DataFrame) -> DataFrame:
    return ledger.where("action = 'refused'")


#: Outputs, and distinct needles, of a segment that meet in one automaton.
BLOCK_OUTPUTS, BLOCK_NEEDLES = 1_000, 50_000


def occurrences(wanted: DataFrame, records: DataFrame, most_outputs: int = BLOCK_OUTPUTS, most_needles: int = BLOCK_NEEDLES) -> DataFrame:
    """For each distinct needle (conversation_id, segment, needle) and each tier, flags and source of
    the records whose form holds it: the first of these (rseq).

    Needles of a segment become one automaton that passes over each output once, so outputs
    and needles are never paired. Large segments are cut in blocks of outputs, and of needles.
    """
    blocks = lambda rows, most, name: rows.groupBy(*SEGMENT).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    shape = blocks(wanted, most_needles, "nblocks").join(blocks(records, most_outputs, "oblocks"), SEGMENT)
    dealt = lambda of, n: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = wanted.join(shape, SEGMENT).withColumn("nblock", dealt(["needle"], "nblocks")).withColumn("block", all_of("oblocks"))
    held = records.join(shape, SEGMENT).withColumn("block", dealt(["seq", "norm"], "oblocks")).withColumn("nblock", all_of("nblocks"))
    key = [*SEGMENT, "block", "nblock"]
    out = wanted.select(*SEGMENT, "needle").schema.fields + held.select("tier", "flags", "source", F.col("seq").alias("rseq")).schema.fields

    def meet(needles_: pa.Table, outputs: pa.Table) -> pa.Table:
        import ahocorasick

        words, norms, automaton = needles_.column("needle").to_pylist(), outputs.column("norm").to_pylist(), ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(word, k)
        left, right = [], []
        if words:
            automaton.make_automaton()
            for at, norm in enumerate(norms):
                found = {k for _, k in automaton.iter(norm)} if norm else ()
                left.extend(found)
                right.extend([at] * len(found))
        mine, theirs = needles_.take(pa.array(left, pa.int64())), outputs.take(pa.array(right, pa.int64()))
        columns = [*[mine.column(c) for c in (*SEGMENT, "needle")], *[theirs.column(c) for c in ("tier", "flags", "source", "seq")]]
        return pa.table(columns, names=[f.name for f in out])

    # new names for the columns both sides have from the joins above
    asked = asked.select(*[F.col(c).alias(c) for c in (*key, "needle")])
    held = held.select(*[F.col(c).alias(c) for c in (*key, "tier", "flags", "source", "seq", "norm")])
    hits = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, StructType(out))
    return hits.groupBy(*SEGMENT, "needle", "tier", "flags", "source").agg(F.min("rseq").alias("rseq"))


def attribute(calls: DataFrame, records: DataFrame) -> DataFrame:
    """``calls`` (conversation_id, segment, seq, tool, args[name, value, is_string, leaves])
    with args that carry tier, flags and sources.

    Each distinct needle of a segment is looked for once; an argument then takes what its
    needles first occurred in, as far as that was before the call. That a record of the
    same tier, flags and source holds the needle again changes no union of them.
    """
    args = calls.select(*SEGMENT, "seq", F.posexplode("args").alias("pos", "arg"))
    asked = args.select(*SEGMENT, "seq", "pos", F.explode(F.array_distinct(needles(F.col("arg.leaves")))).alias("needle"))
    firsts = occurrences(asked.select(*SEGMENT, "needle").distinct(), records)
    hits = asked.join(firsts, [*SEGMENT, "needle"]).where(F.col("rseq") < F.col("seq"))
    found = hits.groupBy(*SEGMENT, "seq", "pos").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_set(F.struct("rseq", "flags", "source"))).alias("m"))
    joined = args.join(found, [*SEGMENT, "seq", "pos"], "left")
    traced = F.struct(
        F.col("arg.name").alias("name"), F.col("arg.value").alias("value"), F.col("arg.is_string").alias("is_string"),
        F.coalesce("tier", F.lit(USER)).alias("tier"),
        F.coalesce(F.array_distinct(F.flatten(F.transform("m", lambda x: x["flags"]))), F.array().cast("array<string>")).alias("flags"),
        F.coalesce(F.array_distinct(F.transform("m", lambda x: x["source"])), F.array(F.lit(USER_SOURCE))).alias("sources"),
    )
    rows = joined.groupBy(*SEGMENT, "seq").agg(F.array_sort(F.collect_list(F.struct("pos", traced.alias("a")))).alias("t"))
    rows = rows.select(*SEGMENT, "seq", F.transform("t", lambda x: x["a"]).alias("args"))
    base = calls.drop("args").join(rows, [*SEGMENT, "seq"], "left")
    return base.withColumn("args", F.coalesce("args", F.array().cast(f"array<{ARG}>")))


def with_context(calls: DataFrame, records: DataFrame) -> DataFrame:
    """Side-effecting calls without arguments get the whole conversation as their argument."""
    seen = calls.select("conversation_id", "segment", "seq").join(records.select("conversation_id", "segment", F.col("seq").alias("rseq"), "tier", "flags", "source"), ["conversation_id", "segment"])
    seen = seen.where("rseq < seq").groupBy("conversation_id", "segment", "seq").agg(F.min("tier").alias("_tier"), F.array_sort(F.collect_list(F.struct("rseq", "flags", "source"))).alias("_m"))
    df = calls.join(seen, ["conversation_id", "segment", "seq"], "left")
    whole = F.struct(
        F.lit(CONTEXT_ARG).alias("name"), F.lit(CONTEXT_ARG).alias("value"), F.lit(True).alias("is_string"), F.col("_tier").alias("tier"),
        F.array_distinct(F.flatten(F.transform("_m", lambda x: x["flags"]))).alias("flags"), F.array_distinct(F.transform("_m", lambda x: x["source"])).alias("sources"),
    )
    bare = (F.size("args") == 0) & F.coalesce(F.col("policy.side_effecting"), F.lit(False)) & F.col("_tier").isNotNull()
    return df.withColumn("args", F.when(bare, F.array(whole)).otherwise(F.col("args"))).drop("_tier", "_m")


def ledger_pivot(ledger: DataFrame) -> DataFrame:
    """Counts by tool of verdicts and actions."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return ledger.groupBy("tool").agg(count("verdict", "allow"), count("verdict", "confirm"), count("verdict", "deny"), count("action", "executed"), count("action", "refused"))
