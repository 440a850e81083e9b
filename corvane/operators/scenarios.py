"""Expectations held against what the gate did: one row per scenario, with every mismatch.

A table of expectations says what must become of a keyed call: whether it is refused, the
codes raised (in order, repeats included), the arguments found tainted, the verdict on
what was read. An expectation that is null is not held against anything. A scenario fails
too where nothing, or more than one thing, happened under its key, or where it is told
twice; calls without an expectation come out as failures of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What can be expected, and the outcome's column it is held against.
CHECKS = {"refused": "boolean", "codes": "array<string>", "tainted": "array<string>", "detection": "string"}


def outcomes(acted: DataFrame, key: list[str], detection: Column | None = None) -> DataFrame:
    """``key`` and the observed values of calls that were decided and acted on."""
    seen = F.lit(None).cast("string") if detection is None else detection
    return acted.select(*key, (F.col("action") == "refused").alias("refused"), "codes", F.col("tainted_args").alias("tainted"), seen.alias("detection"))


def _told(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, with how many there were; columns that are not there are null."""
    values = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in CHECKS.items()]
    rows = df.select(*key, F.struct(*values).alias("v"))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))


def _text(value: Column, kind: str) -> Column:
    shown = F.concat(F.lit("["), F.array_join(value, ", "), F.lit("]")) if kind.startswith("array") else value.cast("string")
    return F.coalesce(shown, F.lit("nothing"))


def verify(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """``key``, passed and mismatches. Keys that are null in both tables meet."""
    told, seen = _told(expected, key).alias("e"), _told(observed, key).alias("o")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}"))
    rows = told.join(seen, same, "full")
    found = [
        F.when(F.col("e.n").isNull(), "no expectation"),
        F.when(F.col("e.n") > 1, F.concat(F.lit("told "), F.col("e.n").cast("string"), F.lit(" times"))),
        F.when(F.col("o.n").isNull(), "no outcome"),
        F.when(F.col("o.n") > 1, F.concat(F.col("o.n").cast("string"), F.lit(" outcomes"))),
    ]
    for c, kind in CHECKS.items():
        want, got = F.col(f"e.v.{c}"), F.col(f"o.v.{c}")
        differs = (F.col("e.n") == 1) & (F.col("o.n") == 1) & want.isNotNull() & ~want.eqNullSafe(got)
        found.append(F.when(differs, F.concat(F.lit(f"{c}: expected "), _text(want, kind), F.lit(", got "), _text(got, kind))))
    names = [F.coalesce(F.col(f"e.{c}"), F.col(f"o.{c}")).alias(c) for c in key]
    return rows.select(*names, F.array_compact(F.array(*found)).alias("mismatches")).withColumn("passed", F.size("mismatches") == 0)
