"""Exact tests at any size, and boot counts."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corvane.functions import gate
from corvane.operators import evaluation
from corvane.sources import policy as policies


def exact(b, c):
    n, k = b + c, min(b, c)
    term = total = 1
    for i in range(k):
        term = term * (n - i) // (i + 1)
        total += term
    return float(min(Fraction(1), Fraction(2 * total, 2**n)))


def test_mcnemar_equals_whole_number_sums(spark):
    pairs = [(6, 0), (2, 1), (500, 500), (501, 500), (900, 1100), (1001, 1001), (1001, 1002), (1002, 1100), (1001, 1300), (1500, 1400), (3000, 2500), (4000, 4100), (1001, 9000), (1200, 2600)]
    df = spark.createDataFrame(pairs, "b long, c long")
    for r in df.select("b", "c", evaluation.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect():
        assert r["p"] == pytest.approx(exact(r["b"], r["c"]), rel=1e-9, abs=1e-300), (r["b"], r["c"])


def test_mcnemar_of_a_billion_pairs(spark):
    """No array of that length, and close to the normal tail, which is good to 1/n there."""
    half = 500_000_000
    cases = [(half - d, half + d) for d in (0, 1, 10_000, 30_000, 60_000)] + [(3 * 10**12, 3 * 10**12 + 5_000_000), (1001, 10**9)]
    df = spark.createDataFrame(cases, "b long, c long")
    for r in df.select("b", "c", evaluation.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect():
        b, c = r["b"], r["c"]
        z = max(0, abs(b - c) - 1) / math.sqrt(b + c)
        assert r["p"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-5, abs=1e-300), (b, c)


def test_boot_counts(spark):
    rows = [("send", True, 2, [], {}, False), ("read", False, 0, [], {}, False)]
    policy = spark.createDataFrame(rows, policies.POLICY_ROW)
    calls = spark.createDataFrame([("send", 5), ("read", 2), ("odd", 1), (None, 3)], "tool string, calls long")
    assert gate.boot_counts(calls, policy).first().asDict() == {"tools": 4, "sinks": 1, "sink_calls": 5, "unregistered": 2}
    assert gate.boot_counts(calls.limit(0), policy).first().asDict() == {"tools": 0, "sinks": 0, "sink_calls": 0, "unregistered": 0}
