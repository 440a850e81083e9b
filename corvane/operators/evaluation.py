"""Ranking metrics and exact statistics as aggregations."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.store import cut

MIN_DISCORDANT = 6


class PairingError(ValueError):
    """Two result sets that do not cover the same keys."""


def score_queries(queries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """One row per query (query_id, relevant array) and its ranking (query_id, item, rank):
    recall, precision, rr, ndcg and hit at k; null where nothing is relevant."""
    if k <= 0:
        raise ValueError("k must be positive")
    n = F.size(F.array_distinct("relevant"))
    window = ranked.where(F.col("rank") <= k).join(queries.select("query_id", "relevant"), "query_id")
    window = window.select("query_id", "rank", "item", F.array_contains("relevant", F.col("item")).alias("rel"))
    gain = F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = window.groupBy("query_id").agg(
        F.count_if("rel").alias("hits"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"),
        (F.count("*") - F.countDistinct("item")).alias("_twice"),
    )
    rows = queries.select("query_id", n.alias("n_relevant")).join(per, "query_id", "left")
    rows = rows.withColumn("hits", F.when(F.coalesce("_twice", F.lit(0)) > 0, F.raise_error(F.lit("an item is ranked twice"))).otherwise(F.coalesce("hits", F.lit(0))))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_relevant")))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    some = lambda x: F.when(F.col("n_relevant") > 0, x)
    return rows.select(
        "query_id", "n_relevant", "hits",
        some(F.col("hits") / F.col("n_relevant")).alias("recall"), some(F.col("hits") / F.lit(k)).alias("precision"),
        some(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"), some(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        some((F.col("hits") > 0).cast("double")).alias("hit"),
    )


def summarize(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Macro-averages over the queries that have the metric, and how many have not."""
    metrics = ("recall", "precision", "rr", "ndcg", "hit")
    group = scores.groupBy(by) if by else scores.groupBy()
    return group.agg(F.count("*").alias("n_queries"), F.count_if(F.col("recall").isNull()).alias("n_undefined"), *[F.avg(m).alias(m) for m in metrics])


def z_for(confidence: float) -> float:
    """The two-sided critical value."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """low, high and rate; without trials 0, 1 and null."""
    z = z_for(confidence)
    n, s = trials.cast("double"), successes.cast("double")
    p = F.when(trials > 0, s / n)
    scale = 1 + F.lit(z * z) / n
    middle = (p + F.lit(z * z) / (2 * n)) / scale
    margin = F.lit(z) / scale * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    low = F.when(trials == 0, 0.0).when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - margin))
    high = F.when(trials == 0, 1.0).when(successes == trials, 1.0).otherwise(F.least(F.lit(1.0), middle + margin))
    return low, high, p


#: Up to so many pairs, or so many of the rarer kind, the binomial tail is summed term by term.
SUMMED = 1000
#: Nodes and weights on [0, 1] by which longer tails are integrated.
_NODES = [((x + 1) / 2, w / 2) for x, w in zip(*(v.tolist() for v in np.polynomial.legendre.leggauss(48)))]


def _binomial_log(n: Column, k: Column, more: Column) -> Column:
    """log of C(n, k) p^k q^(n-k), p = 1/2 + ``more``, for large k and n-k: by the distance from
    the mean, so that nothing large cancels."""
    error = lambda x: 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0)))  # noqa: E731  what Stirling's formula leaves of log x!
    off = (k - n / 2) - n * more
    far = -k * F.log1p(-off / k) - (n - k) * F.log1p(off / (n - k))
    return error(n) - error(k) - error(n - k) - far + F.ln(n / (2 * math.pi * k * (n - k))) / 2


def _binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins, k <= n/2, by the incomplete beta integral at 1/2 with parameters n-k and k+1.

    The integrand is a bell of the beta's deviation, or past its shoulder an exponential; what
    lies ten deviations, or forty e-folds, below 1/2 is nothing. So the work is the same at any size.
    """
    a, b = n - k, k + 1
    mean, deviation = a / (a + b), F.sqrt(a * b / (a + b + 1)) / (a + b)
    steep = (mean - 0.5) / deviation
    width = F.least(F.lit(0.499), deviation * F.least(F.lit(10.0), 40 / F.greatest(steep, F.lit(1.0))))
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _NODES])

    def density(below: Column) -> Column:
        return (n - k) / (0.5 - below) * F.exp(_binomial_log(n, k, below))

    return F.aggregate(nodes, F.lit(0.0), lambda total, node: total + node["w"] * density(width * node["x"])) * width


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of b and c discordant pairs; 1 without any.

    Twice the tail of a fair binomial: summed by the ratio of neighbouring terms while it is
    short, beyond ``SUMMED`` integrated. Memory and time are bounded whatever the counts.
    """
    n, least = (b + c).cast("double"), F.least(b, c)
    steps = F.sequence(F.lit(0), F.least(least, F.lit(SUMMED)).cast("int"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))
    step = lambda a, k: F.struct((a["total"] + a["term"]).alias("total"), (a["term"] * (n - k) / (k + 1)).alias("term"))
    small = F.aggregate(steps, start, step, lambda a: a["total"]) * F.pow(F.lit(2.0), 1 - n)
    # beyond a thousand pairs the terms are scaled down as they grow
    logs = F.aggregate(
        steps,
        F.struct(F.lit(float("-inf")).alias("total"), (-n * F.lit(math.log(2))).alias("term")),
        lambda a, k: F.struct(
            (F.greatest(a["total"], a["term"]) + F.log1p(F.exp(-F.abs(F.when(a["total"] == float("-inf"), F.lit(800.0)).otherwise(a["total"] - a["term"]))))).alias("total"),
            (a["term"] + F.ln((n - k) / (k + 1))).alias("term"),
        ),
        lambda a: F.exp(a["total"]) * 2,
    )
    tail = F.when(n <= SUMMED, small).when(least <= SUMMED, logs).otherwise(2 * _binomial_tail(n, least.cast("double")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail))


def mcnemar_statistic(b: Column, c: Column) -> Column:
    """Continuity-corrected chi-square; null without discordant pairs."""
    return F.when(b + c > 0, F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), 2) / (b + c))


def key_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """key and right_only of the keys that only one of two tables (key, ...) has."""
    left, right = a.select("key").distinct().withColumn("l", F.lit(True)), b.select("key").distinct().withColumn("r", F.lit(True))
    return left.join(right, "key", "full_outer").where("l is null or r is null").select("key", F.col("l").isNull().alias("right_only"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, a, b of two outcome tables (key, passed) that must cover the same keys."""
    odd = key_mismatches(a, b).orderBy("key")
    sample = odd.where("right_only").limit(3).unionByName(odd.where("not right_only").limit(3)).collect()
    if sample:
        raise PairingError("keys without a partner: " + ", ".join(str(r["key"]) for r in sample))
    return paired_where_both(a, b)


def paired_where_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, a, b of the keys that both tables have: for display, where a partial run is still shown."""
    return a.select("key", F.col("passed").alias("a")).join(b.select("key", F.col("passed").alias("b")), "key")


def p_floor(discordant: Column) -> Column:
    """The smallest p-value that so many discordant pairs can reach."""
    return F.least(F.lit(1.0), 2 * F.pow(F.lit(0.5), discordant))


def mean_or_none(flag: Column) -> Column:
    """Aggregate: the share of true values; null where there are none."""
    return F.avg(flag.cast("double"))


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """The complementary error function."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(v)).astype("float64")


#: Runs of letters, runs of digits, and any other visible or private character by itself.
TOKEN = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \\t\\r\\n]"


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def token_inflation(df: DataFrame, before: Column, after: Column, count: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """tokens_before, tokens_after and their ratio over all rows, by any counting function."""
    sums = df.agg(F.sum(count(before)).alias("tokens_before"), F.sum(count(after)).alias("tokens_after"))
    return sums.withColumn("ratio", F.try_divide("tokens_after", "tokens_before"))


def cluster_sums(pairs: DataFrame, order: str = "cluster") -> DataFrame:
    """cluster, n, sa, sb: pairs and successes of either side, and what clusters are numbered by."""
    yes = lambda c: F.sum(F.col(c).cast("int"))
    return pairs.groupBy("cluster").agg(F.count("*").alias("n"), yes("a").alias("sa"), yes("b").alias("sb"), F.min(order).alias("_o"))


def pair_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The 2 by 2 table of paired outcomes with rates, their difference and McNemar's test."""
    count = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    rows = pairs.groupBy(*(by or [])).agg(count(True, True).alias("both"), count(True, False).alias("only_a"), count(False, True).alias("only_b"), count(False, False).alias("neither"))
    n = F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")
    rows = rows.withColumn("n_pairs", n).withColumn("rate_a", F.try_divide(F.col("both") + F.col("only_a"), n)).withColumn("rate_b", F.try_divide(F.col("both") + F.col("only_b"), n))
    return (
        rows.withColumn("difference", F.col("rate_b") - F.col("rate_a"))
        .withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b")))
        .withColumn("statistic", mcnemar_statistic(F.col("only_a"), F.col("only_b")))
        .withColumn("underpowered", F.col("only_a") + F.col("only_b") < MIN_DISCORDANT)
    )


def cluster_of(key: Column) -> Column:
    return F.split_part(key, F.lit("::"), F.lit(1))


#: Kinds of cluster that one task holds, and how many blocks of them there are at most.
BLOCK_KINDS, BLOCKS = 4096, 1024
#: Replicates that one task draws, and numbers it holds of them at a time.
SLICE, HELD = 1000, 4_000_000


def cluster_kinds(sums: DataFrame) -> DataFrame:
    """n, sa, sb and times: how many clusters have these three sums.

    Such clusters are alike to a replicate, so only the times their kind is drawn matter:
    these are multinomial too, and their number does not grow with the clusters'.
    """
    return sums.groupBy("n", "sa", "sb").agg(F.count("*").alias("times"))


def block_draws(seed: int, part: int, weights: list[int], block: int, total: int, replicates: int) -> np.ndarray:
    """How many of each replicate's ``total`` draws fall on ``block``: a descent from all blocks to
    it, halving them, with binomial draws seeded by the node. Every task draws the same at a node."""
    low, high = 0, len(weights)
    drawn = np.full(replicates, total, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, both = sum(weights[low:middle]), sum(weights[low:high])
        taken = np.random.default_rng([seed, part, low, high]).binomial(drawn, left / both if both else 0.0)
        drawn, low, high = (taken, low, middle) if block < middle else (drawn - taken, middle, high)
    return drawn


def drawn_sums(kinds: DataFrame, resamples: int, seed: int, block_kinds: int = BLOCK_KINDS) -> DataFrame:
    """replicate, n, sa, sb: the sums over the clusters each replicate draws.

    Kinds lie in blocks. A task takes a block and a slice of the replicates, draws how often
    each kind occurs (a multinomial of the block's share) and emits one row of sums per
    replicate; so neither draws nor clusters are ever rows. Results depend on the seed and
    the kinds alone, not on partitions.
    """
    many = kinds.count()
    blocks = max(1, min(BLOCKS, -(-many // block_kinds)))
    placed = kinds.withColumn("block", F.pmod(F.xxhash64("n", "sa", "sb"), F.lit(blocks)).cast("int"))
    found = {r["block"]: r["w"] for r in placed.groupBy("block").agg(F.sum("times").alias("w")).collect()}
    weights = [int(found.get(k, 0)) for k in range(blocks)]
    total = sum(weights)

    def draw(key: tuple, group: pa.Table) -> pa.Table:
        part, block = (k.as_py() for k in key)
        rows = group.sort_by([("n", "ascending"), ("sa", "ascending"), ("sb", "ascending")])
        values = np.stack([rows.column(c).to_numpy() for c in ("n", "sa", "sb")], axis=1).astype(np.int64)
        times = rows.column("times").to_numpy().astype(np.float64)
        first = part * SLICE
        drawn = block_draws(seed, part, weights, block, total, min(SLICE, resamples - first))
        rng = np.random.default_rng([seed, part, block, len(weights), 1])
        step = max(1, HELD // len(times))
        out = np.concatenate([rng.multinomial(drawn[k : k + step], times / times.sum()) @ values for k in range(0, len(drawn), step)])
        return pa.table([pa.array(np.arange(first, first + len(drawn)), pa.int64()), *[pa.array(out[:, c]) for c in range(3)]], names=["replicate", "n", "sa", "sb"])

    parts = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // SLICE)))
    rows = placed.select(parts.alias("part"), "block", "n", "sa", "sb", "times")
    each = rows.groupBy("part", "block").applyInArrow(draw, "replicate long, n long, sa long, sb long")
    return each.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb")])


def serial_sums(sums: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The same with draws of Python's generator over clusters in order, for results that must
    agree with a serial program; it is meant for a few thousand draws."""
    from pyspark.sql import Window

    numbered = sums.withColumn("cluster_idx", F.row_number().over(Window.orderBy("_o", "cluster")) - 1)
    n, rng = sums.count(), random.Random(seed)
    rows = [(r, rng.randrange(n)) for r in range(resamples) for _ in range(n)]
    draws = sums.sparkSession.createDataFrame(rows, "replicate long, cluster_idx int")
    return draws.join(numbered, "cluster_idx").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb")])


def cluster_bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 0, confidence: float = 0.95, driver: bool = False, order: str = "cluster") -> DataFrame:
    """low, high, point of rate b - rate a, resampling clusters (cluster, a, b).

    Pairs collapse to three sums per cluster and clusters to their kinds, so the work grows
    with neither. ``driver`` draws as a serial program would (``serial_sums``).
    """
    sums = cluster_sums(pairs, order)
    point = sums.agg(((F.sum("sb") - F.sum("sa")) / F.sum("n")).alias("point"), F.count("*").cast("int").alias("n_clusters"), F.sum("n").alias("n_pairs"))
    if sums.isEmpty():
        return pairs.sparkSession.createDataFrame([(-1.0, 1.0, None, 0, 0)], "low double, high double, point double, n_clusters int, n_pairs long")
    drawn = serial_sums(sums, resamples, seed) if driver else drawn_sums(cut(cluster_kinds(sums), "cluster-kinds"), resamples, seed)
    values = drawn.select(((F.col("sb") - F.col("sa")) / F.col("n")).alias("d"))
    alpha = 1 - confidence
    ends = values.agg(F.percentile("d", F.lit(alpha / 2)).alias("low"), F.percentile("d", F.lit(1 - alpha / 2)).alias("high"))
    return ends.crossJoin(F.broadcast(point))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per metric, the paired table of two runs (metric, key, passed)."""
    key = lambda df: df.select(F.struct("metric", "key").alias("key"), "passed")
    return pair_counts(paired(key(a), key(b)).withColumn("metric", F.col("key.metric")), ["metric"])


def fingerprint(*parts: Column) -> Column:
    """Eight hex digits of a configuration's parts; null is not the empty string."""
    shown = [F.coalesce(p.cast("string"), F.lit("\x00None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *shown), 256), 1, 8)


def percent_text(low: Column, high: Column, rate: Column, s: Column, n: Column) -> Column:
    """``rate (s/n) 95% CI [lo%, hi%]`` with one decimal."""
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    return F.concat(F.coalesce(pct(rate), F.lit("n/a")), F.lit(" ("), s.cast("string"), F.lit("/"), n.cast("string"), F.lit(") 95% CI ["), pct(low), F.lit(", "), pct(high), F.lit("]"))
