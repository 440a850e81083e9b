"""Sharding by a K-d tree over document metadata.

Documents with equal texts form one item that is never split. Items carry a weight
(the bytes of all their rows) and a point of metadata coordinates. Starting from
one node, every node that still stands for several shards is cut along its widest
dimension at the distributed weighted median (the weighted quantile, where the
shard counts of its halves differ), until each leaf is one shard of the target size
(all bytes over the wanted shards). A last repair moves single items from leaves above
that size to leaves below it.

Scale: texts are read once; what moves is one narrow row per document. A weighted
quantile is found by narrowing histograms: each pass adds weights by (node, bin) on
the executors and sends at most ``BINS`` rows per node to the driver, whatever the
input's size. Slots are numbered within salted buckets of a shard, so no task holds
a whole shard.

The number of shards is configuration; per shard the driver also sees up to ``MOVABLE``
items of the repair, and tasks get one row per node and per moved item.

Defined cases: a null text counts as an empty one (and shares its shard); a very long
text is one item like any other; repeated rows get a slot each (equal ids in any order);
a null id sorts first and counts as 0 in the tree; a null metadata value is a value of its
own, a missing column is no dimension; an empty table gives an empty result; an item
heavier than a shard fills one alone; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import cut, key128

BINS = 1024
#: Spans of up to so many items are told apart by exact coordinates.
FEW = 256
#: A coordinate has 32 bits of position and 20 bits of hash, which parts ties.
POSITION, JITTER = 1 << 32, 1 << 20
#: Rows of one numbering bucket, on average.
BUCKET_ROWS = 20_000
#: Items of a shard that the repair may move, and by how much it may lift one above the mean.
MOVABLE, TOLERANCE = 64, 0.0005


def coordinates(items: DataFrame, raw: list[str]) -> DataFrame:
    """``raw`` (long) columns as ``x``: positions in the table's extent, ties parted by the hash ``k1``."""
    ends = items.agg(*[f(c).alias(f"{n}_{c}") for c in raw for n, f in (("lo", F.min), ("hi", F.max))]).first()
    jitter = F.pmod(F.col("k1"), F.lit(JITTER))
    x = []
    for c in raw:
        lo, hi = ends[f"lo_{c}"] or 0, ends[f"hi_{c}"] or 0
        place = F.floor((F.col(c) - F.lit(lo)).cast("double") * F.lit((POSITION - 1) / max(hi - lo, 1)))
        x.append(place.cast("long") * JITTER + jitter)
    return items.select("k1", "k2", "weight", F.array(*x).alias("x"), F.lit(0).cast("long").alias("node"))


def with_node(items: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """``items`` of the given nodes joined to one parameter row per node (at most a row per shard)."""
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"{v}L" for v in r) + ")" for r in rows)
    few = items.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(node, {names})")
    return items.join(F.broadcast(few), "node")


def quantiles(items: DataFrame, wanted: dict[int, tuple[int, int, int, int, float, float]]) -> dict[int, int]:
    """For each node the coordinate that parts its weight best at the wanted amount.

    wanted: node to (dimension, lowest, highest, items, weight of the left part, of all).
    A span of many items is cut into bins of equal width; the one where the wanted
    weight is reached is searched further, until it holds few items, which are then
    told apart by their exact coordinates.
    """
    spans = {n: (lo, hi + 1, count, 0.0) for n, (_, lo, hi, count, _, _) in wanted.items()}
    found: dict[int, int] = {}
    while spans:
        steps = {n: 1 if k <= FEW else max(1, math.ceil((hi - lo) / BINS)) for n, (lo, hi, k, _) in spans.items()}
        asked = [(n, wanted[n][0], lo, hi, steps[n]) for n, (lo, hi, _, _) in spans.items()]
        rows = (
            with_node(items, asked, "dim, lo, hi, step")
            .withColumn("v", F.get("x", F.col("dim").cast("int")))
            .where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
            .groupBy("node", F.expr("(v - lo) div step").alias("bin"))
            .agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
            .collect()
        )
        counts: dict[int, dict[int, tuple[float, int]]] = {n: {} for n in spans}
        for r in rows:
            counts[r["node"]][int(r["bin"])] = (float(r["w"]), r["n"])
        left = {}
        for n, (lo, hi, _, before) in spans.items():
            target = wanted[n][4]
            at = before
            for b in sorted(counts[n]):
                w, k = counts[n][b]
                if at + w >= target:
                    start = lo + b * steps[n]
                    if steps[n] == 1:
                        found[n] = start if target - at < at + w - target else start + 1
                    else:
                        left[n] = (start, min(hi, start + steps[n]), k, at)
                    break
                at += w
            else:
                found[n] = hi
        spans = left
    return found


def grow(items: DataFrame, n_dims: int, n_shards: int) -> DataFrame:
    """``items`` (weight, x, node 0) with their leaf as ``shard``."""
    leaves = {0: (0, n_shards)}  # node to its first shard and number of shards
    items = cut(items, "shard-nodes")
    while any(n > 1 for _, n in leaves.values()):
        ends = items.groupBy("node").agg(
            F.sum("weight").alias("w"),
            F.count("*").alias("n"),
            *[f(F.get("x", F.lit(d))).alias(f"{n}{d}") for d in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))],
        )
        wanted = {}
        for r in ends.collect():
            n = leaves[r["node"]][1]
            if n > 1:
                widest = max(range(n_dims), key=lambda d: r[f"hi{d}"] - r[f"lo{d}"])
                w = float(r["w"])
                wanted[r["node"]] = (widest, r[f"lo{widest}"], r[f"hi{widest}"], r["n"], w * (n // 2) / n, w)
        at = quantiles(items, wanted)
        after, moves = {}, []
        fresh = max(leaves) + 1
        for k, (first, n) in leaves.items():
            if n == 1:
                after[k] = (first, n)
                moves.append((k, 0, None, k, k))
            else:
                after[fresh], after[fresh + 1] = (first, n // 2), (first + n // 2, n - n // 2)
                moves.append((k, wanted[k][0] if k in at else 0, at.get(k), fresh, fresh + 1))
                fresh += 2
        moved = with_node(items, moves, "dim, at, below, above").select(
            "k1", "k2", "weight", "x", F.when(F.get("x", F.col("dim").cast("int")) < F.col("at"), F.col("below")).otherwise(F.col("above")).alias("node")
        )
        items = cut(moved, "shard-nodes")
        leaves = after
    return with_node(items, [(k, first) for k, (first, _) in leaves.items()], "shard")


def repair(items: DataFrame, n_shards: int) -> DataFrame:
    """``items`` (k1, k2, weight, shard) with some moved, so that shards come closer to their mean.

    The driver sees each shard's weight and at most ``MOVABLE`` of the items that a shard
    above the mean could give away (none heavier than its excess), and moves the largest that fits from the
    heaviest shard to the lightest as long as that brings them closer.
    """
    weights = {k: 0.0 for k in range(n_shards)}
    weights.update({r["shard"]: float(r["w"]) for r in items.groupBy("shard").agg(F.sum("weight").alias("w")).collect()})
    mean = sum(weights.values()) / n_shards
    over = [(k, math.ceil(w - mean)) for k, w in weights.items() if w > mean]
    if not over:
        return items
    excess = items.sparkSession.createDataFrame(over, "shard int, excess long")
    fits = items.join(F.broadcast(excess), "shard").where("weight <= excess")
    turn = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("k1"), "k2"))
    rows = fits.withColumn("n", turn).where(F.col("n") <= MOVABLE).select("k1", "k2", "weight", "shard").collect()
    gifts: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (-r["weight"], r["k1"], r["k2"])):
        gifts.setdefault(r["shard"], []).append(r)
    heap = [(w, k) for k, w in weights.items()]
    heapq.heapify(heap)
    moves = []
    for k, _ in sorted(over, key=lambda x: -x[1]):
        for r in gifts.get(k, []):
            w, light = heap[0]
            if light != k and r["weight"] <= weights[k] - mean and w + r["weight"] <= mean + TOLERANCE * mean:
                heapq.heapreplace(heap, (w + r["weight"], light))
                weights[light] = w + r["weight"]
                weights[k] -= r["weight"]
                moves.append((r["k1"], r["k2"], light))
    if not moves:
        return items
    moved = items.sparkSession.createDataFrame(moves, "k1 long, k2 long, to int")
    return items.join(F.broadcast(moved), ["k1", "k2"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")


def number(rows: DataFrame, n_rows: int, n_shards: int, order: str) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, numbered bucket by bucket."""
    buckets = max(1, math.ceil(n_rows / (n_shards * BUCKET_ROWS)))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy(order))
    if buckets == 1:
        return rows.withColumn("slot", (inside - 1).cast("long")).drop("_b")
    w = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_b").count()
    starts = counts.select("shard", "_b", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_in", inside - 1)
    return placed.join(starts, ["shard", "_b"]).withColumn("slot", F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard and slot; sizes near equal.

    Dimensions: the smallest id of an item, its text's length, and the ``metadata``
    columns (equal values share a coordinate).
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    present = [c for c in metadata if c in docs.columns]
    k1, k2 = key128(text)
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        k1.alias("k1"),
        k2.alias("k2"),
        *[F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(JITTER)).alias(f"m_{c}") for c in present],
    )
    slim = cut(slim, "shard-docs")
    raw = ["first", "length", *[f"m_{c}" for c in present]]
    items = slim.groupBy("k1", "k2").agg(
        F.sum("size").alias("weight"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("long").alias("first"),
        F.max("size").alias("length"),
        *[F.min(f"m_{c}").alias(f"m_{c}") for c in present],
    )
    items = cut(items, "shard-items")
    placed = grow(coordinates(items, raw), len(raw), n_shards)
    placed = repair(placed.select("k1", "k2", "weight", F.col("shard").cast("int").alias("shard")), n_shards)
    rows = slim.select("doc_id", "size", "text_crc32", "k1", "k2").join(placed.select("k1", "k2", "shard"), ["k1", "k2"])
    return number(rows.drop("k1", "k2"), slim.count(), n_shards, "doc_id")
