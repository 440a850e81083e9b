"""Connected components of a link table, without any driver-side state but counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut

#: Up to so many links (16 bytes each) are solved by one task; more go through star rounds.
ONE_TASK = 2_000_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of one task to the smallest node reachable from each."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # the roots of both ends sink to the lower root
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(links: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``links`` (a, b).

    Few links are solved in one task of bounded size, with the same result. Otherwise this
    alternates large-star and small-star steps: each node's larger (then smaller)
    neighbours are linked to its smallest neighbour, until nothing changes (which takes a
    number of rounds logarithmic in the nodes; more than ``max_rounds`` is an error). Every
    step is one aggregation and one join; its result is written to the shared folder.
    A node with very many neighbours only contributes its minimum to the join, and
    adaptive execution splits its rows.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_solve, "node long, component long")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        mark = after.agg(F.count("*"), F.sum("v"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        edges = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
