"""Nearest neighbours by a block matrix join in int8 with error bounds.

Query rows and candidate rows are dealt to blocks of bounded size; each pair of a
query block and a candidate block is one tile. In a tile, unit vectors are quantised
to int8 per vector, one matrix product gives approximate cosines, and the norms of
the quantisation residuals bound each one's error. Only pairs whose upper bound
reaches the k-th best lower bound are computed in double precision on the original
vectors. A tile keeps each query's k best; these short lists are merged by Spark's
rank-limited window, which keeps the k best in every task before anything moves.

The result is exact: a pruned pair cannot be among the k best. Equal vectors get
equal scores (each pair is computed by the same sequence of operations).

Scale: the work is queries times candidates, the part each tile holds is bounded
(``QUERY_BLOCK`` by ``ROW_BLOCK`` rows), nothing is broadcast, and a hot vector is
just more rows: blocks are dealt by a hash of the id. A row is copied once per block of
queries and a query once per block of rows, so query blocks are the larger ones.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; only vectors of equal length are compared; no row with the
query's own id is returned to it; rows that repeat an id and a vector count once; an id
with several vectors counts once, with the best score of any (as query: of any of its
vectors); equal scores go by the smaller id; an empty table, or one whose vector column
has no type, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import cut

QUERY_BLOCK, ROW_BLOCK = 16_384, 8192
PARTIAL = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(f"`{vec_col}`").cast("array<double>")
    df = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    return df.where(fine).distinct()


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and scales of the unit vectors, and the norms of what is lost."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - code * scale[:, None]
    return code, scale, np.sqrt((lost * lost).sum(axis=1))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision on the original vectors, summed from the first
    component to the last."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        dot += x * y
        aa += x * x
        bb += y * y
    return np.clip(dot / (np.sqrt(aa) * np.sqrt(bb)), -1, 1)


def tile(k: int):
    """A function from a tile's query and candidate rows to each query's k best."""

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not rows.num_rows:
            return empty
        qid, q = _matrix(queries)
        cid, c = _matrix(rows)
        by_id = np.argsort(cid, kind="stable")
        cid, c = cid[by_id], c[by_id]
        new_id = np.flatnonzero(np.append(True, cid[1:] != cid[:-1]))  # an id's rows count once for the k-th bound
        qc, qs, qe = _quantise(q)
        cc, cs, ce = _quantise(c)
        cf = cc.astype(np.float32).T  # products of int8 codes are whole numbers below 2^24: exact in float32
        found_q, found_c, found_s = [], [], []
        for at in range(0, len(qid), 128):
            part = slice(at, at + 128)
            rough = (qc[part].astype(np.float32) @ cf) * (qs[part, None] * cs[None, :])
            slack = qe[part, None] + ce[None, :] + qe[part, None] * ce[None, :] + 1e-9
            own = qid[part, None] == cid[None, :]
            low = np.maximum.reduceat(np.where(own, -np.inf, rough - slack), new_id, axis=1)
            kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
            i, j = np.nonzero((rough + slack >= kth[:, None]) & ~own)
            score = np.concatenate([exact_cosine(q[part][i[b : b + 65536]], c[j[b : b + 65536]]) for b in range(0, len(i), 65536)] or [np.empty(0)])
            order = np.lexsort((cid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            _, once = np.unique(np.stack([i, cid[j]]), axis=1, return_index=True) if len(i) else (None, np.empty(0, np.int64))
            once.sort()  # the first, that is the best, of each query and id
            i, j, score = i[once], j[once], score[once]
            first = np.searchsorted(i, i)  # where the query's run begins
            keep = np.arange(len(i)) - first < k
            found_q.append(qid[part][i[keep]])
            found_c.append(cid[j[keep]])
            found_s.append(score[keep])
        return pa.table({"query_id": np.concatenate(found_q), "vec_id": np.concatenate(found_c), "score": np.concatenate(found_s)})

    return best


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Each query's k nearest rows by cosine: query_id, rank (from 1), vec_id, score."""
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    rows, asked = cut(rows, "search-rows"), cut(asked, "search-queries")
    n_row_blocks = max(1, math.ceil(rows.count() / ROW_BLOCK))
    n_query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("vec_id", "v", F.size("v").alias("dim"), block(n_row_blocks, "row").alias("rb"), every(n_query_blocks).alias("qb"))
    asked = asked.select("vec_id", "v", F.size("v").alias("dim"), block(n_query_blocks, "query").alias("qb"), every(n_row_blocks).alias("rb"))
    tiles = asked.groupBy("dim", "qb", "rb").cogroup(rows.groupBy("dim", "qb", "rb")).applyInArrow(tile(k), PARTIAL)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = tiles.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
