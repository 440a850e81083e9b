"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

A document's set holds its distinct five-word shingles. ``FUNCTIONS`` minwise tokens
(the smallest shingle hash under each of that many hash functions) represent it. In
each of ``trees`` independent trees the documents start at the root; a node branches
its documents by the minwise token at one or two positions that a hash of the node
chooses, so that two documents at the threshold share a little more than one branch
per level on average. A node with at most ``small`` documents is compared exhaustively;
a larger one links its documents to two pivots and is branched further.

In a small node all pairs are held against sizes and sketches (four bits of each token).
What hangs together by the pairs left is a candidate group; the same group in several
nodes and trees counts once. Groups are confirmed on full sets inside one task each, so
no table of pairs is ever made and a group sends at most a spanning forest of links.
First each document is compared in its largest group, which settles most; then in
the groups of pairs that were not held together so far, if they still join different
components. Large nodes link documents to pivots. If they then hold more than one
component (what is of one component has nothing left to find), nodes of up to
``medium`` documents, and all nodes at ``depth``, are compared exhaustively too, in
blocks dealt to many tasks; larger ones are followed down, ``levels`` levels a round.

Scale: texts are read once for sketches and once more for the documents with a
candidate; equal sets are one class throughout; nodes with one document drop out level
by level; no large node's documents are gathered in one task; what a round makes is
bounded by documents times nodes, not by pairs. Components are computed on tables (see
graph.py).

Recall: a pair at the threshold meets in a first-level node of a tree with probability
0.89. All trees choose among the same 128 tokens; averaged over how many of them agree,
twelve trees miss such a pair with probability 10^-9 where its nodes are small at
once. Deeper nodes hold it with less: about 0.6 per tree after nine levels, 0.46 at any
depth, so that twelve trees miss it with about 0.001 at the threshold if its nodes never
get small, and far more rarely at higher similarity; another document linked with both
makes up for a missed pair. The sketches' test loses a pair at the threshold with a
probability of 4 in a million (4.5 deviations).

Defined cases: null, empty and blank texts have an empty set and are linked with
nothing; a text of fewer than five words is one shingle; a very long text is one set
like any other (about 8 bytes a word, whole in one task); texts with equal sets tie and
keep the smallest id; rows that repeat an id are one document, linked by any of its
texts; a null id is a component of its own (null), kept; an empty table gives an empty
result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.graph import components
from corvane.llm.shared import beside, cut, free_name

FUNCTIONS = 128
SHINGLE = 5
#: Distinct words whose hashes a Python worker remembers.
REMEMBERED = 1_000_000
#: A pair is held against its sets unless its sketches agree less than this many
#: standard deviations below what is expected at the threshold.
DEVIATIONS = 4.5


@dataclass(frozen=True)
class NearDedup:
    percent: int = 85
    trees: int = 12
    levels: int = 2
    depth: int = 21
    small: int = 1024
    block: int = 512
    medium: int = 4096
    seed: int = 1

    def chance(self, level: int) -> float:
        """How often a node branches twice: at the threshold two documents share a little
        more than one branch per level, so that trees hold them at any depth."""
        return min(1.0, (105 if level else 110) / self.percent - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEN = np.random.default_rng(20240501)
_MUL = _GEN.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _GEN.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Words to their 64-bit hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self) -> None:
        self.hash = _Hashes().__getitem__

    def of(self, text: str | None) -> np.ndarray:
        return self.all([text])[0]

    def all(self, texts: list[str | None]) -> list[np.ndarray]:
        # bytes: only A-Z and ASCII white space count
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sizes = [len(w) for w in words]
        h = np.fromiter((x for w in words for x in map(self.hash, w)), np.uint64, sum(sizes))
        n = max(len(h) - SHINGLE + 1, 0)
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total = _mix(total + h[k : k + n] * _BASE[k])
        out, at = [], 0
        for size in sizes:
            if size >= SHINGLE:
                out.append(np.unique(total[at : at + size - SHINGLE + 1]))
            elif size:
                one = np.zeros(1, np.uint64)
                for k in range(size):
                    one = _mix(one + h[at + k : at + k + 1] * _BASE[k])
                out.append(one + np.uint64(size))
            else:
                out.append(np.empty(0, np.uint64))
            at += size
        return out


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in slices of about ``most`` characters of text, so that long texts are not held together."""
    texts, start, size = [], 0, 0
    for k, value in enumerate(batch.column(column)):
        text = value.as_py()
        if texts and size + len(text or "") > most:
            yield batch.slice(start, k - start), texts
            texts, start, size = [], k, 0
        texts.append(text)
        size += len(text or "")
    if texts:
        yield batch.slice(start), texts


def minwise(shingles: np.ndarray) -> np.ndarray:
    """FUNCTIONS minwise tokens of 32 bits: the top halves of odd multiples, modulo 2^64."""
    best = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        values = ((shingles[None, at : at + 4096] * _MUL[:, None]) >> np.uint64(32)).min(axis=1)
        best = np.minimum(best, values)
    return best.astype(np.uint32)


def _branches(node: np.ndarray, sig: np.ndarray, chance: float, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and children: each node chooses one position, or by ``chance`` two."""
    h = _mix(node.astype(np.uint64) + np.uint64(level * 0x9E3779B9))
    rows, kids = [], []
    for k in range(2):
        p = ((h >> np.uint64(8 + 16 * k)) % np.uint64(FUNCTIONS)).astype(np.int64)
        token = sig[np.arange(len(node)), p].astype(np.uint64)
        child = _mix(_mix(h + np.uint64(k + 1)) ^ (token * np.uint64(0x9E3779B97F4A7C15)))
        take = np.full(len(node), True) if k == 0 else (_mix(h) % np.uint64(10_000)).astype(np.int64) < chance * 10_000
        rows.append(np.nonzero(take)[0])
        kids.append(child[take])
    return np.concatenate(rows), np.concatenate(kids).view(np.int64)


def _fingerprint(data: bytes) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63), xxhash.xxh64_intdigest(data, 7) - (1 << 63)


def _sketcher(cfg: NearDedup):
    """Batches of (doc_id, text) to sketches; ``roots`` are the first nodes of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        start = _mix(np.arange(cfg.trees, dtype=np.uint64) + np.uint64(cfg.seed * 1000))
        for whole in batches:
            for batch, texts in slices(whole):
                sets = shingler.all(texts)
                n = np.array([len(s) for s in sets], np.int64)
                f1, f2 = zip(*[_fingerprint(s.tobytes()) for s in sets])
                sig = np.stack([minwise(s) if len(s) else np.zeros(FUNCTIONS, np.uint32) for s in sets])
                four = (_mix(sig.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
                bits = np.ascontiguousarray(four[:, ::2] << 4 | four[:, 1::2]).view(np.int64)
                rows, kids = _branches(np.tile(start, len(sets)), np.repeat(sig, cfg.trees, axis=0), cfg.chance(0), 0)
                rows = rows // cfg.trees
                order = np.argsort(rows, kind="stable")[n[np.sort(rows)] > 0]
                ends = np.append(0, np.cumsum(np.bincount(rows[order], minlength=len(sets)))).astype(np.int32)
                width = np.arange(len(sets) + 1, dtype=np.int32) * bits.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), *[pa.array(x, pa.int64()) for x in (n, f1, f2)], pa.ListArray.from_arrays(width, bits.ravel()),
                        pa.ListArray.from_arrays(ends, kids[order]), pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bits", "roots", "sig"],
                )

    return run


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, bits array<long>, roots array<long>, sig binary"


def _descend(cfg: NearDedup, level: int):
    """Batches of (doc_id, node, sig) to (doc_id, node) so many levels below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), FUNCTIONS)
            node, at = pdf["node"].to_numpy().view(np.uint64), np.arange(len(pdf))
            for k in range(cfg.levels):
                rows, kids = _branches(node, sig[at], cfg.chance(level + k), level + k)
                node, at = kids.view(np.uint64), at[rows]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at], "node": node.view(np.int64)})

    return run


def _nodes(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Members of the nodes with two documents or more: node, doc_id, what ``about`` has, members, pivots."""
    rows = cut(rows.distinct(), "near-nodes")
    sizes = rows.groupBy("node").agg(F.count("*").alias("members"), F.min("doc_id").alias("pivot"), F.min_by("doc_id", F.xxhash64("doc_id", "node")).alias("pivot2"))
    return cut(rows.join(sizes.where("members > 1"), "node").join(about, "doc_id"), "near-members")


def _least_agreement(cfg: NearDedup) -> int:
    """Four-bit tokens that a pair at the threshold has in common, less the deviations."""
    p = cfg.percent / 100 + (1 - cfg.percent / 100) / 16
    return int(FUNCTIONS * p - DEVIATIONS * (FUNCTIONS * p * (1 - p)) ** 0.5)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many four-bit tokens agree, row by row, of sketches with sixteen of them a word."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(~x & np.uint64(0x1111111111111111)).sum(axis=1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with by the links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, dealt anew so that no group is split."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        keys = t.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield t.slice(0, last)
        held = t.slice(last)
    if held is not None:
        yield held


def _candidates(cfg: NearDedup):
    """Rows of small nodes, sorted by node, to groups of documents worth a full comparison.

    Inside a node all pairs of different labels that no earlier group (``own``) held
    together are held against sizes and sketches; what hangs together by the pairs left
    is a group, whose key is a hash of its documents: the same group found in other
    nodes and trees is one.
    """
    least = _least_agreement(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "node"):
            node, doc, n, label = (t.column(c).to_numpy() for c in ("node", "doc_id", "n_shingles", "label"))
            bits, own = (t.column(c).combine_chunks().flatten().to_numpy().reshape(len(node), -1) for c in ("bits", "own"))
            bits = bits.view(np.uint64)
            left, right = [], []
            for d in range(1, len(node)):
                i = np.nonzero(node[d:] == node[:-d])[0]
                if not len(i):
                    break
                j = i + d
                fits = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * cfg.percent) & (label[i] != label[j])
                fits &= ~(own[i] == own[j]).any(axis=1)
                i, j = i[fits], j[fits]
                for at in range(0, len(i), 1 << 18):
                    p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                    good = _agreement(bits[p], bits[q]) >= least
                    left.append(p[good])
                    right.append(q[good])
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            root = _roots(len(node), a, b)
            rows = np.unique(np.concatenate([a, b]))
            group, at, size = np.unique(root[rows], return_inverse=True, return_counts=True)
            total = np.zeros(len(group), np.uint64)
            np.add.at(total, at, _mix(doc[rows].view(np.uint64) + np.uint64(77)))
            values = [node[rows], doc[rows], _mix(total)[at].view(np.int64), size[at].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["node", "doc_id", "key", "size"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part, texts in slices(batch):
            sets = [s.tobytes() for s in shingler.all(texts)]
            f1, f2 = zip(*[_fingerprint(x) for x in sets])
            values = [part.column(0), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "f1", "f2", "shingles"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets share.

    Elements of all sets are counted once; those of one set alone do not count; the rest
    is a product of 0/1 matrices, taken in slices of bounded size.
    """
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(first) - 1
    often = np.diff(np.append(np.nonzero(first)[0], len(values)))
    out = np.full((n, n), float((often == n).sum()))
    some = (often > 1) & (often < n)
    number = np.cumsum(some) - 1
    use = some[column]
    column, owner = number[column[use]], owner[use]
    width = max(1024, (1 << 22) // n)
    ends = np.searchsorted(column, np.arange(0, int(some.sum()) + width, width))
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - k * width] = 1
        out += m @ m.T
    return out


def spanning(of: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links i, j that are enough to connect what all of them connect; ``of``: what a row stands for."""
    parent = list(range(int(of.max()) + 1)) if len(of) else []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    pairs, first = np.unique(np.stack([of[i], of[j]]), axis=1, return_index=True) if len(i) else (np.empty((2, 0), int), [])
    for a, b, k in zip(*pairs.tolist(), np.asarray(first).tolist()):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return i[keep], j[keep]


def _compare(percent: int):
    """Groups (key, doc_id, label, shingles), sorted by key, to links that span what full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "key"):
            key, doc, label = (t.column(c).to_numpy() for c in ("key", "doc_id", "label"))
            raw = t.column("shingles").combine_chunks()
            out_a, out_b = [], []
            ends = np.append(np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key))
            for lo, hi in zip(ends[:-1], ends[1:]):
                if hi - lo < 2 or (label[lo:hi] == label[lo]).all():
                    continue
                sets = [np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in range(lo, hi)]
                both, size = common(sets), np.array([len(s) for s in sets], float)
                i, j = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
                _, at = np.unique(label[lo:hi], return_inverse=True)  # what has one label is linked already
                i, j = spanning(at, i[at[i] != at[j]], j[at[i] != at[j]])
                out_a.append(doc[lo + i])
                out_b.append(doc[lo + j])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return run


def compared(groups: DataFrame, sets: DataFrame, cfg: NearDedup) -> DataFrame:
    """Links (a, b) inside groups (key, doc_id, label) of bounded size, by full sets."""
    rows = groups.join(sets.select("doc_id", "shingles"), "doc_id").select("key", "doc_id", "label", "shingles")
    return rows.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_compare(cfg.percent), "a long, b long")


def small_groups(rows: DataFrame, cfg: NearDedup) -> DataFrame:
    """node, doc_id, key, size: the candidate groups of small nodes (rows with label, own, n_shingles, bits)."""
    rows = rows.select("node", "doc_id", "n_shingles", "bits", "label", "own")
    dealt = rows.repartition("node").sortWithinPartitions("node")
    return cut(dealt.mapInArrow(_candidates(cfg), "node long, doc_id long, key long, size long"), "near-groups")


def own_group(groups: DataFrame) -> DataFrame:
    """doc_id and the key of the largest of its groups."""
    return cut(groups.groupBy("doc_id").agg(F.max_by("key", F.struct("size", "key")).alias("key")), "near-own")


def pivot_groups(members: DataFrame, cfg: NearDedup) -> DataFrame:
    """key, doc_id: documents of large nodes with the pivot that they agree with most, in blocks."""
    many = members.where(F.col("members") > cfg.small)
    keys = ["node", "doc_id", "n_shingles", "bits", "label"]
    agree, best = F.lit(0), None
    for k in range(FUNCTIONS // 16):
        x = F.get("bits", F.lit(k)).bitwiseXOR(F.get("o_bits", F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        agree = agree + F.bit_count(F.bitwise_not(x).bitwiseAND(F.lit(0x1111111111111111)))
    sized = F.least("n_shingles", "o_n_shingles") * 100 >= F.greatest("n_shingles", "o_n_shingles") * cfg.percent
    for pivot in ("pivot", "pivot2"):
        hub = many.where(F.col("doc_id") == F.col(pivot)).select("node", *[F.col(c).alias(f"o_{c}") for c in keys[1:]]).distinct()
        met = many.join(hub, "node").where(F.col("label") != F.col("o_label")).where(sized)
        met = met.select("doc_id", "o_doc_id", agree.alias("agree")).where(F.col("agree") >= _least_agreement(cfg))
        best = met if best is None else best.unionByName(met)
    best = cut(best.groupBy("doc_id").agg(F.max_by("o_doc_id", F.struct("agree", -F.col("o_doc_id"))).alias("other")), "near-pivots")
    blocks = best.groupBy("other").agg(F.ceil(F.count("*") / cfg.block).alias("blocks"))
    rows = best.join(blocks, "other").withColumn("key", F.xxhash64("other", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    return rows.select("key", "doc_id").unionByName(rows.select("key", F.col("other").alias("doc_id"))).distinct()


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    return df.drop("label").join(named, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def mixed_only(rows: DataFrame, by: str) -> DataFrame:
    """The rows whose ``by`` has more than one label."""
    mixed = rows.groupBy(by).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(by)
    return rows.join(mixed, by, "left_semi")


def tiles(rows: DataFrame, by: str, block: int, cfg: NearDedup) -> DataFrame:
    """``rows`` with a ``key``: groups in which every two documents of a ``by`` meet, blocks
    of about ``block`` of them two by two."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = beside(rows, sizes, by, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(cfg.seed)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("key", F.xxhash64(by, F.least("block", "other"), F.greatest("block", "other"))).drop("block", "other", "blocks")


def cheapest(groups: DataFrame, cfg: NearDedup) -> DataFrame:
    """key, doc_id: groups that hold together at least the pairs that ``groups`` do.

    Groups that share documents form a clump. Where dealing a clump in blocks copies a
    document less often than its groups do, all pairs of the clump are compared instead.
    """
    groups = cut(groups, "near-left")
    heads = groups.groupBy("key").agg(F.min("doc_id").alias("head"))
    clump = components(groups.join(heads, "key").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    clump = clump.select(F.col("node").alias("doc_id"), F.col("component").alias("clump"))
    placed = cut(groups.join(clump, "doc_id"), "near-clumps")
    sizes = placed.groupBy("clump").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))
    whole = sizes.select("clump", (F.ceil(F.col("docs") / cfg.block) * F.col("docs") <= F.col("rows")).alias("whole"))
    placed = beside(placed, whole, "clump", "doc_id")
    dense = tiles(placed.where("whole").select("clump", "doc_id").distinct(), "clump", cfg.block, cfg)
    return dense.select("key", "doc_id").unionByName(placed.where("not whole").select("key", "doc_id"))


def links_between(docs: DataFrame, classes: DataFrame, sketches: DataFrame, cfg: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) between classes; enough of them to give every component."""
    about = classes.select("doc_id", "n_shingles", "bits", F.col("doc_id").alias("label"))
    small, key = F.col("members") <= cfg.small, F.array("doc_id")
    members = _nodes(classes.select("doc_id", F.explode("roots").alias("node")), about)
    groups = small_groups(members.where(small).withColumn("own", key), cfg)
    large = members.where(~small).select("node", "doc_id")
    wanted = groups.select("doc_id").union(large.select("doc_id")).distinct()
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = texts.join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(_sets, "doc_id long, f1 long, f2 long, shingles binary").dropDuplicates(["doc_id", "f1", "f2"]), "near-sets")
    # first each document in the largest of its groups, or with a pivot
    own = own_group(groups)
    first = own.select("key", "doc_id").unionByName(pivot_groups(members, cfg)).withColumn("label", F.col("doc_id"))
    links = cut(compared(first, sets, cfg), "near-links")
    labels = cut(components(links), "near-labels")
    # then the pairs of small nodes that no group held together and that join components
    held = own.select("doc_id", F.array("key").alias("own"))
    left = cut(_labelled(groups.select("node", "doc_id").distinct(), labels), "near-left")
    left = mixed_only(left, "node").join(held, "doc_id").join(about.drop("label"), "doc_id")
    groups = small_groups(left, cfg).select("key", "doc_id")
    # and what is found in the large nodes or below them
    sigs, level = sketches.select("doc_id", "sig").dropDuplicates(["doc_id"]), 1
    while True:
        large = cut(mixed_only(_labelled(large, labels), "node"), "near-large")
        if large.limit(1).count() == 0:
            break
        most = cfg.medium if level < cfg.depth else sys.maxsize
        some = large.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") <= most).select("node")
        medium = tiles(large.join(some, "node", "left_semi").select("node", "doc_id", "label"), "node", cfg.small, cfg).withColumn("node", F.col("key")).distinct()
        medium = medium.withColumn("own", key).join(about.drop("label"), "doc_id")
        groups = groups.unionByName(small_groups(medium, cfg).select("key", "doc_id"))
        large = large.join(some, "node", "left_anti")
        if large.limit(1).count() == 0:
            break
        rows = large.select("doc_id", "node").join(sigs, "doc_id").select("doc_id", "node", "sig")
        rows = rows.mapInPandas(_descend(cfg, level), "doc_id long, node long")
        members = _nodes(rows, _labelled(about, labels))
        deeper = members.where(small).join(held, "doc_id", "left").withColumn("own", F.coalesce("own", key))
        groups = groups.unionByName(small_groups(deeper, cfg).select("key", "doc_id"))
        large = members.where(~small).select("node", "doc_id")
        level += cfg.levels
    last = cut(_labelled(cheapest(groups.distinct(), cfg), labels), "near-rest")
    return links.unionByName(cut(compared(mixed_only(last, "key"), sets, cfg), "near-links"))


def near_components(docs: DataFrame, cfg: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketches = cut(slim.mapInArrow(_sketcher(cfg), SKETCH), "near-sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.first("roots").alias("roots"))
    classes = cut(classes, "near-classes")
    links = links_between(docs, classes, sketches, cfg, id_col, text_col)
    labels = cut(components(links), "near-labels").select(F.col("node").alias("class_id"), "component")
    of_class = classes.select("f1", "f2", F.col("doc_id").alias("class_id")).join(labels, "class_id", "left")
    rows = sketches.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id", "doc_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, cfg: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component holds a smaller id (columns unchanged)."""
    own = free_name(docs, "gone")
    gone = near_components(docs, cfg, id_col, text_col).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(f"`{own}`"), "left_anti")
