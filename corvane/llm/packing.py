"""Packing token sequences by a configuration linear program.

Texts are tokenised, an end id is added, and each document longer than a sequence is
cut into pieces of the full length, the first piece being the shorter one. What is
left is a histogram of piece lengths: at most ``capacity`` numbers, whatever the
corpus. On it the driver solves the configuration LP (use the fewest sequences, each
filled by some multiset of lengths) by multiplicative weights: lengths carry prices,
a knapsack dynamic programme finds the best-priced configuration, and its lengths
become cheaper. The fractional solution is rounded down and what that leaves over is
placed best-fit. The configurations are then dealt to pieces by their rank among the
pieces of the same length.

Scale: texts are read and tokenised once and never shuffled; what moves is one narrow
row per piece. Ranks are numbered in salted buckets per length, so a length that a
third of all pieces share is numbered by many tasks. The plan sent to tasks has at
most ``capacity`` intervals per configuration and a bounded number of configurations.

Defined cases: a null or empty text is one piece that holds only the end id; a very long
text is held whole by one task, with four bytes per id, and gives many pieces; repeated
rows are packed each (rows equal in id, piece and length tie, and either may take either
place); a null id is packed like any other; an empty table gives an empty result; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one numbering bucket, on average.
BUCKET_ROWS = 1_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A byte-level BPE encoder from a tokenizers file, and the ids of its added tokens.

    The file's merges run in the order of the ids, so the ids by themselves are the
    merge ranks.
    """
    import public_tokenizers
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


class Tokens:
    """Texts to ids as little-endian 32-bit bytes.

    Added tokens that stand in a text have their own id; what lies between them is
    encoded by itself.
    """

    def __init__(self, vocabulary: str) -> None:
        self.encoding, self.added = encoder(vocabulary)
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def of(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        own = lambda t: np.array([self.added[t]], dtype="<u4").tobytes()
        return b"".join(own(t) if k % 2 else self.plain(t) for k, t in enumerate(self.marks.split(text)) if t)

    def plain(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def cutter(vocabulary: str, capacity: int, end_id: int):
    """Batches of (doc_id, text) to batches of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            last, data = None, b""
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if text != last:
                    last, data = text, tokens.of(text) + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = min(capacity, (n - at) % capacity or capacity)
                    ids.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[at * 4 : (at + size) * 4]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def knapsack(price: np.ndarray, available: np.ndarray, capacity: int) -> dict[int, int]:
    """A multiset of lengths within ``capacity`` that is worth most, by dynamic
    programming over the filled length; no length more often than it is available.

    A fill's last length is the one worth most together with the best of the room left.
    A length that the best there has used up already gives way to the next in worth, so
    only for lengths too scarce to fill ``capacity`` alone may a better multiset exist.
    """
    reverse = np.where(available > 0, price, -np.inf)[::-1].copy()
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for filled in range(1, capacity + 1):
        worth = best[:filled] + reverse[capacity - filled : capacity]
        best[filled] = best[filled - 1]
        while (value := worth[k := int(worth.argmax())]) > best[filled]:
            size = filled - k
            if (available[size] + 1) * size <= filled and parts(last, k).get(size, 0) >= available[size]:
                worth[k] = -np.inf
                continue
            best[filled], last[filled] = value, size
            break
    return parts(last, capacity)


def parts(last: np.ndarray, filled: int) -> dict[int, int]:
    """The lengths of the best fill and how often; ``last`` is 0 where a place stays free."""
    out: dict[int, int] = {}
    while filled > 0:
        size = int(last[filled])
        if size:
            out[size] = out.get(size, 0) + 1
        filled -= size or 1
    return out


#: Shares of the fractional uses that a rounding is tried with; the plan always places most pieces.
SHARES = (1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6)


def solve(histogram: dict[int, int], capacity: int, rounds: int = 4000, step: float = 4.0) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used; every piece is covered exactly once.

    The covering LP by multiplicative weights: a length's price falls exponentially
    with the share of its demand covered so far; the knapsack prices a configuration
    over all lengths; it is used as often as its scarcest length allows. Rounds end
    when every length is covered (or after ``rounds``). The uses are rounded down,
    fullest first, and what that leaves over goes best-fit. Best-fit does well only
    with small pieces to fill gaps, and those the plan has mostly used: so the
    rounding is tried with shares of each use and bounds on the room that a
    configuration may leave, and the one that takes the fewest sequences is kept.
    """
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        demand[size] += n
    full = [({capacity: 1}, int(demand[capacity]))] if demand[capacity] else []
    demand[capacity] = 0
    uses = relaxed(demand, capacity, rounds, step)
    room = [capacity - sum(s * c for s, c in key) for key, _ in uses]
    tried = (
        rounded([(key, use * share) for (key, use), free in zip(uses, room) if free <= most], demand, capacity)
        for share in SHARES
        for most in {capacity, *(int(np.quantile(room, q)) for q in (0.0, 0.5) if room)}
    )
    return full + min(tried, key=lambda plan: sum(n for _, n in plan))


def rounded(uses: list[tuple[tuple, float]], demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of the given configurations, and best-fit ones for what they leave."""
    left, plan = demand.copy(), []
    for key, use in uses:
        n = int(min([use, *(left[s] // c for s, c in key)]))
        if n > 0:
            plan.append((dict(key), n))
            for s, c in key:
                left[s] -= n * c
    return plan + best_fit(left, capacity)


def relaxed(demand: np.ndarray, capacity: int, rounds: int, step: float) -> list[tuple[tuple, float]]:
    """The fractional solution: configurations and their uses, fullest first."""
    present = np.nonzero(demand)[0]
    sizes = np.arange(capacity + 1)
    covered = np.zeros(capacity + 1)
    uses: dict[tuple, float] = {}
    for _ in range(rounds if present.size else 0):
        share = covered[present] / demand[present]
        if share.min() >= 1:
            break
        price = np.zeros(capacity + 1)
        price[present] = sizes[present] * np.exp(-step * (share - share.min()))
        config = knapsack(price, demand, capacity)
        use = min(demand[s] / n for s, n in config.items())
        key = tuple(sorted(config.items()))
        uses[key] = uses.get(key, 0.0) + use
        for s, n in config.items():
            covered[s] += n * use
    return sorted(uses.items(), key=lambda x: (-sum(s * n for s, n in x[0]), -x[1]))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Places the pieces counted in ``left``, longest first, each configuration as
    often as its counts allow: the longest length left, then ever the longest that fits."""
    left = left.copy()
    out = []
    while (present := np.nonzero(left)[0]).size:
        config: dict[int, int] = {}
        room = capacity
        while room > 0:
            k = np.searchsorted(present, room, side="right") - 1
            while k >= 0 and config.get(int(present[k]), 0) >= left[present[k]]:
                k -= 1
            if k < 0:
                break
            size = int(present[k])
            config[size] = config.get(size, 0) + 1
            room -= size
        n = int(min(left[s] // c for s, c in config.items()))
        for s, c in config.items():
            left[s] -= n * c
        out.append((config, n))
    return out


def dealt(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where each interval of ranks begins, its first sequence, and
    the offset in the sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for config, n in plan:
        offset = 0
        for size, count in sorted(config.items(), reverse=True):
            for _ in range(count):
                out.setdefault(size, []).append((used.get(size, 0), sequence, offset))
                used[size] = used.get(size, 0) + n
                offset += size
        sequence += n
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in out.items()}


def placer(places: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                rows = np.nonzero(length == size)[0]
                begin, first, place = places[int(size)]
                k = np.searchsorted(begin, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = first[k] + rank[rows] - begin[k], place[k]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = cut(texts.mapInArrow(cutter(vocabulary, capacity, end_id), PIECES), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = [max(1, -(-histogram.get(n, 0) // BUCKET_ROWS)) for n in range(capacity + 1)]
    rows = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.get(F.lit(buckets), F.col("length").cast("int"))))
    inside = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "piece")) - 1
    counts = rows.groupBy("length", "b").count()
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("at"))
    ranked = rows.withColumn("in", inside).join(starts, ["length", "b"]).withColumn("rank", F.col("at") + F.col("in"))
    out = PIECES + ", sequence_id long, offset long"
    return ranked.mapInArrow(placer(dealt(solve(histogram, capacity))), out)
