"""Language-model scoring with a sharded Elias-Fano bigram trie.

Model. Unigrams: p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) over the training tokens.
Bigrams: p(w | h) = (c(h w) + k p1(w)) / (c(h) + k), a Dirichlet prior whose strength
k is the one of ``STRENGTHS`` that gives the training tokens the largest leave-one-out
likelihood; an unseen context gives p1. Each text starts in a start context and ends
with an end token.

Flow. Texts are read once and encoded into blocks: a block has the hashes of its
distinct words and its tokens as positions in them. Each block sends, to each shard
of the n-gram space, its distinct words and bigrams with their training counts
(Elias-Fano coded), so whatever is frequent is counted before it moves. A shard adds up
the counts of all blocks, builds its trie over a memory-mapped file, and answers each
block's n-grams. The answers return to the blocks, where texts are scored.

Scale: no model is broadcast or gathered; shards and blocks have a bounded size and
their number grows with the corpus. Bigrams are dealt by a hash of both words, so the
successors of a frequent word are spread over all shards; its context range in each
trie is then a part of them.

A bigram is known by 60 bits of hash (24 of its context, 36 of both words) inside its
shard of some millions: about one unseen bigram in 10^11 is taken for another. Words have 64 bits. Counts from 1,024 on are quantised within 0.25 percent.

Defined cases: a null or empty text is only the end token; rows that repeat an id are
texts of their own; a null id is held out; a very long text is one block by itself,
held whole by one task; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.ngram_trie import EliasFano, Trie, dequantise
from corvane.llm.shared import cut

BLOCK_BYTES = 12 << 20
SHARD_TOKENS = 2_000_000
STRENGTHS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
CONTEXT_BITS, SUCCESSOR_BITS = 24, 36
#: Words of their own that no text can hold (words have no space).
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))
BLOCK = "block long, docs array<long>, lens array<int>, held array<boolean>, words binary, tokens binary"
ASK = "shard int, block long, words binary, word_counts binary, n_pairs int, low_bits int, low binary, high binary, pair_counts binary"
ANSWER = "block long, shard int, word_counts binary, pair_codes binary, train_tokens long, distinct long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, loo array<double>"


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(dtype)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text, held) to blocks."""
    part, made = TaskContext.get().partitionId(), 0

    def block(docs: list, texts: list, held: list) -> pa.RecordBatch:
        nonlocal made
        local: dict[bytes, int] = {}
        ids: list[int] = []
        lens = []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
            ids += [local.setdefault(w, len(local)) for w in words]
            lens.append(len(words) + 1)
        digest = xxhash.xxh3_64_intdigest
        hashes = np.array([digest(w) for w in local], dtype=np.uint64)
        hashes = np.append(hashes, END)
        flat = np.full(sum(lens), len(hashes) - 1, np.int64)
        is_word = np.ones(len(flat), bool)
        is_word[np.cumsum(lens) - 1] = False
        flat[is_word] = ids
        order = np.argsort(hashes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        made += 1
        values = [[(part << 24) + made], [docs], [lens], [held], [hashes[order].tobytes()], [_pack(place[flat].astype(np.uint32))]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "docs", "lens", "held", "words", "tokens"])

    for batch in batches:
        docs, texts, held, size = [], [], [], 0
        for d, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            t = t.as_py() or ""
            if texts and size + len(t) > BLOCK_BYTES:
                yield block(docs, texts, held)
                docs, texts, held, size = [], [], [], 0
            docs.append(d)
            texts.append(t)
            held.append(h)
            size += len(t)
        if texts:
            yield block(docs, texts, held)


class Grams:
    """What a block's tokens come to: distinct bigrams in the order of shard and key."""

    def __init__(self, words: bytes, tokens: bytes, lens: list[int], held: list[bool], shards: int) -> None:
        self.words = np.frombuffer(words, np.uint64)
        self.tokens = _unpack(tokens, np.uint32).astype(np.int64)
        self.lens = np.asarray(lens, np.int64)
        self.trained = np.repeat(~np.asarray(held, bool), self.lens)
        n = len(self.words)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        self.first = np.cumsum(self.lens) - self.lens
        before[self.first] = n  # the start context
        self.before = before
        code = before * n + self.tokens
        order = np.argsort(code, kind="stable")
        code = code[order]
        fresh = np.empty(len(code), bool)
        fresh[:1] = True
        np.not_equal(code[1:], code[:-1], out=fresh[1:])
        starts = np.nonzero(fresh)[0]
        distinct = code[starts]
        self.train = np.add.reduceat(self.trained[order].astype(np.int64), starts) if len(starts) else starts
        group = np.cumsum(fresh) - 1
        h1 = np.append(self.words, START)[distinct // n]
        h2 = self.words[distinct % n]
        both = _mix(_mix(h1) + h2)
        self.shard = self.shard_of(both, shards)
        self.key = ((_mix(h1 + np.uint64(1)) >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(SUCCESSOR_BITS)) | (_mix(both) >> np.uint64(64 - SUCCESSOR_BITS))
        by = np.lexsort((self.key, self.shard))
        self.shard, self.key, self.train = self.shard[by], self.key[by], self.train[by]
        rank = np.empty_like(by)
        rank[by] = np.arange(len(by))
        self.of_token = np.empty(len(self.tokens), np.int64)  # the bigram of each token
        self.of_token[order] = rank[group]
        self.word_shard = self.shard_of(self.words, shards)  # ascending, as the words are

    @staticmethod
    def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _asker(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g = Grams(r["words"], r["tokens"], r["lens"], r["held"], shards)
                counts = np.bincount(g.tokens[g.trained], minlength=len(g.words)).astype(np.uint32)
                wcut = np.searchsorted(g.word_shard, np.arange(shards + 1))
                pcut = np.searchsorted(g.shard, np.arange(shards + 1))
                rows = []
                for s in range(shards):
                    w, p = slice(wcut[s], wcut[s + 1]), slice(pcut[s], pcut[s + 1])
                    ef = EliasFano.of(g.key[p], 1 << (CONTEXT_BITS + SUCCESSOR_BITS))
                    rows.append((
                        s, r["block"], g.words[w].tobytes(), _pack(counts[w]), ef.n, ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), _pack(g.train[p].astype(np.uint32)),
                    ))
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                names = ["shard", "block", "words", "word_counts", "n_pairs", "low_bits", "low", "high", "pair_counts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and each input's place among them."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)), place


def answer(t: pa.Table) -> pa.Table:
    """One shard: the sums of all blocks' counts, as answers to every block."""
    rows = t.to_pylist()
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    _, total, place = _sums(words, [_unpack(r["word_counts"], np.uint32) for r in rows])
    word_out = total[place].astype(np.uint32)
    pairs = [EliasFano(r["n_pairs"], r["low_bits"], np.frombuffer(r["low"], np.uint8), np.frombuffer(r["high"], np.uint8), None).decode() for r in rows]
    keys, sums, _ = _sums(pairs, [_unpack(r["pair_counts"], np.uint32) for r in rows])
    seen = sums > 0
    mask = np.uint64((1 << SUCCESSOR_BITS) - 1)
    keys = keys[seen]
    trie = Trie.of(keys >> np.uint64(SUCCESSOR_BITS), keys & mask, sums[seen], CONTEXT_BITS, SUCCESSOR_BITS).mapped()
    asked = np.concatenate(pairs)
    codes = trie.lookup(asked >> np.uint64(SUCCESSOR_BITS), asked & mask)
    out, w, p = [], 0, 0
    for k, r in enumerate(rows):
        out.append((
            r["block"], r["shard"], _pack(word_out[w : w + len(words[k])]), _pack(codes[p : p + len(pairs[k])]),
            int(total.sum()) if k == 0 else 0, int((total > 0).sum()) if k == 0 else 0,
        ))
        w, p = w + len(words[k]), p + len(pairs[k])
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = ["block", "shard", "word_counts", "pair_codes", "train_tokens", "distinct"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _scorer(shards: int, n_train: int, distinct: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        parts = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        outs: list[list] = [[] for _ in range(8)]
        for r in blocks.to_pylist():
            g = Grams(r["words"], r["tokens"], r["lens"], r["held"], shards)
            c = np.concatenate([_unpack(x["word_counts"], np.uint32) for x in parts]).astype(np.float64)
            c12 = dequantise(np.concatenate([_unpack(x["pair_codes"], np.uint16) for x in parts]))[g.of_token]
            p1 = (c + 0.1) / (n_train + 0.1 * (distinct + 1))
            end = np.searchsorted(g.words, END)
            c1 = np.append(c, c[end])[g.before]  # as many starts as ends
            p1 = p1[g.tokens]
            add = lambda x: np.add.reduceat(x, g.first)
            scores, loo = [], []
            for k in STRENGTHS:
                scores.append(add(np.log10((c12 + k * p1) / (c1 + k))))
                left = np.where(g.trained, np.log10((np.maximum(c12 - 1, 0) + k * p1) / (np.maximum(c1 - 1, 0) + k)), 0.0)
                loo.append(add(left))
            columns = [
                r["docs"], r["held"], g.lens.tolist(), add((c[g.tokens] > 0).astype(np.int64)).tolist(), [n_train] * len(g.lens),
                add(np.log10(p1)).tolist(), np.array(scores).T.tolist(), np.array(loo).T.tolist(),
            ]
            for out, col in zip(outs, columns):
                out += col
        floats = pa.list_(pa.float64())
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), floats, floats]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "scores", "loo"]
        return pa.table([pa.array(x, k) for x, k in zip(outs, kinds)], names=names)

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` marks the rows that the model does not learn from.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held"))
    blocks = cut(texts.mapInArrow(encode, BLOCK), "lm-blocks")
    tokens = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-tokens // SHARD_TOKENS))
    asks = blocks.mapInArrow(_asker(shards), ASK)
    answers = cut(asks.groupBy("shard").applyInArrow(answer, ANSWER), "lm-answers")
    sums = answers.agg(F.sum("train_tokens"), F.sum("distinct")).first()
    paired = blocks.groupBy("block").cogroup(answers.select("block", "shard", "word_counts", "pair_codes").groupBy("block"))
    scored = cut(paired.applyInArrow(_scorer(shards, sums[0] or 0, sums[1] or 0), SCORED), "lm-scores")
    best = scored.where("not held_out").agg(*[F.sum(F.get("loo", F.lit(k))).alias(f"k{k}") for k in range(len(STRENGTHS))]).first()
    chosen = max(range(len(STRENGTHS)), key=lambda k: best[k] if best[k] is not None else float("-inf"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.get("scores", F.lit(chosen)).alias("score"))
