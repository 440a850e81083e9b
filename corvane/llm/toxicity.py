"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters. Each voter is a word (lexicon) or the beginning of words (pattern) and votes for
one class on a text that holds it, else it abstains. The insults of ``SEED_LEXICON``
always vote for toxic; further words and beginnings are mined from the labelled training
rows, for either class, by how much more often texts of that class hold them.

Label model. A text's votes are modelled as generated by its hidden class. Voters
that nearly always vote together, given the class, are correlated: their excess
agreement is estimated and each voter's weight is divided by the size of the group
it effectively speaks for. Accuracies (the rates of voting in either class) and the
class balance are estimated by expectation maximisation over the votes. A row's given
label is one more voter: it starts the maximisation, so that it knows which class is
which, and its accuracy is estimated like any other but never above ``label_accuracy``,
so that votes can overrule it. (Without the labels' vote the classes drift apart from
them: 73 held-out toxic texts of 144 are found on the test table instead of 119.)

Classifier. A logistic regression on vote counts is trained on the label model's
posteriors and scores every text. Inputs are the text's words alone.

Scale: the models are fitted on a bounded sample of labelled training rows
(``max_rows`` of either class, taken by a hash of the id, weighted back to the fold's
class balance); counts for mining are aggregated on the executors; scoring is one pass
over the texts without a shuffle. The model's size is part of its definition: the
``max_voters`` toxic and ``max_clean_voters`` clean features that tell most, by text
count and lift, ties by length and spelling. Tasks receive these and the sample's ids.

Defined cases: null and empty texts have no votes and get the base score; a very long
text is scored whole; unlabelled rows, null labels and rows outside the training fold
never reach the models; rows that repeat an id are scored each, and count in training
with any of their texts; a null id is scored and has no label; without any toxic training
row the seed lexicon votes with default accuracies; an empty table gives an empty result;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut

#: Common insults.
SEED_LEXICON = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "ugly", "hate you", "shut up")
#: Lengths of the word beginnings that patterns may have.
PREFIXES = (3, 4, 5, 6)
#: Characters stripped from a word's ends before it is looked up.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|~_-+=/\\^@`…«»“”‘’"
REMEMBERED = 500_000


@dataclass(frozen=True)
class Toxicity:
    max_rows: int = 6_000
    max_voters: int = 640
    max_clean_voters: int = 160
    min_texts: int = 6
    min_lift: float = 8.0
    rounds: int = 25
    label_accuracy: float = 0.98


@dataclass
class Model:
    voters: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def features(word: str) -> list[str]:
    """What a word may match: itself, and its beginnings marked with a star."""
    w = word.strip(EDGES).lower()
    return [w, *[w[:k] + "*" for k in PREFIXES if len(w) > k]] if len(w) > 2 else []


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, toxic) to counts of texts per feature, summed per batch."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[toxic].update({f for w in set((text.as_py() or "").split()) for f in features(w)})
        toxic, clean = counts[1], counts[0]
        names = list(toxic)  # features of clean texts alone can never become voters of this sample
        rest = [n for n in clean if n not in toxic]
        names += rest
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())],
            names=["feature", "toxic", "clean"],
        )


class Votes:
    """Votes of texts, remembering each word's voters."""

    def __init__(self, voters: dict[str, int]) -> None:
        self.voters, self.known = voters, {}
        self.phrases = [(p, k) for p, k in voters.items() if " " in p]

    def of(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        if not text:
            return out
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in text.split():
            hits = known.get(w)
            if hits is None:
                hits = known[w] = tuple(self.voters[f] for f in features(w) if f in self.voters)
            for k in hits:
                out[k] = out.get(k, 0) + 1
        if self.phrases:
            lower = text.lower()
            for p, k in self.phrases:
                if p in lower:
                    out[k] = out.get(k, 0) + lower.count(p)
        return out


def _voter(voters: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(voters)
        for batch in batches:
            got = [votes.of(t.as_py()) for t in batch.column(0)]
            longs = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(g) for g in got], longs), pa.array([list(g.values()) for g in got], longs)], names=["toxic", "voter", "times"])

    return run


def label_model(votes: np.ndarray, labels: np.ndarray, share: np.ndarray, cfg: Toxicity) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of the sample's rows, the voters' log-odds weights, and the class log-odds.

    Class balance, the rates of voting in either class and the accuracy of the given
    labels are estimated together, rows weighted by ``share``.
    """
    m, most = votes.shape[1], cfg.label_accuracy
    y, pull, balance = labels.astype(np.float64), np.zeros(m), 0.0
    for _ in range(cfg.rounds):
        yes, no = share * y, share * (1 - y)
        n = len(y) * yes.sum(), len(y) * no.sum()  # effective rows of either class
        on = (len(y) * (yes @ votes) + 0.5) / (n[0] + 1)
        off = (len(y) * (no @ votes) + 0.5) / (n[1] + 1)
        # excess agreement of two voters inside the classes, as a correlation
        centred = (votes - (y[:, None] * on + (1 - y)[:, None] * off)) * np.sqrt(share)[:, None]
        spread = np.sqrt((centred**2).sum(axis=0) + 1e-9)
        corr = np.clip((centred.T @ centred) / np.outer(spread, spread), 0, 1)
        group = np.maximum(1.0, (corr * (corr > 0.4)).sum(axis=1))
        told, silent = np.log(on / off) / group, np.log((1 - on) / (1 - off)) / group
        pull, balance = told - silent, float(np.log(yes.sum() / no.sum()))
        right = np.clip([yes @ labels / yes.sum(), no @ (1 - labels) / no.sum()], 0.5, most)
        given = np.where(labels == 1, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        new = 1 / (1 + np.exp(-np.clip(balance + given + votes @ pull + silent.sum(), -30, 30)))
        moved = np.abs(new - y).max()
        y = new
        if moved < 1e-4:
            break
    return y, pull, balance


def design(rows: list[tuple[list[int], list[int]]], m: int) -> np.ndarray:
    """The classifier's inputs: 1 for a vote, a little more for repeated ones."""
    x = np.zeros((len(rows), m), np.float32)
    for i, (voter, times) in enumerate(rows):
        x[i, voter] = 1 + 0.25 * np.log(np.array(times, dtype=np.float32))
    return x


def linear(x: np.ndarray, y: np.ndarray, share: np.ndarray, start: np.ndarray, toxic: np.ndarray, odds: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with row weights ``share``, from the label
    model's weights on; each weight adapts at its own pace. A voter never speaks against
    its polarity (``toxic``: true where it votes for toxic)."""
    w, b = start.copy(), float(odds)
    mean, var = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * share
        grad = np.append(x.T @ g + 1e-6 * w, g.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        move = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-7)
        w = w - move[:-1]
        w, b = np.where(toxic, np.maximum(w, 0), np.minimum(w, 0)).astype(np.float32), b - float(move[-1])
    return w, b


def choose_voters(found: list[tuple[str, int, int]], clean: list[tuple[str, int, int]], cfg: Toxicity) -> tuple[dict[str, int], int]:
    """The voters, toxic ones first, and how many of them are toxic: the seed lexicon and
    mined features, without a beginning that matches the very texts a longer voter does."""
    voters = {w: k for k, w in enumerate(SEED_LEXICON)}

    def add(rows: list[tuple[str, int, int]], most: int) -> None:
        chosen: dict[tuple[int, int], list[str]] = {}
        for name, toxic, other in rows:
            same = chosen.setdefault((toxic, other), [])
            if len(voters) >= most or name.endswith("*") and any(o.startswith(name[:-1]) for o in same):
                continue
            same.append(name)
            voters.setdefault(name, len(voters))

    add(found, cfg.max_voters)
    n_toxic = len(voters)
    add(clean, n_toxic + cfg.max_clean_voters)
    return voters, n_toxic


def fit(texts: DataFrame, n_toxic: int, n_clean: int, cfg: Toxicity = Toxicity()) -> Model:
    """The model, from the sample ``texts`` (text, toxic 0 or 1) of a fold with so many rows."""
    sizes = texts.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, n = int(sizes["p"] or 0), int(sizes["n"])
    if not n_toxic or not n_clean or not p or p == n:
        voters, _ = choose_voters([], [], cfg)
        return Model(voters, np.full(len(voters), 4.0), -2.5)
    counts = texts.mapInArrow(_mine, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = (F.col("toxic") / F.lit(p)) / ((F.col("clean") + 1) / F.lit(max(n - p, 1)))
    fall = (F.col("clean") / F.lit(max(n - p, 1))) / ((F.col("toxic") + 1) / F.lit(p))
    some = cut(counts.where(((F.col("toxic") >= cfg.min_texts) & (lift >= cfg.min_lift)) | ((F.col("clean") >= cfg.min_texts) & (fall >= cfg.min_lift))), "tox-features")
    rows = lambda by, most: [tuple(r)[:3] for r in some.where(by >= cfg.min_lift).orderBy((F.greatest("toxic", "clean") * F.ln(by)).desc(), F.length("feature").desc(), "feature").limit(most).collect()]
    voters, n_for = choose_voters(rows(lift, 4 * cfg.max_voters), rows(fall, 4 * cfg.max_clean_voters), cfg)
    got = texts.mapInArrow(_voter(voters), "toxic int, voter array<int>, times array<int>").collect()
    x = design([(r["voter"], r["times"]) for r in got], len(voters))
    labels = np.array([r["toxic"] for r in got])
    share = np.where(labels == 1, n_toxic / p, n_clean / max(n - p, 1)) / (n_toxic + n_clean)
    posterior, pull, odds = label_model((x > 0).astype(np.float64), labels, share, cfg)
    toxic = np.arange(len(voters)) < n_for
    start = np.where(toxic, np.maximum(pull, 0), np.minimum(pull, 0)).astype(np.float32)
    w, b = linear(x, posterior, share.astype(np.float32), start, toxic, odds)
    return Model(voters, w, b)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(model.voters)
        for batch in batches:
            scores = []
            for t in batch.column(1):
                got = votes.of(t.as_py())
                z = model.bias + sum(float(model.weights[k]) * (1 + 0.25 * math.log(c)) for k, c in got.items())
                scores.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(
    docs: DataFrame, labels: DataFrame, trains: Column, cfg: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and score for every row of ``docs``; ``trains`` (over ``labels``) marks the training fold."""
    marked = labels.where("toxic is not null").where(F.coalesce(trains, F.lit(False)))
    marked = marked.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    some = lambda c: marked.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(cfg.max_rows)
    chosen = some(0).unionByName(some(1))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = cut(named.join(F.broadcast(chosen), "id").select("text", "toxic"), "tox-sample")
    model = fit(texts, n.get(1, 0), n.get(0, 0), cfg)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(_scorer(model), "doc_id long, score double")
