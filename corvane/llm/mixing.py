"""Mixing sources to target weights by temperature.

The share of a source's tokens is raised to an exponent t in [0, 1] and normalised:
t = 1 keeps the natural shares, t = 0 makes sources equal. The exponent is bisected
until the weights reach a target entropy, and raised where needed so that, at the
given budget of tokens, no source repeats more than ``max_repeat`` times. Without a
given budget it is raised until the budget that ``max_repeat`` allows is at least
``least`` of all tokens, so that a scarce source cannot shrink the whole mix.

The weights are realised as budgeted block permutations: a source's documents fall
into blocks by a hash, the blocks are put into a seeded order, documents into a
seeded order within their block, and passes over this permutation are taken until
the source's tokens are spent. A document is taken in a pass if its first token
lies within the budget.

Scale: the corpus is read once into one narrow row per document. Source totals are
never collected; the search evaluates a grid of exponents inside one aggregation and
narrows it three times. A source's budget ends in one block, found by running sums over
block totals; only that block is ordered, and the place in the permutation where the
budget ends is all that documents are held against. So texts are never shuffled, and a
source with a third of all rows is spread over many tasks.

Defined cases: null texts hold no word and count one token (the document's end), so
that every document has a place; a very long text counts its words like any other; a null
source is a source of its own; a null id has a place like any other; rows that repeat an
id in a source share a place, so the source may exceed its budget by the tokens of the
repeats of one id; an empty table gives an empty result; other columns pass through
unread, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.quality_rules import words_of
from corvane.llm.shared import beside, cut, free_name

GRID, ROUNDS = 33, 4
BLOCK_ROWS = 4096
#: Up to so many sources (some hundred bytes each) are sent to every task.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    """target_entropy: share of the largest possible entropy. budget: tokens to
    realise as a share of all tokens; None: the largest that ``max_repeat`` allows
    at the weights (at most all). least: the share that this may not fall below."""

    target_entropy: float = 0.95
    max_repeat: float = 4.0
    budget: float | None = 1.0
    seed: int = 7
    least: float = 0.9


def profile(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: the weights' entropy, and the largest weight over natural share."""
    whole = sources.agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / F.lit(float(whole))
    sums = []
    for k, t in enumerate(exponents):
        w = F.pow(share, F.lit(t))
        sums += [F.sum(w).alias(f"z{k}"), F.sum(w * F.ln(w)).alias(f"e{k}"), F.max(w / share).alias(f"r{k}")]
    row = sources.agg(*sums).first()
    return [
        (math.log(row[f"z{k}"]) - row[f"e{k}"] / row[f"z{k}"], row[f"r{k}"] / row[f"z{k}"])
        for k in range(len(exponents))
    ]


def bisect(sources: DataFrame, holds) -> float:
    """The exponent up to which ``holds(entropy, ratio)`` is true (0 if never, 1 if always).

    A bisection that asks for many midpoints in one pass over the sources.
    """
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
        true = [holds(*p) for p in profile(sources, grid)]
        last = max((k for k in range(GRID + 1) if all(true[: k + 1])), default=-1)
        if last < 0:
            return lo
        if last == GRID:
            return hi
        lo, hi = grid[last], grid[last + 1]
    return lo


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The largest exponent that meets the entropy, or the smallest that keeps the
    repetition limit, if that is larger; 1.0 for fewer than two sources."""
    n = sources.count()
    if n < 2:
        return 1.0
    at = bisect(sources, lambda entropy, _: entropy >= mix.target_entropy * math.log(n))
    floor = mix.budget if mix.budget is not None else min(mix.least, mix.max_repeat)
    above = lambda _, ratio: floor * ratio > mix.max_repeat
    return max(at, bisect(sources, above))


def order_of(id_col: str, seed: int, blocks) -> Column:
    """Where a row stands in the permutation of its source: its block's turn, the block,
    its turn inside the block, and the id, which parts ties."""
    whole = F.col(f"`{id_col}`")
    block = F.pmod(F.xxhash64(F.lit("block"), F.lit(seed), whole), blocks)
    turn = F.xxhash64(F.lit("turn"), F.lit(seed), block)
    return F.struct(turn.alias("turn"), block.alias("block"), F.xxhash64(F.lit("order"), F.lit(seed), whole).alias("key"), whole.alias("id"))


def n_tokens_of(text_col: str) -> Column:
    return (F.size(words_of(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))) + 1).cast("long")


def cuts(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): id, source and n_tokens of each document; per source its tokens,
    weight, budget, the whole passes taken and ``last``, the place in the permutation up
    to which one more pass is taken."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_tokens_of(text_col).alias("n_tokens"))
    rows = cut(rows, "mix-docs")
    sources = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    t = exponent(sources, mix)
    share = F.col("tokens") / F.lit(float(total))
    z = sources.agg(F.sum(F.pow(share, F.lit(t)))).first()[0] or 1.0
    ratio = sources.agg(F.max(F.pow(share, F.lit(t)) / F.lit(z) / share)).first()[0] or 1.0
    budget = mix.budget if mix.budget is not None else min(1.0, mix.max_repeat / ratio)
    weight = (F.pow(share, F.lit(t)) / F.lit(z)).alias("weight")
    sources = sources.select("source", "tokens", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"), weight)
    sources = sources.withColumn("budget", F.round(F.col("weight") * F.lit(budget * total)).cast("long"))
    sources = sources.withColumn("passes", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    sources = cut(sources.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-weights")
    # the block in which a source's budget ends, by running sums over block totals
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    placed = beside(keyed, sources.select("key", "blocks", "rest"), "key", "doc_id").withColumn("place", order_of("doc_id", mix.seed, F.col("blocks")))
    placed = placed.where("rest > 0").select("key", "rest", "n_tokens", "place")
    sizes = placed.groupBy("key", "rest", "place.turn", "place.block").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy("key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    ends = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).where("start < rest and start + size >= rest")
    ends = ends.select("key", "block", "start")
    inside = placed.withColumn("block", F.col("place.block")).join(ends, ["key", "block"])
    until = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("start") + F.coalesce(F.sum("n_tokens").over(until), F.lit(0)))
    last = inside.where("start < rest").groupBy("key").agg(F.max("place").alias("last"))
    return rows, cut(sources.join(last, "key", "left").drop("rest"), "mix-cuts")


def with_copies(rows: DataFrame, sources: DataFrame, mix: Mix, id_col: str, source_col: str) -> DataFrame:
    """``rows`` beside a struct column ``taken`` with copies, weight and budget.

    Sources are a table of one row each; up to ``BROADCAST_SOURCES`` go to every task,
    more are joined by their key.
    """
    key, taken = free_name(rows, "key"), "taken"
    few = sources.select(F.col("key").alias(key), F.struct("weight", "budget", "passes", "blocks", "last").alias("taken"))
    named = F.col(f"`{source_col}`").cast("string")
    rows = rows.withColumn(key, F.coalesce(F.concat(F.lit("s"), named), F.lit("n")))
    if sources.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(few), key)
    else:
        joined = beside(rows, few, key, id_col)
    place = order_of(id_col, mix.seed, F.col("taken.blocks"))
    more = F.coalesce(place <= F.col("taken.last"), F.lit(False)).cast("int")
    values = F.struct(F.col("taken.weight"), F.col("taken.budget"), (F.col("taken.passes") + more).cast("int").alias("copies"))
    return joined.withColumn(taken, values).drop(key)


def spread(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The realised mix.

    Returns (plan, sources): plan has doc_id, source, n_tokens, weight, budget (tokens
    of the source) and copies (0: left out); sources has one row per source.
    """
    rows, sources = cuts(docs, mix, id_col, text_col, source_col)
    plan = with_copies(rows, sources, mix, "doc_id", "source")
    return plan.select("doc_id", "source", "n_tokens", "taken.weight", "taken.budget", "taken.copies"), sources


def apply(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it (columns unchanged)."""
    _, sources = cuts(docs, mix, id_col, text_col, source_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"))
    out = with_copies(whole, sources, mix, "id", "source").where("taken.copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("taken.copies")))).select("row.*")
