"""Documents to chunks: heading sections, recursive splitting, overlap merging.

Everything is an expression over one row: sections and pieces are arrays, levels of
the recursive split are one array rewrite each, and the greedy merge is a fold of lengths. So
chunking is a narrow projection: no shuffle, no Python, and it pipelines with the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import CHARS_PER_TOKEN, SPACE, let, strip

#: Separators, coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
HEADING = f"(?Umd)^{SPACE}{{0,3}}(#{{1,6}}){SPACE}+(.+?){SPACE}*$"
#: A character no text should hold, put before headings to cut at them.
CUT = "\U000fffff"


@dataclass(frozen=True)
class Chunker:
    max_tokens: int = 512
    overlap_tokens: int = 64
    respect_headings: bool = True

    def __post_init__(self) -> None:
        if self.max_tokens <= 0:
            raise ValueError("a chunk must hold at least one token")
        if not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("the overlap must be shorter than a chunk, and not negative")

    @property
    def max_chars(self) -> int:
        return self.max_tokens * CHARS_PER_TOKEN

    @property
    def overlap_chars(self) -> int:
        return self.overlap_tokens * CHARS_PER_TOKEN


def sections(text: Column) -> Column:
    """array<struct<heading, body>>: the part before the first heading, then each heading
    with what follows it; parts without a body are left out."""
    marked = F.regexp_replace(text, HEADING, CUT + "$2" + CUT)
    whole = F.array(F.struct(F.lit("").alias("heading"), text.alias("body")))

    def pair(parts: Column) -> Column:
        # before, heading, body, heading, body, ...
        name = lambda k: F.when(k == 0, "").otherwise(strip(F.get(parts, k * 2 - 1)))
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int")),
            lambda k: F.struct(name(k).alias("heading"), strip(F.get(parts, k * 2)).alias("body")),
        )
        return F.when(F.size(parts) == 1, whole).otherwise(F.filter(pairs, lambda s: F.length(s["body"]) > 0))

    return let(F.split(marked, CUT, -1), pair)


def _level(pieces: Column, sep: str, most: int) -> Column:
    """Pieces that are too long are cut after each ``sep``; blank parts of a cut are dropped."""

    def cut(p: Column) -> Column:
        def kept(parts: Column) -> Column:
            whole = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(sep))).otherwise(x))
            return F.filter(whole, lambda x: x.rlike("[^\\s\\x1c-\\x1f]") & (F.length(strip(x)) > 0))

        return F.when((F.length(p) > most) & p.contains(sep), let(F.split(p, "\\Q" + sep + "\\E", -1), kept)).otherwise(F.array(p))

    whole = F.exists(pieces, lambda p: (F.length(p) > most) & p.contains(sep))
    return F.when(whole, F.flatten(F.transform(pieces, cut))).otherwise(pieces)


def _leveller(sep: str, most: int):
    return lambda pieces: _level(pieces, sep, most)


def _hard(pieces: Column, most: int) -> Column:
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > most, slices(p)).otherwise(F.array(p))))


#: Lengths folded by one inner fold: a step copies what the fold has emitted so far, so
#: short folds inside a fold over their results keep the copying small.
FOLDED = 512
_CUT = "array<struct<begin:int,end:int,carried:int>>"


def _bounds(lengths: Column, most: int, overlap: int) -> Column:
    """array<struct<begin, end, carried>>: the pieces [begin, end) of each chunk, and how many
    characters of the chunk before it stand in front of them. Numbers alone are folded."""

    def state(cuts: Column, at: Column, begin: Column, carried: Column, held: Column) -> Column:
        return F.struct(cuts.alias("cuts"), at.alias("at"), begin.alias("begin"), carried.alias("carried"), held.alias("held"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["held"] > 0) & (acc["held"] + n > most)
        done = F.struct(acc["begin"].alias("begin"), acc["at"].alias("end"), acc["carried"].alias("carried"))
        kept = F.least(acc["held"], F.lit(overlap))
        return state(
            F.when(full, F.concat(acc["cuts"], F.array(done))).otherwise(acc["cuts"]),
            acc["at"] + 1,
            F.when(full, acc["at"]).otherwise(acc["begin"]),
            F.when(full, kept).otherwise(acc["carried"]),
            F.when(full, kept).otherwise(acc["held"]) + n,
        )

    none = F.array().cast(_CUT)
    zero = F.lit(0)

    def run(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(lengths, k, FOLDED), state(none, acc["at"], acc["begin"], acc["carried"], acc["held"]), step)
        return let(inner, lambda x: state(F.concat(acc["cuts"], x["cuts"]), x["at"], x["begin"], x["carried"], x["held"]))

    last = lambda acc: F.concat(acc["cuts"], F.array(F.struct(acc["begin"].alias("begin"), acc["at"].alias("end"), acc["carried"].alias("carried"))))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(lengths)), F.lit(FOLDED)), state(none, zero, zero, zero, zero), run, last)


def _merge(pieces: Column, most: int, overlap: int) -> Column:
    """Greedy merge; a full chunk is emitted and its tail begins the next one.

    Pieces have at least one character, so the carried tail lies within as many pieces
    before a chunk as it has characters: what a chunk costs does not depend on the text.
    """

    def text(all_: Column, c: Column) -> Column:
        own = F.array_join(F.slice(all_, c["begin"] + 1, c["end"] - c["begin"]), "")
        before = F.array_join(F.slice(all_, F.greatest(F.lit(0), c["begin"] - c["carried"]) + 1, F.least(c["begin"], c["carried"])), "")
        return strip(F.concat(F.when(c["carried"] > 0, F.right(before, c["carried"])).otherwise(""), own))

    bounds = lambda all_: let(F.transform(all_, F.length), lambda lengths: _bounds(lengths, most, overlap))
    made = let(pieces, lambda all_: F.transform(bounds(all_), lambda c: text(all_, c)))
    return let(made, lambda chunks: F.filter(chunks, lambda x, k: (F.length(x) > 0) | (k < F.size(chunks) - 1)))


def pieces_of(body: Column, chunker: Chunker) -> Column:
    """The chunk texts of one section. Each step is bound once, so the cost is linear."""
    most = chunker.max_chars

    def split(b: Column) -> Column:
        pieces = F.array(b)
        for sep in SEPARATORS:
            pieces = let(pieces, _leveller(sep, most))
        return _merge(_hard(pieces, most), most, chunker.overlap_chars)

    none = F.array().cast("array<string>")
    return let(strip(body), lambda b: F.when(F.length(b) > most, split(b)).when(F.length(b) > 0, F.array(b)).otherwise(none))


def chunk(docs: DataFrame, chunker: Chunker = Chunker(), text: str = "text") -> DataFrame:
    """``docs`` exploded to chunks: adds ordinal (through the document), heading and chunk_text."""
    one = F.array(F.struct(F.lit("").alias("heading"), F.col(text).alias("body")))
    parts = sections(F.col(text)) if chunker.respect_headings else one
    made = F.flatten(
        F.transform(parts, lambda s: F.transform(pieces_of(s["body"], chunker), lambda c: F.struct(s["heading"].alias("heading"), c.alias("chunk_text"))))
    )
    rows = docs.select("*", F.posexplode(made).alias("ordinal", "_c"))
    return rows.select(*docs.columns, F.col("_c.heading").alias("heading"), "ordinal", F.col("_c.chunk_text").alias("chunk_text"))
