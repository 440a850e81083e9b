"""What describes a run: defence layers and their label, task selection, run flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.spotlight import DATAMARKED, DELIMIT, ENCODE

#: The layers that can be toggled, in order, and those on by default.
LAYERS = ("l2", "l3", "l4", "l5")
NAMES = {"spotlight": "l2", "detect": "l3", "quarantine": "l4", "gate": "l5"}
DEFAULT = ("spotlight", "detect", "gate")


@dataclass(frozen=True)
class Defence:
    """Which layers are on. Provenance (l1) always is; quarantine costs calls and is never on by itself."""

    spotlight: bool = True
    detect: bool = True
    quarantine: bool = False
    gate: bool = True
    style: str = DELIMIT

    def __post_init__(self) -> None:
        if self.style not in (DELIMIT, DATAMARKED, ENCODE):
            raise ValueError(f"unknown spotlight style: {self.style!r}")

    @classmethod
    def of(cls, layers: Sequence[str], style: str = DELIMIT) -> Defence:
        return cls(**{name: name in layers for name in NAMES}, style=style)

    @classmethod
    def none(cls) -> Defence:
        return cls.of(())

    @property
    def enabled(self) -> tuple[str, ...]:
        return tuple(layer for name, layer in NAMES.items() if getattr(self, name))

    @property
    def label(self) -> str:
        """``guard-l1+l2-delimit+l3+l5``: the spotlight's style is part of it, layers that are off are not."""
        return "guard-" + "+".join(["l1", *(f"{x}-{self.style}" if x == "l2" else x for x in self.enabled)])


class LayerError(ValueError):
    """A list of layers that does not say which are on."""


#: What each word of a list turns on, and whether it must be the only one.
WORDS = {**{name: ((name,), False) for name in NAMES}, "all": (DEFAULT, True), "none": ((), True)}


def parse_layers(spec: str) -> tuple[str, ...]:
    """Layer names of a comma-separated list, in layer order; ``all`` and ``none`` stand alone."""
    asked = spec.casefold().split(",")
    turned_on: set[str] = set()
    for word in map(str.strip, asked):
        if word not in WORDS:
            raise LayerError(f"{spec!r} has {word!r} for a layer; there are {', '.join(WORDS)}")
        layers, alone = WORDS[word]
        if alone and len(asked) > 1:
            raise LayerError(f"{spec!r} has {word!r} beside other layers")
        turned_on.update(layers)
    return tuple(filter(turned_on.__contains__, NAMES))


def label_of(spotlight: Column, detect: Column, quarantine: Column, gate: Column, style: Column) -> Column:
    """The label of a table of configurations."""
    on = [(F.concat(F.lit("l2-"), style), spotlight), (F.lit("l3"), detect), (F.lit("l4"), quarantine), (F.lit("l5"), gate)]
    return F.concat(F.lit("guard-"), F.concat_ws("+", F.lit("l1"), *[F.when(flag, name) for name, flag in on]))


def numeric_suffix(ident: Column) -> Column:
    """The number that ends an id, or -1: ids sort by it, then by themselves."""
    digits = F.regexp_extract(ident, "([0-9]+)$", 1)
    return F.when(digits == "", F.lit(-1).cast("decimal(38,0)")).otherwise(digits.cast("decimal(38,0)"))


def first_ids(df: DataFrame, ident: str, most: int) -> DataFrame:
    """The first ``most`` distinct ids in numeric order, a top-k without a global sort."""
    if most < 1:
        raise ValueError("at least one task must be selected")
    return df.select(ident).distinct().orderBy(numeric_suffix(F.col(ident)), ident).limit(most)


def named_ids(df: DataFrame, ident: str, wanted: Sequence[str]) -> DataFrame:
    """The ``wanted`` ids, each of which the table must have."""
    asked = df.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"{ident} string")
    missing = [r[0] for r in asked.join(df.select(ident), ident, "left_anti").limit(3).collect()]
    if missing:
        raise ValueError(f"unknown ids: {', '.join(missing)}")
    return asked


def replayed(calls: Column, *metrics: Column) -> Column:
    """A run that made no model call and yet has a result was served from a cache."""
    return (calls == 0) & F.coalesce(*metrics).isNotNull()


def screening_only(user_tasks: Column, injection_tasks: Column) -> Column:
    """A run over explicitly named tasks was picked by its outcome: no test on it is valid."""
    return user_tasks.isNotNull() | injection_tasks.isNotNull()


def pipeline_name(model: Column, label: Column, *parts: Column) -> Column:
    """A name that is safe in paths and differs whenever any part that can change a result does."""
    from corvane.operators.evaluation import fingerprint

    safe = F.regexp_replace(model, "[^A-Za-z0-9._-]+", "_")
    return F.concat_ws("-", F.lit("local"), safe, label, fingerprint(model, label, *parts))
