"""Trust tiers as an integer lattice: labels, predicates, lower bounds, provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tiers, lowest trust first.
UNTRUSTED, QUARANTINE_DERIVED, CURATED, USER, SYSTEM = range(5)
NAMES = ("UNTRUSTED", "QUARANTINE_DERIVED", "CURATED", "USER", "SYSTEM")
PROVENANCE = "struct<source_uri:string,tier:int,content_sha256:string,detector_flags:array<string>,note:string>"


def tier_label(tier: Column) -> Column:
    """``T0_UNTRUSTED`` to ``T4_SYSTEM``."""
    return F.concat(F.lit("T"), tier.cast("string"), F.lit("_"), F.get(F.array(*[F.lit(n) for n in NAMES]), tier))


def tier_of(label: str) -> int:
    """The tier a label names: case and a ``Tn_`` prefix do not matter; others raise."""
    text = label.strip().upper()
    if text.startswith("T") and "_" in text and text not in NAMES:
        text = text.split("_", 1)[1]
    if text not in NAMES:
        raise ValueError(f"unknown trust tier: {label!r}")
    return NAMES.index(text)


def tier_from_label(label: Column) -> Column:
    text = F.upper(F.trim(label))
    bare = F.when(text.startswith("T") & ~text.isin(*NAMES), F.regexp_replace(text, "^T[^_]*_", "")).otherwise(text)
    known = F.array_position(F.array(*[F.lit(n) for n in NAMES]), bare)
    return F.when(known > 0, known.cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit("unknown trust tier: "), label)))


def is_authority(tier: Column) -> Column:
    return tier >= USER


def is_data_only(tier: Column) -> Column:
    return ~is_authority(tier)


def is_attacker_influenced(tier: Column) -> Column:
    return tier <= QUARANTINE_DERIVED


def glb(tier: Column) -> Column:
    """Aggregate: the lowest tier of a group; of nothing, the highest."""
    return F.coalesce(F.min(tier), F.lit(SYSTEM))


def glb_of(tiers: Column) -> Column:
    """The lowest of an array of tiers; of nothing, the highest."""
    return F.coalesce(F.array_min(tiers), F.lit(SYSTEM))


def downgrade(tier: Column, to: Column) -> Column:
    """``to``, which may not be above ``tier``."""
    return F.when(to <= tier, to).otherwise(F.raise_error(F.lit("a downgrade may only lower a tier")))


def declassify(tier: Column) -> Column:
    """The one raise there is: untrusted content, once extracted in quarantine."""
    return F.when(tier == UNTRUSTED, F.lit(QUARANTINE_DERIVED)).otherwise(
        F.raise_error(F.lit("only untrusted content is declassified by quarantine"))
    )


def merge_provenance(records: Column) -> Column:
    """Distinct by (source_uri, content_sha256): the first of each, in order."""
    key = lambda r: F.struct(r["source_uri"].alias("u"), r["content_sha256"].alias("h"))
    keyed = F.array_sort(F.transform(records, lambda r, i: F.struct(key(r).alias("k"), i.alias("i"))))
    # the first of each run of equal keys, back in order: n log n in the records

    def firsts(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(s, lambda e, i: (i == 0) | ~e["k"].eqNullSafe(F.get(s, i - 1)["k"])), lambda e: e["i"]))

    places = F.get(F.transform(F.array(keyed), firsts), F.lit(0))
    return F.transform(places, lambda i: F.get(records, i))


def union_in_order(*arrays: Column) -> Column:
    """Distinct elements, in the order they first appear."""
    return F.array_distinct(F.concat(*arrays))


def flags_of(records: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(records, lambda r: r["detector_flags"])))


def sources_of(records: Column) -> Column:
    return F.array_distinct(F.transform(records, lambda r: r["source_uri"]))


def citation_label(source_uri: Column, heading: Column, ordinal: Column, tier: Column) -> Column:
    """``uri (heading) [tier]``; a chunk without a heading is named by its place."""
    part = F.concat(F.lit("part "), (ordinal + 1).cast("string"))
    where = F.when(F.coalesce(heading, F.lit("")) != "", heading).otherwise(part)
    return F.concat(source_uri, F.lit(" ("), where, F.lit(") ["), tier_label(tier), F.lit("]"))
