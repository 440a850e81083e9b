"""Work that grows with its input and no faster: against plain versions, and on large cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import chunking, evaluation, taint

# ---------------------------------------------------------------- case folding


def test_case_folding_of_every_character(spark):
    every = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    rows = ["".join(every[k : k + 4096]) for k in range(0, len(every), 4096)] + ["", "plain ASCII", "Straße ﬃ İ ΣΑΣ", "\n", "A\nß"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").repartition(8)
    for r in df.select("t", text.casefold(F.col("t")).alias("c")).collect():
        assert r["c"] == r["t"].casefold()


# ---------------------------------------------------------------- chunks


def merged(pieces, most, overlap):
    out, held = [], ""
    for p in pieces:
        if held and len(held) + len(p) > most:
            out.append(held.strip())
            held = held[-overlap:] if overlap else ""
        held += p
    return [*out, held.strip()] if held.strip() else out


@pytest.mark.parametrize("overlap", [0, 3, 11])
def test_merging_equals_the_plain_fold(spark, overlap):
    rng = random.Random(overlap)
    rows = [["".join(rng.choices("ab é𝔸\n", k=rng.randint(1, 12))) for _ in range(n)] for n in (1, 2, 3, 40, 511, 512, 513, 1025, 1400)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, pieces array<string>")
    for r in df.select("id", chunking._merge(F.col("pieces"), 16, overlap).alias("c")).collect():
        assert r["c"] == merged(rows[r["id"]], 16, overlap)


def test_a_text_of_ten_megabytes(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(500)]
    sentences = [" ".join(rng.choices(words, k=12)) + ". " for _ in range(140_000)]
    whole = "".join(sentences)
    assert len(whole) > 10_000_000
    df = spark.createDataFrame([(1, whole)], "doc_id long, text string").cache()
    df.count()
    began = time.time()
    got = [r["chunk_text"] for r in chunking.chunk(df, chunking.Chunker(respect_headings=False)).select("ordinal", "chunk_text").orderBy("ordinal").collect()]
    assert time.time() - began < 60
    assert got == merged([*sentences[:-1], sentences[-1].strip()], 2048, 256)


# ---------------------------------------------------------------- attribution


def args_of(*values):
    return [(f"a{k}", v, True, [v]) for k, v in enumerate(values)]


CALL = "conversation_id string, segment int, seq long, tool string, args array<struct<name:string,value:string,is_string:boolean,leaves:array<string>>>"
RECORD = "conversation_id string, segment int, seq long, source string, tier int, flags array<string>, norm string"


def attributed(spark, calls, records):
    rows = taint.attribute(spark.createDataFrame(calls, CALL), spark.createDataFrame(records, RECORD)).collect()
    return {(r["conversation_id"], r["segment"], r["seq"]): [(a["tier"], a["flags"], a["sources"]) for a in r["args"]] for r in rows}


def traced(call, records):
    conversation, segment, seq, _, args = call
    out = []
    for _, value, _, _ in args:
        hits = sorted((r[2], r[5], r[3], r[4]) for r in records if r[:2] == (conversation, segment) and r[2] < seq and r[6] and len(value) >= 4 and value in r[6])
        if hits:
            once = lambda xs: list(dict.fromkeys(xs))
            out.append((min(h[3] for h in hits), once(f for h in hits for f in h[1]), once(h[2] for h in hits)))
        else:
            out.append((3, [], ["session://user-turn"]))
    return out


@pytest.mark.parametrize("most", [1_000, 3])
def test_attribution_equals_looking_everywhere(spark, monkeypatch, most):
    """Also with segments in many blocks; needles that contain, overlap and equal one another."""
    monkeypatch.setattr(taint.occurrences, "__defaults__", (most, most))
    rng = random.Random(most)
    piece = lambda n: "".join(rng.choices("ab c", k=n)).strip()
    flags = [[], ["x"], ["x", "y"], ["z"]]
    records = [("one", rng.randint(1, 2), s, f"tool:{rng.randint(0, 2)}", rng.randint(0, 2), rng.choice(flags), rng.choice([piece(60), piece(200), "", None])) for s in range(0, 120, 2)]
    records.append(("two", 1, 4, "tool:0", 0, ["x"], "abcab abcab"))
    calls = [("one", rng.randint(1, 2), s, "t", args_of(*[" ".join(piece(rng.randint(3, 6)).split()) for _ in range(rng.randint(0, 4))])) for s in range(1, 120, 2)]
    calls += [("two", 1, 4, "t", args_of("abcab")), ("two", 1, 5, "t", args_of("abcab", "abca", "abcab abcab", "cab", "")), ("three", 1, 1, "t", args_of("abcd"))]
    got = attributed(spark, calls, records)
    for call in calls:
        assert got[call[:3]] == traced(call, records), call
    assert sum(tier < 3 for found in got.values() for tier, _, _ in found) > 20


def test_ten_thousand_outputs_and_calls_in_one_segment(spark):
    """Each call's text stands in the output just before it, and one text in every output."""
    n = 10_000
    records = [("c", 1, 2 * k, f"tool:{k % 3}", 0, ["x"] if k % 3 else [], f"shared words and value {k:06d} of many " * 5) for k in range(n)]
    calls = [("c", 1, 2 * k + 1, "t", args_of(f"value {k:06d}", "shared words", f"value {k + 1:06d}")) for k in range(n)]
    began = time.time()
    got = attributed(spark, calls, records)
    assert time.time() - began < 60
    for k in (0, 1, 2, 5, n - 1):
        flags = ["x"] if k % 3 else []
        everyone = [f"tool:{j}" for j in range(min(k, 2) + 1)]
        assert got["c", 1, 2 * k + 1] == [(0, flags, [f"tool:{k % 3}"]), (0, ["x"] if k else [], everyone), (3, [], ["session://user-turn"])]


# ---------------------------------------------------------------- bootstrap


def replicates(spark, kinds, resamples, **more):
    df = spark.createDataFrame(kinds, "n long, sa long, sb long, times long")
    return np.array([tuple(r) for r in evaluation.drawn_sums(df, resamples, 7, **more).orderBy("replicate").collect()])


def test_two_clusters_are_drawn_as_coins_fall(spark):
    got = replicates(spark, [(1, 0, 0, 1), (1, 0, 1, 1)], 20_500)
    assert got[:, 0].tolist() == list(range(20_500)) and set(got[:, 1]) == {2}
    share = np.bincount(got[:, 3]) / len(got)
    assert share == pytest.approx([0.25, 0.5, 0.25], abs=0.015)


@pytest.mark.parametrize("block_kinds", [4096, 7])
def test_draws_have_the_moments_of_a_multinomial(spark, block_kinds):
    """In one block and in many; every draw falls somewhere, whatever the blocks."""
    rng = random.Random(3)
    kinds = [(10, k % 11, (k * k) % 11, rng.randint(1, 5)) for k in range(60)]
    kinds = list({k[:3]: k for k in kinds}.values())
    each = np.repeat(np.array([k[:3] for k in kinds]), [k[3] for k in kinds], axis=0)
    got = replicates(spark, kinds, 6_000, block_kinds=block_kinds)
    assert set(got[:, 1]) == {10 * len(each)}
    difference = each[:, 2] - each[:, 1]
    drawn = got[:, 3] - got[:, 2]
    spread = difference.std() * len(each) ** 0.5
    assert drawn.mean() == pytest.approx(difference.sum(), abs=5 * spread / 6_000**0.5)
    assert drawn.std() == pytest.approx(spread, rel=0.05)
    assert (replicates(spark, kinds[::-1], 6_000, block_kinds=block_kinds) == got).all()


def test_a_million_clusters(spark):
    df = spark.range(3_000_000).select((F.col("id") / 3).cast("long").alias("cluster"), (F.xxhash64("id") % 2 == 0).alias("a"), (F.xxhash64("id", F.lit(1)) % 3 == 0).alias("b"))
    began = time.time()
    r = evaluation.cluster_bootstrap(df, 10_000).first()
    assert time.time() - began < 60 and r["n_clusters"] == 1_000_000 and r["n_pairs"] == 3_000_000
    rates = df.groupBy("cluster").agg(F.sum(F.col("b").cast("int") - F.col("a").cast("int")).alias("d")).agg(F.stddev_pop("d").alias("s")).first()["s"]
    wide = 1.96 * rates / 3 / 1_000_000**0.5
    assert r["low"] == pytest.approx(r["point"] - wide, abs=wide * 0.06) and r["high"] == pytest.approx(r["point"] + wide, abs=wide * 0.06)
