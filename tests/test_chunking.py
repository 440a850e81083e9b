"""What chunks must be, on random texts, and outputs worked out by hand."""

import random

import pytest

from corvane.functions.text import CHARS_PER_TOKEN
from corvane.operators import chunking


def chunked(spark, texts, config):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {k: [] for k in range(len(texts))}
    for r in chunking.chunk(df, config).orderBy("doc_id", "ordinal").collect():
        got[r["doc_id"]].append((r["ordinal"], r["chunk_text"]))
    assert all([o for o, _ in rows] == list(range(len(rows))) for rows in got.values())
    return [[c for _, c in got[k]] for k in range(len(texts))]


def random_texts(seed, n=150):
    rng = random.Random(seed)
    bits = ["a", "bb", "word", ". ", "! ", "? ", "; ", ", ", " ", "\n", "\n\n", "longerword", "x" * 40, "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def visible(text):
    return "".join(text.split())


@pytest.mark.parametrize("tokens", [4, 8, 25])
def test_without_overlap_chunks_hold_the_text_in_order_and_within_bounds(spark, tokens):
    texts = random_texts(tokens)
    for text, chunks in zip(texts, chunked(spark, texts, chunking.Chunker(tokens, 0, respect_headings=False))):
        assert visible("".join(chunks)) == visible(text)
        assert all(len(c) <= tokens * CHARS_PER_TOKEN and c == c.strip() for c in chunks)
        if len(text.strip()) <= tokens * CHARS_PER_TOKEN:
            assert chunks == ([text.strip()] if text.strip() else [])


@pytest.mark.parametrize(("tokens", "overlap"), [(8, 2), (16, 4)])
def test_overlap_begins_a_chunk_with_the_end_of_the_one_before(spark, tokens, overlap):
    texts = [t for t in random_texts(99 + tokens) if t.strip()]
    plain = chunked(spark, texts, chunking.Chunker(tokens, 0, respect_headings=False))
    for text, alone, chunks in zip(texts, plain, chunked(spark, texts, chunking.Chunker(tokens, overlap, respect_headings=False))):
        assert all(len(c) <= (tokens + overlap) * CHARS_PER_TOKEN for c in chunks)
        assert visible(chunks[0])[:1] == visible(text)[:1] and visible(chunks[-1])[-1:] == visible(text)[-1:]
        assert len(chunks) >= len(alone)
        for before, after in zip(chunks, chunks[1:]):
            shared = max((k for k in range(len(after) + 1) if visible(before).endswith(visible(after[:k]))), default=0)
            assert shared > 0 or not visible(before)


def test_outputs_worked_by_hand(spark):
    config = chunking.Chunker(4, 1, respect_headings=False)  # at most 16 characters, 4 of them repeated
    texts = ["one two. three four. five", "para one\n\npara two is long", "abcdefghijklmnopqrst", "  \n ", "short"]
    want = [
        ["one two.", "wo. three four.", "ur. five"],  # cut after sentences; ". " stays with what it ends
        ["para one", "ne\n\npara two is long"],  # cut at the paragraph only; what is repeated comes on top
        ["abcdefghijklmnop", "mnopqrst"],  # nothing to cut at: cut hard
        [],
        ["short"],
    ]
    assert chunked(spark, texts, config) == want


def test_sections(spark):
    text = "before\n# Top\n## Sub one\nbody one\n  ### Deep ###\n\nbody two\n#nospace\n"
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, "# only\n\n# heads\n")], "doc_id long, text string")
    got = {r["doc_id"]: [] for r in df.collect()}
    for r in chunking.chunk(df).orderBy("doc_id", "ordinal").collect():
        got[r["doc_id"]].append((r["ordinal"], r["heading"], r["chunk_text"]))
    assert got[1] == [(0, "", "before"), (1, "Sub one", "body one"), (2, "Deep ###", "body two\n#nospace")]
    assert got[2] == [(0, "", "no heading")] and got[3] == []


def test_settings_are_checked():
    for bad in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            chunking.Chunker(*bad)
