"""The pipeline against brute force, stage by stage on each stage's own input."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_lines, prose

NOISE = "#*$%&|<>{}[]\\^~_=+@!"


def keeps(text):
    words = text.encode().split()
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = {}
    for g in grams:
        many[g] = many.get(g, 0) + 1
    covered = {p for k, g in enumerate(grams) if many[g] > 1 for p in (k, k + 1, k + 2)}
    lines = text.split("\n")
    fails = lambda x: 100 * sum(c in NOISE for c in x) > 10 * len(x) or "all rights reserved" in x.lower()
    size = lambda x: len("".join(x.split()))
    lost = sum(size(x) for x in lines if fails(x))
    good = len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and 100 * lost <= 30 * size(text)
    return "\n".join(x for x in lines if not fails(x)) if good else None


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for k in range(50):
        text = prose(rng, rng.randrange(40, 130))
        if k % 7 == 0 and k:
            text = rows[k - 1][1].replace(" ", "  ", 1)
        if k % 6 == 0:
            text = "This line is on many pages of the same site, again.\n" + text + "\nAll rights reserved by nobody."
        if k % 9 == 0:
            text = "*** ".join(text.split())
        rows.append((k, text, "en", "big" if k % 2 else f"s{k % 3}", len(text)))
    rows += [(60, None, None, None, None), (61, "", "en", "big", 0), (62, "w " * 80, "en", "big", 160)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return f"file://{path}"


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None)
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append(name)
        if k == 4:
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if k == 0:
            assert after == {i: c for i, t in before if (c := keeps(t)) is not None}
        elif k == 1:
            assert after == {i: c for (i, t), c in zip(before, brute_lines(before).values()) if c.split() or c == t}
        elif k == 2:
            assert set(after) == {i for i, (_, c) in brute_components(before).items() if c == i}
        else:
            assert set(after) <= {i for i, _ in before} and 0 < len(after) == docs.count()
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(after)
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r)[:5] for r in packed}
    assert seen == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
