import numpy as np

from corvane.operators import ingest, retrieval, scenarios
from corvane.sources import policy as policies


def test_every_mismatch_is_told(spark):
    kinds = "k string, refused boolean, codes array<string>, tainted array<string>, detection string"
    told = [
        ("same", True, ["a", "a"], ["to"], "clean"), ("open", None, None, None, None), ("codes", True, ["a"], [], None), ("order", None, ["a", "b"], None, None),
        ("none", True, [], [], None), ("twice", False, [], [], None), ("twice", False, [], [], None), ("seen", None, None, None, "malicious"), (None, True, None, None, None),
    ]
    seen = [
        ("same", True, ["a", "a"], ["to"], "clean"), ("open", True, ["x"], [], None), ("codes", False, ["a", "a"], ["to"], None), ("order", True, ["b", "a"], [], None),
        ("twice", False, [], [], None), ("seen", True, [], [], None), ("more", True, [], [], None), ("open", True, [], [], None), (None, False, [], [], None),
    ]
    rows = scenarios.verify(spark.createDataFrame(told, kinds), spark.createDataFrame(seen, kinds), ["k"]).collect()
    got = {r["k"]: r["mismatches"] for r in rows}
    assert got == {
        "same": [], "open": ["2 outcomes"], "codes": ["refused: expected true, got false", "codes: expected [a], got [a, a]", "tainted: expected [], got [to]"],
        "order": ["codes: expected [a, b], got [b, a]"], "none": ["no outcome"], "twice": ["told 2 times"], "seen": ["detection: expected malicious, got nothing"],
        "more": ["no expectation"], None: ["refused: expected true, got false"],
    }
    assert {r["k"] for r in rows if r["passed"]} == {"same"}
    nothing = spark.createDataFrame([], kinds)
    assert scenarios.verify(nothing, nothing, ["k"]).collect() == []


def test_dense_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [v.tolist() for v in rng.normal(size=(300, 8))]
    vectors = [(k, v) for k, v in enumerate(base)] + [(300 + k, base[3]) for k in range(9)] + [(400, [1e-200 * x for x in base[3]]), (401, [1e200 * x for x in base[3]])]
    odd = [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0, None] + [0.0] * 6), (505, [1.0, 2.0]), (506, [float("inf")] + [1.0] * 7), (507, [2.0, 1.0])]
    asked = [(k, base[k]) for k in range(0, 300, 29)] + [(900, base[3]), (901, [3.0, 1.0]), (902, None), (903, [0.0] * 8), (904, [-x for x in base[3]])]
    held = spark.createDataFrame(vectors + odd, "chunk_id long, embedding array<double>")
    batch = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    right = set()
    for q, v in asked:
        if not v or not np.any(v):
            continue
        near = []
        for c, w in vectors + odd[5:]:
            if w and len(w) == len(v) and np.all(np.isfinite(w)):
                x, y = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                near.append((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9), c))
        right |= {(q, c, k + 1) for k, (s, c) in enumerate(sorted(near)[:7]) if s < 0}
    for tile in ((4, 50), (1024, 16384)):
        got = retrieval.dense_top(held, batch, 7, tile=tile).collect()
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got} == right
    assert retrieval.dense_top(held.limit(0), batch, 3).collect() == [] and retrieval.dense_top(held, batch.limit(0), 3).collect() == []


def test_summary_of_a_batch(spark):
    schema, p = "text string, source_uri string, doc_id string", policies.load()
    first = spark.createDataFrame([("one", "kb://a", "a"), ("two", "https://b", "b")], schema)
    known = ingest.ingest(first, p)
    start = ingest.summary(first, p, known).first()
    assert tuple(start)[:5] == (2, 0, 0, 2, 0) and start["chunks_by_tier"] == {"T0_UNTRUSTED": 1, "T2_CURATED": 1}
    second = spark.createDataFrame([("one", "kb://a", "a"), ("two, new", "https://b", "b"), ("three", "https://c", "c"), ("three", "https://c", "c"), ("", "https://d", "d"), (None, "https://e", "e")], schema)
    batch = ingest.ingest(second, p, known.registry, known.chunks)
    row = ingest.summary(second, p, batch, known.registry).first()
    assert tuple(row)[:5] == (4, 1, 2, 2, 0) and row["chunks_by_tier"] == {"T0_UNTRUSTED": 2}
    lost = ingest.summary(first, p, ingest.ingest(first, p, None, known.chunks)).first()
    assert tuple(lost)[:5] == (2, 0, 0, 0, 2) and lost["chunks_by_tier"] == {}
    empty = ingest.summary(first.limit(0), p, ingest.ingest(first.limit(0), p)).first()
    assert tuple(empty)[:5] == (0, 0, 0, 0, 0) and empty["chunks_by_tier"] == {}
