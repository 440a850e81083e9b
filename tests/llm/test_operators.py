"""Operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import graph, line_dedup, lm_scoring, mixing, near_dedup, ngram_trie, packing, quality_rules, sharding, toxicity, vector_search, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string"
WORDS = "alpha beta gamma delta river stone cloud maple seven lantern orbit quartz velvet ember falcon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts with every odd case: nulls, blanks, copies, near copies, a long one."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    near = []
    for b in base[:4]:
        w = b.split()
        w[60] = "changed"
        near.append(" ".join(w))
    lines = ["\n".join(["A line that several documents share, word for word.", base[k]]) for k in range(3)]
    lines.append("A line that several documents share, word for ward.\nand one more line that nobody else has at all")
    odd = [None, "", "   \n\t ", "one", "one two three", "word " * 400, prose(rng, 6000), "x" * 5000, "é ü ß – “quoted”  twice\x0b\x0cspaced"]
    every = base + near + lines + odd + [base[0], base[0], None]
    return list(enumerate(every))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "big" if i % 3 else f"s{i % 5}", 1, "clash", "clash") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def split(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_quality_counts_match_brute_force(docs, texts, empty):
    got = {r["doc_id"]: r for r in quality_rules.assess(docs).collect()}
    for i, t in texts:
        words = split(t)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = Counter(grams)
        covered = {p for k, g in enumerate(grams) if many[g] > 1 for p in (k, k + 1, k + 2)}
        full = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["source"] is not None and (r["clean_text"] is None) == (t is None)
    assert quality_rules.assess(empty).count() == 0


def test_quality_verdict_removes_lines_first(spark):
    rng = random.Random(1)
    good = prose(rng, 80)
    nav = "Home | News | About | Contact | Help"
    rows = [(0, f"{nav}\n{good}"), (1, f"{good}\n" + "\n".join(["a*** b$$$ c### d%%% e&&& f***"] * 40)), (2, good)]
    got = {r["doc_id"]: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == good and got[0]["n_removed_lines"] == 1
    assert not got[1]["kept"] and got[2]["kept"] and got[2]["clean_text"] == good


def test_boilerplate_fails_short_lines_and_whole_words_only(spark):
    rng = random.Random(12)
    good = prose(rng, 90)
    texts = [
        good + " the cookie recipe holds the copyright notice of my javascript book " + prose(rng, 60),
        f"{good}\nThe catalog in the dialog informs a blog in print",
        f"{good}\nWe use cookies. Log in or sign up",
        f"{good}\n" + "click here to read more, subscribe now! " * 4,
        f"{good}\nCOPYRIGHT 2020",
    ]
    got = {r["doc_id"]: r for r in quality_rules.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i]["kept"] for i in range(5))
    assert [got[i]["clean_text"] for i in range(5)] == [texts[0], texts[1], good, good, good]


def test_sharding_is_balanced_and_keeps_copies_together(docs, texts, empty):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(texts)
    by_text, sizes, slots = {}, Counter(), {}
    lookup = dict(texts)
    for r in got:
        t = (lookup[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
        by_text.setdefault(t, set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(4))
    assert sharding.shard(empty, 4).count() == 0


def brute_lines(rows, least=30):
    seen, out = [], {}
    for i, t in rows:
        keep = []
        for line in [] if t is None else t.split("\n"):
            s = line.strip(" \t\n\x0b\x0c\r")
            gone = False
            if len(s) >= least:
                gone = any(near_edit(s, o) for o in seen)
                seen.append(s)
            if not gone:
                keep.append(line)
        out[i] = None if t is None else "\n".join(keep)
    return out


def near_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def test_line_dedup_matches_brute_force(spark, docs, texts, empty):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == brute_lines(texts)
    rng = random.Random(3)
    seed = ["".join(rng.choice("ab ") for _ in range(rng.choice([30, 31, 64, 300]))) for _ in range(12)]
    rows = []
    for k in range(60):
        s = list(rng.choice(seed))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(s))
            rng.choice([lambda: s.insert(at, "c"), lambda: s.pop(at), lambda: s.__setitem__(at, "d")])()
        rows.append((k, "".join(s)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert line_dedup.dedup(empty).count() == 0


def test_lines_of_any_length_are_held_against_each_other(spark):
    rng = random.Random(11)
    rows = [(k, "\n".join("".join(rng.choice("ab é語😀") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(4)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "x\ny\n\nzz"), (103, "long " * 40 + "1\n" + "long " * 40 + "2")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=1).collect()}
    assert got == brute_lines(rows, 1)


def test_short_lines_drop_exact_copies(spark):
    import corpus_pipeline

    long = "A line that is longer than thirty characters, number "
    texts = ["Home\n" + long + "one", "Home \n\nhome\n" + long + "two\nHome", None, "\n\n" + long + "ten", "短い文です。\n", "短い文です。\nHome\nHone", "Home"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [texts[0], "\nhome\n" + long + "two", None, "\n" * 2 + long + "ten", texts[4], "Hone", ""]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, exact_chars=1).collect()}
    assert got == dict(enumerate(want))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert kept == {i: t for i, t in got.items() if i != 6}


def brute_components(rows, percent=85):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_near_dedup_matches_brute_force(spark, docs, texts, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(docs).collect()}
    assert got == brute_components(texts)
    # a large group of near copies goes through deep nodes
    rng = random.Random(9)
    base = prose(rng, 200).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(200)] = f"new{k}"
        rows.append((k, " ".join(w)))
    cfg = near_dedup.NearDedup(small=4, depth=5, block=8, medium=12)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert near_dedup.near_components(empty).count() == 0


def test_components_by_stars_and_in_one_task(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in graph.components(df).collect()}
    stars = {tuple(r) for r in graph.components(df, one_task=0).collect()}
    assert one == stars and (130, 100) in one


def test_warc_round_trip(spark, tmp_path):
    html = "<html>" + "body " * 40 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</html>"
    rows = [(0, "http://a.example/x", html, "c"), (1, "http://b.example/", html, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "short", "c"), (5, "u", "short", "c"), (None, "u", "ü" * 60, "c"), (1, "u", html, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r)[:5] for r in warc.round_trip(pages, f"file://{tmp_path}/w").collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = h == html and i != 0
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 0 if again else None))
    assert got == sorted(want, key=str)
    records = warc.read_archives(spark, f"file://{tmp_path}/w").cache()
    ids = {r["record_id"] for r in records.collect()}
    told = [r["refers_to"] for r in records.where("record_type = 'revisit'").collect()]
    assert told and set(told) <= ids and records.where("intact").count() == 3 * len(rows)
    warc.write_archives(pages, f"file://{tmp_path}/again")
    assert {r["record_id"] for r in warc.read_archives(spark, f"file://{tmp_path}/again").collect()} == ids
    whole = warc.assemble(records)
    row = whole.where("record_type = 'response' and capture.payload_bytes > 200 and target_uri like 'http://a%'").first()
    assert row["capture"]["payload"].decode() == html and row["request"]["target_uri"] == row["metadata"]["target_uri"]
    assert warc.round_trip(pages.limit(0)).count() == 0
    warc.write_archives(pages, f"file://{tmp_path}/z", compression="gzip")
    assert warc.read_archives(spark, f"file://{tmp_path}/z").where("intact").count() == 3 * len(rows)


def test_trie_and_elias_fano(monkeypatch):
    rng = np.random.default_rng(0)
    for universe in (10, 1000, 1 << 44):
        v = np.sort(rng.integers(0, universe, 500).astype(np.uint64))
        ef = ngram_trie.EliasFano.of(v, universe)
        assert (ef.decode() == v).all() and (ef.get(np.arange(500)) == v).all()
    pairs = np.unique(rng.integers(0, 1 << 18, 3000).astype(np.uint64))
    c, s = pairs >> np.uint64(10), pairs & np.uint64(1023)
    count = rng.integers(1, 900, len(pairs))
    trie = ngram_trie.Trie.of(c, s, count, 8, 10).mapped()
    for n in (20, len(pairs)):
        assert (trie.lookup(c[:n], s[:n]) == count[:n]).all()
    calls = []
    monkeypatch.setattr(ngram_trie, "STRIDE", 64)
    monkeypatch.setattr(ngram_trie.EliasFano, "between", lambda self, lo, hi, real=ngram_trie.EliasFano.between: calls.append((lo, hi)) or real(self, lo, hi))
    some = rng.permutation(len(pairs))[:400]
    assert (trie.lookup(c[some], s[some]) == count[some]).all()
    assert len(calls) > 10 and all(hi - lo <= 64 + 24 for lo, hi in calls)  # ranges, never the whole level
    assert (trie.successors.between(5, 9) == trie.successors.decode()[5:9]).all()
    missing = np.setdiff1d(np.arange(1 << 12).astype(np.uint64), pairs)
    assert (trie.lookup(missing >> np.uint64(10), missing & np.uint64(1023)) == 0).all()
    big = np.array([1024, 5000, 10**6])
    assert np.abs(ngram_trie.dequantise(ngram_trie.quantise(big)) / big - 1).max() < 0.003


def test_language_model_matches_brute_force(docs, texts, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, held).collect()}
    seqs = {i: [w.lower() if w.isascii() else w for w in (t or "").encode().lower().decode().encode().split()] + [b" e"] for i, t in texts}
    uni, bi = Counter(), Counter()
    for i, w in seqs.items():
        if zlib.crc32(str(i).encode()) % 10:
            uni.update(w)
            bi.update(zip([b" s"] + w, w))
    n, v = sum(uni.values()), len(uni)
    uni[b" s"] = uni[b" e"]
    p1 = lambda x: (uni[x] + 0.1) / (n + 0.1 * (v + 1))
    fits = []
    for k in lm_scoring.STRENGTHS:
        total = {i: sum(math.log10((bi[a, b] + k * p1(b)) / (uni[a] + k)) for a, b in zip([b" s"] + w, w)) for i, w in seqs.items()}
        fits.append(max(abs(total[i] - got[i]["score"]) for i in seqs))
    assert min(fits) < 1e-6
    for i, w in seqs.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10(p1(x)) for x in w)) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert lm_scoring.score(empty, held).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_tokens_equal_the_library(vocabulary, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    own = packing.Tokens(vocabulary)
    odd = ["a  b   c\n\n d\t e", " leading and trailing  ", "don't we'll  it's 'quoted' 12 345", "x y   z", "end <|endoftext|> here", "<|endoftext|><|endoftext|> a b c d<|endoftext|>", "a b c <|endoftext|>\n\n  d <|endofte", "\n\n\n", "tab\tand \r\n windows"]
    for text in [t or "" for _, t in texts] + odd:
        assert np.frombuffer(own.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_places_every_token_once(docs, texts, vocabulary, empty):
    rows = packing.pack(docs, vocabulary, 256).collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    own = packing.Tokens(vocabulary)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        ids = np.append(np.frombuffer(own.of(t or ""), "<u4"), 0).astype("<u4")
        got = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == [sum(x["length"] for x in got[:k]) for k in range(len(got))]
        assert sum(r["length"] for r in got) == len(ids) and all(r["length"] == 256 for r in got[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got)
    total = sum(r["length"] for r in rows)
    assert len(used) <= math.ceil(total / 256) + 2
    assert packing.pack(empty, vocabulary).count() == 0


def test_packing_plan_covers_the_histogram():
    rng = np.random.default_rng(4)
    histogram = dict(Counter(int(x) for x in rng.integers(1, 513, 20_000)))
    plan = packing.solve(histogram, 512)
    made = Counter()
    for config, n in plan:
        assert sum(s * c for s, c in config.items()) <= 512
        for s, c in config.items():
            made[s] += c * n
    assert made == Counter(histogram)
    assert sum(n for _, n in plan) <= math.ceil(sum(s * n for s, n in histogram.items()) / 512) * 1.01


def test_packing_returns_the_rounded_lp_plan():
    rng = np.random.default_rng(6)
    for pieces, capacity, most in ((20_000, 512, 1.01), (300, 128, 1.05)):
        histogram = dict(Counter(int(x) for x in rng.integers(1, capacity, pieces)))
        demand = np.zeros(capacity + 1, dtype=np.int64)
        for s, n in histogram.items():
            demand[s] = n
        uses = packing.relaxed(demand, capacity, 4000, 4.0)
        covered = Counter()
        for key, use in uses:
            assert sum(s * c for s, c in key) <= capacity and all(c <= demand[s] for s, c in key)
            for s, c in key:
                covered[s] += c * use
        assert all(covered[s] >= n - 1e-9 for s, n in histogram.items())
        plan = packing.solve(histogram, capacity)
        chosen = {key for key, _ in uses}
        by_lp = sum(n for config, n in plan if tuple(sorted(config.items())) in chosen)
        total = sum(n for _, n in plan)
        assert by_lp > total / 2
        assert total <= math.ceil(sum(s * n for s, n in histogram.items()) / capacity) * most


def test_search_is_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)] + [(300 + k, base[7].tolist(), "x") for k in range(9)]
    rows += [(400, None, "x"), (401, [], "x"), (402, [0.0] * 16, "x"), (403, [float("nan")] * 16, "x"), (404, [1.0, None] + [0.0] * 14, "x"), (405, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in vector_search.search(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v, float) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    for q in [i for i in good if i % 50 == 0]:
        scores = {i: float((good[q] * v).sum() / (np.sqrt((good[q] ** 2).sum()) * np.sqrt((v**2).sum()))) for i, v in good.items() if i != q}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert [x[1] for x in sorted(got[q])] == want
        assert all(abs(s - scores[i]) < 1e-12 for _, i, s in got[q])
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


def test_search_counts_repeated_ids_once(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    close = base[0] + rng.normal(size=8) / 100
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(40, close.tolist())] * 7
    rows += [(41, (close * 2**k * 1.5).tolist()) for k in range(7)] + [(0, base[0].tolist())] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in vector_search.search(df, df.where("vec_id = 0"), 5).collect())
    best = {}
    for i, v in rows:
        v = np.array(v)
        best[i] = float((base[0] * v).sum() / (np.sqrt((base[0] ** 2).sum()) * np.sqrt((v**2).sum())))
    want = sorted((i for i in best if i), key=lambda i: (-round(best[i], 9), i))[:5]
    assert {i for _, i in got} == set(want) and len(got) == 5


def test_mixing_meets_budgets(docs, spark, empty):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randrange(5, 40)), "hot" if k % 3 else f"s{k % 4}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, sources = mixing.spread(df, mixing.Mix(target_entropy=0.95, max_repeat=4.0))
    got = plan.collect()
    assert len(got) == 600
    weights = {r["source"]: r["weight"] for r in got}
    blocks = sources.select("source", "blocks")
    order = df.join(blocks, "source").select("doc_id", "source", mixing.order_of("doc_id", 7, F.col("blocks")).alias("place")).collect()
    assert abs(sum(weights.values()) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    assert abs(entropy - 0.95) < 0.01
    for s in weights:
        mine = [r for r in got if r["source"] == s]
        taken = sum(r["copies"] * r["n_tokens"] for r in mine)
        assert 0 <= taken - mine[0]["budget"] <= max(r["n_tokens"] for r in mine)
        # brute force: whole passes, then documents in the permutation's order until the budget is spent
        left, place = mine[0]["budget"], {r["doc_id"]: r["place"] for r in order if r["source"] == s}
        want, total = Counter(), sum(r["n_tokens"] for r in mine)
        for r in mine:
            want[r["doc_id"]] += left // total
        left %= total
        for r in sorted(mine, key=lambda r: tuple(place[r["doc_id"]])):
            if left > 0:
                want[r["doc_id"]] += 1
            left -= r["n_tokens"]
        assert {r["doc_id"]: r["copies"] for r in mine} == dict(want)
    once = mixing.apply(df, mixing.Mix(max_repeat=1.0, budget=None))
    assert once.count() == once.select("doc_id").distinct().count() and once.columns == df.columns
    assert mixing.apply(docs, mixing.Mix()).columns == docs.columns
    assert mixing.apply(empty, mixing.Mix()).count() == 0


def test_a_stray_source_does_not_shrink_the_mix(spark):
    rows = [(k, "a b c d e f g h i", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(3000)] + [(3000, "a b", "stray"), (3001, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, sources = mixing.spread(df, mixing.Mix(target_entropy=0.95, max_repeat=1.0, budget=None))
    got = plan.collect()
    assert {r["copies"] for r in got} == {0, 1}
    assert sum(r["copies"] * r["n_tokens"] for r in got) >= 0.899 * sum(r["n_tokens"] for r in got)
    parts = {r["source"]: (r["budget"], r["tokens"]) for r in sources.collect()}
    assert all(0 < b <= n for b, n in parts.values()) and parts["hot"][0] > 0.7 * parts["hot"][1]


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        words = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(50)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(50)] = rng.choice(["idiot", "scumbag", "vexolo" + rng.choice("abc"), "moron."])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic) if k % 7 else None))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, marks, F.col("doc_id") % 3 != 1).collect()}
    assert len(scored) == 902 and scored[1000] == scored[1001] < 0.2
    held = [k for k in range(900) if k % 3 == 1]
    right = sum((scored[k] >= 0.7) == (k % 5 == 0) for k in held)
    assert right / len(held) > 0.97
    none = toxicity.score(docs, marks.where("toxic is null"), F.lit(True)).collect()
    assert len(none) == 902
    assert toxicity.score(empty, marks, F.lit(True)).count() == 0


def test_near_dedup_of_a_group_that_is_not_all_linked(spark):
    """Copies with one to ten changed words: most pairs lie under the threshold, in large nodes."""
    rng = random.Random(21)
    base = prose(rng, 150).split()
    rows = []
    for k in range(260):
        w = list(rows[rng.randrange(len(rows))][1].split()) if k % 3 == 2 else list(base)
        for _ in range(rng.randrange(1, 11)):
            w[rng.randrange(150)] = f"new{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    want = brute_components(rows)
    for cfg in (near_dedup.NearDedup(), near_dedup.NearDedup(small=24, depth=7, block=16, medium=40)):
        got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 10 < len({c for _, c in want.values()}) < 260


def test_a_huge_page_has_its_own_file(spark, tmp_path):
    rows = [(k, "http://a/", "short page") for k in range(200)] + [(500, "http://b/", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/big")
    sizes = sorted(f.stat().st_size for f in (tmp_path / "big").glob("part-*"))
    assert len(sizes) == 2 and warc.round_trip(pages).count() == 201


def test_an_id_with_two_vectors_counts_once(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (1, [1.0, 0.1, 0.0]), (1, [0.0, 0.0, 1.0]), (2, [0.1, 1.0, 0.0]), (3, [1.0, 1.0, 1.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in vector_search.search(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()]
    best = round(1 / 1.01**0.5, 6)
    assert got == [(1, 1, best), (2, 2, best), (3, 3, round(3**-0.5, 6))]


def test_search_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_search, "ROW_BLOCK", 20)
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(120, 3)), 1)  # coarse, so that scores tie across tiles
    base[np.abs(base).sum(axis=1) == 0] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(5, base[5].tolist())] * 6, "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(df, df.where("vec_id % 4 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 120, 4):
        x, y = np.repeat(base[q : q + 1], 120, axis=0), base
        scores = vector_search.exact_cosine(x, y)
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert [i for _, i, _ in sorted(got[q])] == want


def test_packing_beats_best_fit_where_the_plan_does():
    k = 100  # six halves, two kinds of quarters: best-fit fills 11 where 9 do
    histogram = {501: 6 * k, 252: 6 * k, 251: 6 * k, 248: 12 * k}
    demand = np.zeros(1001, dtype=np.int64)
    for s, n in histogram.items():
        demand[s] = n
    greedy = sum(n for _, n in packing.best_fit(demand, 1000))
    plan = sum(n for _, n in packing.solve(histogram, 1000))
    assert greedy == 11 * k and 9 * k <= plan <= 9.5 * k


@pytest.mark.parametrize("seed", range(4))
def test_packing_takes_no_more_sequences_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    for capacity, sizes in ((128, rng.integers(1, 128, 300)), (512, np.clip(rng.lognormal(5, 1, 4000), 1, 511).astype(int))):
        histogram = dict(Counter(int(x) for x in sizes))
        demand = np.zeros(capacity + 1, dtype=np.int64)
        for s, n in histogram.items():
            demand[s] = n
        assert sum(n for _, n in packing.solve(histogram, capacity)) <= sum(n for _, n in packing.best_fit(demand, capacity))


def test_packing_is_near_the_optimum_of_small_histograms():
    def fewest(sizes, capacity):
        best = [len(sizes)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                    place(k + 1, bins[:b] + [bins[b] + sizes[k]] + bins[b + 1 :])
            place(k + 1, bins + [sizes[k]])

        place(0, [])
        return best[0]

    rng = random.Random(14)
    for _ in range(12):
        sizes = sorted((rng.randrange(2, 20) for _ in range(11)), reverse=True)
        made = sum(n for _, n in packing.solve(dict(Counter(sizes)), 20))
        assert fewest(sizes, 20) <= made <= fewest(sizes, 20) + 1


def test_shards_are_near_equal(spark):
    rng = random.Random(15)
    rows = [(k, "x" * rng.choice([rng.randrange(400), rng.randrange(4000)]), "en" if k % 3 else "de", "hot" if k % 2 else f"s{k % 7}") for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 10).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 10
    assert len(sizes) == 10 and all(abs(w - mean) < 0.01 * mean for w in sizes.values())
    assert sharding.shard(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string"), 10).count() == 6000


INTERNAL = (
    "_id", "dropped", "_lines", "_t", "_w", "_l", "_g", "_row", "_some", "_copies", "_n", "_part", "_gone", "_key", "taken", "row", "kept", "n_words", "n_lines",
    "n_dropped", "clean_text", "toxic", "score", "node", "key", "label", "component_id", "place", "copies", "weight", "salt", "id", "sequence_id", "length", "rank",
)


def test_columns_may_have_any_name(spark):
    """Every operator and stage, on a table that has a column for every internal or output name."""
    import corpus_pipeline

    rng = random.Random(17)
    names = [*INTERNAL, "a.b", "with space"]
    rows = [(k, prose(rng, 60) if k else None, "en", f"s{k % 2}", 1, *[f"own{k}"] * len(names)) for k in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    assert sharding.shard(df, 2).count() == 6 and toxicity.score(df, marks, F.lit(True)).count() == 6
    assert near_dedup.near_components(df).count() == 6 and lm_scoring.score(df, F.col("doc_id") == 1).count() == 6
    assert mixing.spread(df, mixing.Mix())[0].count() == 6
    for out in (line_dedup.dedup(df), quality_rules.assess(df), quality_rules.keep(df), mixing.apply(df, mixing.Mix()), near_dedup.deduplicated(df)):
        left = {r["doc_id"]: r for r in out.collect()}
        assert all(r["a.b"] == f"own{k}" and r["_id"] == f"own{k}" for k, r in left.items()) and len(left) >= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        assert all(r[n] == f"own{r['doc_id']}" for r in out.collect() for n in names)
    assert corpus_pipeline.pack(spark, df, "").count() == 6


CLEAN_BY_LANGUAGE = {
    "en": "The council met late on Tuesday.\nIt heard from the harbour master, who wants a copyright on the tide tables.\nNobody agreed",
    "de": "Der Rat tagte am Dienstag bis spät in die Nacht.\nIm Impressumsrecht ist vieles offen, sagte die Leiterin nach der Sitzung.\nEs blieb ruhig",
    "fr": "Le conseil a siégé mardi soir.\nLa directrice veut en savoir plus sur le port avant de voter le budget de la ville et de ses quais.\nOui",
    "es": "El consejo se reunió el martes.\nLa directora quiere leer más informes sobre el puerto antes de votar el presupuesto de la ciudad vieja.\nSí",
}
JUNK_BY_LANGUAGE = {
    "en": "Click here to log in",
    "de": "Klicken Sie hier • Alle Rechte vorbehalten",
    "fr": "Tous droits réservés - Mentions légales",
    "es": "Todos los derechos reservados. Aviso legal",
}


def test_quality_rules_in_four_languages(spark):
    rng = random.Random(31)
    rows = []
    for k, lang in enumerate(CLEAN_BY_LANGUAGE):
        body = f"{CLEAN_BY_LANGUAGE[lang]}\n{prose(rng, 60)}."
        rows += [(10 * k, body), (10 * k + 1, f"{JUNK_BY_LANGUAGE[lang]}\n{body}"), (10 * k + 2, "Home\nNews\nContact us\nSearch\nSite map\n" + body)]
    rows.append((99, f"Home\nNews\n\nSearch\nHelp\n{prose(rng, 60)}."))  # a blank line ends a run
    got = {r["doc_id"]: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(4):
        body = rows[3 * k][1]
        assert [got[10 * k + j]["clean_text"] for j in range(3)] == [body] * 3
        assert all(got[10 * k + j]["kept"] for j in range(3))
    assert got[99]["clean_text"] == rows[-1][1]


def test_a_registered_mix_moves_weights(spark):
    from corvane.llm import queries

    rows = [(k, "a b c d e f g h i", f"s{k % 20}" if k % 3 else "s0") for k in range(3000)]
    got = mixing.spread(spark.createDataFrame(rows, "doc_id long, text string, source string"), queries.MIX)[0].collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["n_tokens"]
    assert max(taken.values()) <= 1.1 * min(taken.values()) and len({r["copies"] for r in got}) >= 2
    assert abs(sum(taken.values()) - 1.5 * sum(r["n_tokens"] for r in got)) < 0.01 * sum(taken.values())
