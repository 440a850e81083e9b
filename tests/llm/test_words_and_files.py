"""Source divergence, spelling variants and token files against brute force, and on odd tables."""

import mmap
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import divergence, spelling, token_files
from corvane.llm.shared import cut

DOC = "doc_id long, text string, lang string, source string, n long, term string, word string, file string"
LOWER = str.maketrans(divergence.UPPER, divergence.UPPER.lower())


def table(spark, rows):
    """(doc_id, text, lang, source) rows with columns that clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "clash", "clash", "clash") for r in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    stems = ["lantern", "Lanterne", "orbital", "maple", "maples", "Éclair", "éclairs", "straße", "strasse", "quartz", "river", "rivér", "ÀÉ", "x"]
    word = lambda: rng.choice(stems) + rng.choice(["", "s", "a", "ß"]) * (rng.random() < 0.3)
    text = lambda n: " ".join(word() for _ in range(n))
    out = [(i, text(rng.randrange(30, 60)), rng.choice(["en", "de"]), "big" if rng.random() < 0.4 else rng.choice("abc")) for i in range(60)]
    out += [(60, None, "en", "a"), (61, "", None, None), (62, "  \n\t ", "de", "only-blank"), (63, text(8000), "en", "long"), (64, "12 345 - _", "fr", "digits")]
    out += [(None, text(40), "en", "a"), (70, "same text twice", "en", "a"), (70, "same text twice", "en", "a"), (71, "z" * 40_000 + " " + "z" * 40_000, "de", "big"), (72, "z" * 40_000, None, "big"), (73, "日本 <|endoftext|> ok", "ja", "a")]
    return out


def audit_by_hand(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))) for _, t, lang, source in rows]
    held = Counter((lang, w) for lang, _, ws in docs for w in set(ws))
    kept = defaultdict(list)
    for (lang, w), n in held.items():
        if n >= min_docs:
            kept[lang].append(w)
    counts = defaultdict(Counter)
    for lang, source, ws in docs:
        counts[lang, source].update(w for w in ws if held[lang, w] >= min_docs)
    share = lambda c, ws: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(ws)) for w in ws}
    shares = {g: share(c, kept[g[0]]) for g, c in counts.items()}
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for (lang, source), p in shares.items():
        pairs = [(-sum(apart(p[w], q[w]) for w in p), s) for (other, s), q in shares.items() if other == lang and s != source]
        whole = share(sum((c for g, c in counts.items() if g[0] == lang), Counter()), kept[lang])
        terms = [(-apart(p[w], whole[w]), w) for w in p if counts[lang, source][w] and p[w] > whole[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out |= {(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def test_divergence_matches_brute_force(spark, rows):
    got = divergence.audit(table(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audit_by_hand(rows)
    assert any(r[2] == "term" for r in found) and any(r[0] == "" for r in found)


def test_divergence_of_rare_words_and_of_nothing(spark, rows):
    """A language that keeps nothing has pairs of value 0; an empty table gives nothing."""
    few = [(1, "one two", "en", "a"), (2, "three", "en", "b"), (3, None, "en", None)]
    found = {tuple(r) for r in divergence.audit(table(spark, few)).collect()}
    assert found == audit_by_hand(few) and {r[4] for r in found} == {0} and len(found) == 6
    assert divergence.audit(table(spark, [])).collect() == []


def test_terms_are_counted_in_one_pass(spark, rows, monkeypatch):
    """op11: each term of a text was a row, twice, once for documents and once for occurrences; also in small parts of a batch."""
    monkeypatch.setattr(divergence, "COUNTED_BYTES", 3_000)
    seen = []
    monkeypatch.setattr(divergence, "cut", lambda df, label: seen.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, label))
    assert {tuple(r) for r in divergence.audit(table(spark, rows)).collect()} == audit_by_hand(rows)
    plans = dict(seen)
    assert plans["all-terms"].count("MapInArrow") == 1 and not any("Generate explode" in plans[x] for x in ("all-terms", "kept-terms", "term-counts"))


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 3_000_000_000_000, 7_000_000_000_001, 12_345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_by_hand(rows, min_chars=5, min_count=3):
    n = Counter()
    for ident, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    out, form = {}, {}
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(others), form[w], n.get(form[w])]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("shard_words", [20_000, 7])
def test_spelling_matches_brute_force(spark, rows, shard_words):
    """Also with halves that more words share than a task takes."""
    rng = random.Random(4)
    noise = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))) for _ in range(300)]
    more = rows + [(200 + k, " ".join(rng.choice(noise) for _ in range(60)), "en", "a") for k in range(40)]
    found = spelling.group(table(spark, more), shard_words=shard_words).collect()
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found}
    assert len(found) == len(got) and got == groups_by_hand(more)
    assert any(v[2] for v in got.values()) and any(v[4] != v[2] for w, v in got.items() if v[2])


def test_spelling_of_nothing(spark):
    assert spelling.group(table(spark, [])).collect() == []
    assert spelling.group(table(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "words once", "en", "a")])).collect() == []


def test_roots_follow_long_chains(spark):
    """Forty steps, more than any counts allow in practice."""
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(40)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w40" for w, _ in chain}


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(400)} | {"", "é", "éa"})
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words)))
    assert a.number("abcabcabc") is None and a.number("zz") is None
    kinds, left = set(), [0]
    while left:  # states by the words that they accept: no two alike
        s = left.pop()
        if s not in kinds:
            kinds.add(s)
            left += [t for t, _ in a.edges[s].values()]
    tails = lambda s: frozenset([""] * a.final[s] + [c + x for c, (t, _) in a.edges[s].items() for x in tails(t)])
    assert len({tails(s) for s in kinds}) == len(kinds)
    for w in words[::17]:
        for exact in (0, len(w) // 2):
            changed, longer = a.near(w, exact)
            assert {words[k] for k in changed} == {v for v in words if len(v) == len(w) and near(v, w) and v[:exact] == w[:exact]}
            assert {words[k] for k in longer} == {v for v in words if len(v) == len(w) + 1 and near(v, w) and v[:exact] == w[:exact]}


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack_bits(data, 1001, bits) == ids).all()
    assert (token_files.unpack_bits(data, 13, bits, 500) == ids[500:513]).all()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def by_library(rows, vocabulary, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    return [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t, *_ in rows]


@pytest.mark.parametrize("end", [2, 70_000])
def test_token_files_match_the_library(spark, rows, vocabulary, monkeypatch, end):
    """One file and many, blocks that documents straddle, 16 bits an id and 17."""
    mixed = random.Random(1).sample(rows, len(rows))
    want = by_library(mixed, vocabulary, end)
    for file_bytes in (token_files.FILE_BYTES, 4000):
        got = token_files.round_trip(table(spark, mixed).repartition(5), vocabulary, end, file_bytes=file_bytes).orderBy("start").collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want)
        order = [r["doc_id"] for r in got]
        assert order == sorted(order, key=lambda i: (i is not None, i))
        ends = np.cumsum([r["n_tokens"] for r in got])
        assert [r["start"] for r in got] == [0, *ends[:-1]]


def test_files_are_read_at_random(spark, rows, vocabulary, tmp_path):
    """Documents and spans from memory-mapped files, without the rest."""
    import glob

    token_files.write_files(table(spark, rows), f"file://{tmp_path}/ids", vocabulary, file_bytes=20_000)
    paths = [p for p in glob.glob(f"{tmp_path}/ids/part-*")]
    files = []
    for p in paths:
        with open(p, "rb") as f:
            files.append(token_files.TokenFile(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    files.sort(key=lambda f: f.number)
    assert len(files) > 1 and files[0].bits == 16 and sum(f.n_docs for f in files) == len(rows)
    want = {i: x for i, x in by_library(rows, vocabulary, 2)}
    for f in files:
        for k in random.Random(3).sample(range(f.n_docs), f.n_docs):
            if f.known[k]:
                assert (f.document(k) == want[int(f.doc_ids[k])]).all()
        assert (np.concatenate(list(f.documents())) == f.ids(0, f.n_ids)).all()
        assert (f.ids(3, 9) == f.ids(0, f.n_ids)[3:9]).all()
    size = os.path.getsize(paths[0])
    with open(paths[0], "rb") as f, pytest.raises(Exception):
        token_files.TokenFile(f.read(size // 2))


def test_documents_straddle_blocks(rows, vocabulary, monkeypatch):
    """A file whose blocks are shorter than its documents, 17 bits an id."""
    import pyarrow as pa

    monkeypatch.setattr(token_files, "BLOCK_IDS", 10)
    monkeypatch.setattr(token_files.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 7})()))
    want = [x for _, x in by_library(rows, vocabulary, 70_000)]
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([r[1] for r in rows], pa.string())]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "text"])
    parts = token_files.writer(vocabulary, 70_000)(iter([batch.slice(0, 20), batch.slice(20)]))
    file = token_files.TokenFile(b"".join(part.column(0)[0].as_py() + b"\n" for part in parts))
    assert (file.number, file.bits, file.n_ids) == (7, 17, sum(map(len, want))) and file.n_blocks == -(-file.n_ids // 10)
    assert file.known.tolist() == [r[0] is not None for r in rows]
    assert all((a == b).all() for a, b in zip(file.documents(), want)) and all((file.document(k) == x).all() for k, x in enumerate(want))


def test_token_files_of_nothing(spark, vocabulary):
    assert token_files.round_trip(table(spark, []), vocabulary).collect() == []
