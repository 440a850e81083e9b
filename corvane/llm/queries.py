"""The registered queries of the subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import divergence, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_rules, sharding, spelling, token_files, toxicity, vector_search, warc
from corvane.session import table


#: Half as many tokens again as there are, dealt almost evenly: sources are repeated, small ones more often.
MIX = mixing.Mix(target_entropy=0.99995, max_repeat=4.0, budget=1.5)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = sharding.shard(docs, n_shards=40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 1)
    return scored.select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return lm_scoring.score(docs, fold == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.assess(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = mixing.spread(table(spark, sf_dir, "documents"), MIX)
    return plan


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query, in the operators' order."""
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_near_dedup": op3_near_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_warc": op5_warc,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_packing": op7_packing,
        "op8_vector_search": op8_vector_search,
        "op9_quality_rules": op9_quality_rules,
        "op10_mixing": op10_mixing,
        "op11_divergence": op11_divergence,
        "op12_spelling": op12_spelling,
        "op13_token_files": op13_token_files,
    }


#: White space around and between words, as DuckDB text.
_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP_SQL = f"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
spots AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts),
lines AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i], {_WHITE_SQL}) AS s FROM spots),
used AS (SELECT doc_id, i, s, doc_id * 10000000 + i AS place FROM lines WHERE length(s) >= 1),
d AS (SELECT s, length(s) AS n, min(place) AS lead_place FROM used GROUP BY s),
near AS (
  SELECT DISTINCT b.s FROM d a JOIN d b ON a.n = b.n AND a.lead_place < b.lead_place
  WHERE (left(a.s, a.n // 2) = left(b.s, a.n // 2) OR right(a.s, (a.n - 1) // 2) = right(b.s, (a.n - 1) // 2))
    AND levenshtein(a.s, b.s) <= 4 -- in bytes; a character has at most four
    AND len(list_filter(range(1, a.n + 1), lambda i: a.s[i] <> b.s[i])) = 1
  UNION
  SELECT DISTINCT CASE WHEN a.lead_place < b.lead_place THEN b.s ELSE a.s END FROM d a JOIN d b ON a.n + 1 = b.n
  WHERE (left(a.s, a.n // 2) = left(b.s, a.n // 2) OR right(a.s, a.n - a.n // 2) = right(b.s, a.n - a.n // 2))
    AND levenshtein(a.s, b.s) <= 4
    AND len(list_filter(range(0, a.n + 1), lambda i: left(b.s, i) || right(b.s, a.n - i) = a.s)) > 0),
gone AS (
  SELECT u.doc_id, u.i FROM used u JOIN d USING (s) LEFT JOIN near USING (s)
  WHERE u.place > d.lead_place OR near.s IS NOT NULL),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, md5(text) AS text_md5 FROM kept
"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS n, sha256(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS lead_id FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND lead_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND lead_id <> page_id THEN lead_id END AS refers_to
FROM f
"""

_WORDS_SQL = "list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR_DEDUP_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
x AS (SELECT doc_id, unnest(s) AS k FROM g),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM same JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, min(other) = n.doc_id AS kept FROM n JOIN reach ON node = n.doc_id GROUP BY n.doc_id, n.n
"""


def _phrases_sql() -> str:
    return "(?:" + "|".join(p.replace("'", "''") for p in quality_rules.BOILERPLATE) + ")s?"


def _fails_sql(x: str) -> str:
    """A line fails one of the shipped rules, menus of several lines aside."""
    rules, few = quality_rules.QualityRules(), f"length({x})"
    marks = lambda m: f"(length({x}) - length(translate({x}, '{m}', '')))"
    words = f"len({_WORDS_SQL.format(t=x).replace('lambda x: x', 'lambda w: w')})"
    lower = f"lower(trim({x}, {_WHITE_SQL}))"
    whole = f"'(?:^|[^\\pL\\pN])({_phrases_sql()})(?:[^\\pL\\pN]|$)'"
    held = f"length(array_to_string(regexp_extract_all({lower}, {whole}, 1), ''))"
    phrases = f"(regexp_matches({lower}, {whole}) AND {held} * 100 >= length({lower}) * {rules.boiler_share})"
    return (
        f"({marks(quality_rules.NOISE_MARKS)} * 100 > {few} * {rules.noise_share} OR ({marks(quality_rules.NAV_MARKS)} >= {rules.nav_marks} "
        f"AND {marks(quality_rules.NAV_MARKS)} * 100 >= {words} * {rules.nav_share}) OR {phrases})"
    )


_RULES = quality_rules.QualityRules()
_ENDS = quality_rules.TERMINAL.replace("'", "''")
QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS_SQL.format(t='t')} AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY 1),
l AS (SELECT doc_id, i, ls[i] AS x, trim(ls[i], {_WHITE_SQL}) AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM w)),
e AS (SELECT *, length(s) BETWEEN 1 AND {_RULES.menu_chars} AND NOT contains('{_ENDS}', right(s, 1)) AND len({_WORDS_SQL.format(t='s').replace('lambda x: x', 'lambda w: w')}) <= {_RULES.menu_words} AS entry FROM l),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, entry ORDER BY i) AS run FROM e),
m AS (SELECT *, entry AND count(*) OVER (PARTITION BY doc_id, entry, run) >= {_RULES.menu_run} AS menu FROM o),
b AS (SELECT doc_id, sum(length(array_to_string({_WORDS_SQL.format(t='x').replace('lambda x: x', 'lambda w: w')}, ''))) AS n FROM m WHERE menu OR {_fails_sql('x')} GROUP BY 1),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
  list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0) AS lost
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost * 100 <= word_chars * {_RULES.max_lost_share} AS kept FROM v
"""


_DOT_SQL = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y)"  # summed from first to last
SEARCH_SQL = f"""
WITH u AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT vec_id, e, sqrt({_DOT_SQL.format(a='e', b='e')}) AS n FROM u),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, q.e AS a, c.e AS b, q.n AS na, c.n AS nb FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
s AS (SELECT query_id, vec_id, max(greatest(-1, least(1, {_DOT_SQL.format(a='a', b='b')} / (na * nb)))) AS score FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


_TERMS_SQL = f"regexp_extract_all(translate(t, '{_UPPER}', '{_UPPER.lower()}'), '{divergence.TERM}')"
_SHARE_SQL = "(1 + ({n} + 2)::HUGEINT * 1000000000 // ({total} + 2 * {kept}))::BIGINT"
_APART_SQL = "((p - q) * (p - q)) // (p + q)"
DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
x AS (SELECT id, lang, source, unnest({_TERMS_SQL}) AS term FROM d),
k AS (SELECT lang, term FROM x GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS kept FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(any_value(kept), 0) AS kept, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) USING (lang, source) GROUP BY 1, 2),
s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_SHARE_SQL.format(n='coalesce(n, 0)', total='total', kept='kept')} AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
w AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
u AS (SELECT lang, sum(n) AS total FROM w GROUP BY 1),
q AS (SELECT lang, term, {_SHARE_SQL.format(n='n', total='total', kept='kept')} AS q FROM w JOIN u USING (lang) JOIN v USING (lang)),
m AS (SELECT a.lang, a.source, b.source AS item, sum({_APART_SQL}) AS value FROM s a JOIN (SELECT lang, source, term, p AS q FROM s) b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ({_APART_SQL})::BIGINT FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""

#: CRC-32 of a text's UTF-8 bytes: the table by its rule, then a fold over the bytes.
_CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_BYTES_SQL = "list_transform(range(octet_length(encode({t}))), lambda i: ('0x' || substr(hex(encode({t})), 2 * i + 1, 2))::BIGINT)"
SPELLING_SQL = f"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(text, '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
x AS (SELECT id || ':' || run AS marked, run, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM d) GROUP BY 1, 2),
tab AS (SELECT {_CRC_TABLE_SQL} AS crc_table),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES_SQL.format(t='marked')}), lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM x, tab),
r AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
v AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
c AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.rest = w.word),
near AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM pairs GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN near USING (word)),
up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.at = f.word WHERE f.form IS NOT NULL),
top AS (SELECT up.word, up.at AS root FROM up JOIN f ON f.word = up.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN top USING (word)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose full result it can express."""
    return {
        "op3_near_dedup": NEAR_DEDUP_SQL,
        "op4_line_dedup": LINE_DEDUP_SQL,
        "op5_warc": WARC_SQL,
        "op8_vector_search": SEARCH_SQL,
        "op9_quality_rules": QUALITY_SQL,
        "op11_divergence": DIVERGENCE_SQL,
        "op12_spelling": SPELLING_SQL,
    }
