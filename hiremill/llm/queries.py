"""Registered queries of the corpus operators, and their SQL where SQL can express them. Every query reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill.llm import bpe, divergence, html_runs, jaccard, langid, mixing, packing, perplexity, phrases, pii, quality_model, url_rules, vafile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed values of the URL rule query: verdict and rule (host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query("op1_byte_bpe")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op2_length_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), packing.word_length())


@_query("op3_quality_classifier")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.score_documents(_table(spark, sf, "documents"))


@_query("op4_language_id")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(_table(spark, sf, "documents"))


@_query("op5_url_rules", """
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS mark FROM pages
),
rest AS (
  SELECT page_id, CASE WHEN mark = 0 THEN '' ELSE substring(u, mark + 3) END AS r FROM parts
),
split AS (
  SELECT page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substring(r, length(regexp_extract(r, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM rest
),
rules(host_part, path_part, rule, verdict) AS (
  VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
    ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')
),
fits AS (
  SELECT s.page_id, s.host, s.path, x.rule, x.verdict,
    row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(x.host_part) DESC, length(x.path_part) DESC) AS rn
  FROM (SELECT DISTINCT page_id, host, path FROM split) s JOIN rules x
    ON (s.host = x.host_part OR ends_with(s.host, '.' || x.host_part)) AND starts_with(s.path, x.path_part)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.host = s.host AND f.path = s.path AND f.rn = 1
""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@_query("op6_html_text")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return html_runs.extract(_table(spark, sf, "pages"))


@_query("op7_personal_data")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf, "documents"))


@_query("op8_ngram_jaccard")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.components(_table(spark, sf, "documents"))


@_query("op9_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    vectors = vafile.quantised(_table(spark, sf, "embeddings"), "vec_id", "embedding", 256)
    return vafile.search(vectors.where(F.col("id") % 50 == 0), vectors, 5).withColumnRenamed("id", "vec_id")


@_query("op10_perplexity_rules")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.judge_documents(_table(spark, sf, "documents"))


@_query("op11_phrase_mining", """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')
),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_spans AS (SELECT lang, a, w, unnest(range(2, k)) AS size FROM c),
spans AS (SELECT lang, a, size, unnest(list_transform(range(1, len(w) + 2 - size), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM inner_spans),
longest AS (SELECT lang, phrase, max(a) AS longer FROM spans GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longest x ON x.lang = low.lang AND x.phrase = low.phrase WHERE x.longer IS NULL OR 100 * x.longer < 80 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine(_table(spark, sf, "documents"))


@_query("op12_context_mixing")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.score_documents(_table(spark, sf, "documents"))


@_query("op13_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
),
kept AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
lt AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(lt.v, 0) AS v, lt.total AS lang_total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = g.lang AND t.source = g.source LEFT JOIN lt ON lt.lang = g.lang
),
p AS (
  SELECT g.lang, g.source, k.term, k.all_n, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 1)) // (g.lang_total + g.v) AS lang_p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - lang_p) * (p - lang_p)) // lang_p AS BIGINT) AS value FROM p WHERE n > 0 AND p > lang_p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(_table(spark, sf, "documents"))
