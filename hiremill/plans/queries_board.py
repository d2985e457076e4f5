"""Checked queries for board aggregates, field clusters, themes, bundles and the graph (groups E, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill.functions.terms import TermRules
from hiremill.functions.text import empty_list, join_list
from hiremill.operators import clusters as H
from hiremill.operators import fields as G
from hiremill.operators import market as M
from hiremill.operators import signals as S
from hiremill.plans import queries_text as QT
from hiremill.plans.adapters import PART_SQL, POSTING_SQL, posting_doc, posting_part
from hiremill.plans.base import query, table
from hiremill.session import checkpointed

PLAIN = TermRules(inline=(), canonical={}, generic=(), weak_suffixes=(), weak_focus_patterns=(), weak_focus_terms=(), broad=(), tools=(), board_canonical={}, board_broad=(),
                  board_generic=("error",), bad_suffixes=("ly",), stop_words=(), role_names=("en",))


def plain_rows(spark, sf):
    """Documents as board rows without signals."""
    p = posting_doc(spark, sf).withColumn("role_group", F.col("role"))
    return p.withColumns({f"{c}_signals": empty_list() for c in [*S.CATEGORIES, "role"]})


@query("e5_company_profiles", "WITH " + POSTING_SQL + """,
long AS (SELECT company, ord, 'role' AS f, 0 AS pos, role AS label FROM posting UNION ALL SELECT company, ord, 'focus', 0, focus_label FROM posting WHERE focus_label <> ''
  UNION ALL SELECT company, ord, 'keyword', generate_subscripts(keywords, 1), unnest(keywords) FROM posting
  UNION ALL SELECT company, ord, 'summary', 0, trim(regexp_replace(summary, '\\s+', ' ', 'g')) FROM posting WHERE quality <> 'low' AND trim(summary) <> ''),
fs AS (SELECT company, f, label, row_number() OVER (PARTITION BY company, f ORDER BY min(ord), arg_min(pos, ord)) AS rk FROM long GROUP BY company, f, label),
ls AS (SELECT company, list(label ORDER BY rk) FILTER (f = 'role' AND rk <= 6) AS roles, list(label ORDER BY rk) FILTER (f = 'focus' AND rk <= 5) AS focuses,
  list(label ORDER BY rk) FILTER (f = 'keyword' AND rk <= 8) AS kws, list(label ORDER BY rk) FILTER (f = 'summary' AND rk <= 4) AS sums FROM fs GROUP BY company),
ng AS (SELECT *, list_filter(coalesce(focuses, []) || coalesce(kws, []), lambda x: lower(x) <> 'error' AND NOT lower(x) LIKE '%ly') AS p0 FROM ls),
kw AS (SELECT *, list_filter(list_filter(p0, lambda x, i: list_position(p0, x) = i)[1:8], lambda x: NOT contains(lower(company), lower(x)))[1:5] AS k FROM ng)
SELECT c.company, c.postings, c.active_postings, c.usable_postings, array_to_string(roles, '|') AS roles, coalesce(array_to_string(focuses, '|'), '') AS focus_labels,
  coalesce(array_to_string(sums, '|'), '') AS summaries, array_to_string(k, '|') AS keywords, array_to_string(k[1:3], ' · ') || ' 중심 공고가 반복됩니다.' AS reason, k[1] AS headline
FROM (SELECT company, count(*) AS postings, count(*) FILTER (active) AS active_postings, count(*) FILTER (quality <> 'low') AS usable_postings FROM posting GROUP BY company) c JOIN kw ON kw.company = c.company""")
def e5(spark, sf):
    c = M.company_profiles(plain_rows(spark, sf), PLAIN)
    return c.select("company", "postings", "active_postings", "usable_postings", *[join_list(x).alias(x) for x in ("roles", "focus_labels", "summaries", "keywords")], "reason", "headline")


TONES = (("tone-a", ("thtion", "attion")), ("tone-b", ("inoran", "hehely")), ("tone-c", ("en",)))


@query("e7_tone_legend", "WITH " + POSTING_SQL + """,
kt AS (SELECT id, ord, summary, role, unnest(keywords) AS label FROM posting),
kt1 AS (SELECT *, CASE WHEN regexp_matches(label, 'thtion|attion') THEN 'tone-a' WHEN regexp_matches(label, 'inoran|hehely') THEN 'tone-b' WHEN contains(label, 'en') THEN 'tone-c' END AS tone FROM kt),
hits AS (SELECT DISTINCT id, tone FROM kt1 WHERE tone IS NOT NULL),
fb AS (SELECT id, CASE WHEN regexp_matches(x, 'thtion|attion') THEN 'tone-a' WHEN regexp_matches(x, 'inoran|hehely') THEN 'tone-b' WHEN contains(x, 'en') THEN 'tone-c' END AS tone
  FROM (SELECT id, lower(role || ' ' || summary) AS x FROM posting WHERE id NOT IN (SELECT id FROM hits))),
al AS (SELECT * FROM hits UNION ALL SELECT * FROM fb WHERE tone IS NOT NULL),
words AS (SELECT tone, label, row_number() OVER (PARTITION BY tone ORDER BY count(*) DESC, label) AS rk FROM kt1 WHERE tone IS NOT NULL GROUP BY tone, label),
t AS (SELECT unnest(['tone-a', 'tone-b', 'tone-c']) AS tone, unnest([1, 2, 3]) AS position)
SELECT t.position, t.tone, (SELECT count(*) FROM al WHERE al.tone = t.tone) AS n, coalesce((SELECT string_agg(label, '|' ORDER BY rk) FROM words WHERE words.tone = t.tone AND rk <= 5), '') AS keywords,
  CASE WHEN t.tone = 'tone-a' THEN 'stored' ELSE coalesce((SELECT string_agg(label, ', ' ORDER BY rk) FROM words WHERE words.tone = t.tone AND rk <= 3) || ' 중심의 공고 신호를 모아 보여줍니다.', '""" + M.NO_TONE_TEXT + """') END AS description FROM t""")
def e7(spark, sf):
    stored = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("tone-a").alias("tone"), F.lit("stored").alias("description"))
    t = M.tone_legend(posting_doc(spark, sf), stored, TONES)
    return t.select("position", "tone", "n", join_list("keywords").alias("keywords"), "description")


@query("e8_board_overview", "WITH " + QT.SCOPE_SQL + """
SELECT count(*) AS source_jobs, count(*) FILTER (i) AS total_jobs, count(*) FILTER (i AND active) AS active_jobs, count(*) FILTER (i AND summary <> '' AND quality <> 'low') AS summary_coverage,
  count(*) FILTER (i AND trim(summary) <> '') AS display_coverage, count(DISTINCT CASE WHEN i THEN company END) AS company_count, count(*) FILTER (NOT i) AS filtered_out,
  count(*) FILTER (scope_action = 'review') AS review_candidates, count(*) FILTER (mdl) AS model_applied, count(*) FILTER (mdl AND n_chars % 2 = 0) AS model_low_confidence,
  count(*) FILTER (i AND NOT active) AS inactive_jobs, count(*) FILTER (i) - count(*) FILTER (i AND summary <> '' AND quality <> 'low') AS missing_summaries
FROM (SELECT *, scope_action = 'include' AS i FROM scope)""")
def e8(spark, sf):
    from hiremill.operators.classify import scope_decision

    d = scope_decision(QT.scope_rows(spark, sf), QT.SCOPE).withColumns({"has_summary": F.col("summary") != "", "o_confidence": F.when(F.col("n_chars") % 2 == 0, "low").otherwise("high")})
    return M.board_overview(d)


@query("e9_market_profile", "WITH " + POSTING_SQL + """,
long AS (SELECT role, ord, 'focus' AS facet, 0 AS pos, focus_label AS label FROM posting WHERE focus_label <> '' UNION ALL SELECT role, ord, 'keyword', generate_subscripts(keywords, 1), unnest(keywords) FROM posting
  UNION ALL SELECT role, ord, 'skill', generate_subscripts(skills, 1), substring(unnest(skills), 1, 32) FROM posting UNION ALL SELECT role, ord, 'company', 0, company FROM posting
  UNION ALL SELECT role, ord, f, pos, substring(v, 1, 140) FROM (SELECT role, ord, f, pos, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS v FROM (
    SELECT role, ord, 'task' AS f, generate_subscripts(tasks, 1) AS pos, unnest(tasks) AS l FROM posting UNION ALL SELECT role, ord, 'requirement', generate_subscripts(requirements, 1), unnest(requirements) FROM posting
    UNION ALL SELECT role, ord, 'preferred', generate_subscripts(preferred, 1), unnest(preferred) FROM posting)) WHERE length(v) > 3 AND NOT starts_with(v, '*') AND NOT starts_with(v, '•')),
cnt AS (SELECT role, facet, label, count(*) AS n, min(ord) AS o, min(ord * 1000000 + pos) AS p FROM long GROUP BY ALL)
SELECT role, facet, label, n FROM (SELECT *, row_number() OVER (PARTITION BY role, facet ORDER BY n DESC, o, p) AS rank FROM cnt)
WHERE rank <= CASE facet WHEN 'focus' THEN 10 WHEN 'keyword' THEN 14 WHEN 'skill' THEN 14 WHEN 'company' THEN 12 WHEN 'preferred' THEN 6 ELSE 10 END""")
def e9(spark, sf):
    return M.market_profile(posting_doc(spark, sf), "role").select("role", "facet", "label", "n")


@query("e9_market_totals", "WITH " + POSTING_SQL + " SELECT role, count(*) AS analyzed_jobs, count(DISTINCT company) AS company_count FROM posting GROUP BY role")
def e9t(spark, sf):
    return M.market_totals(posting_doc(spark, sf), "role")


@query("e10_representative_postings", "WITH " + POSTING_SQL + """
SELECT id, role, company, title, low, density, rank FROM (SELECT id, role, company, title, quality = 'low' AS low,
  len(keywords) + len(skills) + CASE WHEN trim(summary) <> '' THEN 4 ELSE 0 END + CASE WHEN focus_label <> '' THEN 2 ELSE 0 END AS density,
  row_number() OVER (PARTITION BY role ORDER BY quality = 'low', len(keywords) + len(skills) + CASE WHEN trim(summary) <> '' THEN 4 ELSE 0 END + CASE WHEN focus_label <> '' THEN 2 ELSE 0 END DESC, company, title, id) AS rank FROM posting) WHERE rank <= 4""")
def e10(spark, sf):
    return M.representative_postings(plain_rows(spark, sf))


LABEL_SNAPSHOT_SQL = "WITH " + POSTING_SQL + """,
b AS (SELECT *, focus_label IN ('click', 'view', 'error') AS br, focus_label IN ('view') AS ac FROM posting)
SELECT 'jobs' AS metric, count(*) AS value FROM b UNION ALL SELECT 'summary_present', count(*) FROM b WHERE trim(summary) <> '' UNION ALL SELECT 'focus_present', count(*) FROM b WHERE focus_label <> ''
UNION ALL SELECT 'low', count(*) FROM b WHERE quality = 'low' UNION ALL SELECT 'broad_raw', count(*) FROM b WHERE br UNION ALL SELECT 'accepted_broad_raw', count(*) FROM b WHERE br AND ac
UNION ALL SELECT 'bad_broad_raw', count(*) FROM b WHERE br AND NOT ac UNION ALL SELECT 'broad_board', count(*) FROM b WHERE br AND active UNION ALL SELECT 'accepted_broad_board', count(*) FROM b WHERE ac AND active
UNION ALL SELECT 'bad_broad_board', count(*) FROM b WHERE br AND NOT ac AND active UNION ALL SELECT 'low_blank_focus', count(*) FROM b WHERE quality = 'low' AND focus_label = '' AND active"""


@query("e11_label_snapshot", LABEL_SNAPSHOT_SQL)
def e11(spark, sf):
    p = posting_doc(spark, sf)
    return M.label_snapshot(p, p.where("active"), ["click", "view", "error"], ["view"])


@query("e11_top_focus", "WITH " + POSTING_SQL + " SELECT row_number() OVER (ORDER BY n DESC, o) AS rank, label, n FROM (SELECT focus_label AS label, count(*) AS n, min(ord) AS o FROM posting WHERE focus_label <> '' GROUP BY 1) QUALIFY rank <= 15")
def e11t(spark, sf):
    return M.top_focus(posting_doc(spark, sf))


def review_flags(spark, sf):
    l = table(spark, sf, "labels")
    return l.select(F.when(F.col("doc_id") % 2 == 0, "core").otherwise("incremental").alias("dataset"), (F.col("doc_id") % 3 > 0).alias("reviewed"),
                    F.when(F.col("doc_id") % 3 == 1, F.col("quality") == 1).alias("overall_pass"))


@query("e12_decision_blockers", """
SELECT name, false AS passed FROM (SELECT 'core_reviewed' AS name, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 > 0) >= 30 AS p FROM labels
  UNION ALL SELECT 'incremental_reviewed', count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 > 0) >= 100000 FROM labels UNION ALL SELECT 'suite_gate', false UNION ALL SELECT 'models_compared', false) WHERE NOT p""")
def e12(spark, sf):
    p = posting_doc(spark, sf)
    return M.decision_report_metrics(p, p, review_flags(spark, sf), False, 1, need_incremental=100_000)[1]


@query("e12_decision_metrics", LABEL_SNAPSHOT_SQL + """
UNION ALL SELECT 'core_reviewed' AS metric, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 > 0) AS value FROM labels UNION ALL SELECT 'incremental_reviewed', count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 > 0) FROM labels
UNION ALL SELECT 'core_passed', count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 = 1 AND quality = 1) FROM labels UNION ALL SELECT 'incremental_passed', count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 = 1 AND quality = 1) FROM labels
UNION ALL SELECT 'core_judged', count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 = 1) FROM labels UNION ALL SELECT 'incremental_judged', count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 = 1) FROM labels""")
def e12m(spark, sf):
    p = posting_doc(spark, sf)
    return M.decision_report_metrics(p, p.where("active"), review_flags(spark, sf), False, broad=["click", "view", "error"], accepted=["view"])[0]


@query("e13_scope_audit", "WITH " + QT.SCOPE_SQL + """
SELECT 'action' AS kind, scope_action AS key, count(*) AS n FROM scope GROUP BY 2 UNION ALL SELECT 'quality', quality, count(*) FROM scope WHERE scope_action <> 'include' GROUP BY 2
UNION ALL SELECT 'reason', coalesce(reasons[1], 'none'), count(*) FROM scope WHERE scope_action <> 'include' GROUP BY 2""")
def e13(spark, sf):
    from hiremill.operators.classify import scope_decision

    return M.scope_audit(scope_decision(QT.scope_rows(spark, sf), QT.SCOPE))


@query("e14_base_order", "WITH " + POSTING_SQL + """
SELECT id, CASE WHEN active THEN 0 ELSE 1 END AS k0, CASE role WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS k1, CASE WHEN role IN ('fr', 'en') THEN '' ELSE role END AS k2,
  -coalesce(CAST(epoch(TRY_CAST(nullif(last_seen_at, '') AS TIMESTAMP)) AS BIGINT), 0) AS k3, lower(company) AS k4, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS k5 FROM posting""")
def e14(spark, sf):
    # The whole table in board order with the keys it is ordered by.
    ordered = M.base_order(posting_doc(spark, sf), "role", ["fr", "en"])
    return ordered.select("id", *[k.alias(f"k{i}") for i, k in enumerate(M.order_keys("role", ["fr", "en"])[:6])])


@query("e15_distribution", "WITH " + POSTING_SQL + """
SELECT 'role' AS "column", role AS value, count(*) AS n FROM posting GROUP BY 2 UNION ALL SELECT 'quality', quality, count(*) FROM posting GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM posting GROUP BY 2""")
def e15(spark, sf):
    return M.distribution(posting_doc(spark, sf), ["role", "quality", "event_type"])


SMALL_FIELDS = G.FieldRules(aliases=(("Thtion", ("thtion", "ontion")), ("Hehely", ("hehely",))), stop_words=("the", "and"), weak=("thatin",), short_ok=("und",), skill_only=("ononst",), broad=("attion",),
                            endings=("(ly|ing)$",), themes=(("a", "t-a", "Alpha", ("tion", "nder")), ("b", "t-b", "Beta", ("ment", "eau")), ("z", "t-z", "Rest", ())), bonus_terms=("inoran",), malus_terms=("Eriner",))
TOK = "regexp_extract_all(array_to_string({}, ' '), '[A-Za-z][A-Za-z0-9+#./-]{1,}|[가-힣]{2,}')"
TERM_SQL = POSTING_SQL + """,
ft0 AS (SELECT id, ord, company, role, 'skills' AS section, keywords AS lines FROM posting),
ft1 AS (SELECT *, regexp_replace(lower(array_to_string(lines, ' ')), '[^0-9a-z가-힣]+', '', 'g') AS blob, """ + TOK.replace("{}", "lines") + """ AS toks FROM ft0),
ft2 AS (SELECT *, list_filter([CASE WHEN regexp_matches(blob, 'thtion|ontion') THEN 'Thtion' END, CASE WHEN contains(blob, 'hehely') THEN 'Hehely' END], lambda x: x IS NOT NULL)
  || list_transform(toks, lambda x: CASE WHEN regexp_matches(x, 'thtion|ontion') THEN 'Thtion' WHEN contains(x, 'hehely') THEN 'Hehely' WHEN length(x) <= 4 THEN upper(x) ELSE upper(x[1:1]) || lower(x[2:]) END) AS cand FROM ft1),
ft3 AS (SELECT *, list_filter(cand, lambda x: lower(x) NOT IN ('the', 'and', 'thatin') AND NOT regexp_matches(lower(x), '(ly|ing)$') AND lower(x) <> company AND NOT (regexp_matches(x, '^[A-Za-z]{1,3}$'))) AS good FROM ft2),
fterms AS (SELECT id, ord, company, section, lines, list_filter(good, lambda x, i: list_position(list_transform(good, lambda y: lower(y)), lower(x)) = i)[1:10] AS terms FROM ft3)"""


def docs(spark, sf):
    p = plain_rows(spark, sf).withColumn("skills", F.col("keywords"))
    return checkpointed(G.pick_theme(G.section_documents(p, ["skills"], SMALL_FIELDS), SMALL_FIELDS))


@query("g1_field_terms", "WITH " + TERM_SQL + " SELECT id, section, array_to_string(terms, '|') AS terms FROM fterms WHERE len(terms) > 0")
def g1(spark, sf):
    return docs(spark, sf).select("id", "section", join_list("terms").alias("terms"))


SEED_SQL = TERM_SQL + """,
tl AS (SELECT section, id, ord, company, unnest(terms) AS label, generate_subscripts(terms, 1) - 1 AS pos FROM fterms),
df AS (SELECT section, label, count(*) AS df FROM tl GROUP BY ALL),
sc AS (SELECT tl.*, df, df * 10 + least(length(label), 12) + CASE WHEN regexp_matches(label, '^[A-Z0-9+.#/-]+$') THEN 4 ELSE 0 END + 5 + CASE WHEN lower(label) = 'inoran' THEN 2 ELSE 0 END - CASE WHEN label = 'Eriner' THEN 18 ELSE 0 END AS score
  FROM tl JOIN df USING (section, label)),
seed AS (SELECT section, id, ord, company, label AS seed, lower(label) AS key FROM sc QUALIFY row_number() OVER (PARTITION BY section, id ORDER BY df >= 4 DESC, score DESC, label) = 1),
kw AS (SELECT section, key, label, sum(greatest(7 - pos, 1) + least(df, 4)) AS s FROM sc JOIN (SELECT id, key FROM seed) USING (id) WHERE pos < 8 GROUP BY ALL),
kwl AS (SELECT section, key, string_agg(label, '|' ORDER BY rk) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY s DESC, label) AS rk FROM kw) WHERE rk <= 5 GROUP BY ALL)"""


@query("g2_seed_clusters", "WITH " + SEED_SQL + """
SELECT section, key, posting_count, company_count, keywords FROM (SELECT section, key, count(*) AS posting_count, count(DISTINCT company) AS company_count FROM seed GROUP BY ALL) JOIN kwl USING (section, key) WHERE posting_count >= 2""")
def g2(spark, sf):
    c = G.seed_clusters(docs(spark, sf), SMALL_FIELDS)
    return c.select("section", "key", "posting_count", "company_count", join_list("keywords").alias("keywords"))


@query("g3_theme_clusters", "WITH " + TERM_SQL + """,
th AS (SELECT *, list_transform(terms, lambda x: lower(x)) AS k, lower(array_to_string(terms, ' ')) AS t FROM fterms WHERE len(terms) > 0),
sc AS (SELECT *, CASE WHEN len(list_filter(k, lambda x: contains(x, 'tion') OR contains('tion', x))) > 0 THEN 3 ELSE 0 END + CASE WHEN contains(t, 'tion') THEN 1 ELSE 0 END + CASE WHEN len(list_filter(k, lambda x: contains(x, 'nder') OR contains('nder', x))) > 0 THEN 3 ELSE 0 END + CASE WHEN contains(t, 'nder') THEN 1 ELSE 0 END AS a,
  CASE WHEN len(list_filter(k, lambda x: contains(x, 'ment') OR contains('ment', x))) > 0 THEN 3 ELSE 0 END + CASE WHEN contains(t, 'ment') THEN 1 ELSE 0 END + CASE WHEN len(list_filter(k, lambda x: contains(x, 'eau') OR contains('eau', x))) > 0 THEN 3 ELSE 0 END + CASE WHEN contains(t, 'eau') THEN 1 ELSE 0 END AS b FROM th),
pk AS (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 'z' WHEN a >= b THEN 'a' ELSE 'b' END AS key FROM sc),
kw AS (SELECT key, label, sum(greatest(5 - pos, 1)) AS s FROM (SELECT key, unnest(terms) AS label, generate_subscripts(terms, 1) - 1 AS pos FROM pk) WHERE pos < 8 GROUP BY ALL),
kwl AS (SELECT key, string_agg(label, '|' ORDER BY rk) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, label) AS rk FROM kw) WHERE rk <= 4 GROUP BY key)
SELECT 'skills' AS section, key, count(*) AS posting_count, count(DISTINCT company) AS company_count, any_value(keywords) AS keywords FROM pk JOIN kwl USING (key) GROUP BY key""")
def g3(spark, sf):
    c = G.theme_clusters(docs(spark, sf), SMALL_FIELDS)
    return c.select("section", "key", "posting_count", "company_count", join_list("keywords").alias("keywords"))


@query("g4_section_clusters")
def g4(spark, sf):
    p = plain_rows(spark, sf).withColumn("skills", F.col("keywords"))
    d = G.pick_theme(G.section_documents(p, ["detail_body", "tasks", "skills"], SMALL_FIELDS), SMALL_FIELDS)
    c = G.section_clusters(d, SMALL_FIELDS)
    return c.select("section", "position", "kind", "key", "label", "tone", join_list("keywords").alias("keywords"), "posting_count", "company_count", join_list("samples").alias("samples"))


THEME_RULES = H.ThemeRules(themes=(("x", ("tion", "purchase")), ("y", ("thatin", "view")), ("w", ("nder", "click"))), default="w", keyword_bonus=(("w", ("inoran",), 4),), role_bonus=(("y", ("de",), 4),), terms=PLAIN)


def theme_sql(tokens):
    return " + ".join(f"3 * len(list_filter(kw, lambda x: contains(x, '{t}') OR contains('{t}', x))) + len(list_filter(tm, lambda x: contains(x, '{t}') OR contains('{t}', x)))" for t in tokens)


ASSIGN_SQL = POSTING_SQL + """,
at0 AS (SELECT *, list_filter([focus_label] || keywords, lambda x: x <> '') AS kw0, list_filter([focus_label] || keywords || [role], lambda x: x <> '' AND x <> 'error' AND NOT x LIKE '%ly') AS tm0 FROM posting),
at1 AS (SELECT *, list_filter(kw0, lambda x, i: list_position(kw0, x) = i) AS kw, list_filter(tm0, lambda x, i: list_position(tm0, x) = i)[1:20] AS tm FROM at0),
at2 AS (SELECT *, """ + theme_sql(["tion", "purchase"]) + " AS sx, " + theme_sql(["thatin", "view"]) + " + CASE WHEN role = 'de' THEN 4 ELSE 0 END AS sy, " + theme_sql(["nder", "click"]) + """ + CASE WHEN list_contains(kw, 'inoran') THEN 4 ELSE 0 END AS sw FROM at1),
assigned AS (SELECT *, CASE WHEN sx >= sy AND sx >= sw THEN 'x' WHEN sy >= sw THEN 'y' ELSE 'w' END AS cluster_id, greatest(sx, sy, sw) AS theme_score FROM at2)"""


def themed(spark, sf):
    return H.assign_themes(plain_rows(spark, sf), THEME_RULES)


@query("h1_assign_themes", "WITH " + ASSIGN_SQL + " SELECT id, cluster_id, theme_score FROM assigned")
def h1(spark, sf):
    return themed(spark, sf).select("id", "cluster_id", "theme_score")


@query("h1_theme_summary", "WITH " + ASSIGN_SQL + """,
kl AS (SELECT cluster_id, ord, unnest(l) AS label, generate_subscripts(l, 1) AS pos FROM (SELECT cluster_id, ord, list_filter([focus_label] || keywords, lambda x: x <> '' AND x <> 'error' AND NOT x LIKE '%ly') AS l FROM assigned)),
kr AS (SELECT cluster_id, label, row_number() OVER (PARTITION BY cluster_id ORDER BY min(ord), arg_min(pos, ord)) AS rk FROM kl GROUP BY cluster_id, label)
SELECT a.cluster_id, count(*) AS n, count(DISTINCT company) AS company_count, (SELECT string_agg(label, '|' ORDER BY rk) FROM kr WHERE kr.cluster_id = a.cluster_id AND rk <= 6) AS keywords FROM assigned a GROUP BY a.cluster_id""")
def h1s(spark, sf):
    c = H.theme_clusters_summary(themed(spark, sf), THEME_RULES)
    return c.select("cluster_id", "n", "company_count", join_list("keywords").alias("keywords"))


def profiles_small(spark, sf):
    return M.company_profiles(plain_rows(spark, sf), PLAIN)


CT_SQL = POSTING_SQL + """,
tx AS (SELECT company, list_transform(list_filter([focus_label] || keywords || [role, CASE WHEN quality = 'low' THEN '' ELSE summary END], lambda x: true), lambda x: regexp_replace(lower(x), '[^0-9a-z가-힣]+', '', 'g')) AS l FROM posting),
hit AS (SELECT company, count(*) AS postings, """ + ", ".join(f"sum({' + '.join(f'''len(list_filter(l, lambda x: contains(x, '{t}')))''' for t in ts)}) AS h{i}" for i, (_, ts) in enumerate(THEME_RULES.themes)) + """ FROM tx GROUP BY company)"""


@query("h2_company_theme_hits", "WITH " + CT_SQL + " SELECT company, postings, h0, h1, h2 FROM hit")
def h2h(spark, sf):
    rows = plain_rows(spark, sf)
    empty = rows.groupBy("company").agg(F.count(F.lit(1)).alias("postings")).withColumn("keywords", empty_list())
    parts = []
    for i, (name, tokens) in enumerate(THEME_RULES.themes):
        import dataclasses

        one = dataclasses.replace(THEME_RULES, themes=((name, tokens),), default=name)
        parts.append(H.company_themes(rows, empty, one).select("company", "postings", F.col("score").alias(f"h{i}")))
    return parts[0].join(parts[1].drop("postings"), "company").join(parts[2].drop("postings"), "company")


@query("h2_company_themes")
def h2(spark, sf):
    a = H.company_themes(plain_rows(spark, sf), profiles_small(spark, sf), THEME_RULES)
    c = H.company_theme_clusters(a, {"x": "Ex", "y": "Why", "w": "Wu"})
    return c.select("id", "theme", "label", "postings", "company_count", join_list("keywords").alias("keywords"))


@query("h3_merge_stored_clusters", """
WITH st AS (SELECT c_nationkey AS ord, 'c' || c_nationkey AS id, c_name AS company FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 2, 'c2', c_name FROM customer WHERE c_custkey % 5 = 1),
co AS (SELECT c_name AS company, 1 + count(o_orderkey) AS postings FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 2 GROUP BY ALL),
fc AS (SELECT company, id FROM st WHERE company IN (SELECT company FROM co) QUALIFY row_number() OVER (PARTITION BY company ORDER BY ord) = 1)
SELECT co.company, co.postings, coalesce(fc.id, (SELECT arg_min(st.id, st.ord) FROM st JOIN co ON co.company = st.company)) AS cluster_id FROM co LEFT JOIN fc ON fc.company = co.company""")
def h3(spark, sf):
    """Customers as companies, their orders as postings, nations as stored clusters; some are claimed twice, some by none."""
    c = table(spark, sf, "customer")
    rows = (c.where("c_custkey % 4 <> 0").select(F.col("c_nationkey").cast("bigint").alias("ord"), "c_name")
            .unionByName(c.where("c_custkey % 5 = 1").select(F.lit(2).cast("bigint").alias("ord"), "c_name")))
    st = rows.groupBy("ord").agg(F.collect_list("c_name").alias("companies")).withColumns({"id": F.concat(F.lit("c"), F.col("ord")), "label": F.lit("")})
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    co = c.where("c_custkey % 3 <> 2").join(orders, "c_custkey", "left").select(F.col("c_name").alias("company"), (F.coalesce("n", F.lit(0)) + 1).cast("bigint").alias("postings"))
    return H.merge_stored_clusters(st, co)[0]


@query("h3_best_overlap_cluster", "WITH " + POSTING_SQL + """,
c AS (SELECT DISTINCT company, unnest(keywords) AS term FROM posting), k AS (SELECT DISTINCT role, unnest(keywords) AS term FROM posting),
h AS (SELECT company, role AS cluster_id, count(*) AS overlap FROM c JOIN k USING (term) GROUP BY ALL)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY company ORDER BY overlap DESC, CASE cluster_id WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END) = 1""")
def h3o(spark, sf):
    p = posting_doc(spark, sf)
    flat = lambda df, key: df.select(key, F.explode("keywords").alias("t")).distinct().groupBy(key).agg(F.collect_list("t").alias("keywords"))
    k = flat(p, "role").select(F.col("role").alias("id"), "keywords", F.when(F.col("role") == "de", 1).when(F.col("role") == "en", 2).when(F.col("role") == "es", 3).otherwise(4).alias("ord"))
    return H.best_overlap_cluster(flat(p, "company"), k)


VEC_SQL = POSTING_SQL + """,
vt0 AS (SELECT company, quality, role, list_filter([focus_label] || keywords, lambda x: x <> '' AND x <> 'error' AND NOT x LIKE '%ly') AS l FROM posting),
vt1 AS (SELECT company, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:18]) AS term, CASE WHEN quality = 'low' THEN 2.2 ELSE 3.4 END::DOUBLE AS w FROM vt0 UNION ALL SELECT company, role, 0.25::DOUBLE FROM vt0),
raw AS (SELECT company, term, sum(w) AS w FROM vt1 GROUP BY ALL), dfq AS (SELECT term, count(*) AS df FROM raw GROUP BY term),
vec AS (SELECT company, term, round(w * (1 + (SELECT count(DISTINCT company) FROM raw) / df), 3) AS weight FROM raw JOIN dfq USING (term)
  QUALIFY row_number() OVER (PARTITION BY company ORDER BY round(w * (1 + (SELECT count(DISTINCT company) FROM raw) / df), 3) DESC, term) <= 10)"""


def vectors(spark, sf):
    return H.company_vectors(plain_rows(spark, sf), None, PLAIN)


@query("h4_company_vectors", "WITH " + VEC_SQL + " SELECT company, term, round(weight, 2) AS weight FROM vec")
def h4(spark, sf):
    return vectors(spark, sf).select("company", "term", F.round("weight", 2).alias("weight"))


MERGE_SQL = VEC_SQL + """,
mem AS (SELECT DISTINCT company, CAST(right(company, 1) AS INT) % 3 || '' AS cluster_id FROM posting),
mv AS (SELECT cluster_id, term, round(sum(weight) / (SELECT count(*) FROM mem m2 WHERE m2.cluster_id = mem.cluster_id), 3) AS weight FROM vec JOIN mem USING (company) GROUP BY cluster_id, term),
cv AS (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) <= 12)"""


def members(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("company")).distinct().withColumn("cluster_id", (F.substring("company", -1, 1).cast("int") % 3).cast("string"))


@query("h5_merge_vectors", "WITH " + MERGE_SQL + " SELECT cluster_id, term, round(weight, 2) AS weight FROM cv")
def h5m(spark, sf):
    return H.merge_vectors(vectors(spark, sf), members(spark, sf)).select("cluster_id", "term", F.round("weight", 2).alias("weight"))


@query("h5_weighted_jaccard", "WITH " + MERGE_SQL + """,
p AS (SELECT company AS l, cluster_id AS r FROM mem),
sh AS (SELECT p.l, p.r, sum(least(a.weight, b.weight)) AS mins FROM p JOIN vec a ON a.company = p.l JOIN cv b ON b.cluster_id = p.r AND b.term = a.term GROUP BY ALL),
ta AS (SELECT company AS l, sum(weight) AS s FROM vec GROUP BY 1), tb AS (SELECT cluster_id AS r, sum(weight) AS s FROM cv GROUP BY 1)
SELECT p.l, p.r, round(coalesce(mins, 0) / (ta.s + tb.s - coalesce(mins, 0)), 5) AS similarity FROM p JOIN ta USING (l) JOIN tb USING (r) LEFT JOIN sh ON sh.l = p.l AND sh.r = p.r""")
def h5(spark, sf):
    v, m = vectors(spark, sf), members(spark, sf)
    left = v.select(F.col("company").alias("key"), "term", "weight")
    right = H.merge_vectors(v, m).select(F.col("cluster_id").alias("key"), "term", "weight")
    return H.weighted_jaccard(left, right, m.select(F.col("company").alias("l"), F.col("cluster_id").alias("r"))).withColumn("similarity", F.round("similarity", 5))


SCHEMA_RULES = H.SchemaRules(schemas=(("s1", ("tion", "view")), ("s2", ("en", "click")), ("s3", ("zzzz",))), bonuses=(("s1", "role", ("de",), 4), ("s2", "text", ("inoran",), 3)), data_roles=("fr",), data_schema="s3", other_schema="s1", terms=PLAIN)


@query("h6_company_schema_clusters", "WITH " + POSTING_SQL + """,
b0 AS (SELECT company, role, list_filter([focus_label] || keywords, lambda x: x <> '' AND x <> 'error' AND NOT x LIKE '%ly') AS l, summary, group_summary FROM posting),
b1 AS (SELECT company, role, lower(array_to_string(list_filter([role, trim(regexp_replace(summary, '\\s+', ' ', 'g')), group_summary] || list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], lambda x: x <> ''), ' ')) AS b FROM b0),
c AS (SELECT company, sum(len(regexp_extract_all(b, 'tion')) + len(regexp_extract_all(b, 'view'))) * 2 + max(CASE WHEN role = 'de' THEN 4 ELSE 0 END) AS s1,
  sum(len(regexp_extract_all(b, 'en')) + len(regexp_extract_all(b, 'click'))) * 2 + max(CASE WHEN contains(b, 'inoran') THEN 3 ELSE 0 END) AS s2 FROM b1 GROUP BY company)
SELECT company, CASE WHEN s1 >= s2 THEN 's1' ELSE 's2' END AS cluster_id, CAST(greatest(s1, s2) AS BIGINT) AS score FROM c""")
def h6(spark, sf):
    return H.company_schema_clusters(plain_rows(spark, sf), SCHEMA_RULES)


PAIR_RULES = H.PairRules(terms=PLAIN, noise=("old",), aliases={"gizmo": "Gizmo"}, axis_skills=("ring", "widget", "bolt", "gear", "plate", "rod", "Gizmo", "anvil"),
                         templates=((("SMALL", "ring"), "Small rings", "Small rings together"), (("PROMO", "Gizmo"), "Promo", "Promo gizmos")), thesis="%s with %s")
PAIRS_SQL = PART_SQL + """,
pr AS (SELECT id, ord, company, active, role, axes[1] AS l, unnest(list_transform(list_filter(skills, lambda x: x IN ('ring', 'widget', 'bolt', 'gear', 'plate', 'rod', 'gizmo', 'anvil')), lambda x: CASE WHEN x = 'gizmo' THEN 'Gizmo' ELSE x END)) AS r FROM posting),
pm AS (SELECT DISTINCT '' AS grp, array_to_string(list_sort([lower(l), lower(r)]), '|') AS pair, id, ord, company, active, l AS "left", r AS "right" FROM pr)"""


def part_pairs(spark, sf, group=None):
    prof = H.semantic_profile(posting_part(spark, sf), PAIR_RULES)
    return prof, H.pair_members(prof, group)


@query("h7_pair_stats", "WITH " + PAIRS_SQL + """
SELECT grp, pair, count(*) AS postings, count(DISTINCT company) AS companies, count(*) FILTER (active) AS active_postings, arg_min("left", ord) AS "left", arg_min("right", ord) AS "right" FROM pm GROUP BY grp, pair""")
def h7(spark, sf):
    return H.pair_stats(part_pairs(spark, sf)[1]).select("grp", "pair", "postings", "companies", "active_postings", "left", "right")


DOC_PAIR_RULES = H.PairRules(terms=PLAIN, noise=("error",), aliases={}, axis_skills=("thtion", "attion", "ertion", "inoran", "hehely", "orantion", "thatin", "ononst", "thanea", "eriner"), templates=(), thesis="%s with %s")


@query("h7_document_pairs", "WITH " + POSTING_SQL + """,
dp0 AS (SELECT id, ord, company, active, list_distinct(list_filter([event_type, role], lambda x: x NOT IN ('', 'error'))) AS axs, list_filter([event_type, role], lambda x: x NOT IN ('', 'error')) AS ax,
  list_filter(list_filter(skills, lambda x: length(x) <= 24)[1:12], lambda x: x IN ('thtion', 'attion', 'ertion', 'inoran', 'hehely', 'orantion', 'thatin', 'ononst', 'thanea', 'eriner')) AS sk FROM posting),
dp1 AS (SELECT id, ord, company, active, CASE WHEN len(ax) = 2 THEN [{'l': ax[1], 'r': ax[2]}] ELSE [] END || flatten(list_transform(ax, lambda a: list_transform(sk[1:8], lambda b: {'l': a, 'r': b}))) AS ps FROM dp0),
dp2 AS (SELECT id, ord, company, active, unnest(ps) AS p FROM dp1),
dp3 AS (SELECT *, array_to_string(list_sort([p.l, p.r]), '|') AS pair FROM dp2)
SELECT '' AS grp, pair, count(*) AS postings, count(DISTINCT company) AS companies, count(*) FILTER (active) AS active_postings, arg_min(p.l, ord) AS "left", arg_min(p.r, ord) AS "right" FROM dp3 GROUP BY pair""")
def h7d(spark, sf):
    rows = posting_doc(spark, sf).withColumn("axes", F.array("event_type", "role"))
    return H.pair_stats(H.pair_members(H.semantic_profile(rows, DOC_PAIR_RULES))).select("grp", "pair", "postings", "companies", "active_postings", "left", "right")


@query("h8_semantic_bundles")
def h8(spark, sf):
    prof, m = part_pairs(spark, sf)
    b = H.bundle_evidence(H.semantic_bundles(m, 12, PAIR_RULES), m, prof)
    return b.select("position", "pair", "label", "postings", "companies", "active_postings", "new_postings", "confidence", "templated", join_list("evidence_terms").alias("evidence_terms"))


@query("h8_role_bundles")
def h8r(spark, sf):
    _, m = part_pairs(spark, sf, "role")
    return H.semantic_bundles(m, 8, PAIR_RULES).select("grp", "position", "pair", "label", "postings", "new_postings", "confidence")


GRAPH_SQL = QT.ROWFACET_SQL + """,
fe AS (SELECT id, ord, event_type AS cluster_id, 'role' AS facet, 6 AS base, unnest(f_role[1:4]) AS label, generate_subscripts(f_role[1:4], 1) - 1 AS pos FROM facets UNION ALL SELECT id, ord, event_type, 'keyword', 5, unnest(f_keyword[1:4]), generate_subscripts(f_keyword[1:4], 1) - 1 FROM facets
  UNION ALL SELECT id, ord, event_type, 'tag', 3, unnest(f_tag[1:4]), generate_subscripts(f_tag[1:4], 1) - 1 FROM facets UNION ALL SELECT id, ord, event_type, 'context', 2, unnest(f_context[1:4]), generate_subscripts(f_context[1:4], 1) - 1 FROM facets),
edges AS (SELECT *, 'signal:' || facet || ':' || regexp_replace(lower(label), '[^0-9a-z가-힣]+', '', 'g') AS signal_id FROM fe)"""


def graph(spark, sf):
    return H.signal_graph(QT.facet_rows(spark, sf).withColumn("cluster_id", F.col("event_type")))


@query("h9_posting_edges", "WITH " + GRAPH_SQL + " SELECT id, signal_id, facet, greatest(base - pos, 1) AS weight FROM edges")
def h9(spark, sf):
    return graph(spark, sf)["posting_edges"]


@query("h9_cluster_edges", "WITH " + GRAPH_SQL + " SELECT cluster_id, signal_id, sum(base) AS weight FROM edges GROUP BY ALL")
def h9c(spark, sf):
    return graph(spark, sf)["cluster_edges"]


@query("h9_cluster_summary", "WITH " + GRAPH_SQL + """,
sg AS (SELECT signal_id, arg_min(label, ord) AS label FROM edges GROUP BY 1),
c0 AS (SELECT cluster_id, facet, signal_id, sum(base) AS w FROM edges GROUP BY ALL), ce AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, facet ORDER BY w DESC, signal_id) AS rk FROM c0)
SELECT cluster_id, facet, count(*) AS n, string_agg(lower(label), '|' ORDER BY rk) AS labels FROM ce JOIN sg USING (signal_id) WHERE rk <= 6 GROUP BY cluster_id, facet""")
def h9s(spark, sf):
    return graph(spark, sf)["cluster_summary"].select("cluster_id", "facet", F.size("labels").cast("bigint").alias("n"), F.lower(join_list("labels")).alias("labels"))


@query("h9_signal_nodes", "WITH " + GRAPH_SQL + " SELECT signal_id, facet FROM edges GROUP BY ALL")
def h9n(spark, sf):
    return graph(spark, sf)["signals"].select("signal_id", "facet")


CONN_SQL = POSTING_SQL + """,
cs0 AS (SELECT id, event_type AS cluster_id, unnest(list_transform(keywords[1:6], lambda x: {'k': x, 'w': 6}) || [{'k': focus_label, 'w': 5}, {'k': role, 'w': 4}]) AS s FROM posting),
conn AS (SELECT id, cluster_id, s.k AS key, max(s.w) AS w FROM cs0 WHERE s.k NOT IN ('', 'error') AND NOT s.k LIKE '%ly' GROUP BY ALL),
rich AS (SELECT p.id, coalesce(sum(c.w), 0) AS richness FROM posting p LEFT JOIN conn c ON c.id = p.id GROUP BY p.id),
lead AS (SELECT event_type AS cluster_id, p.id AS leader, focus_label AS lf, role AS lr, quality AS lq FROM posting p JOIN rich USING (id)
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY richness DESC, active DESC, coalesce(epoch(TRY_CAST(nullif(last_seen_at, '') AS TIMESTAMP)), 0), lower(company) DESC, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) DESC, p.id) = 1)"""


def clustered(spark, sf):
    return plain_rows(spark, sf).withColumn("cluster_id", F.col("event_type"))


@query("h10_related_postings", "WITH " + CONN_SQL + """,
sh AS (SELECT c.id, sum(least(c.w, d.w)) AS s FROM conn c JOIN lead l ON l.cluster_id = c.cluster_id JOIN conn d ON d.id = l.leader AND d.key = c.key GROUP BY c.id)
SELECT l.cluster_id, l.leader, p.id, CAST(coalesce(s, 0) + CASE WHEN lf <> '' AND lf = p.focus_label THEN 4 ELSE 0 END + CASE WHEN lr = p.role THEN 5 ELSE 0 END + CASE WHEN lq <> 'low' AND p.quality <> 'low' THEN 1 ELSE 0 END AS BIGINT) AS similarity, richness
FROM posting p JOIN lead l ON l.cluster_id = p.event_type JOIN rich r ON r.id = p.id LEFT JOIN sh ON sh.id = p.id WHERE p.id <> l.leader""")
def h10(spark, sf):
    return H.related_postings(clustered(spark, sf), PLAIN)


@query("h10_row_similarity", "WITH " + CONN_SQL + """,
pr AS (SELECT id AS l, CAST(ord + 1 AS VARCHAR) AS r FROM posting WHERE ord + 1 IN (SELECT ord FROM posting)),
sh AS (SELECT pr.l, pr.r, sum(least(a.w, b.w)) AS s FROM pr JOIN conn a ON a.id = pr.l JOIN conn b ON b.id = pr.r AND b.key = a.key GROUP BY ALL)
SELECT pr.l, pr.r, CAST(coalesce(s, 0) + CASE WHEN a.focus_label <> '' AND a.focus_label = b.focus_label THEN 4 ELSE 0 END + CASE WHEN a.role = b.role THEN 5 ELSE 0 END + CASE WHEN a.quality <> 'low' AND b.quality <> 'low' THEN 1 ELSE 0 END AS BIGINT) AS similarity
FROM pr JOIN posting a ON a.id = pr.l JOIN posting b ON b.id = pr.r LEFT JOIN sh ON sh.l = pr.l AND sh.r = pr.r""")
def h10p(spark, sf):
    rows = clustered(spark, sf)
    nxt = rows.select("id", "ord").select(F.col("id").alias("l"), (F.col("ord") + 1).alias("ord")).join(rows.select("ord", F.col("id").alias("r")), "ord").select("l", "r")
    return H.row_similarity(rows, nxt, PLAIN)


@query("e16_bundle_filter")
def e16(spark, sf):
    rows = posting_part(spark, sf)
    _, m = part_pairs(spark, sf)
    b = H.semantic_bundles(m, 12, PAIR_RULES)
    f = H.bundle_filter(b, m, M.current_rows(rows, None, True, "role"), False)
    return f.select("position", "pair", "posting_count", "company_count")


@query("h11_bundle_health")
def h11(spark, sf):
    rows = posting_part(spark, sf)
    _, m = part_pairs(spark, sf)
    b = H.semantic_bundles(m, 12, PAIR_RULES)
    return H.bundle_health(rows, m, b)


@query("h12_build_board")
def h12(spark, sf):
    from hiremill.operators.board import BoardPlan, build_board

    args, rules = QT.board_inputs(spark, sf)
    parts = build_board(*args, plan=BoardPlan(rules=rules, themes=THEME_RULES, pairs=DOC_PAIR_RULES, tones=TONES))
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
