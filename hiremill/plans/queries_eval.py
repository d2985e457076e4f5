"""Checked queries for sampling, evaluation and reviewed labels (groups I, J, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill.functions.terms import TermRules
from hiremill.functions.text import empty_list, join_list
from hiremill.operators import evaluate as J
from hiremill.operators import review as K
from hiremill.operators import sampling as I
from hiremill.operators.classify import scope_decision
from hiremill.plans import queries_text as QT
from hiremill.plans.adapters import POSTING_SQL, posting_doc, posting_part
from hiremill.plans.base import query, table
from hiremill.plans.queries_board import PLAIN


def rows(spark, sf):
    return posting_doc(spark, sf).withColumns({"role_group": F.col("role"), "cluster_id": F.col("event_type")})


ORDER_SQL = """CASE quality WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, CASE WHEN active THEN 0 ELSE 1 END, role, event_type, company, trim(regexp_replace(title, '\\s+', ' ', 'g')), id"""


@query("i1_stratified_round_robin", "WITH " + POSTING_SQL + f""",
b AS (SELECT quality, role, event_type, active, count(*) AS n FROM posting GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n, role, event_type, CASE WHEN active THEN 'active' ELSE 'inactive' END) AS br FROM b),
t AS (SELECT p.id, p.quality, br, row_number() OVER (PARTITION BY p.quality, p.role, p.event_type, p.active ORDER BY {ORDER_SQL}) AS turn FROM posting p JOIN br USING (quality, role, event_type, active)),
pl AS (SELECT id, quality, row_number() OVER (PARTITION BY quality ORDER BY turn, br) AS place FROM t),
c AS (SELECT least(120, count(*)) AS goal, count(*) FILTER (quality = 'high') AS h, count(*) FILTER (quality = 'medium') AS m, count(*) FILTER (quality = 'low') AS l FROM posting),
q AS (SELECT goal, least(h, greatest(4, round_even(goal * 0.08, 0))) AS qh, least(m, greatest(24, round_even(goal * 0.32, 0))) AS qm, l FROM c),
q2 AS (SELECT *, least(l, greatest(goal - qh - qm, 0)) AS ql FROM q),
ch AS (SELECT id, CASE quality WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS stage, place, 'quota' AS source FROM pl, q2 WHERE place <= CASE quality WHEN 'high' THEN qh WHEN 'medium' THEN qm ELSE ql END),
fl AS (SELECT id, 3 AS stage, row_number() OVER (ORDER BY {ORDER_SQL}) AS place, 'fill' AS source FROM posting WHERE id NOT IN (SELECT id FROM ch))
SELECT * FROM ch UNION ALL SELECT fl.* FROM fl WHERE place <= (SELECT goal FROM q2) - (SELECT count(*) FROM ch)""")
def i1(spark, sf):
    return I.stratified_round_robin(rows(spark, sf), 120)


@query("i2_newest_holdout", "WITH " + POSTING_SQL + " SELECT id, first_seen_at FROM posting ORDER BY first_seen_at DESC, active DESC, company, title, id LIMIT 40")
def i2(spark, sf):
    return I.newest_holdout(rows(spark, sf), 40).select("id", "first_seen_at")


@query("i2_date_range", "WITH " + POSTING_SQL + " SELECT min(first_seen_at) AS oldest, max(first_seen_at) AS newest, count(*) AS n FROM posting")
def i2r(spark, sf):
    return I.date_range(rows(spark, sf))


WAVE = dict(broad=("view",), hiring=("ein", "attion"), banned=("thatin",), generic=("inoran",), particles=("ing", "ly"))
REVIEW_SQL = POSTING_SQL + """,
ri0 AS (SELECT *, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS sm, list_filter(string_split(trim(regexp_replace(lower(summary), '[^0-9a-z가-힣]+', ' ', 'g')), ' '), lambda x: x <> '') AS st,
  list_filter(string_split(trim(regexp_replace(lower(title), '[^0-9a-z가-힣]+', ' ', 'g')), ' '), lambda x: x <> '') AS tt FROM posting),
ri1 AS (SELECT *, CASE WHEN len(st) > 0 AND len(tt) > 0 THEN len(list_intersect(list_distinct(st), list_distinct(tt))) / least(len(list_distinct(st)), len(list_distinct(tt))) ELSE 0 END AS ov,
  len(list_filter(keywords[1:8], lambda x: x IN ('thatin', 'inoran', 'ein', 'attion') OR x LIKE '%ing' OR x LIKE '%ly')) AS nz FROM ri0),
review AS (SELECT *, list_filter([CASE WHEN quality = 'low' THEN 'low_quality' END, CASE WHEN sm = '' THEN 'summary_missing' WHEN length(sm) >= 56 THEN 'summary_too_long' END,
  CASE WHEN focus_label = '' THEN 'focus_missing' WHEN focus_label = 'view' THEN 'focus_too_broad' WHEN regexp_matches(focus_label, 'ein|attion') THEN 'focus_hiring_echo' END,
  CASE WHEN sm = '' THEN NULL WHEN ov >= 0.8 THEN 'summary_title_echo' WHEN regexp_matches(lower(sm), 'ein|attion') THEN 'summary_hiring_echo' WHEN contains(array_to_string(st, ' '), company) THEN 'summary_company_echo' END,
  CASE WHEN nz >= 2 THEN 'keyword_noise' END, CASE WHEN 1 + (len(tasks) > 0)::INT + (len(requirements) > 0)::INT + (len(preferred) > 0)::INT + (len(skills) > 0)::INT <= 1 THEN 'source_thin' END], lambda x: x IS NOT NULL) AS codes FROM ri1),
rs AS (SELECT *, coalesce(list_sum(list_transform(codes, lambda c: CASE WHEN c IN ('low_quality', 'summary_missing', 'focus_missing', 'focus_hiring_echo', 'focus_company_echo', 'summary_title_echo') THEN 100
  WHEN c IN ('focus_too_broad', 'summary_hiring_echo', 'summary_company_echo', 'keyword_noise') THEN 45 ELSE 15 END)), 0) AS score FROM review)"""


def reviewed(spark, sf):
    return I.detect_review_issues(rows(spark, sf), **WAVE)


@query("i3_detect_review_issues", "WITH " + REVIEW_SQL + " SELECT id, array_to_string(codes, '|') AS codes, CAST(score AS BIGINT) AS review_score, CASE WHEN score >= 100 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS review_priority FROM rs")
def i3(spark, sf):
    return reviewed(spark, sf).select("id", join_list("review_codes").alias("codes"), "review_score", "review_priority")


@query("i4_review_wave", "WITH " + REVIEW_SQL + """
SELECT * FROM (SELECT id, false AS control_sample FROM rs WHERE len(codes) > 0 ORDER BY score DESC, quality <> 'low', role, company, title, id LIMIT 30)
UNION ALL SELECT * FROM (SELECT id, true FROM rs WHERE len(codes) = 0 ORDER BY quality <> 'high', NOT active, role, company, title, id LIMIT 12)""")
def i4(spark, sf):
    return I.review_wave(reviewed(spark, sf), 30, 12).select("id", "control_sample")


@query("i5_gold_candidates", "WITH " + POSTING_SQL + """,
g0 AS (SELECT *, focus_label || ' ' || trim(regexp_replace(summary, '\\s+', ' ', 'g')) || ' ' || array_to_string(keywords, ' ') AS tx FROM posting),
g1 AS (SELECT *, CASE WHEN contains(tx, 'thtion') THEN 'd1' WHEN contains(tx, 'attion') THEN 'd2' WHEN contains(tx, 'ertion') THEN 'd1' ELSE 'general' END AS dom FROM g0),
t AS (SELECT id, 'broad_focus' AS reason, 'broad_focus' AS bucket, 0 AS rk FROM g1 WHERE focus_label IN ('view') UNION ALL SELECT id, 'low_or_empty', 'low_or_empty', 1 FROM g1 WHERE quality = 'low' OR trim(summary) = ''
  UNION ALL SELECT id, 'domain_specific', dom, 2 FROM (SELECT * FROM g1 WHERE dom <> 'general' QUALIFY row_number() OVER (PARTITION BY dom ORDER BY focus_label, company, title, id) <= 6)
  UNION ALL SELECT id, 'focus_keyword_conflict', 'confusable', 3 FROM g1 WHERE focus_label <> '' AND NOT list_contains(keywords, focus_label) AND len(keywords) >= 3)
SELECT id, reason, bucket FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY rk) = 1""")
def i5(spark, sf):
    return I.gold_candidates(rows(spark, sf), ["view"], {"thtion": "d1", "attion": "d2", "ertion": "d1"})


@query("i6_balanced_pick", "WITH RECURSIVE " + POSTING_SQL + """,
d AS (SELECT id, company AS c, role AS r, CASE quality WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS q, count(*) OVER (PARTITION BY company) AS den, len(keywords) AS n, focus_label AS f, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM posting),
o AS (SELECT id, c, r, row_number() OVER (ORDER BY q, den, n DESC, f, t, id) AS pl FROM d),
g(i, cs, rs, ids) AS (
  SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN list_append(cs, c) ELSE cs END, CASE WHEN ok THEN list_append(rs, r) ELSE rs END, CASE WHEN ok THEN list_append(ids, CAST(id AS VARCHAR)) ELSE ids END
  FROM (SELECT g.*, o.id, o.c, o.r, len(ids) < 30 AND len(list_filter(cs, lambda x: x = o.c)) < 2 AND (o.r = '' OR len(list_filter(rs, lambda x: x = o.r)) < 10) AS ok FROM g JOIN o ON o.pl = g.i + 1)
),
p AS (SELECT unnest(ids) AS id FROM (SELECT ids FROM g ORDER BY i DESC LIMIT 1)),
fl AS (SELECT id, row_number() OVER (ORDER BY q, den, n DESC, f, t, id) AS pl FROM d WHERE CAST(id AS VARCHAR) NOT IN (SELECT id FROM p))
SELECT id, 'balanced' AS source FROM d WHERE CAST(id AS VARCHAR) IN (SELECT id FROM p) UNION ALL SELECT id, 'fill' FROM fl WHERE pl <= 30 - (SELECT count(*) FROM p)""")
def i6(spark, sf):
    return I.balanced_pick(rows(spark, sf), 30, role="role")


REM_SQL = POSTING_SQL + """,
rem AS (SELECT id, company, title, active, quality, 'board_low_quality' AS bucket FROM posting WHERE quality = 'low' UNION ALL SELECT id, company, title, active, quality, 'core_gate_failure' FROM posting WHERE n_chars % 9 = 0
  UNION ALL SELECT id, company, title, active, quality, 'incremental_gate_failure' FROM posting WHERE n_chars % 11 = 0)"""


def remediation(spark, sf):
    r = rows(spark, sf)
    return I.release_remediation(r, r.where("n_chars % 9 = 0"), r.where("n_chars % 11 = 0"))


@query("i7_bucket_quota_pick", "WITH " + REM_SQL + """,
s1 AS (SELECT id, bucket FROM rem WHERE bucket = 'board_low_quality' ORDER BY NOT active, quality, company, title, id LIMIT 12),
s2 AS (SELECT id, bucket FROM rem WHERE bucket = 'core_gate_failure' AND id NOT IN (SELECT id FROM s1) ORDER BY NOT active, quality, company, title, id LIMIT 10),
s3 AS (SELECT id, bucket FROM rem WHERE bucket = 'incremental_gate_failure' AND id NOT IN (SELECT id FROM s1 UNION ALL SELECT id FROM s2) ORDER BY NOT active, quality, company, title, id LIMIT 8),
ch AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)
SELECT id, bucket, 'quota' AS source FROM ch UNION ALL SELECT id, min(bucket), 'rest' FROM rem WHERE id NOT IN (SELECT id FROM ch) GROUP BY id""")
def i7(spark, sf):
    return I.bucket_quota_pick(remediation(spark, sf), I.RELEASE_TARGETS, [(~F.col("active")).cast("int"), "quality", "company", "title", "id"])


@query("i8_release_remediation", "WITH " + REM_SQL + " SELECT id, bucket, active, quality FROM rem")
def i8(spark, sf):
    return remediation(spark, sf).select("id", "bucket", "active", "quality")


@query("i8_role_remediation", "WITH " + QT.VOTE_SQL + """,
x AS (SELECT v0.id, raw, coalesce(sg, 'xx') AS sg, coalesce(cl, CASE WHEN p.n_chars % 4 < 2 THEN 'xx' ELSE '' END) AS cl, cf, r.role_group AS fin FROM v0 JOIN roles r ON r.id = v0.id JOIN posting p ON p.id = v0.id),
t AS (SELECT id, 'missing_classifier_output' AS bucket, 'high' AS priority, 0 AS rk FROM x WHERE cl = '' UNION ALL SELECT id, 'low_confidence', 'high', 2 FROM x WHERE cl <> '' AND cf = 'low'
  UNION ALL SELECT id, 'final_role_conflict', CASE WHEN raw = sg AND cl <> raw THEN 'critical' WHEN cf = 'high' THEN 'high' ELSE 'medium' END, 1 FROM x WHERE cl <> '' AND cl <> fin
  UNION ALL SELECT id, 'source_role_disagreement', 'medium', 3 FROM x WHERE cl <> '' AND cl = fin AND raw <> cl AND cf = 'high')
SELECT id, bucket, priority FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY rk) = 1""")
def i8r(spark, sf):
    from hiremill.operators.classify import resolve_role

    v = QT.vote_rows(posting_doc(spark, sf)).withColumn("company", F.lit(""))
    return I.role_remediation(resolve_role(v, QT.ROLE_RULES)).select("id", "bucket", "priority")


@query("i9_guard_recovery", "WITH " + QT.SCOPE_SQL + " SELECT id, company, quality FROM scope WHERE act = 'exclude' AND scope_action = 'include'")
def i9(spark, sf):
    return I.guard_recovery_candidates(scope_decision(QT.scope_rows(spark, sf), QT.SCOPE)).select("id", "company", "quality")


HALF_SQL = POSTING_SQL + """,
h0 AS (SELECT id, company, list_filter(keywords, lambda x: contains(x, 'e')) AS e_a, list_filter(keywords, lambda x: contains(x, 't')) AS p_a, keywords[1:2] AS e_b, keywords[1:3] AS p_b FROM posting),
h AS (SELECT *, len(list_intersect(e_a, p_a)) AS ia, len(list_intersect(e_b, p_b)) AS ib FROM h0)"""


def halves(spark, sf):
    p = posting_doc(spark, sf)
    return p.select("id", F.filter("keywords", lambda x: F.contains(x, F.lit("e"))).alias("e_a"), F.filter("keywords", lambda x: F.contains(x, F.lit("t"))).alias("p_a"),
                    F.slice("keywords", 1, 2).alias("e_b"), F.slice("keywords", 1, 3).alias("p_b"))


@query("j1_set_f1", "WITH " + HALF_SQL + " SELECT id, CASE WHEN len(e_a) = 0 AND len(p_a) = 0 THEN 1.0 WHEN len(e_a) = 0 OR len(p_a) = 0 OR ia = 0 THEN 0.0 ELSE 2.0 * ia / (len(e_a) + len(p_a)) END::DOUBLE AS f1 FROM h")
def j1(spark, sf):
    return halves(spark, sf).select("id", J.set_f1(F.col("e_a"), F.col("p_a")).alias("f1"))


@query("j1_score_signal_items", "WITH " + HALF_SQL + """,
x AS (SELECT 'a' AS category, (e_a = p_a) AS ex, CASE WHEN len(e_a) = 0 AND len(p_a) = 0 THEN true ELSE ia > 0 END AS hi, len(e_a) > 0 AS fi FROM h UNION ALL SELECT 'b', (e_b = p_b), CASE WHEN len(e_b) = 0 AND len(p_b) = 0 THEN true ELSE ib > 0 END, len(e_b) > 0 FROM h
  UNION ALL SELECT '*', (e_a = p_a) AND (e_b = p_b), (e_a = p_a) AND (e_b = p_b), (e_a = p_a) AND (e_b = p_b) FROM h)
SELECT category, count(*) AS n, round_even(avg(ex::INT), 4) AS exact_rate, round_even(avg(hi::INT), 4) AS hit_rate, count(*) FILTER (fi) AS filled FROM x GROUP BY category""")
def j1s(spark, sf):
    return J.score_signal_items(halves(spark, sf), ["a", "b"]).select("category", "n", "exact_rate", "hit_rate", "filled")


def gold_pred(spark, sf):
    p = posting_doc(spark, sf)
    n = F.col("n_chars")
    gold = p.where("quality <> 'medium'").select("id", "company", "summary", "focus_label", "keywords", "quality")
    pred = p.select("id", F.when(n % 5 == 0, "").otherwise(F.col("summary")).alias("summary"), F.when(n % 4 == 0, "other").otherwise(F.col("focus_label")).alias("focus_label"), F.slice("keywords", 1, 5).alias("keywords"),
                    F.when(n > 900, "high").otherwise("low").alias("quality"))
    return gold, pred


GOLD_SQL = POSTING_SQL + """,
j AS (SELECT id, company, (n_chars % 5 <> 0 OR trim(summary) = '') AS sm, (n_chars % 4 <> 0 OR focus_label = 'other') AS fm, quality = CASE WHEN n_chars > 900 THEN 'high' ELSE 'low' END AS qm, quality = 'low' AS tl, n_chars <= 900 AS rl,
  CASE WHEN len(keywords) = 0 THEN 1.0 ELSE 2.0 * least(len(keywords), 5) / (len(keywords) + least(len(keywords), 5)) END AS f1, (trim(summary) = '') <> (n_chars % 5 = 0 OR trim(summary) = '') AS sg, (focus_label = '') <> (CASE WHEN n_chars % 4 = 0 THEN 'other' ELSE focus_label END = '') AS fg
  FROM posting WHERE quality <> 'medium')"""


@query("j2_gold_metrics", "WITH " + GOLD_SQL + """
SELECT count(*) AS requested_items, round_even(count(*) FILTER (sm) / count(*), 4) AS summary_exact_rate, round_even(count(*) FILTER (fm) / count(*), 4) AS focus_exact_rate, round_even(count(*) FILTER (qm) / count(*), 4) AS quality_exact_rate,
  round_even(count(*) FILTER (tl AND rl) / count(*) FILTER (tl), 4) AS low_match_rate, round_even(avg(f1), 4) AS avg_keyword_f1, round_even(count(*) FILTER (sm AND fm AND qm AND f1 >= 0.8) / count(*), 4) AS strict_pass_rate,
  round_even(count(*) FILTER (sg) / count(*), 4) AS summary_empty_mismatch_rate, round_even(count(*) FILTER (fg) / count(*), 4) AS focus_empty_mismatch_rate FROM j""")
def j2(spark, sf):
    return J.gold_metrics(J.judged(*gold_pred(spark, sf), PLAIN))


@query("j2_gold_failures", "WITH " + GOLD_SQL + " SELECT id, sm AS summary_match, fm AS focus_match, qm AS quality_match FROM j WHERE NOT (sm AND fm AND qm AND f1 >= 0.8) ORDER BY sm, fm, qm, round_even(f1, 3), company, id LIMIT 10")
def j2f(spark, sf):
    return J.gold_failures(J.judged(*gold_pred(spark, sf), PLAIN)).select("id", "summary_match", "focus_match", "quality_match")


GENERIC = TermRules(**{**PLAIN.__dict__, "generic": ("^thatin$",), "weak_suffixes": ("ing",)})
OUT_SQL = POSTING_SQL + """,
o AS (SELECT *, n_chars % 6 > 0 AS ret, list_filter(keywords, lambda x: x = 'thatin' OR x LIKE '%ing' OR x LIKE 'hat%') AS ban, list_filter(keywords, lambda x: length(x) >= 28 OR x LIKE '%tion') AS sen, focus_label <> '' AND (focus_label LIKE 'hat%' OR focus_label LIKE '%ing' OR focus_label = 'view') AS fb FROM (SELECT * REPLACE (keywords[1:6] AS keywords) FROM posting))"""
BAN = ("^hat", "^view$")


def outputs(spark, sf):
    p = posting_doc(spark, sf)
    return J.with_output_flags(p.select("id", "company", "title"), p.where("n_chars % 6 > 0").select("id", "summary", "focus_label", "keywords", "quality"), BAN, GENERIC, ("tion",))


@query("j3_output_metrics", "WITH " + OUT_SQL + """,
k AS (SELECT count(*) AS n, count(*) FILTER (ret) AS g, sum(len(keywords)) FILTER (ret) AS kw, sum(len(ban)) FILTER (ret) AS b, sum(len(sen)) FILTER (ret) AS s, sum(list_sum(list_transform(keywords, lambda x: length(x)))) FILTER (ret) AS c,
  sum(len(list_filter(keywords, lambda x: length(x) >= 18))) FILTER (ret) AS lk, count(*) FILTER (ret AND trim(summary) = '') AS es, count(*) FILTER (ret AND focus_label = '') AS ef, count(*) FILTER (ret AND quality = 'low') AS lo,
  count(*) FILTER (ret AND trim(summary) <> '' AND focus_label <> '' AND len(keywords) >= 2 AND quality <> 'low') AS us, count(*) FILTER (ret AND fb) AS fbn FROM o)
SELECT n AS requested_items, g AS returned_items, round_even(g / n, 4) AS coverage_rate, round_even(es / g, 4) AS empty_summary_rate, round_even(ef / g, 4) AS empty_focus_rate, round_even(lo / g, 4) AS low_rate, round_even(us / g, 4) AS usable_rate,
  round_even(kw / g, 2) AS keywords_per_item, round_even(c / kw, 2) AS avg_keyword_length, round_even(b / kw, 4) AS banned_rate, round_even(fbn / g, 4) AS focus_banned_rate, round_even(s / kw, 4) AS sentence_rate, round_even(lk / kw, 4) AS long_rate FROM k""")
def j3(spark, sf):
    return J.output_metrics(outputs(spark, sf))


@query("j3_suspicious_terms", "WITH " + OUT_SQL + ", t AS (SELECT unnest(ban || sen || CASE WHEN fb THEN [focus_label] ELSE [] END) AS term FROM o WHERE ret) SELECT row_number() OVER (ORDER BY count(*) DESC, term) AS rank, term, count(*) AS n FROM t GROUP BY term QUALIFY rank <= 12")
def j3s(spark, sf):
    return J.suspicious_terms(outputs(spark, sf))


@query("j3_failure_examples", "WITH " + OUT_SQL + """,
f AS (SELECT *, list_filter([CASE WHEN quality = 'low' THEN 'quality=low' END, CASE WHEN trim(summary) = '' THEN 'empty_summary' END, CASE WHEN focus_label = '' THEN 'empty_focus_label' END, CASE WHEN len(ban) > 0 THEN 'banned_keyword' END, CASE WHEN len(sen) > 0 THEN 'sentence_like_keyword' END], lambda x: x IS NOT NULL) AS rs FROM o WHERE ret)
SELECT id, array_to_string(rs, '|') AS reasons FROM f WHERE len(rs) > 0 ORDER BY len(ban) = 0, len(sen) = 0, quality <> 'low', company, title, id LIMIT 8""")
def j3f(spark, sf):
    return J.failure_examples(outputs(spark, sf)).select("id", join_list("reasons").alias("reasons"))


RUN_SQL = """
mt AS (SELECT 'run' || (o_custkey % 4) AS run, CASE WHEN o_orderkey % 2 = 0 THEN 'core' ELSE 'incremental' END AS dataset, ['strict_pass_rate', 'focus_exact_rate', 'avg_keyword_f1', 'low_match_rate', 'usable_rate', 'low_rate', 'banned_rate', 'empty_focus_rate'][(o_orderkey // 2) % 8 + 1] AS metric,
  round(avg(o_totalprice) / 1000000, 6) AS value FROM orders GROUP BY ALL)"""


def run_metrics(spark, sf):
    o = table(spark, sf, "orders")
    names = F.array(*[F.lit(x) for x in ("strict_pass_rate", "focus_exact_rate", "avg_keyword_f1", "low_match_rate", "usable_rate", "low_rate", "banned_rate", "empty_focus_rate")])
    k = F.col("o_orderkey")
    return o.groupBy(F.concat(F.lit("run"), F.col("o_custkey") % 4).alias("run"), F.when(k % 2 == 0, "core").otherwise("incremental").alias("dataset"),
                     F.get(names, ((k / 2).cast("bigint") % 8).cast("int")).alias("metric")).agg(F.round(F.avg("o_totalprice") / 1000000, 6).alias("value"))


@query("j4_non_regression_gate", "WITH " + RUN_SQL + """,
ck AS (SELECT unnest(['core', 'core', 'core', 'core', 'incremental', 'incremental', 'incremental', 'incremental']) AS dataset, unnest(['strict_pass_rate', 'focus_exact_rate', 'avg_keyword_f1', 'low_match_rate', 'usable_rate', 'low_rate', 'banned_rate', 'empty_focus_rate']) AS metric, unnest([1, 1, 1, 1, 1, -1, -1, -1]) AS d)
SELECT m.run, bool_and((m.value - b.value) * d >= 0) AS passed, count(*) FILTER ((m.value - b.value) * d < 0) AS failed_checks FROM mt m JOIN mt b USING (dataset, metric) JOIN ck USING (dataset, metric) WHERE b.run = 'run0' AND m.run <> 'run0' GROUP BY m.run""")
def j4(spark, sf):
    return J.non_regression_gate(run_metrics(spark, sf), "run0")


@query("j4_suite_gate", "WITH " + RUN_SQL + """
SELECT m.run, bool_and(CASE WHEN metric = 'usable_rate' THEN m.value >= b.value ELSE m.value <= b.value END) AS passed, count(*) FILTER (NOT CASE WHEN metric = 'usable_rate' THEN m.value >= b.value ELSE m.value <= b.value END) AS failed_checks
FROM mt m JOIN mt b USING (dataset, metric) WHERE b.run = 'run0' AND m.run <> 'run0' AND metric IN ('usable_rate', 'low_rate', 'banned_rate', 'empty_focus_rate') GROUP BY m.run""")
def j4s(spark, sf):
    return J.non_regression_gate(run_metrics(spark, sf), "run0", J.SUITE_CHECKS)


@query("j4_metric_diff", "WITH " + RUN_SQL + " SELECT m.run, dataset, metric, round_even(m.value - b.value, 4) AS diff FROM mt m JOIN mt b USING (dataset, metric) WHERE b.run = 'run0' AND m.run <> 'run0'")
def j4d(spark, sf):
    return J.metric_diff(run_metrics(spark, sf), "run0")


@query("j4_champion", "WITH " + RUN_SQL + """
SELECT 'run0' AS run, round(sum(value * CASE WHEN dataset = 'core' THEN CASE metric WHEN 'strict_pass_rate' THEN 5.0 WHEN 'focus_exact_rate' THEN 3.0 WHEN 'avg_keyword_f1' THEN 2.5 WHEN 'low_match_rate' THEN 1.5 ELSE 0 END
  ELSE CASE metric WHEN 'usable_rate' THEN 2.0 WHEN 'low_rate' THEN -1.5 WHEN 'banned_rate' THEN -2.0 WHEN 'empty_focus_rate' THEN -1.0 ELSE 0 END END), 6) AS score, false AS gate_passed, true AS used_fallback_baseline FROM mt WHERE run = 'run0'""")
def j4c(spark, sf):
    m = run_metrics(spark, sf)
    return J.champion(m, J.non_regression_gate(m, "run0"), "run0")


@query("j5_role_accuracy", "WITH " + QT.VOTE_SQL + """,
g AS (SELECT p.id, p.role AS raw, r.role_group, CASE WHEN l.quality = 1 THEN p.role ELSE 'fr' END AS ex FROM posting p JOIN roles r ON r.id = p.id JOIN labels l ON l.doc_id = p.ord)
SELECT count(*) AS n, round_even(count(*) FILTER (role_group = ex) / count(*), 4) AS resolved_accuracy, round_even(count(*) FILTER (raw = ex) / count(*), 4) AS raw_accuracy, count(*) FILTER (role_group = ex AND raw <> ex) AS improved, count(*) FILTER (role_group <> ex) AS mismatches FROM g""")
def j5(spark, sf):
    from hiremill.operators.classify import resolve_role

    p = posting_doc(spark, sf)
    gold = p.join(table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("q")), "ord").select("id", F.when(F.col("q") == 1, F.col("role")).otherwise("fr").alias("expected"))
    return J.role_accuracy(resolve_role(QT.vote_rows(p), QT.ROLE_RULES), gold)


SB_SQL = """
g AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'include' WHEN doc_id % 2 = 0 THEN 'review' ELSE 'exclude' END AS e, CASE WHEN toxic = 1 THEN 'low' ELSE 'high' END AS q FROM labels),
p AS (SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'review' WHEN 2 THEN 'exclude' ELSE 'what' END AS a FROM documents WHERE n_chars % 5 > 0),
j AS (SELECT g.doc_id, e, q, CASE WHEN a IN ('include', 'review', 'exclude') THEN a ELSE '' END AS a FROM g LEFT JOIN p USING (doc_id))"""


def scope_gold_pred(spark, sf):
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").where("n_chars % 5 > 0")
    gold = l.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "include").when(F.col("doc_id") % 2 == 0, "review").otherwise("exclude").alias("expected"), F.when(F.col("toxic") == 1, "low").otherwise("high").alias("quality"))
    n = F.col("n_chars") % 4
    return gold, d.select(F.col("doc_id").alias("id"), F.when(n == 0, "include").when(n == 1, "review").when(n == 2, "exclude").otherwise("what").alias("decision"))


@query("j6_scope_benchmark", "WITH " + SB_SQL + """,
m AS (SELECT count(*) AS n, count(*) FILTER (a <> '') AS v, count(*) FILTER (e = a) AS x, count(*) FILTER (e <> 'exclude') AS inc, count(*) FILTER (e <> 'exclude' AND a = 'exclude') AS fe, count(*) FILTER (e <> 'exclude' AND a = 'exclude' AND q = 'high') AS hf, count(*) FILTER (a = 'review') AS rv FROM j)
SELECT 'evaluated' AS metric, n::DOUBLE AS value FROM m UNION ALL SELECT 'schema_valid_rate', round_even(v / n, 4) FROM m UNION ALL SELECT 'exact_accuracy', round_even(x / n, 4) FROM m UNION ALL SELECT 'include_or_review_recall', round_even((inc - fe) / inc, 4) FROM m
UNION ALL SELECT 'review_usage_rate', round_even(rv / v, 4) FROM m UNION ALL SELECT 'false_excludes', fe FROM m UNION ALL SELECT 'high_quality_false_excludes', hf FROM m UNION ALL SELECT 'missing_predictions', n - v FROM m""")
def j6(spark, sf):
    return J.scope_benchmark(*scope_gold_pred(spark, sf))


@query("j6_confusion", "WITH " + SB_SQL + " SELECT e AS expected, coalesce(p.a, 'missing') AS actual, count(*) AS n FROM g LEFT JOIN p USING (doc_id) GROUP BY ALL")
def j6c(spark, sf):
    return J.confusion(*scope_gold_pred(spark, sf))


FAM = dict(analyst=("en",), engineers=("fr", "de"), deeptech=("thtion", "view"), business=("que", "und"), dominance=("click",), tools=("Purchase",), broad=("error",), block=("Der",))
FAM_SQL = QT.SIG_SQL + """,
fa AS (SELECT s.*, c.scope_action, lower(concat_ws(' ', s.company, s.title, s.summary, s.focus_label, array_to_string(s.keywords, ' '), array_to_string(domain_signals, ' '), array_to_string(problem_signals, ' '), array_to_string(system_signals, ' '),
    array_to_string(model_signals, ' '), array_to_string(data_signals, ' '), array_to_string(workflow_signals, ' '), upper(s.role), s.role)) AS ftx, concat_ws(' ', s.focus_label, coalesce(s.keywords[1], '')) AS fld,
  coalesce(problem_signals[1], list_filter(domain_signals, lambda x: x <> 'Der')[1], '') AS fst FROM signals s JOIN scx c ON c.id = s.id),
fam AS (SELECT id, unnest(list_filter([CASE WHEN scope_action <> 'include' THEN 'excluded_leaked_into_display' END, CASE WHEN role = 'en' AND regexp_matches(fld, 'thtion|view') THEN 'deeptech_in_data_analyst' END, CASE WHEN role = 'en' AND regexp_matches(ftx, 'thtion|view') THEN 'deeptech_context_present' END,
  CASE WHEN role IN ('fr', 'de') AND contains(fld, 'click') THEN 'business_in_engineer_family' END, CASE WHEN role IN ('fr', 'de') AND regexp_matches(ftx, 'que|und') THEN 'business_context_present' END, CASE WHEN focus_label = 'purchase' THEN 'tool_first_focus' END,
  CASE WHEN scope_action = 'review' THEN 'service_scope_review_in_display' END, CASE WHEN focus_label = 'error' AND fst <> '' THEN 'broad_focus_specificity_gap' END], lambda x: x IS NOT NULL)) AS family FROM fa)"""
FAM_SQL = FAM_SQL.replace(",\nfa AS", ",\nscx AS (SELECT id, CASE n_chars % 3 WHEN 0 THEN 'exclude' WHEN 1 THEN 'review' ELSE 'include' END AS scope_action FROM posting),\nfa AS")


def families(spark, sf):
    n = F.col("n_chars") % 3
    r = QT.signal_rows(spark, sf).withColumns({"role_group": F.col("role"), "scope_action": F.when(n == 0, "exclude").when(n == 1, "review").otherwise("include")})
    return J.anomaly_families(r.withColumn("scope_included", F.col("scope_action") == "include"), **FAM)


@query("j7_anomaly_families", "WITH " + FAM_SQL + " SELECT family, count(*) AS n FROM fam GROUP BY family")
def j7(spark, sf):
    return J.family_report(families(spark, sf)).select("family", "n")


@query("j7_family_examples", "WITH " + FAM_SQL + " SELECT family, id, row_number() OVER (PARTITION BY family ORDER BY CAST(id AS BIGINT)) AS rank FROM fam QUALIFY rank <= 12")
def j7e(spark, sf):
    return J.family_examples(families(spark, sf)).select("family", "id", "rank")


@query("j7_family_change", "WITH " + FAM_SQL + " SELECT family, count(*) AS before, count(*) FILTER (CAST(id AS BIGINT) % 2 = 0) AS after FROM fam GROUP BY family")
def j7c(spark, sf):
    f = families(spark, sf)
    return J.family_change(f, f.where("ord % 2 = 0"))


def flags(spark, sf):
    d = scope_decision(QT.scope_rows(spark, sf), QT.SCOPE).withColumns({"role_group": F.col("role"), "classifier_role": F.when(F.col("n_chars") % 5 == 0, "").when(F.col("n_chars") % 5 == 1, "fr").otherwise(F.col("role")),
                                                                        "classifier_confidence": F.lit("low"), "o_confidence": F.when(F.col("n_chars") % 2 == 0, "high").otherwise("low")})
    return J.quality_flags(d, ["thatin"], ai=("tion",), data=("und",), non_scope=("stupid",), data_roles=("de",))


QM_SQL = QT.SCOPE_SQL + """,
qf AS (SELECT *, scope_action = 'include' AS sh, scope_action = 'exclude' AS hd, CASE n_chars % 5 WHEN 0 THEN '' WHEN 1 THEN 'fr' ELSE role END AS cl, lower(concat_ws(' ', title, focus_label, array_to_string(keywords, ' '))) AS tx FROM scope)"""


@query("j8_quality_metrics", "WITH " + QM_SQL + """,
m AS (SELECT count(*) AS source_rows, count(*) FILTER (sh) AS board_rows, count(*) FILTER (sh AND quality = 'low') AS low_rows, count(*) FILTER (sh AND trim(summary) = '') AS missing_summary_rows, 0 AS signal_leak_rows, count(*) FILTER (sh AND list_contains(keywords, 'thatin')) AS display_leak_rows,
  count(*) FILTER (sh AND cl <> '' AND cl <> role) AS role_conflict_rows, count(*) FILTER (sh AND cl <> '' AND cl <> role) AS role_low_conflict_rows, count(*) FILTER (sh AND cl = '') AS role_missing_rows, 0 AS role_stale_rows, count(*) FILTER (NOT sh) AS excluded_rows, count(*) FILTER (scope_action = 'review') AS review_rows,
  count(*) FILTER (hd AND quality = 'high') AS excluded_high_rows, count(*) FILTER (hd AND quality IN ('high', 'medium')) AS excluded_medium_or_high_rows, count(*) FILTER (hd AND quality IN ('high', 'medium') AND NOT contains(tx, 'stupid') AND (contains(tx, 'tion') OR (role = 'de' AND contains(tx, 'und')))) AS excluded_adjacent_rows,
  count(*) FILTER (hd AND n_chars % 2 = 0) AS excluded_confident_rows, count(*) FILTER (sh AND act = 'exclude') AS guard_recovered_rows, count(*) FILTER (sh AND act = 'exclude' AND quality = 'high') AS guard_recovered_high_rows FROM qf),
d AS (SELECT *, round_even(board_rows / source_rows, 6) AS source_retention_rate, round_even(excluded_rows / source_rows, 6) AS filtered_out_rate, round_even(low_rows / board_rows, 6) AS board_low_rate FROM m)
SELECT metric, CAST(value AS DOUBLE) AS value FROM (SELECT COLUMNS(*)::DOUBLE FROM d) UNPIVOT (value FOR metric IN (*))""")
def j8(spark, sf):
    return J.quality_metrics(flags(spark, sf))


#: SQL condition of each row metric that occurs in the view.
METRIC_ROWS = {
    "board_rows": "sh", "low_rows": "sh AND quality = 'low'", "missing_summary_rows": "sh AND trim(summary) = ''", "display_leak_rows": "sh AND list_contains(keywords, 'thatin')",
    "role_conflict_rows": "sh AND cl <> '' AND cl <> role", "role_low_conflict_rows": "sh AND cl <> '' AND cl <> role", "role_missing_rows": "sh AND cl = ''", "excluded_rows": "NOT sh",
    "review_rows": "scope_action = 'review'", "excluded_high_rows": "hd AND quality = 'high'", "excluded_medium_or_high_rows": "hd AND quality IN ('high', 'medium')",
    "excluded_adjacent_rows": "hd AND quality IN ('high', 'medium') AND NOT contains(tx, 'stupid') AND (contains(tx, 'tion') OR (role = 'de' AND contains(tx, 'und')))",
    "excluded_confident_rows": "hd AND n_chars % 2 = 0", "guard_recovered_rows": "sh AND act = 'exclude'", "guard_recovered_high_rows": "sh AND act = 'exclude' AND quality = 'high'"}


@query("j8_metric_samples", "WITH " + QM_SQL + """,
l AS (SELECT id, ord, unnest(list_filter([""" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in METRIC_ROWS.items()) + """], lambda x: x IS NOT NULL)) AS metric FROM qf)
SELECT metric, id, row_number() OVER (PARTITION BY metric ORDER BY ord) AS rank FROM l QUALIFY rank <= 10""")
def j8s(spark, sf):
    return J.metric_samples(flags(spark, sf)).select("metric", "id", "rank")


TGT_SQL = """
mv AS (SELECT 'd' || (l_linenumber) AS metric, round(avg(l_discount), 6) AS actual FROM lineitem GROUP BY 1),
tg AS (SELECT 'd' || l_linenumber AS metric, CASE WHEN l_linenumber % 2 = 0 THEN 'max' ELSE 'min' END AS comparator, round(max(l_tax) * l_linenumber / 8, 6) AS target, CAST(l_linenumber AS DOUBLE) AS weight FROM lineitem GROUP BY l_linenumber),
sc AS (SELECT *, CASE WHEN comparator = 'max' THEN CASE WHEN target <= 0 THEN CASE WHEN actual <= 0 THEN 1.0 ELSE 0.0 END WHEN actual <= target THEN 1.0 ELSE target / actual END ELSE CASE WHEN target <= 0 OR actual >= target THEN 1.0 ELSE actual / target END END AS f,
  CASE WHEN comparator = 'max' THEN actual <= target ELSE actual >= target END AS passed FROM mv JOIN tg USING (metric))"""


def target_tables(spark, sf):
    l = table(spark, sf, "lineitem")
    k = F.col("l_linenumber")
    name = F.concat(F.lit("d"), k)
    m = l.groupBy(name.alias("metric")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    t = l.groupBy(k).agg(F.max("l_tax").alias("x")).select(name.alias("metric"), F.when(k % 2 == 0, "max").otherwise("min").alias("comparator"), F.round(F.col("x") * k / 8, 6).alias("target"), k.cast("double").alias("weight"))
    return m, t


@query("j9_target_score", "WITH " + TGT_SQL + " SELECT metric, actual, target, comparator, round(f, 6) AS fraction, passed FROM sc")
def j9(spark, sf):
    return J.target_score(*target_tables(spark, sf)).select("metric", "actual", "target", "comparator", "fraction", "passed")


@query("j9_overall_score", "WITH " + TGT_SQL + " SELECT round_even(sum(f * weight) / sum(weight) * 100, 4) AS score, bool_and(passed) AS all_passed, count(*) FILTER (NOT passed) AS failed FROM sc")
def j9o(spark, sf):
    return J.overall_score(J.target_score(*target_tables(spark, sf)))


@query("j10_improvement_gate", "WITH " + SB_SQL + """,
m AS (SELECT count(*) FILTER (e <> 'exclude' AND a = 'exclude')::DOUBLE AS fe, count(*) FILTER (e <> 'exclude' AND a = 'exclude' AND q = 'high')::DOUBLE AS hf, round_even(count(*) FILTER (a <> '') / count(*), 4) AS sv, round_even((count(*) FILTER (e <> 'exclude') - count(*) FILTER (e <> 'exclude' AND a = 'exclude')) / count(*) FILTER (e <> 'exclude'), 4) AS rc FROM j)
SELECT unnest(range(1, 12)) AS ord, unnest(['operationalLoopConverged', 'goldsetConfirmed', 'benchmarkFalseExcludeCount', 'benchmarkHighQualityFalseExcludeCount', 'benchmarkSchemaValidRate', 'benchmarkIncludeOrReviewRecall', 'modelBenchmarkPassed', 'modelImprovementEligible', 'shadowGuardOffTargetsPassed', 'guardRecoveredRows', 'guardRecoveredHighQualityRows']) AS name,
  unnest([0, 0, fe, hf, sv, rc, 0, 0, 0, 0, 0]::DOUBLE[]) AS actual, unnest([1, 1, 0, 0, 1, 1, 1, 1, 1, 0, 0]::DOUBLE[]) AS target, unnest([false, false, fe = 0, hf = 0, sv >= 1, rc >= 1, false, false, false, true, true]) AS passed FROM m""")
def j10(spark, sf):
    return J.improvement_gate(J.scope_benchmark(*scope_gold_pred(spark, sf)))


def eval_items(spark, sf):
    """Postings as evaluation items with reviews derived from their labels."""
    p, n = rows(spark, sf), F.col("n_chars")
    flag = lambda k: F.when(n % k == 0, True).when(n % k == 1, False)
    return p.withColumns({
        "dataset": F.when(n % 2 == 0, "core").otherwise("incremental"), "summary_pass": flag(3), "focus_pass": flag(4), "keywords_pass": flag(5), "overall_pass": flag(7),
        "corrected_summary": F.when(n % 11 == 0, "better").otherwise(""), "corrected_focus": F.when(n % 13 == 0, "view").otherwise(""), "corrected_quality": F.when(n % 17 == 0, "low").otherwise(""),
        "notes": F.when(n % 19 == 0, "n").otherwise(""), "corrected_keywords": F.when(n % 23 == 0, F.array(F.lit("kw"))).otherwise(empty_list())})


ITEM_SQL = POSTING_SQL + """,
items AS (SELECT *, CASE WHEN n_chars % 2 = 0 THEN 'core' ELSE 'incremental' END AS dataset, CASE n_chars % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sp, CASE n_chars % 4 WHEN 0 THEN true WHEN 1 THEN false END AS fp, CASE n_chars % 5 WHEN 0 THEN true WHEN 1 THEN false END AS kp,
  CASE n_chars % 7 WHEN 0 THEN true WHEN 1 THEN false END AS op, CASE WHEN n_chars % 11 = 0 THEN 'better' ELSE '' END AS cs, CASE WHEN n_chars % 13 = 0 THEN 'view' ELSE '' END AS cf, CASE WHEN n_chars % 17 = 0 THEN 'low' ELSE '' END AS cq, CASE WHEN n_chars % 19 = 0 THEN 'n' ELSE '' END AS nt,
  CASE WHEN n_chars % 23 = 0 THEN ['kw'] ELSE [] END AS ck FROM posting),
it AS (SELECT *, sp IS NOT NULL OR fp IS NOT NULL OR kp IS NOT NULL OR op IS NOT NULL OR cs <> '' OR cf <> '' OR cq <> '' OR nt <> '' OR len(ck) > 0 AS rv FROM items)"""


@query("j11_review_accuracy", "WITH " + ITEM_SQL + """
SELECT dataset, count(*) AS items, count(*) FILTER (rv) AS reviewed, count(*) FILTER (sp) AS summary_passed, count(sp) AS summary_pass_judged, round_even(count(*) FILTER (sp) / count(sp), 4) AS summary_pass_rate, count(*) FILTER (fp) AS focus_passed, count(fp) AS focus_pass_judged, round_even(count(*) FILTER (fp) / count(fp), 4) AS focus_pass_rate,
  count(*) FILTER (kp) AS keywords_passed, count(kp) AS keywords_pass_judged, round_even(count(*) FILTER (kp) / count(kp), 4) AS keywords_pass_rate, count(*) FILTER (op) AS overall_passed, count(op) AS overall_pass_judged, round_even(count(*) FILTER (op) / count(op), 4) AS overall_pass_rate FROM it GROUP BY dataset""")
def j11(spark, sf):
    return J.review_accuracy(eval_items(spark, sf))


@query("j12_review_error_tags", "WITH " + ITEM_SQL + """,
x AS (SELECT *, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS sm, length(trim(regexp_replace(detail_body, '\\s+', ' ', 'g'))) AS dl FROM it WHERE rv),
t AS (SELECT id, event_type, list_filter([CASE WHEN NOT sp THEN 'summary_rewrite' END, CASE WHEN sp THEN NULL WHEN sp IS NULL THEN NULL WHEN sm = '' THEN 'summary_missing' WHEN length(sm) <= 12 OR sm = title THEN 'summary_title_like' WHEN cs <> '' AND sm <> cs THEN 'summary_not_board_ready' END,
  CASE WHEN NOT fp THEN 'focus_relabel' END, CASE WHEN NOT fp AND focus_label = 'click' THEN 'focus_too_broad_or_generic' END, CASE WHEN NOT fp AND cf <> '' AND focus_label <> '' AND cf <> focus_label THEN 'focus_semantic_mismatch' END, CASE WHEN NOT kp THEN 'keywords_rewrite' END,
  CASE WHEN kp IS NULL OR kp THEN NULL WHEN len(keywords) = 0 THEN 'keywords_missing' WHEN len(ck) > 0 AND list_sort(keywords) <> ck THEN 'keywords_not_groupable' END, CASE WHEN cq = 'low' THEN 'keep_low' END, CASE WHEN cq <> 'low' THEN NULL WHEN dl < 80 THEN 'source_too_sparse' ELSE 'source_not_actionable' END], lambda v: v IS NOT NULL) AS tags FROM x)
SELECT 'tag' AS kind, tag AS key, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag UNION ALL SELECT 'cluster', event_type, count(*) FROM t GROUP BY event_type""")
def j12(spark, sf):
    return J.tag_counts(J.review_error_tags(eval_items(spark, sf).where(J.is_reviewed()), ["click"]))


def wave(spark, sf):
    p, n = rows(spark, sf), F.col("n_chars")
    return p.withColumns({
        "pre_quality": F.when(n % 4 == 0, "low").otherwise("high"), "pre_summary": F.when(n % 3 == 0, "").when(n % 3 == 1, "new").otherwise(F.col("summary")), "pre_focus_label": F.when(n % 5 < 2, "").when(n % 5 == 2, "other").otherwise(F.col("focus_label")),
        "pre_keywords": F.when(n % 7 == 0, F.array(F.lit("z"))).otherwise(F.reverse("keywords"))})


WAVE_SQL = POSTING_SQL + """,
w AS (SELECT *, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS sm, CASE WHEN n_chars % 4 = 0 THEN 'low' ELSE 'high' END AS pq, CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN 'new' ELSE trim(regexp_replace(summary, '\\s+', ' ', 'g')) END AS ps, CASE WHEN n_chars % 5 < 2 THEN '' WHEN n_chars % 5 = 2 THEN 'other' ELSE focus_label END AS pf,
  CASE WHEN n_chars % 7 = 0 THEN ['z'] ELSE list_reverse(keywords) END AS pk FROM posting)"""


@query("k1_triage_buckets", "WITH " + WAVE_SQL + """
SELECT id, CASE WHEN pq = 'low' AND ps = '' AND pf = '' THEN 'keep_low' WHEN quality = 'low' AND pq = 'high' THEN 'upgrade_review' WHEN focus_label <> '' AND pf <> '' AND focus_label <> pf THEN 'focus_check' WHEN sm <> '' AND ps <> '' AND sm <> ps THEN 'summary_check'
  WHEN len(keywords) > 0 AND len(pk) > 0 AND list_sort(keywords) <> list_sort(pk) THEN 'keyword_check' ELSE 'quick_confirm' END AS bucket FROM w""")
def k1(spark, sf):
    return K.triage_buckets(wave(spark, sf)).select("id", "bucket")


HANDOFF_SQL = ITEM_SQL + """,
hq AS (SELECT id, CASE WHEN cq = 'low' AND cs = '' AND cf = '' AND len(ck) = 0 THEN 'low_confirm' WHEN quality = 'low' AND cq IN ('medium', 'high') THEN 'upgrade_review' WHEN sp AND NOT fp THEN 'focus_keyword_check' WHEN NOT sp AND fp THEN 'summary_rewrite_check' WHEN NOT sp AND NOT fp THEN 'full_rewrite_check' ELSE 'mixed_check' END AS bucket FROM items)"""


def twice(spark, sf):
    e = eval_items(spark, sf)
    return e.unionByName(e.where("ord % 10 = 0").withColumns({"ord": F.col("ord") + 10_000_000, "summary_pass": F.lit(True)}))


@query("k2_handoff_queue", "WITH " + HANDOFF_SQL + """
SELECT id, bucket, CASE bucket WHEN 'low_confirm' THEN 1 WHEN 'upgrade_review' THEN 4 WHEN 'full_rewrite_check' THEN 3 ELSE 2 END AS weight, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 2 ELSE 1 END AS copies, CASE WHEN bucket = 'focus_keyword_check' THEN 'backlog' ELSE 'confirm' END AS queue,
  CASE WHEN bucket = 'low_confirm' THEN 'approve_low' ELSE 'approve_draft' END AS recommended_decision FROM hq""")
def k2(spark, sf):
    return K.handoff_queue(twice(spark, sf)).select("id", "bucket", "weight", "copies", "queue", "recommended_decision")


@query("k2_queue_load", "WITH " + HANDOFF_SQL + " SELECT CASE WHEN bucket = 'focus_keyword_check' THEN 'backlog' ELSE 'confirm' END AS queue, bucket, count(*) AS n, sum(CASE bucket WHEN 'low_confirm' THEN 1 WHEN 'upgrade_review' THEN 4 WHEN 'full_rewrite_check' THEN 3 ELSE 2 END) AS load FROM hq GROUP BY ALL")
def k2l(spark, sf):
    return K.queue_load(K.handoff_queue(twice(spark, sf)))


@query("k3_draft_review", "WITH " + WAVE_SQL + """
SELECT id, sm <> '' AND quality IN ('high', 'medium') AS d_summary_pass, NOT (pf <> '' AND pf <> focus_label) AS d_focus_pass, len(pk) > 0 AND keywords = pk AS d_keywords_pass, CASE WHEN sm <> '' AND quality IN ('high', 'medium') THEN '' WHEN ps <> '' THEN ps ELSE sm END AS d_corrected_summary,
  CASE WHEN pf <> '' THEN pf ELSE focus_label END AS d_corrected_focus, array_to_string(CASE WHEN len(pk) > 0 THEN pk ELSE keywords END, '|') AS d_corrected_keywords FROM w""")
def k3(spark, sf):
    return K.draft_review(wave(spark, sf)).select("id", "d_summary_pass", "d_focus_pass", "d_keywords_pass", "d_corrected_summary", "d_corrected_focus", join_list("d_corrected_keywords").alias("d_corrected_keywords"))


@query("k4_prefill", "WITH " + POSTING_SQL + """
SELECT id, CASE WHEN n_chars % 3 = 0 THEN 'manual' WHEN n_chars % 2 = 0 THEN 'model' END AS pre_summary, CASE WHEN n_chars % 3 = 0 THEN 'manual_prefill' WHEN n_chars % 2 = 0 THEN 'model_suggestion' ELSE '' END AS pre_source FROM posting""")
def k4(spark, sf):
    p = rows(spark, sf)
    side = lambda df, text: df.select("id", F.lit(text).alias("summary"), "focus_label", "keywords", "quality", F.lit("").alias("notes"))
    return K.prefill(p.select("id"), side(p.where("n_chars % 3 = 0"), "manual"), side(p.where("n_chars % 2 = 0"), "model")).select("id", "pre_summary", "pre_source")


HINTS = (("thtion", "Tion"), ("ontion", "Tion"), ("inoran", "Inoran"), ("hehely", "RAG"))


@query("k5_heuristic_suggestions")
def k5(spark, sf):
    h = K.heuristic_suggestions(rows(spark, sf), HINTS, PLAIN, ())
    return h.select("id", "suggested_focus", "suggested_summary", join_list("suggested_keywords").alias("suggested_keywords"), "suggested_quality", K.suggestion_usable(PLAIN).alias("usable"))


@query("k5_suggested_focus", "WITH " + POSTING_SQL + """,
t0 AS (SELECT id, focus_label, [trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), trim(regexp_replace(lower(detail_body), '\\s+', ' ', 'g'))] AS x FROM posting),
h AS (SELECT id, unnest(['thtion', 'ontion', 'inoran', 'hehely']) AS nd, unnest(['Tion', 'Tion', 'Inoran', 'RAG']) AS lb, unnest([1, 2, 3, 4]) AS i FROM posting),
f AS (SELECT h.*, CASE WHEN contains(x[1], nd) THEN 1 WHEN contains(x[2], nd) THEN 2 END AS p, x FROM h JOIN t0 USING (id)),
o AS (SELECT id, lb, len(regexp_extract_all(x[p], nd)) AS n FROM f WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, lb ORDER BY p, i) = 1),
b AS (SELECT id, lb FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, length(lb), lb) = 1)
SELECT t0.id, coalesce(b.lb, focus_label) AS suggested_focus FROM t0 LEFT JOIN b ON b.id = t0.id""")
def k5f(spark, sf):
    return K.heuristic_suggestions(rows(spark, sf), HINTS, PLAIN, ()).select("id", "suggested_focus")


def decision_rows(spark, sf):
    p = rows(spark, sf)
    m = F.col("ord") % 5
    d = F.when(m == 0, "approve_draft").when(m == 1, "approve_current").when(m == 2, "Approve_Low").when(m == 3, "needs_edit").otherwise("skip")
    return p.where("ord % 6 > 0").select("id", "ord", F.when(F.col("ord") % 7 == 0, "").otherwise(d).alias("decision"), F.lit("approve_current").alias("recommended_decision"), F.when(F.col("ord") % 4 == 0, "mine").otherwise("").alias("manual_summary"),
                                         F.lit("").alias("manual_focus_label"), F.when(F.col("ord") % 8 == 3, "a, b|a").otherwise("").alias("manual_keywords"), F.lit("").alias("manual_quality"), F.lit("").alias("confirm_notes"))


def drafted(spark, sf):
    return K.draft_review(wave(spark, sf)).withColumn("has_draft", F.col("n_chars") % 9 > 0)


DEC_SQL = POSTING_SQL + """,
d0 AS (SELECT *, CASE WHEN ord % 6 = 0 THEN NULL WHEN ord % 7 = 0 THEN 'approve_current' ELSE ['approve_draft', 'approve_current', 'approve_low', 'needs_edit', 'skip'][ord % 5 + 1] END AS decision FROM posting),
d1 AS (SELECT *, CASE WHEN decision IS NULL THEN 'none' WHEN decision IN ('approve_draft', 'approve_low') AND n_chars % 9 > 0 THEN 'applied' WHEN decision = 'approve_current' THEN 'applied' WHEN decision = 'needs_edit' AND (ord % 4 = 0 OR ord % 8 = 3) THEN 'applied' ELSE 'unresolved' END AS st FROM d0)"""


@query("k6_apply_decisions", "WITH " + DEC_SQL + """
SELECT id, decision, st AS decision_status, CASE WHEN st <> 'applied' THEN NULL ELSE decision = 'approve_current' END AS overall_pass, CASE WHEN st = 'applied' AND decision = 'needs_edit' AND ord % 8 = 3 THEN 'a, b|a' WHEN st = 'applied' AND decision = 'needs_edit' THEN '' ELSE NULL END AS manual_keywords FROM d1""")
def k6(spark, sf):
    a = K.apply_decisions(drafted(spark, sf), decision_rows(spark, sf))
    return a.select("id", "decision", "decision_status", "review.overall_pass", F.when((F.col("decision") == "needs_edit") & F.col("review").isNotNull(), F.array_join("review.corrected_keywords", "|")).alias("manual_keywords"))


@query("k6_decision_counts", "WITH " + DEC_SQL + " SELECT decision, st AS decision_status, count(*) AS n FROM d1 WHERE st <> 'none' GROUP BY ALL")
def k6c(spark, sf):
    return K.decision_counts(K.apply_decisions(drafted(spark, sf), decision_rows(spark, sf)))


@query("k6_parse_flag", "SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS flag FROM events")
def k6p(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "FALSE").when(F.col("event_type") == "error", "maybe").otherwise("")
    return e.select("event_id", K.parse_flag(text).alias("flag"))


@query("k7_merge_reviews", "WITH " + ITEM_SQL + """,
w AS (SELECT *, op IS NOT NULL OR coalesce(sp, false) OR coalesce(fp, false) OR coalesce(kp, false) OR cs <> '' OR cf <> '' OR cq <> '' OR nt <> '' OR len(ck) > 0 AS c FROM items WHERE ord % 2 = 0)
SELECT i.id, i.dataset, coalesce(w.c, false) AS merged, CASE WHEN w.c THEN w.cs ELSE 'old' END AS corrected_summary FROM items i LEFT JOIN w ON w.id = i.id AND w.c""")
def k7(spark, sf):
    e = eval_items(spark, sf)
    return K.merge_reviews(e.withColumn("corrected_summary", F.lit("old")), e.where("ord % 2 = 0")).select("id", "dataset", "merged", "corrected_summary")


@query("k8_gold_seed", "WITH " + ITEM_SQL + """
SELECT id, CASE WHEN cs <> '' THEN cs WHEN sp THEN summary ELSE '' END AS target_summary, CASE WHEN cf <> '' THEN cf WHEN fp THEN focus_label ELSE '' END AS target_focus, array_to_string(CASE WHEN len(ck) > 0 THEN ck WHEN kp THEN keywords ELSE [] END, '|') AS target_keywords,
  CASE WHEN cq <> '' THEN cq ELSE quality END AS target_quality, 'core' AS dataset FROM it WHERE rv""")
def k8(spark, sf):
    e = eval_items(spark, sf)
    both = e.withColumn("dataset", F.lit("incremental")).unionByName(e.withColumn("dataset", F.lit("core")))
    return K.gold_seed(both).select("id", "target_summary", "target_focus", join_list("target_keywords").alias("target_keywords"), "target_quality", "dataset")


REC_SQL = POSTING_SQL + """,
rc AS (SELECT id, ['broad_focus', 'low_or_empty', 'domain_specific', 'focus_keyword_conflict', 'x'][n_chars % 5 + 1] AS reason, focus_label AS raw, CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN focus_label ELSE 'view' END AS brd, quality FROM posting),
rd AS (SELECT *, CASE WHEN reason = 'low_or_empty' THEN 'approve_low' WHEN brd <> '' AND brd <> raw THEN 'approve_draft' WHEN quality = 'low' AND brd = '' THEN 'approve_low' WHEN reason = 'domain_specific' THEN 'approve_current' WHEN reason = 'focus_keyword_conflict' THEN 'needs_edit'
  WHEN reason = 'broad_focus' AND brd <> '' AND brd <> 'click' THEN 'approve_draft' WHEN reason = 'broad_focus' THEN 'needs_edit' ELSE 'approve_current' END AS dec FROM rc)"""


def recommended(spark, sf):
    n = F.col("n_chars")
    names = F.array(*[F.lit(x) for x in ("broad_focus", "low_or_empty", "domain_specific", "focus_keyword_conflict", "x")])
    p = rows(spark, sf).select("id", F.get(names, (n % 5).cast("int")).alias("reason"), F.col("focus_label").alias("raw_focus"), F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("focus_label")).otherwise("view").alias("board_focus"), F.col("quality").alias("raw_quality"))
    return K.recommend_decision(p, ["click"])


@query("k9_recommend_decision", "WITH " + REC_SQL + " SELECT id, dec AS recommended_decision FROM rd")
def k9(spark, sf):
    return recommended(spark, sf).select("id", "recommended_decision")


@query("k9_confirm_queue", "WITH " + REC_SQL + " SELECT id, dec AS recommended_decision FROM rd WHERE dec IN ('needs_edit', 'approve_draft')")
def k9q(spark, sf):
    return K.confirm_queue(recommended(spark, sf)).select("id", "recommended_decision")


@query("k10_adoption_report", "WITH " + POSTING_SQL + """,
a AS (SELECT id, CASE WHEN n_chars % 7 = 0 THEN 'unresolved' WHEN n_chars % 3 = 0 THEN 'board_projection' WHEN n_chars % 3 = 1 THEN 'raw_extractor' WHEN n_chars % 2 = 0 THEN 'keep_low' ELSE 'manual_override' END AS adopted_from FROM posting)
SELECT adopted_from, count(*) AS n FROM a GROUP BY 1""")
def k10(spark, sf):
    n = F.col("n_chars")
    p = rows(spark, sf)
    pick = lambda d, c, low, man: F.when(n % 3 == 0, d).when(n % 3 == 1, c).when(n % 2 == 0, low).otherwise(man)
    x = p.select("id", (n % 7 > 0).alias("resolved"), pick(F.lit("dd"), F.lit("cc"), F.lit(""), F.lit("mm")).alias("e_summary"), F.when((n % 3 == 2) & (n % 2 == 0), "").otherwise("f").alias("e_focus_label"),
                 F.when((n % 3 == 2) & (n % 2 == 0), empty_list()).otherwise(F.array(F.lit("k"))).alias("e_keywords"), F.when((n % 3 == 2) & (n % 2 == 0), "Low").otherwise("high").alias("e_quality"),
                 *[F.lit(v).alias(f"{s}_{c}") for s, t in (("c", "cc"), ("d", "dd")) for c, v in (("summary", t), ("focus_label", "f"), ("quality", "high"))], *[F.array(F.lit("k")).alias(f"{s}_keywords") for s in "cd"])
    return K.adoption_report(x).groupBy("adopted_from").agg(F.count(F.lit(1)).alias("n"))


@query("k11_adjudication_pack", "WITH " + POSTING_SQL + """,
m AS (SELECT *, CASE n_chars % 5 WHEN 0 THEN 'include' WHEN 1 THEN 'review' WHEN 2 THEN '' ELSE 'exclude' END AS dec, CASE WHEN n_chars % 7 = 0 THEN 'thin info' ELSE '' END AS rs, lower(concat_ws(' ', company, title, summary, focus_label, array_to_string(keywords, ' '), CASE WHEN n_chars % 7 = 0 THEN 'thin info' ELSE '' END)) AS tx FROM posting)
SELECT id, CASE WHEN dec = '' THEN 'missing' ELSE dec END AS model_decision, CASE WHEN dec = 'include' THEN 'include' WHEN dec = 'review' THEN 'review' WHEN th OR ai THEN 'review' ELSE 'exclude' END AS suggested_scope,
  CASE WHEN dec = 'include' THEN 'confirm_positive' WHEN dec = 'review' THEN 'human_boundary_review' WHEN th OR ai THEN 'critical_prompt_failure' ELSE 'goldset_conflict_review' END AS review_priority
FROM (SELECT *, quality = 'low' OR trim(summary) = '' OR contains(rs, 'thin') AS th, regexp_matches(tx, 'thtion|view') AND (NOT contains(tx, 'ment') OR contains(tx, 'thtion')) AS ai FROM m)""")
def k11(spark, sf):
    p, n = rows(spark, sf), F.col("n_chars")
    m = p.select("id", "ord", F.when(n % 5 == 0, "include").when(n % 5 == 1, "review").when(n % 5 == 2, "none").otherwise("exclude").alias("decision"), F.lit("high").alias("confidence"), F.when(n % 7 == 0, "thin info").otherwise("").alias("reason"))
    return K.adjudication_pack(p, m, ("thtion", "view"), ("ment",), ("thin",), ("view",)).select("id", "model_decision", "suggested_scope", "review_priority")


def gold_rows(spark, sf, provisional=True):
    p, n = rows(spark, sf), F.col("n_chars")
    c = p.withColumns({"scope_action": F.when(n % 3 == 0, "include").when(n % 3 == 1, "").otherwise("exclude")})
    d = p.where("n_chars % 4 = 0").select("id", "ord", F.when(n % 8 == 0, "Include").otherwise("bad").alias("confirm_scope"), F.lit("fr").alias("confirm_role"), F.lit("").alias("confirm_focus"), F.lit("").alias("confirm_source"), F.lit("note").alias("reviewer_notes"))
    return p, K.scope_gold(c, p, d, provisional)


GOLDROW_SQL = POSTING_SQL + """,
gr AS (SELECT id, n_chars % 8 = 0 AS ok, CASE WHEN n_chars % 8 = 0 THEN 'include' WHEN n_chars % 3 = 0 THEN 'include' WHEN n_chars % 3 = 1 THEN 'review' ELSE 'exclude' END AS target_scope, CASE WHEN n_chars % 4 = 0 THEN 'fr' ELSE role END AS target_role FROM posting)"""


@query("k12_scope_gold", "WITH " + GOLDROW_SQL + " SELECT id, target_scope, CASE WHEN ok THEN 'human_confirmed' ELSE 'guard_recovery_provisional' END AS decision_source, NOT ok AS requires_confirmation, target_role FROM gr")
def k12(spark, sf):
    return gold_rows(spark, sf)[1].select("id", "target_scope", "decision_source", "requires_confirmation", "target_role")


@query("k12_gold_status", "WITH " + GOLDROW_SQL + """
SELECT count(*) AS items, count(*) FILTER (ok) AS confirmed_items, count(*) FILTER (NOT ok) AS provisional_items, count(*) FILTER (target_scope = 'include') AS include, count(*) FILTER (target_scope = 'review') AS review, count(*) FILTER (target_scope = 'exclude') AS exclude, 0 AS unconfirmed,
  'provisional_requires_human_confirmation' AS status FROM gr""")
def k12s(spark, sf):
    return K.gold_status(gold_rows(spark, sf)[1])


@query("k13_gold_to_overrides", "WITH " + GOLDROW_SQL + " SELECT id, target_scope AS action, CASE WHEN target_scope = 'include' THEN target_role ELSE '' END AS mapped_role, 'note' AS reason, 'high' AS confidence FROM gr WHERE ok")
def k13(spark, sf):
    p, g = gold_rows(spark, sf)
    return K.gold_to_overrides(g.where("not requires_confirmation"), p, "t0").select("id", "action", "mapped_role", "reason", "confidence")


@query("k14_guarded_apply", """
WITH store AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE n_chars % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' ELSE 'review' END AS action FROM documents WHERE n_chars % 2 = 0),
batch AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars % 7 = 0 THEN 'exclude' ELSE 'include' END AS action FROM documents WHERE n_chars % 5 = 0)
SELECT 'override' AS part, id AS name, action AS value FROM (SELECT * FROM store ANTI JOIN batch USING (id) UNION ALL SELECT * FROM batch)
UNION ALL SELECT * FROM (VALUES ('attempt', '1 without writing', 'dry_run'), ('attempt', '2 gate closed', 'blocked'), ('attempt', '3 too many excluded', 'rolled_back'), ('attempt', '4 published', 'published'))""")
def k14(spark, sf):
    """Four attempts on one store; what is published is measured again on the written version."""
    from hiremill.operators import review as R
    from hiremill.session import scratch_folder

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "n_chars", F.col("doc_id").alias("ord"))
    store = docs.where("n_chars % 2 = 0").select("id", F.when(F.col("n_chars") % 3 == 0, "include").when(F.col("n_chars") % 3 == 1, "exclude").otherwise("review").alias("action"))
    change = docs.where("n_chars % 5 = 0")
    batch = change.select("id", F.when(F.col("n_chars") % 7 == 0, "exclude").otherwise("include").alias("action"), "ord")
    worse = change.select("id", F.lit("exclude").alias("action"), "ord")

    def measured(written):
        """As many ids as before and new ones, and no larger share of exclusions than the store had."""
        share = F.avg((F.col("action") == "exclude").cast("int"))
        now, before = written.agg(share.alias("x"), F.count_distinct("id").alias("ids"), F.count("*").alias("n")).first(), store.agg(share.alias("x")).first()
        return now["ids"] == now["n"] and now["x"] <= before["x"]

    root = scratch_folder(spark, "overrides")
    statuses = [("1 without writing", R.guarded_apply(spark, root, store, batch, True, measured, dry_run=True)), ("2 gate closed", R.guarded_apply(spark, root, store, batch, False, measured)),
                ("3 too many excluded", R.guarded_apply(spark, root, store, worse, True, measured)), ("4 published", R.guarded_apply(spark, root, store, batch, True, measured))]
    return R.publish_report(R.current_version(spark, root), statuses)
