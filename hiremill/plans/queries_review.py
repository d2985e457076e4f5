"""Checked queries for comparison and validation (groups C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill.functions.text import join_list
from hiremill.operators import reconcile as C
from hiremill.operators import validate as D
from hiremill.operators.validate import RepairRules, StageRules
from hiremill.plans.adapters import POSTING_SQL, SNAP_SQL, STAGE_ROLES, STAGE_SQL, posting_doc, snapshots, stage_tables
from hiremill.plans.base import query, table
from hiremill.session import checkpointed

SNAP_COLS = ["company", "role", "title", "last_seen_at"]
DELTA_SQL = SNAP_SQL + """,
delta AS (
  SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed'
    WHEN (a.company, a.role, a.title, a.last_seen_at) IS DISTINCT FROM (b.company, b.role, b.title, b.last_seen_at) THEN 'changed'
    ELSE 'unchanged' END AS change
  FROM snap_before b FULL JOIN snap_after a ON a.id = b.id
)"""


@query("c1_snapshot_delta", "WITH " + DELTA_SQL + " SELECT * FROM delta")
def c1(spark, sf):
    return C.snapshot_delta(*snapshots(spark, sf), cols=SNAP_COLS)


@query("c1_delta_counts", "WITH " + DELTA_SQL + " SELECT change, count(*) AS n FROM delta GROUP BY change")
def c1n(spark, sf):
    return C.delta_counts(C.snapshot_delta(*snapshots(spark, sf), cols=SNAP_COLS))


@query("c3_removed_keys", "WITH " + SNAP_SQL + " SELECT id FROM snap_before EXCEPT SELECT id FROM snap_after")
def c3(spark, sf):
    before, after = snapshots(spark, sf)
    return C.removed_keys(after, before)


def deploy_like(stage2):
    return stage2.withColumn("title", F.when(F.col("ord") % 4 == 0, " ").otherwise(F.concat(F.lit("Title "), F.col("ord"))))


@query("c4_deploy_overlay", "WITH " + STAGE_SQL + """,
src AS (SELECT * FROM stage1 WHERE ord % 11 <> 3)
SELECT s.id, CASE WHEN d.ord % 7 = 5 THEN 'Other' ELSE s.role END AS role,
  CASE WHEN d.ord % 4 = 0 THEN s.title ELSE 'Title ' || d.ord END AS title,
  CASE WHEN d.change_hash <> '' AND d.change_hash <> s.change_hash THEN d.change_hash ELSE s.change_hash END AS change_hash,
  array_to_string(list_filter([CASE WHEN d.ord % 7 = 5 THEN 'role' END, CASE WHEN d.ord % 4 <> 0 THEN 'title' END,
    CASE WHEN d.change_hash <> '' AND d.change_hash <> s.change_hash THEN 'change_hash' END], lambda x: x IS NOT NULL), '|') AS changed
FROM src s JOIN stage2 d ON d.id = s.id""")
def c4(spark, sf):
    s1, s2 = stage_tables(spark, sf)
    o = C.deploy_overlay(s1.where("ord % 11 <> 3"), deploy_like(s2))
    return o.select("id", "role", "title", "change_hash", join_list("changed_fields").alias("changed"))


@query("c4_overlay_counts", "WITH " + STAGE_SQL + """
SELECT 'role' AS field, count(*) AS n FROM stage2 WHERE ord % 7 = 5 UNION ALL SELECT 'title', count(*) FROM stage2 WHERE ord % 4 <> 0
UNION ALL SELECT 'change_hash', count(*) FROM stage2 WHERE ord % 11 = 4""")
def c4n(spark, sf):
    s1, s2 = stage_tables(spark, sf)
    return C.overlay_counts(C.deploy_overlay(s1.where("ord % 11 <> 3"), deploy_like(s2)))


@query("c4_overlay_guard", "WITH " + STAGE_SQL + """
SELECT CAST(0 AS BIGINT) AS missing_from_source, count(*) AS missing_from_deploy FROM stage1 WHERE ord % 11 = 3""")
def c4g(spark, sf):
    return C.overlay_guard(*stage_tables(spark, sf))


def override_tables(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(k.cast("string").alias("id"), k.alias("ord"), F.col("c_mktsegment").alias("signature"), F.col("c_name").alias("title"))
    ovr = c.where(k % 3 != 0).select(
        k.cast("string").alias("id"), k.alias("ord"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "old").otherwise(F.col("c_mktsegment")).alias("signature"),
        F.when(k % 7 == 0, "drop").when(k % 7 < 3, "Include").otherwise("exclude").alias("action"),
        F.when(k % 2 == 0, "service_scope_model").otherwise("manual").alias("source"),
        F.when(k % 4 == 0, "low").otherwise("high").alias("confidence"), F.lit("").alias("reason"),
        F.when(k % 6 == 1, "X").otherwise(F.col("c_mktsegment")).alias("role"))
    return rows, ovr


OVR_SQL = """
rws AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_mktsegment AS signature FROM customer),
ovr AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'old' ELSE c_mktsegment END AS signature,
  CASE WHEN c_custkey % 7 = 0 THEN 'drop' WHEN c_custkey % 7 < 3 THEN 'Include' ELSE 'exclude' END AS action,
  CASE WHEN c_custkey % 2 = 0 THEN 'service_scope_model' ELSE 'manual' END AS source,
  CASE WHEN c_custkey % 4 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN c_custkey % 6 = 1 THEN 'X' ELSE c_mktsegment END AS role
  FROM customer WHERE c_custkey % 3 <> 0)"""


@query("c5_resolve_scope_overrides", "WITH " + OVR_SQL + """
SELECT r.id, o.action AS o_action, o.source AS o_source FROM rws r LEFT JOIN ovr o ON o.id = r.id
  AND (o.signature = '' OR o.signature = r.signature) AND lower(o.action) IN ('include', 'review', 'exclude')
  AND NOT (o.source = 'service_scope_model' AND o.confidence = 'low')""")
def c5(spark, sf):
    return C.resolve_overrides(*override_tables(spark, sf), "scope").select("id", "o_action", "o_source")


@query("c5_resolve_role_overrides", "WITH " + OVR_SQL + """
SELECT r.id, o.role AS o_role FROM rws r LEFT JOIN ovr o ON o.id = r.id
  AND (o.signature = '' OR o.signature = r.signature) AND o.role IN ('BUILDING', 'MACHINERY')""")
def c5r(spark, sf):
    return C.resolve_overrides(*override_tables(spark, sf), "role", ["BUILDING", "MACHINERY"]).select("id", "o_role")


@query("c6_stale_overrides", "WITH " + OVR_SQL + """
SELECT r.id, o.signature AS stored_signature, r.signature FROM rws r JOIN ovr o ON o.id = r.id
WHERE o.signature <> '' AND o.signature <> r.signature""")
def c6(spark, sf):
    return C.stale_overrides(*override_tables(spark, sf))


def store_of(before):
    k = F.col("ord")
    return before.where(k % 3 != 1).select(
        "id", F.when(k % 7 == 0, "").otherwise("2024-01-01").alias("summarized_at"),
        F.when(k % 11 == 0, "low").otherwise("high").alias("quality"), F.when(k % 13 == 0, "p1").otherwise("p2").alias("profile"),
        F.when(k % 17 == 0, "x").otherwise(F.col("role")).alias("signature"))


STORE_SQL = """,
store AS (SELECT id, CASE WHEN ord % 7 = 0 THEN '' ELSE '2024-01-01' END AS summarized_at,
  CASE WHEN ord % 11 = 0 THEN 'low' ELSE 'high' END AS quality, CASE WHEN ord % 13 = 0 THEN 'p1' ELSE 'p2' END AS profile,
  CASE WHEN ord % 17 = 0 THEN 'x' ELSE role END AS signature FROM snap_before WHERE ord % 3 <> 1)"""


@query("c7_incremental_targets", "WITH " + DELTA_SQL + STORE_SQL + """
SELECT id, change AS reason, CASE change WHEN 'added' THEN 0 ELSE 1 END AS priority FROM delta WHERE change IN ('added', 'changed')
UNION ALL
SELECT a.id, 'refresh', 2 FROM snap_after a LEFT JOIN store s ON s.id = a.id
WHERE (s.id IS NULL OR s.summarized_at = '' OR s.quality = 'low') AND a.id NOT IN (SELECT id FROM delta WHERE change IN ('added', 'changed'))""")
def c7(spark, sf):
    before, after = snapshots(spark, sf)
    return C.incremental_targets(after, C.snapshot_delta(before, after, SNAP_COLS), store_of(before))


@query("c7_signature_targets", "WITH " + DELTA_SQL + STORE_SQL + """
SELECT id, change AS reason, CASE change WHEN 'added' THEN 0 ELSE 1 END AS priority FROM delta WHERE change IN ('added', 'changed')
UNION ALL
SELECT a.id, 'refresh', 2 FROM snap_after a JOIN store s ON s.id = a.id
WHERE s.signature <> a.role AND a.id NOT IN (SELECT id FROM delta WHERE change IN ('added', 'changed'))""")
def c7s(spark, sf):
    before, after = snapshots(spark, sf)
    rows = after.withColumn("signature", F.col("role"))
    return C.incremental_targets(rows, C.snapshot_delta(before, after, SNAP_COLS), store_of(before), kind="scope")


MODES = {"missing": "s.id IS NULL OR (s.signature <> '' AND s.signature <> a.role)", "stale": "s.id IS NOT NULL AND s.signature <> '' AND s.signature <> a.role", "all": "TRUE"}


def _kind_mode(kind, mode, cond):
    @query(f"c7_{kind}_{mode}", "WITH " + SNAP_SQL + STORE_SQL + f"""
SELECT a.id, 'refresh' AS reason, 2 AS priority FROM snap_after a LEFT JOIN store s ON s.id = a.id WHERE {cond}""")
    def run(spark, sf):
        before, after = snapshots(spark, sf)
        rows = after.withColumns({"signature": F.col("role"), "scope_action": F.when(F.col("ord") % 5 == 0, "review").otherwise("include")})
        return C.incremental_targets(rows, None, store_of(before), kind=kind, mode=mode)


for _mode, _cond in MODES.items():
    _kind_mode("scope", _mode, _cond)
_kind_mode("scope", "review", "a.ord % 5 = 0")
_kind_mode("role", "missing", MODES["missing"])
_kind_mode("role", "stale", MODES["missing"])
_kind_mode("summary", "missing", "s.id IS NULL OR s.summarized_at = '' OR s.quality = 'low'")


@query("c7_stale_mode_newest", "WITH " + SNAP_SQL + STORE_SQL + """
SELECT a.id, 'refresh' AS reason, 2 AS priority, a.last_seen_at FROM snap_after a LEFT JOIN store s ON s.id = a.id
WHERE s.id IS NULL OR s.summarized_at = '' OR s.quality = 'low' OR s.profile <> 'p2' ORDER BY last_seen_at DESC, ord, a.id LIMIT 50""")
def c7m(spark, sf):
    before, after = snapshots(spark, sf)
    return C.incremental_targets(after, None, store_of(before), mode="stale", profile="p2", limit=50)


@query("c8_result_completeness", "WITH " + SNAP_SQL + """
SELECT count(*) AS processed, count(b.id) AS saved, count(*) - count(b.id) AS missing FROM snap_after a LEFT JOIN snap_before b ON b.id = a.id""")
def c8(spark, sf):
    before, after = snapshots(spark, sf)
    return C.result_completeness(after, before)[1]


@query("c8_missing_results", "WITH " + SNAP_SQL + " SELECT id FROM snap_after EXCEPT SELECT id FROM snap_before")
def c8m(spark, sf):
    before, after = snapshots(spark, sf)
    return C.result_completeness(after, before)[0]


@query("c9_layer_reconciliation", """
WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem), b AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F')
SELECT 0 AS pos, 'raw' AS layer, (SELECT count(*) FROM a) AS rows, (SELECT count(DISTINCT id) FROM a) AS distinct_keys,
  (SELECT count(DISTINCT id) FROM a WHERE id NOT IN (SELECT id FROM b)) AS absent_from_next
UNION ALL SELECT 1, 'master', (SELECT count(*) FROM b), (SELECT count(DISTINCT id) FROM b), (SELECT count(DISTINCT id) FROM b WHERE id NOT IN (SELECT id FROM c))
UNION ALL SELECT 2, 'board', (SELECT count(*) FROM c), (SELECT count(DISTINCT id) FROM c), 0""")
def c9(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    return C.layer_reconciliation([("raw", l), ("master", o.where("o_orderstatus <> 'P'")), ("board", o.where("o_orderstatus = 'F'"))])


@query("c10_role_mismatches", "WITH " + STAGE_SQL + """
SELECT a.id, a.role AS role_group, b.role AS stage2_role FROM stage1 a JOIN stage2 b ON b.id = a.id
WHERE regexp_replace(lower(a.role), '[^0-9a-z]+', '', 'g') <> regexp_replace(lower(b.role), '[^0-9a-z]+', '', 'g')""")
def c10(spark, sf):
    s1, s2 = stage_tables(spark, sf)
    j = s1.select("id", F.col("role").alias("role_group")).join(s2.select("id", F.col("role").alias("stage2_role")), "id")
    return C.role_mismatches(j)


@query("c10_compound_term_splits", """
SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'widget') THEN 'red widget' END,
  CASE WHEN list_contains(string_split(p_name, ' '), 'blue') AND list_contains(string_split(p_name, ' '), 'bolt') THEN 'blue bolt' END], lambda x: x IS NOT NULL), '|') AS phrases
FROM part WHERE p_name LIKE '%red widget%' OR p_name LIKE '%blue bolt%'""")
def c10s(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("skills"))
    return C.compound_term_split_issues(p, [("red", "widget"), ("blue", "bolt")]).select("id", join_list("split_phrases").alias("phrases"))


RUNS_SQL = """
base AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE quality WHEN 1 THEN 2 ELSE 0 END AS rb FROM labels),
cand AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 800 THEN 1 ELSE 0 END AS rc FROM documents),
cmp AS (SELECT base.id, CASE WHEN rc > rb THEN 'improved' WHEN rc < rb THEN 'worsened' ELSE 'unchanged' END AS outcome, rb = 0 AND rc >= 1 AS l FROM base JOIN cand ON base.id = cand.id)"""


@query("c11_compare_runs", "WITH " + RUNS_SQL + " SELECT outcome, count(*) AS n, count(*) FILTER (l) AS low_to_non_low FROM cmp GROUP BY outcome")
def c11(spark, sf):
    base = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("quality"))
    n = F.col("n_chars")
    cand = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(n > 3000, "High ").when(n > 800, "medium").otherwise("low").alias("quality"))
    return C.compare_counts(C.compare_runs(base, cand))


@query("c12_merge_current", "WITH " + POSTING_SQL + """
SELECT l.doc_id || '' AS id, 'core' AS source_dataset, CASE WHEN l.doc_id % 2 = 0 THEN trim(regexp_replace(p.summary, ' +', ' ', 'g')) ELSE 'kept' END AS summary,
  CASE WHEN l.doc_id % 2 = 0 THEN p.event_type ELSE 'old' END AS focus_label,
  CASE WHEN l.doc_id % 2 = 0 THEN array_to_string(p.keywords[1:6], '|') ELSE 'a|b' END AS keywords,
  CASE WHEN l.doc_id % 3 = 0 THEN array_to_string(p.skills[1:8], '|') ELSE 's' END AS skills
FROM labels l JOIN posting p ON p.ord = l.doc_id""")
def c12(spark, sf):
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("ord"))
    e = F.array().cast("array<string>")
    items = l.select(
        F.col("ord").cast("string").alias("id"), *[F.lit("").alias(c) for c in ("company", "title", "role_group", "cluster_id", "cluster_label")],
        F.lit(True).alias("active"), F.lit(" kept").alias("summary"), F.lit("old").alias("focus_label"),
        F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("keywords"), F.lit("high").alias("quality"),
        F.struct(F.lit("").alias("detail_body"), e.alias("tasks"), e.alias("requirements"), e.alias("preferred"), F.array(F.lit("s")).alias("skills")).alias("source"))
    p = posting_doc(spark, sf)
    m = C.merge_current(items, p.where("ord % 2 = 0"), p.where("ord % 3 = 0"), "core")
    return m.select("id", "source_dataset", "current.summary", "current.focus_label", join_list(F.col("current.keywords")).alias("keywords"),
                    join_list(F.col("source.skills")).alias("skills"))


@query("c13_cached_or_related", "WITH " + POSTING_SQL + """,
cache AS (SELECT id, company, ord, CASE WHEN ord % 2 = 0 THEN title ELSE 'old' END AS sig, 'insight ' || id AS insight FROM posting WHERE n_chars % 37 = 5),
rel AS (SELECT company, arg_min(insight, ord) AS insight FROM cache GROUP BY company)
SELECT p.id, p.company, CASE WHEN c.sig = p.title THEN 'fresh' WHEN c.id IS NOT NULL THEN 'exact' WHEN r.company IS NOT NULL THEN 'company' ELSE 'fallback' END AS origin,
  coalesce(c.insight, r.insight, CASE WHEN trim(p.summary) <> '' THEN p.company || ' 공고에서는 ' || trim(regexp_replace(p.summary, ' +', ' ', 'g')) || ' 흐름이 핵심으로 보입니다.'
    ELSE p.company || ' 공고의 핵심 신호를 아직 충분히 읽지 못했습니다.' END) AS insight
FROM posting p LEFT JOIN cache c ON c.id = p.id LEFT JOIN rel r ON r.company = p.company""")
def c13(spark, sf):
    p = posting_doc(spark, sf)
    rows = p.select("id", "company", "ord", F.col("title").alias("signature"), F.lit("").alias("headline"), F.lit("").alias("reason"), "summary")
    cache = p.where("n_chars % 37 = 5").select("id", F.when(F.col("ord") % 2 == 0, F.col("title")).otherwise("old").alias("signature"),
                                               F.concat(F.lit("insight "), "id").alias("insight"))
    return C.cached_or_related(rows, cache)


# Rule families made of words that occur in the stage tables.
SMALL = StageRules(
    roles=tuple(STAGE_ROLES), analyst_roles=("Building",), ai_roles=("Machinery", "Automobile"), noise_terms=("K5",),
    deeptech=(r"\bllm\b",), business_context=(r"\bcrm\b", "growth"), business_dominance=("k3",), data_titles=("[13579]$",),
    analytics_titles=("7$",), ai_dominance=(r"\bllm\b", "#0000000[0-4]"), clinical=("clinical", "0005"))

ISSUES_SQL = STAGE_SQL + """,
pair AS (
  SELECT a.*, b.id IS NOT NULL AS found, coalesce(b.change_hash, '') AS h2, coalesce(b.role, '') AS role2, coalesce(b.focus, '') AS focus2,
    coalesce(b.keywords, '') AS keywords2, coalesce(b.summary, '') AS summary2, coalesce(b.approval, '') AS approval, coalesce(b.memo, '') AS memo
  FROM stage1 a LEFT JOIN stage2 b ON b.id = a.id
),
vin AS (
  SELECT id, ord, change_hash, title, detail_body, company, role AS r1, focus AS f1, keywords AS k1, summary AS s1,
    CASE WHEN role2 <> '' THEN role2 ELSE role END AS role, CASE WHEN focus2 <> '' THEN focus2 ELSE focus END AS focus,
    CASE WHEN keywords2 <> '' THEN keywords2 ELSE keywords END AS keywords, CASE WHEN summary2 <> '' THEN summary2 ELSE summary END AS summary,
    found, h2, role2, focus2, keywords2, summary2, approval, memo
  FROM pair
),
vt0 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(keywords, '[,/]'), lambda x: trim(x)), lambda x: x <> '') AS raw_terms FROM vin),
vt AS (SELECT *, list_filter(raw_terms, lambda x, i: list_position(list_transform(raw_terms, lambda y: lower(y)), lower(x)) = i) AS terms FROM vt0),
ve AS (SELECT *, lower(concat_ws(' ', company, title, role, focus, summary, array_to_string(terms, ' '), detail_body)) AS txt,
    lower(concat_ws(' ', title, focus, summary, array_to_string(terms[1:6], ' '))) AS lead_txt,
    lower(concat_ws(' ', title, focus, summary, array_to_string(terms, ' '), detail_body)) AS ai_txt FROM vt),
vf AS (SELECT *, regexp_matches(title, '[13579]$') AS dt, regexp_matches(lead_txt, 'k3') AS bd, regexp_matches(title, '#0000000[0-4]') AS ait,
    regexp_matches(ai_txt, '(^|[^a-z0-9])llm([^a-z0-9]|$)|#0000000[0-4]') AS aia, regexp_matches(txt, '(^|[^a-z0-9])crm([^a-z0-9]|$)|growth') AS bc,
    regexp_matches(title, '7$') AS ant, role IN ('Machinery', 'Automobile') AS ai FROM ve),
vissue AS (SELECT *, list_filter([
    CASE WHEN change_hash = '' THEN {'c': 'missing_change_hash', 's': 'high'} END,
    CASE WHEN role NOT IN ('Automobile', 'Building', 'Furniture', 'Machinery') THEN {'c': 'invalid_role', 's': 'high'} END,
    CASE WHEN focus = '' THEN {'c': 'missing_focus', 's': 'medium'} END,
    CASE WHEN summary = '' THEN {'c': 'missing_group_summary', 's': 'medium'} END,
    CASE WHEN len(terms) = 0 THEN {'c': 'missing_keywords', 's': 'medium'} END,
    CASE WHEN lower(focus) = 'k5' OR list_contains(list_transform(terms, lambda x: lower(x)), 'k5') THEN {'c': 'noise_keyword', 's': 'high'} END,
    CASE WHEN focus <> '' AND list_contains(list_transform(terms, lambda x: lower(x)), lower(focus)) THEN {'c': 'duplicate_signal', 's': 'medium'} END,
    CASE WHEN role = 'Building' AND regexp_matches(txt, 'clinical|0005') THEN {'c': 'clinical_scientist_as_analyst', 's': 'high'} END,
    CASE WHEN role = 'Building' AND regexp_matches(txt, '(^|[^a-z0-9])llm([^a-z0-9]|$)') THEN {'c': 'deeptech_as_analyst', 's': CASE WHEN bd THEN 'medium' ELSE 'high' END} END,
    CASE WHEN NOT ai THEN NULL WHEN ant AND NOT ait THEN {'c': 'analytics_engineering_as_ai_role', 's': 'high'}
      WHEN dt AND NOT ait AND NOT aia THEN {'c': 'data_engineering_as_ai_role', 's': 'high'} WHEN dt AND ait THEN {'c': 'data_engineering_ai_title_context', 's': 'info'}
      WHEN dt THEN {'c': 'data_engineering_ai_context', 's': 'info'} WHEN bd AND NOT aia THEN {'c': 'business_role_as_ai_role', 's': 'high'}
      WHEN bd THEN {'c': 'business_focus_in_ai_role', 's': 'medium'} WHEN bc THEN {'c': 'business_context_in_ai_role', 's': 'info'} END,
    CASE WHEN summary <> '' AND length(replace(summary, ' ', '')) <= 4 THEN {'c': 'summary_too_short', 's': 'low'} END], lambda x: x IS NOT NULL) AS q FROM vf)"""

PAIR_SQL = ISSUES_SQL + """,
vdiff AS (SELECT *, q || list_filter([
    CASE WHEN role2 <> '' AND lower(role2) <> lower(r1) THEN {'c': 'role_diff', 's': 'info'} END,
    CASE WHEN focus2 <> '' AND focus2 <> f1 THEN {'c': 'focus_diff', 's': 'info'} END,
    CASE WHEN keywords2 <> '' AND keywords2 <> k1 THEN {'c': 'keywords_diff', 's': 'info'} END,
    CASE WHEN summary2 <> '' AND summary2 <> s1 THEN {'c': 'summary_diff', 's': 'info'} END], lambda x: x IS NOT NULL) AS iss FROM vissue),
vstate AS (SELECT *, CASE WHEN NOT found THEN 'stage2_missing' WHEN change_hash <> '' AND h2 <> '' AND change_hash <> h2 THEN 'stage2_stale'
    WHEN len(list_filter(iss, lambda x: x.s IN ('high', 'medium'))) > 0 THEN 'quality_issue' WHEN approval = 'approved' THEN 'stage2_approved' ELSE 'stage2_pending' END AS state FROM vdiff),
cand AS (SELECT *, CASE state WHEN 'stage2_approved' THEN 'approved' WHEN 'stage2_pending' THEN 'pending' ELSE 'needs_review' END AS status,
    CASE WHEN len(list_filter(iss, lambda x: x.s = 'high')) > 0 OR state IN ('stage2_missing', 'stage2_stale') THEN 'high'
      WHEN len(list_filter(iss, lambda x: x.s = 'medium')) > 0 THEN 'medium' WHEN len(iss) > 0 THEN 'low' ELSE 'pass' END AS priority,
    [state] || list_transform(iss, lambda x: x.c) AS codes FROM vstate)"""


@query("d1_quality_issues", "WITH " + ISSUES_SQL.replace("LEFT JOIN stage2 b ON b.id = a.id", "LEFT JOIN (SELECT * FROM stage2 WHERE false) b ON b.id = a.id") + """
SELECT id, array_to_string(list_transform(q, lambda x: x.c || ':' || x.s), '|') AS issues FROM vissue""")
def d1(spark, sf):
    s1, _ = stage_tables(spark, sf)
    q = D.quality_issues(s1, SMALL)
    return q.select("id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["severity"])), "|").alias("issues"))


def candidates(spark, sf):
    return D.validate_pair(*stage_tables(spark, sf), rules=SMALL)


@query("d2_pair_diffs", "WITH " + PAIR_SQL + """
SELECT id, array_to_string(list_filter(list_transform(iss, lambda x: x.c), lambda c: c LIKE '%_diff'), '|') AS diffs FROM cand""")
def d2(spark, sf):
    s1, s2 = stage_tables(spark, sf)
    d = D.pair_diffs(D.with_stage2(s1, s2))
    return d.select("id", F.array_join(D.codes_of("diffs"), "|").alias("diffs"))


@query("c2_validate_pair", "WITH " + PAIR_SQL + """
SELECT id, status, priority, array_to_string(codes, ' | ') AS codes, r1 AS stage1_role, role2 AS stage2_role, s1 AS stage1_summary, summary2 AS stage2_summary, approval, memo FROM cand""")
def c2(spark, sf):
    return candidates(spark, sf).select("id", "status", "priority", F.array_join("codes", " | ").alias("codes"), "stage1_role", "stage2_role",
                                        "stage1_summary", "stage2_summary", "approval", "memo")


@query("d3_state_status_priority", "WITH " + PAIR_SQL + " SELECT state, status, priority, count(*) AS n FROM cand GROUP BY ALL")
def d3(spark, sf):
    return candidates(spark, sf).groupBy("state", "status", "priority").agg(F.count(F.lit(1)).alias("n"))


REPORT_SQL = PAIR_SQL + """,
report AS (
  SELECT 'state' AS section, state AS key, count(*) AS n FROM cand GROUP BY state
  UNION ALL SELECT 'issue', c, count(*) FROM (SELECT unnest(list_transform(iss, lambda x: x.c)) AS c FROM cand) GROUP BY c
  UNION ALL SELECT 'blocking', c, count(*) FROM (SELECT unnest(list_transform(list_filter(iss, lambda x: x.s IN ('high', 'medium')), lambda x: x.c)) AS c FROM cand) GROUP BY c
  UNION ALL SELECT 'severity', c, count(*) FROM (SELECT unnest(list_transform(iss, lambda x: x.s)) AS c FROM cand) GROUP BY c
  UNION ALL SELECT 'metric', 'candidateRows', count(*) FROM cand UNION ALL SELECT 'metric', 'stage1Rows', count(*) FROM stage1
  UNION ALL SELECT 'metric', 'stage2Rows', count(*) FROM stage2 UNION ALL SELECT 'metric', 'removedFromStage1', 0)"""


@query("d4_validation_report", "WITH " + REPORT_SQL + " SELECT * FROM report")
def d4(spark, sf):
    s1, s2 = stage_tables(spark, sf)
    return D.validation_report(candidates(spark, sf), s1, s2)


DEPLOY_SQL = """,
deploy AS (
  SELECT id, ord, change_hash, CASE WHEN role2 <> '' THEN role2 ELSE r1 END AS role, CASE WHEN focus2 <> '' THEN focus2 ELSE f1 END AS focus,
    CASE WHEN keywords2 <> '' THEN keywords2 ELSE k1 END AS keywords, CASE WHEN summary2 <> '' THEN summary2 ELSE s1 END AS summary
  FROM cand WHERE status = 'approved' AND approval = 'approved' AND state NOT IN ('stage2_missing', 'stage2_stale', 'quality_issue') AND priority IN ('pass', 'low'))"""


@query("d5_deployable_rows", "WITH " + PAIR_SQL + DEPLOY_SQL + " SELECT * EXCLUDE (ord) FROM deploy")
def d5(spark, sf):
    return D.deployable_rows(candidates(spark, sf)).select("id", "change_hash", "role", "focus", "keywords", "summary")


@query("d6_release_gate", "WITH " + REPORT_SQL + DEPLOY_SQL + """,
m AS (SELECT (SELECT count(*) FROM cand) AS n, (SELECT count(*) FROM cand WHERE approval = 'approved') AS ap, (SELECT count(*) FROM cand WHERE status = 'pending') AS pe,
  (SELECT count(*) FROM cand WHERE status = 'needs_review') AS nr, (SELECT count(*) FROM cand WHERE change_hash = '') AS im, (SELECT count(*) FROM deploy) AS dn,
  (SELECT count(*) FROM deploy WHERE change_hash = '' OR focus = '' OR keywords = '' OR summary = '') AS dm,
  (SELECT count(*) FROM deploy WHERE role NOT IN ('Automobile', 'Building', 'Furniture', 'Machinery')) AS dr,
  (SELECT count(*) FROM stage1) AS s1, (SELECT count(*) FROM stage2) AS s2,
  (SELECT coalesce(sum(n), 0) FROM report WHERE section = 'state' AND key IN ('stage2_missing', 'stage2_stale', 'stage2_unreadable', 'quality_issue')) AS bs,
  (SELECT coalesce(sum(n), 0) FROM report WHERE section = 'blocking') AS bi)
SELECT 1 AS ord, 'stage2Readable' AS name, 'true' AS actual, 'true' AS target, true AS passed
UNION ALL SELECT 2, 'rowCountAligned', s1 || '/' || s2 || '/' || n, 'stage1 == stage2 == candidates > 0', s1 > 0 AND s1 = s2 AND s2 = n FROM m
UNION ALL SELECT 3, 'noRemovedFromStage1', '0', '0', true UNION ALL SELECT 4, 'noBlockingStates', bs || '', '0', bs = 0 FROM m
UNION ALL SELECT 5, 'noBlockingIssueCounts', bi || '', '0', bi = 0 FROM m UNION ALL SELECT 6, 'noPendingRows', pe || '', '0', pe = 0 FROM m
UNION ALL SELECT 7, 'noNeedsReviewRows', nr || '', '0', nr = 0 FROM m UNION ALL SELECT 8, 'allRowsApproved', ap || '', n || '', n > 0 AND ap = n FROM m
UNION ALL SELECT 9, 'deployRowsMatchStage1', dn || '', s1 || '', s1 > 0 AND dn = s1 FROM m UNION ALL SELECT 10, 'candidateIdentityComplete', im || '', '0', im = 0 FROM m
UNION ALL SELECT 11, 'candidateKeysUnique', '0', '0', true UNION ALL SELECT 12, 'deployFieldsComplete', dm || '', '0', dm = 0 FROM m
UNION ALL SELECT 13, 'deployRolesAllowed', dr || '', '0', dr = 0 FROM m""")
def d6(spark, sf):
    s1, s2 = stage_tables(spark, sf)
    # Candidates are a table of their own between validation and gate; several counts read it.
    c = checkpointed(candidates(spark, sf))
    return D.release_gate(c, D.deployable_rows(c), D.validation_report(c, s1, s2), roles=STAGE_ROLES)


@query("d6_gate_examples", "WITH " + PAIR_SQL + """,
kinds AS (SELECT id, ord, unnest(list_filter([CASE WHEN status = 'pending' THEN 'pending' END, CASE WHEN status = 'needs_review' THEN 'needsReview' END,
  CASE WHEN approval <> 'approved' THEN 'unapproved' END, CASE WHEN state IN ('stage2_missing', 'stage2_stale', 'quality_issue') THEN 'blocking' END,
  CASE WHEN change_hash = '' THEN 'missingCandidateIdentity' END], lambda x: x IS NOT NULL)) AS kind FROM cand)
SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY ord) AS rank FROM kinds QUALIFY rank <= 10""")
def d6e(spark, sf):
    return D.gate_examples(candidates(spark, sf)).select("kind", "id", "rank")


TRIAGE_SQL = PAIR_SQL + """,
tri AS (SELECT id, ord, g.grp, g.m FROM (SELECT id, ord, unnest(list_filter([
  {'grp': 'stage2_sync', 'm': list_filter(codes, lambda x: x IN ('stage2_stale', 'stage2_missing', 'stage2_unreadable'))},
  {'grp': 'role_mismatch', 'm': list_filter(codes, lambda x: x IN ('data_engineering_as_ai_role', 'business_focus_in_ai_role', 'business_role_as_ai_role', 'deeptech_as_analyst', 'clinical_scientist_as_analyst'))},
  {'grp': 'signal_extraction', 'm': list_filter(codes, lambda x: x IN ('missing_keywords', 'missing_focus', 'missing_group_summary', 'noise_keyword', 'duplicate_signal'))},
  {'grp': 'non_blocking_context', 'm': list_filter(codes, lambda x: priority IN ('pass', 'low') AND x IN ('business_context_in_ai_role', 'summary_too_short', 'role_diff', 'focus_diff', 'keywords_diff', 'summary_diff'))}
  ], lambda x: len(x.m) > 0)) AS g FROM cand))"""


@query("d7_triage_report", "WITH " + TRIAGE_SQL + """
SELECT grp AS "group", '' AS code, count(*) AS n FROM tri GROUP BY grp UNION ALL
SELECT grp, c, count(*) FROM (SELECT grp, unnest(m) AS c FROM tri) GROUP BY grp, c""")
def d7(spark, sf):
    return D.triage_report(candidates(spark, sf))


@query("d7_triage_examples", "WITH " + TRIAGE_SQL + """
SELECT grp AS "group", id, array_to_string(m, '|') AS matched, row_number() OVER (PARTITION BY grp ORDER BY ord) AS rank FROM tri QUALIFY rank <= 12""")
def d7e(spark, sf):
    return D.triage_examples(candidates(spark, sf)).select("group", "id", join_list("matched").alias("matched"), "rank")


SMALL_REPAIR = RepairRules(
    roles=tuple(STAGE_ROLES),
    role_rules=(("7$", None, "Furniture", "high", "seven"), ("[13]$", "llm", "Machinery", "medium", "odd llm"), ("2$", None, "Building", "low", "two")),
    focus_by_role=((["Furniture"], True, "7$", "Seven / Focus", "title"), (["Building"], False, "", "Build / Plan", "role")),
    focus_rules=(("crm", "Crm, Growth"), ("llm", "Llm / Rag")),
    keyword_rules=((r"\bllm\b", "LLM"), ("growth", "Growth"), ("crm", "CRM"), ("growth|llm", "LLM")), validation=SMALL)

REPAIR_SQL = PAIR_SQL + """,
rp AS (SELECT *, lower(title) AS lt, lower(concat_ws(' ', company, title, r1, f1, k1, s1, detail_body)) AS tx,
  list_filter(list_transform(regexp_split_to_array(k1, '[,/]'), lambda x: trim(x)), lambda x: x <> '') AS kt,
  CASE WHEN state IN ('stage2_missing', 'stage2_stale') THEN 'stage2_sync'
    WHEN len(list_filter(codes, lambda x: x IN ('analytics_engineering_as_ai_role', 'data_engineering_as_ai_role', 'business_focus_in_ai_role', 'business_role_as_ai_role', 'deeptech_as_analyst', 'clinical_scientist_as_analyst'))) > 0 THEN 'role_mismatch'
    WHEN len(list_filter(codes, lambda x: x IN ('missing_keywords', 'missing_focus', 'missing_group_summary', 'noise_keyword', 'duplicate_signal'))) > 0 THEN 'signal_extraction' ELSE 'other' END AS grp
  FROM cand WHERE status = 'needs_review'),
rq AS (SELECT *, list_filter(kt, lambda x, i: list_position(list_transform(kt, lambda y: lower(y)), lower(x)) = i) AS own,
  CASE WHEN lt LIKE '%7' THEN 'Furniture' WHEN regexp_matches(lt, '[13]$') AND tx LIKE '%llm%' THEN 'Machinery' WHEN lt LIKE '%2' THEN 'Building'
    WHEN r1 IN ('Automobile', 'Building', 'Furniture', 'Machinery') THEN r1 ELSE '' END AS nr,
  CASE WHEN lt LIKE '%7' THEN 'high' WHEN regexp_matches(lt, '[13]$') AND tx LIKE '%llm%' THEN 'medium' ELSE 'low' END AS nc FROM rp),
rr AS (SELECT *, CASE WHEN nr = 'Furniture' AND lt LIKE '%7' THEN 'Seven / Focus' WHEN nr = 'Building' THEN 'Build / Plan' WHEN tx LIKE '%crm%' THEN 'Crm, Growth'
    WHEN tx LIKE '%llm%' THEN 'Llm / Rag' ELSE f1 END AS nf,
  CASE WHEN len(own) > 0 THEN own WHEN tx LIKE '%llm%' THEN ['LLM'] WHEN tx LIKE '%crm%' THEN ['Growth', 'CRM', 'LLM'] ELSE [] END AS nk FROM rq),
repairs AS (SELECT id, ord, grp, nc, CASE WHEN grp = 'stage2_sync' THEN r1 ELSE nr END AS role, CASE WHEN grp = 'stage2_sync' THEN f1 ELSE nf END AS focus,
  array_to_string(CASE WHEN grp = 'stage2_sync' THEN own ELSE nk END, ', ') AS keywords,
  CASE WHEN grp = 'stage2_sync' THEN s1 WHEN nf = '' THEN s1
    ELSE array_to_string(['경력'] || list_transform(regexp_split_to_array(nf, '[/,]'), lambda x: trim(x)), ' / ') END AS summary,
  CASE WHEN grp = 'stage2_sync' THEN 'high' WHEN nf = '' OR len(nk) = 0 OR s1 = '' AND nf = '' THEN 'low' WHEN nc = 'high' THEN 'high' ELSE 'medium' END AS confidence FROM rr)"""


@query("d8_repair_candidates", "WITH " + REPAIR_SQL + """
SELECT id, grp AS repair_group, role AS suggested_role, focus AS suggested_focus, keywords AS suggested_keywords, summary AS suggested_summary, confidence,
  CASE WHEN grp = 'stage2_sync' THEN 'resync_stage2_candidate' WHEN confidence <> 'low' THEN 'repair_then_review' ELSE 'model_or_human_review_required' END AS recommended_action
FROM repairs""")
def d8(spark, sf):
    r = D.repair_candidates(candidates(spark, sf), stage_tables(spark, sf)[0], SMALL_REPAIR)
    return r.select("id", "repair_group", "suggested_role", "suggested_focus", "suggested_keywords", "suggested_summary", "confidence", "recommended_action")


def repairs(spark, sf):
    s1, _ = stage_tables(spark, sf)
    return D.repair_effect(D.repair_candidates(candidates(spark, sf), s1, SMALL_REPAIR), s1, SMALL)


@query("d9_repair_effect")
def d9(spark, sf):
    return repairs(spark, sf).select("id", join_list("before_codes").alias("before_codes"), join_list("after_codes").alias("after_codes"), "after_count", "repair_effect")


@query("d10_apply_repairs", "WITH " + REPAIR_SQL + """,
ap AS (SELECT p.*, r.id IS NOT NULL AS hit, coalesce(nullif(r.role, ''), nullif(p.role2, ''), p.role) AS vr, coalesce(nullif(r.focus, ''), nullif(p.focus2, ''), p.focus) AS vf,
  coalesce(nullif(r.keywords, ''), nullif(p.keywords2, ''), p.keywords) AS vk, coalesce(nullif(r.summary, ''), nullif(p.summary2, ''), p.summary) AS vs, r.confidence
  FROM pair p LEFT JOIN repairs r ON r.id = p.id)
SELECT id, vr AS stage2_role, vf AS stage2_focus, vk AS stage2_keywords,
  CASE WHEN length(vs) > 4 THEN vs WHEN vf = '' THEN '경력' ELSE array_to_string(['경력'] || list_transform(regexp_split_to_array(vf, '[/,]'), lambda x: trim(x)), ' / ') END AS stage2_summary,
  't0; ' || CASE WHEN hit THEN 'stage2 repair source=heuristic; confidence=' || confidence || '; effect=' WHEN found THEN 'stage2 carry-forward' ELSE 'stage2 pass-through from stage1' END
    || CASE WHEN vf = '' THEN '; missing focus after apply' ELSE '' END || CASE WHEN length(vs) <= 4 THEN '; summary fallback' ELSE '' END AS memo
FROM ap""")
def d10(spark, sf):
    s1, s2 = stage_tables(spark, sf)
    r = D.repair_candidates(candidates(spark, sf), s1, SMALL_REPAIR)
    return D.apply_repairs(s1, s2, r, "t0").select("id", "stage2_role", "stage2_focus", "stage2_keywords", "stage2_summary", "memo")
