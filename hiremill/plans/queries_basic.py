"""Checked queries for sources, normalisation and briefing (groups A, B, E)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiremill.functions.text import join_list
from hiremill.operators import aggregate as E
from hiremill.operators import prepare as B
from hiremill.plans.adapters import POSTING_SQL, SNAP_SQL, posting_doc, snapshots
from hiremill.plans.base import query, table
from hiremill.sources import io as A

NORM_SQL = POSTING_SQL + """,
norm AS (
  SELECT *,
    list_transform(skills, lambda x: CASE x WHEN 'python' THEN 'Python' WHEN 'pytorch' THEN 'PyTorch' WHEN 'docker' THEN 'Docker'
      WHEN 'tensorflow' THEN 'TensorFlow' WHEN 'kubernetes' THEN 'Kubernetes' WHEN 'github' THEN 'GitHub'
      WHEN 'tableau' THEN 'Tableau' WHEN 'bigquery' THEN 'BigQuery' ELSE x END) AS normalized_skills,
    CASE WHEN experience = '' THEN '미기재' ELSE '경력 ' || CAST(n_chars % 12 AS VARCHAR) || '년+' END AS experience_label,
    CASE WHEN experience = '' THEN 'unknown' WHEN n_chars % 12 <= 2 THEN 'junior' WHEN n_chars % 12 <= 5 THEN 'mid'
      WHEN n_chars % 12 <= 8 THEN 'senior' ELSE 'lead' END AS experience_band,
    list_filter(['일반채용', '학사', '석사', '박사', '전문연구요원', '인턴', '계약직'], lambda x: contains(track, x)) AS track_labels,
    list_filter(string_split(focus, '/'), lambda x: x <> '') AS focus_labels,
    TRY_CAST(substring(first_seen_at, 1, 10) AS DATE) AS first_seen_date
  FROM posting
),
scored0 AS (
  SELECT *, list_filter([
      CASE WHEN experience_label = '미기재' THEN '경력수준 불명확' END, CASE WHEN len(track_labels) = 0 THEN '채용트랙 불명확' END,
      CASE WHEN len(focus_labels) = 0 THEN '직무초점 미정리' END, CASE WHEN len(normalized_skills) < 2 THEN '핵심기술 부족' END,
      CASE WHEN len(tasks) < 2 THEN '주요업무 부족' END, CASE WHEN len(requirements) < 2 THEN '자격요건 부족' END,
      CASE WHEN trim(title) = '' OR regexp_matches(lower(title), 'official website|talent pool|^ai engineer$|^ai research engineer$|^채용공고$')
        THEN '제목이 지나치게 포괄적' END], lambda x: x IS NOT NULL) AS review_issues
  FROM norm
),
scored AS (
  SELECT *, greatest(28, least(100, 100 - len(review_issues) * 12 + CASE WHEN active THEN 4 ELSE 0 END)) AS quality_score,
    len(review_issues) >= 2 AS needs_review,
    CASE WHEN list_contains(review_issues, '제목이 지나치게 포괄적') OR len(review_issues) >= 3 THEN 'high'
      WHEN len(review_issues) = 2 THEN 'medium' ELSE 'low' END AS review_priority,
    CASE WHEN len(review_issues) > 0 THEN array_to_string(review_issues[1:3], ', ') ELSE '검수 필요 없음' END AS instruction
  FROM scored0
)"""


def scored(spark, sf):
    return E.posting_quality(B.normalize_taxonomy(posting_doc(spark, sf)))


@query("a1_snapshot_rows", """
SELECT n_nationkey AS ord, CAST(n_nationkey AS VARCHAR) AS n_nationkey,
  nullif(trim(CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE n_name END), '') AS n_name FROM nation""")
def a1(spark, sf):
    n = table(spark, sf, "nation")
    raw = n.select(F.col("n_nationkey").alias("line"), F.col("n_nationkey").cast("string").alias(" n_nationkey "),
                   F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name")).alias("n_name"),
                   F.lit("x").alias("_c3"))
    return A.tidy_rows(raw, "line")


@query("a2_source_size_guard", "WITH " + SNAP_SQL + """
SELECT n AS row_count, p AS previous_count, CAST(floor(p * 0.95) AS BIGINT) AS minimum_allowed, n < 10 AS too_few,
  n < floor(p * 0.95) AS shrunk, NOT (n < 10 OR n < floor(p * 0.95)) AS passed
FROM (SELECT (SELECT count(*) FROM snap_after) n, (SELECT count(*) FROM snap_before) p)""")
def a2(spark, sf):
    before, after = snapshots(spark, sf)
    return A.source_size_guard(after, before, min_rows=10, shrink_ratio=0.95)


ITEM = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@query("a3_load_keyed_store", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type, value FROM events""")
def a3(spark, sf):
    e = table(spark, sf, "events")
    doc = e.select(F.concat(
        F.lit('{"updatedAt":null,"items":{"'), F.col("event_id").cast("string"), F.lit('":'),
        F.to_json(F.struct("event_type", "value")), F.lit("}}")).alias("json"))
    schema = T.StructType([T.StructField("items", T.MapType(T.StringType(), ITEM))])
    return A.unpack_store(doc.select(F.from_json("json", schema).alias("d")).select("d.items"), ITEM)


@query("a4_upsert_by_key", "WITH " + SNAP_SQL + """
SELECT id, role, title FROM snap_before WHERE id NOT IN (SELECT id FROM snap_after)
UNION ALL SELECT id, role, title FROM snap_after""")
def a4(spark, sf):
    before, after = snapshots(spark, sf)
    twice = after.withColumn("role", F.lit("old")).withColumn("ord", F.col("ord") - 1).unionByName(after)
    return A.upsert_by_key(before.select("id", "role", "title"), twice)


@query("a5_prune_by_key", "WITH " + SNAP_SQL + """
SELECT b.id, b.role, (SELECT count(*) FROM snap_before WHERE ord % 10 = 1) AS removed
FROM snap_before b WHERE ord % 10 <> 1""")
def a5(spark, sf):
    before, after = snapshots(spark, sf)
    removed = before.select("id").join(after.select("id"), "id", "left_anti")
    kept, gone = A.prune_by_key(before.select("id", "role"), removed)
    return kept.withColumn("removed", gone.scalar())


@query("a6_sheet_rows", "WITH " + POSTING_SQL + """
SELECT id, title, array_to_string(preferred, ', ') AS preferred, CASE WHEN active THEN 'true' ELSE 'false' END AS active, '' AS memo
FROM posting""")
def a6(spark, sf):
    return A.sheet_rows(posting_doc(spark, sf), ["id", "title", "preferred", "active", "memo"])


@query("a7_json_lines", """
SELECT '{"doc_id":' || doc_id || ',"quality":' || quality || ',"note":null}' AS line FROM labels""")
def a7(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "quality", F.lit(None).cast("string").alias("note"))
    return A.as_json_lines(l)


@query("b1_normalize_postings", """
SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS id, c_name AS company,
  CASE WHEN c_custkey % 5 = 0 THEN '미분류' ELSE 'tier' || c_nationkey END AS company_tier,
  CASE WHEN c_custkey % 3 = 0 THEN '기타' ELSE c_mktsegment END AS role,
  CASE WHEN c_custkey % 4 = 0 THEN 'a|b' ELSE 'x' END AS focus_axes, c_custkey % 2 = 0 AS active,
  c_mktsegment || '|line two' AS tasks, CASE WHEN c_custkey % 7 = 0 THEN 'sql|Deep Learning|go' ELSE 'sql|python' END AS skills
FROM customer""")
def b1(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    src = c.select(
        k.alias("ord"), k.cast("string").alias("공고키"), F.lit(" ").alias("회사명_표시"), F.col("c_name").alias("company_name"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("tier"), "c_nationkey")).alias("기업층"),
        F.when(k % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("분류직무"),
        F.when(k % 4 == 0, "a / b; a").otherwise("x").alias("직무초점_표시"),
        F.when(k % 2 == 0, "활성").otherwise("no").alias("활성여부"),
        F.concat("c_mktsegment", F.lit("\n\n line two ")).alias("주요업무_표시"),
        F.when(k % 7 == 0, "sql deep learning go").otherwise("sql, python,sql").alias("핵심기술_표시"))
    p = B.normalize_postings(src)
    return p.select("ord", "id", "company", "company_tier", "role", join_list("focus_axes").alias("focus_axes"), "active",
                    join_list("tasks").alias("tasks"), join_list("skills").alias("skills"))


@query("b2_split_skills", """
WITH w AS (SELECT p_partkey AS id, string_split(p_name || ' ' || lower(p_type), ' ') AS t FROM part)
SELECT id, CASE WHEN len(v) >= 3 THEN array_to_string(list_transform(list_filter(v, lambda x, i: list_position(v, x) = i),
    lambda x: replace(x, 'red_widget', 'Red Widget')), '|')
  ELSE replace(array_to_string(v, ' '), 'red_widget', 'Red Widget') END AS skills
FROM (SELECT id, string_split(replace(array_to_string(t, ' '), 'red widget', 'red_widget'), ' ') AS v FROM w)""")
def b2(spark, sf):
    p = table(spark, sf, "part")
    line = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    return p.select(F.col("p_partkey").alias("id"), join_list(B.split_skills(line, ["Red Widget"])).alias("skills"))


@query("b3_normalize_taxonomy", "WITH " + NORM_SQL + """
SELECT id, array_to_string(normalized_skills, '|') AS skills, experience_label, experience_band,
  array_to_string(track_labels, '|') AS tracks, array_to_string(focus_labels, '|') AS focuses,
  CAST(first_seen_date AS VARCHAR) AS first_seen_date FROM norm""")
def b3(spark, sf):
    return B.normalize_taxonomy(posting_doc(spark, sf)).select(
        "id", join_list("normalized_skills").alias("skills"), "experience_label", "experience_band",
        join_list("track_labels").alias("tracks"), join_list("focus_labels").alias("focuses"),
        F.col("first_seen_date").cast("string").alias("first_seen_date"))


@query("b4_apply_enrichment", "WITH " + POSTING_SQL + """
SELECT p.id, CASE WHEN l.quality = 1 THEN '신입' ELSE p.experience END AS experience,
  CASE WHEN l.toxic = 1 THEN '석사 / 박사' ELSE p.track END AS track, p.focus,
  CASE WHEN l.quality = 0 THEN 'sql|rag' ELSE array_to_string(p.skills, '|') END AS skills, l.doc_id IS NOT NULL AS ai_enriched
FROM posting p LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = p.id""")
def b4(spark, sf):
    l = table(spark, sf, "labels")
    e = l.select(F.col("doc_id").cast("string").alias("id"),
                 F.when(F.col("quality") == 1, "신입").otherwise("").alias("experience_label"),
                 F.when(F.col("toxic") == 1, F.array(F.lit("석사"), F.lit("박사"))).alias("track_labels"),
                 F.expr("cast(array() as array<string>)").alias("focus_labels"),
                 F.when(F.col("quality") == 0, F.array(F.lit("sql"), F.lit("rag"))).alias("skills"),
                 F.lit("t").alias("applied_at"), F.lit("").alias("reviewer_note"))
    return B.apply_enrichment(posting_doc(spark, sf), e).select(
        "id", "experience", "track", "focus", join_list("skills").alias("skills"), "ai_enriched")


@query("b11_content_signature", "WITH " + SNAP_SQL + """
SELECT count(*) AS n, count(DISTINCT (company, role, title, last_seen_at)) AS distinct_signatures FROM snap_after""")
def b11(spark, sf):
    _, after = snapshots(spark, sf)
    sig = after.select(B.content_signature(after, B.SYNC_FIELDS).alias("sig"))
    return sig.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sig").alias("distinct_signatures"))


@query("b12_overlay_candidate_results", "WITH " + POSTING_SQL + """
SELECT p.id, p.title, 'q' || l.quality AS focus_label, 'done' AS summary
FROM posting p JOIN labels l ON CAST(l.doc_id AS VARCHAR) = p.id""")
def b12(spark, sf):
    rows = posting_doc(spark, sf).select("id", "title", "focus_label", "summary")
    res = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"),
                                            F.concat(F.lit("q"), "quality").alias("focus_label"), F.lit("done").alias("summary"))
    return B.overlay_candidate_results(rows, res, ["focus_label", "summary"])


@query("e1_posting_quality", "WITH " + NORM_SQL + """
SELECT id, array_to_string(review_issues, '|') AS issues, quality_score, needs_review, review_priority, instruction FROM scored""")
def e1(spark, sf):
    return scored(spark, sf).select("id", join_list("review_issues").alias("issues"), "quality_score", "needs_review",
                                    "review_priority", "instruction")


BRIEF_SQL = "WITH " + NORM_SQL + """,
latest AS (SELECT max(first_seen_date) AS d FROM scored),
long AS (
  SELECT role, ord, 'tier' AS facet, 0 AS pos, company_tier AS label FROM scored WHERE company_tier <> ''
  UNION ALL SELECT role, ord, 'experience', 0, experience_label FROM scored WHERE experience_label <> '미기재'
  UNION ALL SELECT role, ord, 'track', generate_subscripts(track_labels, 1), unnest(track_labels) FROM scored
  UNION ALL SELECT role, ord, 'focus', generate_subscripts(focus_labels, 1), unnest(focus_labels) FROM scored
  UNION ALL SELECT role, ord, 'skill', generate_subscripts(normalized_skills, 1), unnest(normalized_skills) FROM scored
  UNION ALL SELECT role, ord, 'company', 0, company FROM scored
),
counted AS (SELECT role, facet, label, count(*) AS n, min(ord) AS o, arg_min(pos, ord) AS p FROM long GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY role, facet ORDER BY n DESC, o, p) AS rk FROM counted),
tops AS (
  SELECT role, max(label) FILTER (facet = 'tier' AND rk = 1) AS tier, max(label) FILTER (facet = 'experience' AND rk = 1) AS expr,
    string_agg(label, '|' ORDER BY rk) FILTER (facet = 'track' AND rk <= 4) AS tracks,
    string_agg(label, '|' ORDER BY rk) FILTER (facet = 'focus' AND rk <= 4) AS focuses,
    string_agg(label, '|' ORDER BY rk) FILTER (facet = 'skill' AND rk <= 5) AS skills,
    string_agg(label, ', ' ORDER BY rk) FILTER (facet = 'skill' AND rk <= 3) AS skills3,
    max(label) FILTER (facet = 'track' AND rk = 1) AS track1, max(label) FILTER (facet = 'focus' AND rk = 1) AS focus1,
    string_agg(label || ':' || n, '|' ORDER BY rk) FILTER (facet = 'company' AND rk <= 4) AS companies,
    count(*) FILTER (facet = 'company') AS company_count
  FROM ranked GROUP BY role
),
agg AS (
  SELECT role, count(*) AS total_jobs, count(*) FILTER (active) AS active_jobs,
    count(*) FILTER (first_seen_date >= (SELECT d FROM latest) - INTERVAL 6 DAY) AS recent_jobs_7d,
    count(*) FILTER (experience_label <> '미기재') AS c1, count(*) FILTER (len(track_labels) > 0) AS c2,
    count(*) FILTER (len(focus_labels) > 0) AS c3, count(*) FILTER (len(normalized_skills) >= 2) AS c4,
    count(*) FILTER (len(tasks) >= 2) AS c5, count(*) FILTER (len(requirements) >= 2) AS c6,
    sum(quality_score) AS sc, count(*) FILTER (needs_review) AS review_needed
  FROM scored GROUP BY role
)
SELECT agg.role, total_jobs, active_jobs, CAST(round_even(active_jobs / total_jobs * 100, 0) AS BIGINT) AS active_rate, recent_jobs_7d,
  company_count, coalesce(expr, '경력수준 미상') AS top_experience, coalesce(tracks, '') AS top_tracks, coalesce(focuses, '') AS top_focuses,
  coalesce(skills, '') AS top_skills, companies AS top_companies,
  CAST(round_even(c1 / total_jobs * 100, 0) AS BIGINT) AS coverage_experience, CAST(round_even(c2 / total_jobs * 100, 0) AS BIGINT) AS coverage_track,
  CAST(round_even(c3 / total_jobs * 100, 0) AS BIGINT) AS coverage_focus, CAST(round_even(c4 / total_jobs * 100, 0) AS BIGINT) AS coverage_skills,
  CAST(round_even(c5 / total_jobs * 100, 0) AS BIGINT) AS coverage_tasks, CAST(round_even(c6 / total_jobs * 100, 0) AS BIGINT) AS coverage_requirements,
  CAST(round_even(sc / total_jobs, 0) AS BIGINT) AS average_quality_score, review_needed,
  coalesce(tier, '기업군 미상') || ' 채용이 중심이고, ' || coalesce(expr, '경력수준 미상') || ' 수요가 가장 두드러집니다. ' || coalesce(track1, '트랙 미상')
    || ' 트랙 비중이 높으며, ' || coalesce(skills3, '핵심기술 정보') || ' 스택과 ' || coalesce(focus1, '초점 미상') || ' 초점이 반복적으로 나타납니다.' AS narrative
FROM agg JOIN tops ON agg.role = tops.role"""


@query("e2_role_brief", BRIEF_SQL)
def e2(spark, sf):
    b = E.role_brief(scored(spark, sf))
    return b.withColumns({
        **{c: join_list(c) for c in ["top_tracks", "top_focuses", "top_skills"]},
        "top_companies": F.array_join(F.transform("top_companies", lambda x: F.concat(x["name"], F.lit(":"), x["count"])), "|")})


OVERVIEW_SQL = """
overview AS (
  SELECT count(*) AS total_jobs, count(*) FILTER (active) AS active_jobs, count(DISTINCT company) AS companies,
    count(*) FILTER (first_seen_date >= (SELECT max(first_seen_date) FROM scored) - INTERVAL 6 DAY) AS recent_jobs_7d, CAST(0 AS BIGINT) AS enriched,
    count(*) FILTER (needs_review) AS review_needed, count(*) FILTER (review_priority = 'high') AS high_priority,
    CAST(round_even(count(*) FILTER (experience_label <> '미기재') / count(*) * 100, 0) AS BIGINT) AS coverage_experience,
    CAST(round_even(count(*) FILTER (len(track_labels) > 0) / count(*) * 100, 0) AS BIGINT) AS coverage_track,
    CAST(round_even(count(*) FILTER (len(focus_labels) > 0) / count(*) * 100, 0) AS BIGINT) AS coverage_focus,
    CAST(round_even(count(*) FILTER (len(normalized_skills) >= 2) / count(*) * 100, 0) AS BIGINT) AS coverage_skills,
    CAST(round_even(count(*) FILTER (len(tasks) >= 2) / count(*) * 100, 0) AS BIGINT) AS coverage_tasks,
    CAST(round_even(count(*) FILTER (len(requirements) >= 2) / count(*) * 100, 0) AS BIGINT) AS coverage_requirements
  FROM scored)"""


@query("e3_briefing_overview", "WITH " + NORM_SQL + "," + OVERVIEW_SQL + " SELECT * FROM overview")
def e3(spark, sf):
    return E.briefing_overview(scored(spark, sf))


@query("e3_pipeline_stages", "WITH " + NORM_SQL + "," + OVERVIEW_SQL + """
SELECT 1 AS stage, '원본 수집' AS label, total_jobs AS count FROM overview UNION ALL SELECT 2, '규칙 정규화', total_jobs FROM overview
UNION ALL SELECT 3, 'AI 보정 필요', review_needed FROM overview UNION ALL SELECT 4, 'AI 반영 완료', enriched FROM overview
UNION ALL SELECT 5, '고우선 검수', high_priority FROM overview""")
def e3s(spark, sf):
    return E.pipeline_stages(E.briefing_overview(scored(spark, sf)))


@query("e4_review_queue", "WITH " + NORM_SQL + """
SELECT id, review_priority, quality_score, CASE review_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS priority_rank
FROM scored WHERE needs_review ORDER BY priority_rank, quality_score, ord LIMIT 14""")
def e4(spark, sf):
    return E.review_queue(scored(spark, sf)).select("id", "review_priority", "quality_score", "priority_rank")


@query("e4_publish_list", "WITH " + NORM_SQL + """
SELECT id, review_priority, coalesce(CAST(epoch(TRY_CAST(nullif(last_seen_at, '') AS TIMESTAMP)) AS BIGINT), 0) AS last_seen_epoch,
  CASE review_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS priority_rank FROM scored""")
def e4p(spark, sf):
    return E.publish_list(scored(spark, sf)).select("id", "review_priority", "last_seen_epoch", "priority_rank")


@query("e6_role_filters", "WITH " + POSTING_SQL + """
SELECT coalesce(role, 'all') AS role, count(*) AS n,
  CASE WHEN role IS NULL THEN -1 WHEN role = 'fr' THEN 0 WHEN role = 'en' THEN 1 ELSE 2 END AS sort_rank
FROM posting GROUP BY ROLLUP(role)""")
def e6(spark, sf):
    return E.role_filters(posting_doc(spark, sf), order=["fr", "en"])
