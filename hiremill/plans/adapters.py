"""Views that give generic tables the shape of postings, snapshots and reviewed tables.

Every view exists twice: as a DataFrame for the Spark jobs and as a SQL text for the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill.functions.text import non_blank, null_if_blank, ordered_distinct
from hiremill.plans.base import table


def posting_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as postings: source = company, language = role, lines = tasks, long words = skills."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), "ts", "event_type", "value")
    n = F.col("n_chars")
    joined = docs.join(labels, "doc_id", "left").join(events, "doc_id", "left")
    # Word lists of a text are made where they are used; Spark drops the columns a job does not read.
    base = joined.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("ord"),
        F.col("source").alias("company"),
        F.when(n > 3000, "large").when(n > 800, "mid").otherwise("").alias("company_tier"),
        F.col("lang").alias("role"),
        F.upper("lang").alias("role_display"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("경력 "), (n % 12).cast("string"), F.lit("년"))).alias("experience"),
        F.when(n % 5 == 0, "석사/박사").when(n % 5 == 1, "학사").when(n % 5 == 2, "일반채용").otherwise("").alias("track"),
        F.concat(F.coalesce("event_type", F.lit("")), F.when(n % 3 == 0, F.concat(F.lit("/"), F.col("source"))).otherwise("")).alias("focus"),
        F.concat_ws(" / ", "event_type", "lang").alias("group_summary"),
        F.col("text").alias("detail_body"),
        non_blank(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("tasks"),
        ordered_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("skills"),
        (F.coalesce("value", F.lit(0.0)) >= 10).alias("active"),
        F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("first_seen_at"),
        F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("last_seen_at"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("quality"),
        F.coalesce("event_type", F.lit("")).alias("event_type"),
        n.alias("n_chars"),
        F.coalesce("toxic", F.lit(0)).cast("bigint").alias("toxic"),
    )
    return base.select(
        "*",
        F.filter("tasks", lambda x: F.length(x) >= 80).alias("requirements"),
        F.filter("tasks", lambda x: F.length(x) < 40).alias("preferred"),
        F.col("skills").alias("keywords"),
        F.when(F.col("quality") == "low", "").otherwise(
            F.coalesce(F.try_element_at("tasks", F.lit(-1)), F.lit(""))).alias("summary"),
        F.col("event_type").alias("focus_label"),
    )


POSTING_SQL = """
base0 AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality AS q, l.toxic AS tox, e.ts, e.event_type AS et, e.value,
    list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS tasks,
    regexp_extract_all(lower(d.text), '[a-z]{6,}') AS words
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
),
posting AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, source AS company,
    CASE WHEN n_chars > 3000 THEN 'large' WHEN n_chars > 800 THEN 'mid' ELSE '' END AS company_tier,
    lang AS role, upper(lang) AS role_display,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN n_chars % 4 = 0 THEN '' ELSE '경력 ' || CAST(n_chars % 12 AS VARCHAR) || '년' END AS experience,
    CASE n_chars % 5 WHEN 0 THEN '석사/박사' WHEN 1 THEN '학사' WHEN 2 THEN '일반채용' ELSE '' END AS track,
    coalesce(et, '') || CASE WHEN n_chars % 3 = 0 THEN '/' || source ELSE '' END AS focus,
    concat_ws(' / ', et, lang) AS group_summary,
    text AS detail_body, tasks,
    list_filter(words, lambda x, i: list_position(words, x) = i) AS skills,
    coalesce(value, 0) >= 10 AS active,
    coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '') AS first_seen_at,
    coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '') AS last_seen_at,
    CASE q WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS quality,
    coalesce(et, '') AS event_type, n_chars, coalesce(tox, 0) AS toxic,
    list_filter(tasks, lambda x: length(x) >= 80) AS requirements,
    list_filter(tasks, lambda x: length(x) < 40) AS preferred,
    list_filter(words, lambda x, i: list_position(words, x) = i) AS keywords,
    CASE WHEN q = 0 THEN '' ELSE coalesce(tasks[-1], '') END AS summary,
    coalesce(et, '') AS focus_label
  FROM base0
)"""


def posting_part(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as postings with few distinct terms: a dense co-occurrence table."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("company"), F.col("p_type").alias("role"),
        F.split("p_name", " ").alias("skills"), F.array("p_type").alias("axes"),
        (F.col("p_size") >= 25).alias("active"), F.col("p_size").cast("bigint").alias("size"),
        F.col("p_name").alias("title"))


PART_SQL = """
posting AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ord, p_brand AS company, p_type AS role,
    string_split(p_name, ' ') AS skills, [p_type] AS axes, p_size >= 25 AS active, p_size AS size, p_name AS title
  FROM part
)"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of orders: some keys leave, some come, some change."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("ord"),
        F.col("o_custkey").cast("string").alias("company"), F.col("o_orderstatus").alias("role"),
        F.col("o_orderpriority").alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_seen_at"))
    before = o.where("ord % 10 <> 0")
    after = o.where("ord % 10 <> 1").withColumn(
        "role", F.when(F.col("ord") % 10 == 2, F.lit("X")).otherwise(F.col("role")))
    return before, after


SNAP_SQL = """
snap0 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS company,
    o_orderstatus AS role, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS last_seen_at
  FROM orders
),
snap_before AS (SELECT * FROM snap0 WHERE ord % 10 <> 0),
snap_after AS (
  SELECT id, ord, company, CASE WHEN ord % 10 = 2 THEN 'X' ELSE role END AS role, title, last_seen_at
  FROM snap0 WHERE ord % 10 <> 1)"""


def stage_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a first table and a reviewed second table that lags behind it."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    stage1 = c.select(
        k.cast("string").alias("id"), k.alias("ord"),
        F.when(k % 13 == 6, "").otherwise(F.col("c_nationkey").cast("string")).alias("change_hash"),
        F.initcap("c_mktsegment").alias("role"),
        F.when(k % 17 == 8, "").otherwise(F.split_part("c_name", F.lit("#"), F.lit(1))).alias("focus"),
        F.when(k % 19 == 9, "").otherwise(
            F.concat(F.lit("k"), (k % 4).cast("string"), F.lit(", K"), (k % 6).cast("string"),
                     F.when(k % 5 == 2, " / Customer").otherwise(" / Part"))).alias("keywords"),
        F.when(k % 23 == 3, "sum").otherwise(F.concat(F.lit("summary "), F.lower("c_mktsegment"))).alias("summary"),
        F.col("c_nationkey").cast("string").alias("company"), F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("llm platform "), F.col("c_mktsegment")))
        .when(F.col("c_acctbal") < 0, "crm growth dashboard").otherwise("plain text").alias("detail_body"),
        F.lit("").alias("tasks_text"), F.lit("").alias("requirements_text"), F.lit("").alias("preferred_text"),
        F.lit("").alias("job_url"), F.lit("2024-01-01").alias("last_seen_at"),
        F.lit("경력").alias("experience"), F.lit("").alias("track"))
    stage2 = stage1.where("ord % 11 <> 3").select(
        "id", "ord",
        F.when(F.col("ord") % 11 == 4, F.concat("change_hash", F.lit("1"))).otherwise(F.col("change_hash")).alias("change_hash"),
        F.when(F.col("ord") % 7 == 5, "Other").otherwise(F.col("role")).alias("role"),
        F.col("focus"), F.col("keywords"),
        F.when(F.col("ord") % 9 == 1, "").otherwise(F.col("summary")).alias("summary"),
        F.when(F.col("ord") % 2 == 0, "approved").otherwise("").alias("approval"),
        F.when(F.col("ord") % 3 == 0, "seen").otherwise("").alias("memo"))
    return stage1, stage2


STAGE_SQL = """
stage1 AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS ord,
    CASE WHEN c_custkey % 13 = 6 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS change_hash,
    upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) AS role,
    CASE WHEN c_custkey % 17 = 8 THEN '' ELSE split_part(c_name, '#', 1) END AS focus,
    CASE WHEN c_custkey % 19 = 9 THEN '' ELSE 'k' || (c_custkey % 4) || ', K' || (c_custkey % 6) || CASE WHEN c_custkey % 5 = 2 THEN ' / Customer' ELSE ' / Part' END END AS keywords,
    CASE WHEN c_custkey % 23 = 3 THEN 'sum' ELSE 'summary ' || lower(c_mktsegment) END AS summary,
    CAST(c_nationkey AS VARCHAR) AS company, c_name AS title,
    CASE WHEN c_acctbal > 5000 THEN 'llm platform ' || c_mktsegment WHEN c_acctbal < 0 THEN 'crm growth dashboard'
      ELSE 'plain text' END AS detail_body
  FROM customer
),
stage2 AS (
  SELECT id, ord, CASE WHEN ord % 11 = 4 THEN change_hash || '1' ELSE change_hash END AS change_hash,
    CASE WHEN ord % 7 = 5 THEN 'Other' ELSE role END AS role, focus, keywords,
    CASE WHEN ord % 9 = 1 THEN '' ELSE summary END AS summary,
    CASE WHEN ord % 2 = 0 THEN 'approved' ELSE '' END AS approval,
    CASE WHEN ord % 3 = 0 THEN 'seen' ELSE '' END AS memo
  FROM stage1 WHERE ord % 11 <> 3)"""

# The roles of the stage tables; the last market segment is left out so that the role rule has hits.
STAGE_ROLES = ["Automobile", "Building", "Furniture", "Machinery"]
