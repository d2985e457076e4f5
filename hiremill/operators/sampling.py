"""Evaluation samples and candidate selection: stratified, newest, balanced, quota and remediation picks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from hiremill.functions.rank import first_per, top_k
from hiremill.functions.text import (at, compact, contains_any, is_in, let, lit_list, lit_map, lst, non_blank, ordered_distinct, s, squeeze)
from hiremill.rules import evaluation as EV

QUALITY_ORDER = {"high": 0, "medium": 1, "low": 2, "": 3}


def quality_order(c: str = "quality") -> Column:
    return F.coalesce(F.try_element_at(lit_map(QUALITY_ORDER), s(c)), F.lit(9))


def row_order() -> list[Column]:
    return [quality_order(), F.when(F.coalesce("active", F.lit(False)), 0).otherwise(1), squeeze("role_group"), squeeze("cluster_id"), squeeze("company"), squeeze("title"), F.col("id")]


def stratified_round_robin(rows: DataFrame, target: int) -> DataFrame:
    """Quality-aware stratified sample (id, position, source): one row per bucket and turn, rarest bucket first, then a fill.

    A bucket can give at most `target` rows, so every bucket is cut to that before anything is compared across buckets.
    """
    keyed = rows.select("id", "quality", "active", "role_group", "cluster_id", "company", "title")
    bucket = ["quality", "role_group", "cluster_id", "active"]
    size = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket, all of them ranked: the number of buckets is that of the label combinations.
    rarest = Window.partitionBy("quality").orderBy("n", "role_group", "cluster_id", F.when(F.col("active"), "active").otherwise("inactive"))
    ranks = size.withColumn("bucket_rank", F.row_number().over(rarest))
    turns = top_k(keyed, bucket, row_order(), target, "turn").join(ranks.select(*bucket, "bucket_rank"), bucket)
    counts = size.agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("quality") == q, F.col("n"))), F.lit(0)).alias(q) for q in ("high", "medium", "low")])
    goal = F.least(F.lit(max(target, 1)), F.col("total"))
    counts = counts.withColumn("goal", goal)
    counts = counts.withColumns({"q_high": F.least("high", F.greatest(F.lit(4), F.bround(F.col("goal") * 0.08).cast("bigint"))),
                                 "q_medium": F.least("medium", F.greatest(F.lit(24), F.bround(F.col("goal") * 0.32).cast("bigint")))})
    counts = counts.withColumn("q_low", F.least("low", F.greatest(F.col("goal") - F.col("q_high") - F.col("q_medium"), F.lit(0))))
    quota = counts.select(F.explode(F.array(*[F.struct(F.lit(q).alias("quality"), F.col(f"q_{q}").alias("quota")) for q in ("high", "medium", "low")])).alias("x"), "goal").select("x.*", "goal")
    placed = top_k(turns, ["quality"], ["turn", "bucket_rank"], target, "place").join(F.broadcast(quota), "quality").where(F.col("place") <= F.col("quota"))
    stage = F.when(F.col("quality") == "high", 0).when(F.col("quality") == "medium", 1).otherwise(2)
    chosen = placed.select("id", stage.alias("stage"), F.col("place").cast("bigint").alias("place"), F.lit("quota").alias("source"))
    rest = keyed.join(chosen.select("id"), "id", "left_anti").where(F.col("quality").isin("high", "medium", "low", ""))
    bounded = rest.orderBy(*row_order()).limit(target).withColumn("_one", F.lit(1))
    filler = top_k(bounded, ["_one"], row_order(), target, "place")
    missing = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    room = counts.select("goal").scalar() - missing
    fill = filler.where(F.col("place") <= room).select("id", F.lit(3).alias("stage"), F.col("place").cast("bigint").alias("place"), F.lit("fill").alias("source"))
    return chosen.unionByName(fill)


def newest_holdout(rows: DataFrame, n: int, ts: str = "first_seen_at") -> DataFrame:
    """The n newest rows: a bounded sort, at most n rows leave a task."""
    return rows.orderBy(F.col(ts).desc(), F.coalesce("active", F.lit(False)).desc(), "company", "title", "id").limit(n)


def date_range(rows: DataFrame, ts: str = "first_seen_at") -> DataFrame:
    return rows.agg(F.min(F.nullif(s(ts), F.lit(""))).alias("oldest"), F.max(F.nullif(s(ts), F.lit(""))).alias("newest"), F.count(F.lit(1)).alias("n"))


def match_tokens(c: Column) -> Column:
    return F.array_distinct(non_blank(F.split(F.trim(F.regexp_replace(F.lower(squeeze(c)), "[^0-9a-z가-힣]+", " ")), " ")))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Shared tokens over the smaller token set; 0 when a side is empty."""
    return let(F.struct(match_tokens(left).alias("l"), match_tokens(right).alias("r")), lambda p: F.when(
        (F.size(p["l"]) > 0) & (F.size(p["r"]) > 0), F.size(F.array_intersect(p["l"], p["r"])) / F.least(F.size(p["l"]), F.size(p["r"]))).otherwise(0.0))


SEVERITY_WEIGHT = {"high": 100, "medium": 45, "low": 15}


def detect_review_issues(items: DataFrame, broad: Sequence[str] = tuple(EV.WAVE_BROAD_FOCUS), hiring: Sequence[str] = tuple(EV.HIRING_TERMS),
                         banned: Sequence[str] = tuple(EV.WAVE_BANNED_TERMS), generic: Sequence[str] = tuple(EV.WAVE_GENERIC_KEYWORDS),
                         particles: Sequence[str] = tuple(EV.PARTICLE_SUFFIXES)) -> DataFrame:
    """Adds `review_codes`, `review_score`, `review_priority`. Needs quality, summary, focus_label, keywords, title, company and source fields."""
    q, summ, focus = squeeze("quality"), squeeze("summary"), squeeze("focus_label")
    kw = ordered_distinct(F.transform(lst("keywords"), squeeze), 8)
    flat = lambda c: F.trim(F.regexp_replace(F.lower(squeeze(c)), "[^0-9a-z가-힣]+", " "))
    hires = lambda c: contains_any(F.lower(squeeze(c)), list(hiring))
    echo = lambda c: (flat(c) != "") & (flat("company") != "") & F.contains(flat(c), flat("company"))
    words = {x for x in [*banned, *hiring, *generic]}

    def noisy(x: Column) -> Column:
        end = F.lit(False)
        for p in particles:
            end = end | x.endswith(p)
        return is_in(F.lower(x), words) | (F.length(x) <= 1) | end | (F.size(non_blank(F.split(F.trim(F.regexp_replace(F.lower(x), "[^0-9a-z가-힣]+", " ")), " "))) >= 5)

    issue = lambda cond, code, sev: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
    it = lambda code, sev: F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))
    signals = F.when(squeeze("detail_body") != "", 1).otherwise(0)
    for c in ("tasks", "requirements", "preferred", "skills"):
        signals = signals + F.when(F.size(lst(c)) > 0, 1).otherwise(0)
    found = compact(
        issue(q == "low", "low_quality", "high"),
        F.when(summ == "", it("summary_missing", "high")).when(F.length(summ) >= 56, it("summary_too_long", "low")),
        F.when(focus == "", it("focus_missing", "high")).when(is_in(focus, broad), it("focus_too_broad", "medium")).when(hires(focus), it("focus_hiring_echo", "high"))
        .when(echo(focus), it("focus_company_echo", "high")),
        F.when(summ == "", F.lit(None)).when(overlap_ratio(summ, F.col("title")) >= 0.8, it("summary_title_echo", "high")).when(hires(summ), it("summary_hiring_echo", "medium"))
        .when(echo(summ), it("summary_company_echo", "medium")),
        issue(F.size(F.filter(kw, noisy)) >= 2, "keyword_noise", "medium"), issue(signals <= 1, "source_thin", "low"))
    df = items.withColumn("_i", found)
    score = F.aggregate("_i", F.lit(0), lambda a, i: a + F.coalesce(F.try_element_at(lit_map(SEVERITY_WEIGHT), i["severity"]), F.lit(0)))
    df = df.withColumns({"review_codes": F.transform("_i", lambda i: i["code"]), "review_score": score.cast("bigint")}).drop("_i")
    return df.withColumn("review_priority", F.when(F.col("review_score") >= 100, "high").when(F.col("review_score") >= 45, "medium").otherwise("low"))


def review_wave(items: DataFrame, problems: int, controls: int) -> DataFrame:
    """Worst items first, then clean ones that were not already chosen."""
    p = (items.where(F.size("review_codes") > 0).orderBy(F.col("review_score").desc(), (s("quality") != "low"), "role_group", "company", "title", "id").limit(problems))
    c = (items.where(F.size("review_codes") == 0).join(p.select("id"), "id", "left_anti")
         .orderBy((s("quality") != "high"), ~F.coalesce("active", F.lit(False)), "role_group", "company", "title", "id").limit(controls))
    return p.withColumn("control_sample", F.lit(False)).unionByName(c.select(*items.columns).withColumn("control_sample", F.lit(True)))


def domain_bucket(text: Column, terms: Mapping[str, str]) -> Column:
    out = None
    for token, bucket in terms.items():
        cond = F.contains(text, F.lit(token))
        out = F.when(cond, F.lit(bucket)) if out is None else out.when(cond, F.lit(bucket))
    return out.otherwise("general") if out is not None else F.lit("general")


def gold_candidates(items: DataFrame, broad: Sequence[str] = tuple(EV.GOLD_BROAD_FOCUS), terms: Mapping[str, str] = EV.GOLD_DOMAIN_TERMS, per_domain: int = 6) -> DataFrame:
    """One row per id with the first reason that applies; at most six rows per domain, cut before ids are compared."""
    focus, kws = squeeze("focus_label"), non_blank(F.transform(lst("keywords"), squeeze))
    df = items.withColumns({"_f": focus, "_k": kws})
    text = F.array_join(F.concat(F.array(F.col("_f"), squeeze("summary")), "_k"), " ")
    tag = lambda reason, bucket: F.struct(F.lit(reason).alias("reason"), bucket.alias("bucket"))
    arr = compact(F.when(is_in(F.col("_f"), broad), tag("broad_focus", F.lit("broad_focus"))),
                  F.when((F.lower(squeeze("quality")) == "low") | (squeeze("summary") == ""), tag("low_or_empty", F.lit("low_or_empty"))),
                  F.when(domain_bucket(text, terms) != "general", tag("domain_specific", domain_bucket(text, terms))),
                  F.when((F.col("_f") != "") & ~F.array_contains("_k", F.col("_f")) & (F.size("_k") >= 3), tag("focus_keyword_conflict", F.lit("confusable"))))
    long = df.select("id", F.col("_f").alias("focus_label"), "company", "title", F.explode(arr).alias("t")).select("id", "focus_label", "company", "title", "t.reason", "t.bucket")
    domain = top_k(long.where("reason = 'domain_specific'"), ["bucket"], ["focus_label", "company", "title", "id"], per_domain).drop("rank")
    rank = F.when(F.col("reason") == "broad_focus", 0).when(F.col("reason") == "low_or_empty", 1).when(F.col("reason") == "domain_specific", 2).otherwise(3)
    return first_per(long.where("reason <> 'domain_specific'").unionByName(domain), ["id"], [rank]).select("id", "reason", "bucket")


def balanced_pick(rows: DataFrame, target: int, per_company: int = 2, role: str = "role_display") -> DataFrame:
    """Up to `target` rows in order: a row is passed over while its company or its role has its share; then a fill without shares.

    This is the sequential pick. A row that is passed over stays so, for full companies and roles stay full; so a round takes, of the
    rows whose role is open, each company's first ones up to its room, and from the start of those in order all up to the row that fills a
    role. Roles that fill up number at most target / share, hence few rounds; the driver holds the at most `target` picks.
    """
    density = rows.groupBy(squeeze("company").alias("_c")).agg(F.count(F.lit(1)).alias("density"))
    q = F.coalesce(F.try_element_at(lit_map({"low": 0, "medium": 1, "high": 2}), F.lower(squeeze("quality"))), F.lit(3))
    df = rows.select("id", squeeze("company").alias("_c"), squeeze(role).alias("_r"), q.alias("_q"), F.size(lst("keywords")).alias("_n"), squeeze("focus_label").alias("_f"), squeeze("title").alias("_t")).join(density, "_c")
    order = ["_q", "density", F.col("_n").desc(), "_f", "_t", "id"]
    share = max(4, target // 3)
    picked: list[Row] = []
    by_company, by_role = Counter(), Counter()
    while len(picked) < target:
        full = [r for r, n in by_role.items() if r and n >= share]
        open_rows = df.where(~is_in(F.col("_r"), full) & ~is_in(F.col("id"), [p["id"] for p in picked]))
        room = F.lit(per_company) - (F.coalesce(F.try_element_at(lit_map(dict(by_company)), F.col("_c")), F.lit(0)) if by_company else F.lit(0))
        near = top_k(open_rows, ["_c"], order, per_company, "company_rank").where(F.col("company_rank") <= room)
        found = near.orderBy(*order).limit(target - len(picked)).select("id", "_c", "_r").collect()
        filled = False
        for p in found:
            picked.append(p)
            by_company[p["_c"]] += 1
            by_role[p["_r"]] += 1
            if p["_r"] and by_role[p["_r"]] == share:
                filled = True
                break
        if not filled:
            break
    ids = [p["id"] for p in picked]
    first = df.where(is_in(F.col("id"), ids)).select("id", F.lit("balanced").alias("source"))
    fill = df.where(~is_in(F.col("id"), ids)).orderBy(*order).limit(target - len(picked)).select("id", F.lit("fill").alias("source"))
    return first.unionByName(fill)


def bucket_quota_pick(items: DataFrame, targets: Mapping[str, int], order: Sequence) -> DataFrame:
    """Quota per bucket with ids unique over buckets, then every remaining id once. One bounded step per bucket."""
    chosen = None
    for i, (bucket, quota) in enumerate(targets.items()):
        pool = items.where(F.col("bucket") == bucket)
        if chosen is not None:
            pool = pool.join(chosen.select("id"), "id", "left_anti")
        one = first_per(pool, ["id"], order)
        part = one.orderBy(*order).limit(quota).select("id", "bucket", F.lit("quota").alias("source"))
        chosen = part if chosen is None else chosen.unionByName(part)
    rest = items.join(chosen.select("id"), "id", "left_anti")
    return chosen.unionByName(first_per(rest, ["id"], ["bucket", "company", "title"]).select("id", "bucket", F.lit("rest").alias("source")))


BUCKET_RANK = {"missing_classifier_output": 0, "final_role_conflict": 1, "low_confidence": 2, "source_role_disagreement": 3}
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def role_remediation(rows: DataFrame) -> DataFrame:
    """Role conflicts worth a review, one per id. Needs raw_role, role_group, classifier_role, classifier_confidence, role_signals, company, title."""
    raw, fin, cls = squeeze("raw_role"), squeeze("role_group"), squeeze("classifier_role")
    conf = F.lower(squeeze("classifier_confidence"))
    sig = F.coalesce(at(non_blank(F.transform(lst("role_signals"), squeeze)), 1), F.lit(""))
    tag = lambda b, p: F.struct(F.lit(b).alias("bucket"), (p if isinstance(p, Column) else F.lit(p)).alias("priority"))
    conflict = (cls != "") & (cls != fin)
    agreed = (raw != "") & (sig != "") & (raw == sig) & (cls != raw)
    arr = compact(F.when(cls == "", tag("missing_classifier_output", "high")), F.when((cls != "") & (conf == "low"), tag("low_confidence", "high")),
                  F.when(conflict, tag("final_role_conflict", F.when(agreed, "critical").when(conf == "high", "high").otherwise("medium"))),
                  F.when((cls != "") & ~conflict & (raw != "") & (raw != cls) & (conf == "high"), tag("source_role_disagreement", "medium")))
    long = rows.select("id", "company", "title", F.explode(arr).alias("t")).select("id", "company", "title", "t.bucket", "t.priority")
    order = [F.try_element_at(lit_map(BUCKET_RANK), F.col("bucket")), F.try_element_at(lit_map(PRIORITY_RANK), F.col("priority"))]
    return first_per(long, ["id"], order)


def release_remediation(rows: DataFrame, core_failures: DataFrame, incremental_failures: DataFrame) -> DataFrame:
    """Long (id, bucket, company, title, active, quality): low board rows and gate failures that are on the board."""
    base = rows.select("id", "company", "title", F.coalesce("active", F.lit(False)).alias("active"), squeeze("quality").alias("quality"))
    low = base.where(F.lower("quality") == "low").withColumn("bucket", F.lit("board_low_quality"))
    part = lambda f, name: base.join(f.select("id").distinct(), "id", "left_semi").withColumn("bucket", F.lit(name))
    return low.unionByName(part(core_failures, "core_gate_failure")).unionByName(part(incremental_failures, "incremental_gate_failure"))


RELEASE_TARGETS = {"board_low_quality": 12, "core_gate_failure": 10, "incremental_gate_failure": 8}


def guard_recovery_candidates(rows: DataFrame) -> DataFrame:
    """Rows a model excluded and the decision included, best quality first."""
    hit = rows.where((F.lower(squeeze("o_action")) == "exclude") & (F.lower(squeeze("scope_action")) == "include"))
    rank = F.coalesce(F.try_element_at(lit_map({"high": 0, "medium": 1, "low": 2}), squeeze("quality")), F.lit(9))
    return hit.orderBy(rank, "company", "title", "id")
