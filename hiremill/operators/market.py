"""Board aggregates: company profiles, tone legend, overview, market profile, samples, snapshots, audits, orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.rank import count_if, count_order, gathered, label_counts, melt, place, top_k
from hiremill.functions.terms import TERMS, TermRules, unique_non_generic
from hiremill.functions.text import (at, canon, compact, contains_any, distinct_by_canon, empty_list, epoch_seconds, is_in, let, lit_map, lst, non_blank, ordered_distinct,
                                     s, squeeze)
from hiremill.operators.aggregate import facet_rows, top_facets
from hiremill.operators.signals import CATEGORIES, flat
from hiremill.rules import board as BR
from hiremill.rules import briefing as R
from hiremill.rules import wording as WR

PROFILE_SIGNALS = ["problem", "domain", "system", "data", "workflow", "model"]
SAMPLE_LIMITS = {"role": 6, "focus": 5, "keyword": 8, "summary": 4}


def first_seen_lists(long: DataFrame, keys: Sequence[str], limits: Mapping[str, int]) -> DataFrame:
    """Bounded ordered-distinct lists per (keys, facet): first place of every label, then a bounded ranking."""
    firsts = long.groupBy(*keys, "facet", "label").agg(F.min(place()).alias("p"))
    best = top_k(firsts, [*keys, "facet"], ["p"], max(limits.values()))
    best = best.where(F.col("rank") <= F.try_element_at(lit_map(dict(limits)), F.col("facet")))
    packed = lambda f: F.array_sort(F.collect_list(F.when(F.col("facet") == f, F.struct("rank", "label"))))
    return best.groupBy(*keys).agg(*[F.transform(packed(f), lambda x: x["label"]).alias(f"{f}s") for f in limits])


def company_profiles(rows: DataFrame, t: TermRules = TERMS) -> DataFrame:
    """Per company: posting counts, first-seen samples, up to five keywords without echoes of the name, reason, headline."""
    named = rows.withColumn("company", F.when(s("company") == "", WR.UNKNOWN_COMPANY).otherwise(F.col("company")))
    usable = s("quality") != "low"
    counts = named.groupBy("company").agg(F.count(F.lit(1)).alias("postings"), count_if(F.col("active")).alias("active_postings"), count_if(usable).alias("usable_postings"))
    clean = lambda arr: non_blank(F.transform(arr, squeeze))
    long = facet_rows(named, ["company"], {
        "role": clean(F.array(s("role_group"))), "focus": clean(F.array(s("focus_label"))), "keyword": clean(F.concat(lst("keywords"), flat(PROFILE_SIGNALS))),
        "summary": F.when(usable, clean(F.array(s("summary")))).otherwise(empty_list())})
    j = counts.join(first_seen_lists(long, ["company"], SAMPLE_LIMITS), "company", "left")
    j = j.withColumns({f"{f}s": lst(f"{f}s") for f in SAMPLE_LIMITS})
    own = canon("company")
    pool = F.filter(unique_non_generic(F.concat("focuss", "keywords"), 8, t), lambda x: ~F.contains(own, canon(x)))
    j = j.withColumn("_kw", F.slice(pool, 1, 5))
    j = j.withColumn("_kw", F.when(F.size("_kw") > 0, F.col("_kw")).otherwise(unique_non_generic("roles", 3, t)))
    joined = lambda c, n: F.array_join(F.slice(c, 1, n), " · ")
    reason = (F.when(F.size("_kw") > 0, F.concat(joined("_kw", 3), F.lit(WR.REASON_KEYWORDS))).when(F.size("roles") > 0, F.concat(joined("roles", 2), F.lit(WR.REASON_ROLES)))
              .otherwise(WR.REASON_NONE))
    return j.select("company", "postings", "active_postings", "usable_postings", "roles", F.col("focuss").alias("focus_labels"), F.col("summarys").alias("summaries"),
                    F.col("_kw").alias("keywords"), reason.alias("reason"), F.coalesce(at(F.col("_kw"), 1), at(F.col("roles"), 1), F.lit(WR.HEADLINE_NONE)).alias("headline"))


TONES = list(zip(BR.TONE_ORDER, [tuple(BR.AI_TERMS), tuple(BR.DATA_TERMS), tuple(BR.DOMAIN_TERMS), tuple(BR.ANALYSIS_TERMS)]))
NO_TONE_TEXT = "이 색상군에 해당하는 공고 신호를 모아 보여줍니다."


def tone_of(text: Column, tones: Sequence[tuple] = tuple(TONES)) -> Column:
    """First tone one of whose words occurs in the text."""
    def pick(low: Column) -> Column:
        out = None
        for tone, words in tones:
            cond = contains_any(low, [w.lower() for w in words])
            out = F.when(cond, F.lit(tone)) if out is None else out.when(cond, F.lit(tone))
        return out

    return let(F.lower(squeeze(text)), pick)


def tone_legend(rows: DataFrame, stored: DataFrame | None = None, tones: Sequence[tuple] = tuple(TONES), k: int = 5) -> DataFrame:
    """Per tone: postings (once each), best keywords, samples, and the stored description where there is one."""
    tagged = F.filter(F.transform(lst("keywords"), lambda x: F.struct(tone_of(x, tones).alias("tone"), x.alias("label"))), lambda x: x["tone"].isNotNull())
    previews = lst("preview_lines") if "preview_lines" in rows.columns else empty_list()
    df = rows.select("id", "ord", s("role").alias("role"), s("summary").alias("summary"), previews.alias("previews"), tagged.alias("_t"))
    hit = F.array_distinct(F.transform("_t", lambda x: x["tone"]))
    text = F.concat_ws(" ", "role", "summary", F.array_join("previews", " "))
    df = df.withColumn("_tones", F.when(F.size("_t") > 0, hit).otherwise(F.array_compact(F.array(tone_of(text, tones)))))
    counts = df.select(F.explode(F.array_compact("_tones")).alias("tone")).groupBy("tone").agg(F.count(F.lit(1)).alias("n"))
    words = df.select(F.explode(F.array_compact("_t")).alias("t")).groupBy(F.col("t.tone").alias("tone"), F.col("t.label").alias("label")).agg(F.count(F.lit(1)).alias("c"))
    kws = gathered(top_k(words, ["tone"], [F.col("c").desc(), "label"], k), ["tone"], "keywords")
    lines = df.select(F.explode(F.array_compact("_tones")).alias("tone"), "ord", non_blank(F.transform(F.concat(F.array("summary"), "previews"), squeeze)).alias("l"))
    long = lines.select("tone", "ord", F.posexplode("l").alias("pos", "label")).withColumn("facet", F.lit("sample"))
    samples = first_seen_lists(long, ["tone"], {"sample": 3})
    base = rows.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(t).alias("tone")) for i, (t, _) in enumerate(tones, 1)])).alias("x")).select("x.*")
    j = base.join(counts, "tone", "left").join(kws, "tone", "left").join(samples, "tone", "left")
    kw = lst("keywords")
    text = F.when(F.size(kw) > 0, F.concat(F.array_join(F.slice(kw, 1, 3), ", "), F.lit(WR.TONE_TEXT))).otherwise(NO_TONE_TEXT)
    if stored is not None:
        j = j.join(stored.select("tone", F.col("description").alias("_d")), "tone", "left")
        text = F.coalesce(F.nullif(F.col("_d"), F.lit("")), text)
    return j.select("position", "tone", F.coalesce("n", F.lit(0)).alias("n"), kw.alias("keywords"), lst("samples").alias("samples"), text.alias("description"))


def board_overview(all_rows: DataFrame, clusters_n: Column | None = None, bundles_n: Column | None = None, bypass: bool = False) -> DataFrame:
    """One pass over all base rows. Needs scope_included, scope_action, active, summary, has_summary, quality, company, o_source, o_confidence."""
    inc = F.lit(True) if bypass else F.col("scope_included")
    model = F.coalesce(squeeze("o_source").startswith("service_scope_model"), F.lit(False))
    row = all_rows.agg(
        F.count(F.lit(1)).alias("source_jobs"), count_if(inc).alias("total_jobs"), count_if(inc & F.col("active")).alias("active_jobs"),
        count_if(inc & F.col("has_summary") & (F.lower(squeeze("quality")) != "low")).alias("summary_coverage"),
        count_if(inc & (squeeze("summary") != "")).alias("display_coverage"), F.countDistinct(F.when(inc, s("company"))).alias("company_count"),
        count_if(~inc).alias("filtered_out"), count_if(~inc & (F.col("scope_action") == "review")).alias("review_candidates"),
        count_if(model).alias("model_applied"), count_if(model & (F.lower(squeeze("o_confidence")) == "low")).alias("model_low_confidence"))
    row = row.withColumns({"inactive_jobs": F.col("total_jobs") - F.col("active_jobs"), "missing_summaries": F.col("total_jobs") - F.col("summary_coverage")})
    if clusters_n is not None:
        row = row.withColumn("cluster_count", clusters_n)
    if bundles_n is not None:
        row = row.withColumn("bundle_count", bundles_n)
    return row


@dataclass(frozen=True)
class ProfileRules:
    """Limits, widths and noise of the market profile."""

    limits: Mapping[str, int] = field(default_factory=lambda: {
        "focus": 10, "keyword": 14, "skill": 14, "company": 12, "task": 10, "requirement": 10, "preferred": 6, **{c: 8 for c in CATEGORIES}})
    widths: Mapping[str, int] = field(default_factory=lambda: {
        "focus": 36, "keyword": 44, "skill": 32, "company": 24, "task": 140, "requirement": 140, "preferred": 140, **{c: 44 for c in CATEGORIES}})
    headers: Sequence[str] = ("모집요강", "자격 요건", "우대 사항", "우대사항", "지원 자격", "지원자격", "필수 역량", "기본 요건", "직무내용", "별도 우대사항 미기재")
    snippets: Sequence[str] = ("채용절차법", "반환 청구", "반환 서류", "반환 청구 기간", "복지포인트", "건강검진", "생일 반차", "장기근속 휴가", "오피스 간식", "유급휴가",
                               "중소기업 청년", "서류 전형", "면접 전형", "처우협의", "최종합격", "혜택 및 복지", "복리후생", "재택근무", "유연출근", "간식 제공", "레퍼런스 체크")


PROFILE = ProfileRules()


def market_profile(rows: DataFrame, role: str = "role_group", active_only: bool = False, r: ProfileRules = PROFILE) -> DataFrame:
    """Most frequent labels and lines of every role at once (role, facet, rank, label, n).

    Values are cut to their width before they are counted, so equal openings count together.
    """
    df = rows.where("active") if active_only else rows
    noise = lambda x: is_in(x, r.headers) | (F.length(x) <= 3) | contains_any(F.lower(x), [y.lower() for y in r.snippets]) | x.startswith("*") | x.startswith("•")
    cut = lambda name, arr: F.transform(non_blank(F.transform(arr, squeeze)), lambda x: F.substring(x, 1, r.widths[name]))
    lines = lambda name, c: F.transform(F.filter(non_blank(F.transform(lst(c), squeeze)), lambda x: ~noise(x)), lambda x: F.substring(x, 1, r.widths[name]))
    have = set(rows.columns)
    facets = {"focus": cut("focus", F.array(s("focus_label"))), "keyword": cut("keyword", lst("keywords")), "skill": cut("skill", lst("skills")),
              "company": non_blank(F.array(squeeze("company"))), "task": lines("task", "tasks"), "requirement": lines("requirement", "requirements"), "preferred": lines("preferred", "preferred"),
              **{c: cut(c, lst(f"{c}_signals")) for c in CATEGORIES if f"{c}_signals" in have}}
    df = df.withColumn("_role", squeeze(role)).where("_role not in ('', '전체', '기타')")
    top = top_facets(facet_rows(df, ["_role"], facets), ["_role"], r.limits)
    return top.select(F.col("_role").alias("role"), "facet", F.col("rank").cast("bigint").alias("rank"), "label", "n")


def market_totals(rows: DataFrame, role: str = "role_group") -> DataFrame:
    per = rows.withColumn("_role", squeeze(role)).groupBy("_role", squeeze("company").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.col("_role").alias("role")).agg(F.sum("n").alias("analyzed_jobs"), count_if(F.col("c") != "").alias("company_count"))


def signal_density() -> Column:
    total = F.size(lst("keywords")) + F.size(lst("skills"))
    for c in CATEGORIES:
        total = total + F.size(lst(f"{c}_signals"))
    return total + F.when(squeeze("summary") != "", 4).otherwise(0) + F.when(squeeze("focus_label") != "", 2).otherwise(0)


def representative_postings(rows: DataFrame, k: int = 4, role: str = "role_group") -> DataFrame:
    """The k densest usable postings of every role."""
    d = rows.select("id", squeeze(role).alias("role"), s("company").alias("company"), s("title").alias("title"), (F.lower(s("quality")) == "low").alias("low"), signal_density().cast("bigint").alias("density"))
    return top_k(d, ["role"], ["low", F.col("density").desc(), "company", "title", "id"], k)


SNAPSHOT_BROAD = ["LLM", "파이프라인", "파이썬", "PyTorch", "TensorFlow", "SQL", "도커", "쿠버네티스", "사업 개발", "소프트웨어 개발", "인프라 엔지니어", "컴퓨터 비전",
                  "클라우드", "의료", "의료 데이터", "마케팅", "데이터 분석", "인사이트"]
SNAPSHOT_ACCEPTED = ["컴퓨터 비전", "클라우드", "데이터 분석", "의료", "의료 데이터", "마케팅"]


def label_snapshot(items: DataFrame, board: DataFrame, broad: Sequence[str] = tuple(SNAPSHOT_BROAD), accepted: Sequence[str] = tuple(SNAPSHOT_ACCEPTED)) -> DataFrame:
    """Presence, low and broad-focus counters of stored labels and board rows, long (metric, value)."""
    f = squeeze("focus_label")
    b, a = is_in(f, broad), is_in(f, accepted)
    low = F.lower(squeeze("quality")) == "low"
    raw = items.agg(F.count(F.lit(1)).alias("jobs"), count_if(squeeze("summary") != "").alias("summary_present"), count_if(f != "").alias("focus_present"), count_if(low).alias("low"),
                    count_if(b).alias("broad_raw"), count_if(b & a).alias("accepted_broad_raw"), count_if(b & ~a).alias("bad_broad_raw"))
    brd = board.agg(count_if(b).alias("broad_board"), count_if(b & a).alias("accepted_broad_board"), count_if(b & ~a).alias("bad_broad_board"), count_if(low & (f == "")).alias("low_blank_focus"))
    return melt(raw, [], raw.columns, cast="bigint").unionByName(melt(brd, [], brd.columns, cast="bigint"))


def top_focus(items: DataFrame, k: int = 15) -> DataFrame:
    long = items.select("ord", F.lit(0).alias("pos"), squeeze("focus_label").alias("label"), F.lit(1).alias("one")).where("label <> ''")
    return top_k(label_counts(long, ["one"]), ["one"], count_order(), k).select(F.col("rank").cast("bigint").alias("rank"), "label", "n")


def decision_report_metrics(items: DataFrame, board: DataFrame, reviews: DataFrame, gate_passed: bool, models_seen: int = 0, broad: Sequence[str] = tuple(SNAPSHOT_BROAD),
                            accepted: Sequence[str] = tuple(SNAPSHOT_ACCEPTED), need_core: int = 30, need_incremental: int = 10) -> tuple[DataFrame, DataFrame]:
    """(metrics, blockers) of the model decision. reviews: dataset (core|incremental), reviewed (bool), overall_pass (nullable bool)."""
    snap = label_snapshot(items, board, broad, accepted)
    ds = lambda d: F.col("dataset") == d
    rv = reviews.agg(*[count_if(ds(d) & F.col("reviewed")).alias(f"{d}_reviewed") for d in ("core", "incremental")],
                     *[count_if(ds(d) & F.col("overall_pass")).alias(f"{d}_passed") for d in ("core", "incremental")],
                     *[count_if(ds(d) & F.col("overall_pass").isNotNull()).alias(f"{d}_judged") for d in ("core", "incremental")])
    metrics = snap.unionByName(melt(rv, [], rv.columns, cast="bigint"))
    checks = rv.select(F.array(
        F.struct(F.lit("core_reviewed").alias("name"), (F.col("core_reviewed") >= need_core).alias("passed")),
        F.struct(F.lit("incremental_reviewed").alias("name"), (F.col("incremental_reviewed") >= need_incremental).alias("passed")),
        F.struct(F.lit("suite_gate").alias("name"), F.lit(bool(gate_passed)).alias("passed")),
        F.struct(F.lit("models_compared").alias("name"), F.lit(models_seen >= 2).alias("passed"))).alias("c"))
    return metrics, checks.select(F.explode("c").alias("x")).select("x.name", "x.passed").where("not passed")


def scope_audit(rows: DataFrame) -> DataFrame:
    """Counts (kind, key, n) by action, quality of excluded rows and primary reason."""
    primary = F.coalesce(F.get("scope_reasons", 0)["label"], F.lit("none"))
    tags = F.concat(F.array(F.struct(F.lit("action").alias("kind"), F.col("scope_action").alias("key"))),
                    F.when(~F.col("scope_included"), F.array(F.struct(F.lit("quality").alias("kind"), s("quality").alias("key")), F.struct(F.lit("reason").alias("kind"), primary.alias("key"))))
                    .otherwise(F.expr("cast(array() as array<struct<kind:string,key:string>>)")))
    return rows.select(F.explode(tags).alias("t")).groupBy("t.kind", "t.key").agg(F.count(F.lit(1)).alias("n"))


def order_keys(role: str = "role_group", roles: Sequence[str] = tuple(R.ROLE_ORDER)) -> list[Column]:
    rank = F.lit(len(roles))
    for i, x in reversed(list(enumerate(roles))):
        rank = F.when(F.col(role) == x, i).otherwise(rank)
    seen = epoch_seconds("last_seen_at")
    return [(~F.col("active")).cast("int"), rank, F.when(rank == len(roles), s(role)).otherwise(""), -seen, F.lower(squeeze("company")), F.lower(squeeze("title")), F.col("id")]


def base_order(rows: DataFrame, role: str = "role_group", roles: Sequence[str] = tuple(R.ROLE_ORDER)) -> DataFrame:
    """Active first, then role rank, newest sighting, company, title: a range-partitioned sort."""
    return rows.orderBy(*order_keys(role, roles))


def cluster_drawer(rows: DataFrame, cluster: str) -> DataFrame:
    return rows.where(F.col("cluster_id") == cluster).orderBy(F.col("active").desc(), "company", "id")


def distribution(items: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts by several single columns at once (column, value, n): one unpivot, one aggregate."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), s(c).alias("value")) for c in cols])
    return items.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def current_rows(rows: DataFrame, role: str | None = None, active_only: bool = False, column: str = "role_group") -> DataFrame:
    out = rows.where(F.col(column) == role) if role else rows
    return out.where("active") if active_only else out
