"""Keyed comparisons: snapshot deltas, overlays, overrides, refresh targets, layers, runs, caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.rank import first_per, last_wins, one_per_key
from hiremill.functions.text import canon, empty_list, is_in, lit_map, lst, ordered_distinct, s, squeeze, strip
from hiremill.operators.prepare import SYNC_FIELDS, content_signature
from hiremill.operators.validate import removed_keys  # noqa: F401  (part of the comparison surface)


def signatures(df: DataFrame, cols: Sequence[str], out: str = "sig") -> DataFrame:
    """Last signature of each id. The hash is taken first, so that the ranking moves ids, ordinals and hashes only."""
    return last_wins(df.select("id", "ord", content_signature(df, cols).alias(out))).select("id", out)


def snapshot_delta(before: DataFrame, after: DataFrame, cols: Sequence[str] = tuple(SYNC_FIELDS)) -> DataFrame:
    """(id, change): only keys and hashes are shuffled, never the posting texts."""
    b, a = signatures(before, cols, "b"), signatures(after, cols, "a")
    change = (F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed")
              .when(F.col("a") != F.col("b"), "changed").otherwise("unchanged"))
    return b.join(a, "id", "full_outer").select("id", change.alias("change"))


def delta_counts(delta: DataFrame) -> DataFrame:
    return delta.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# Overlaid field -> column of the source table.
OVERLAY_FIELDS = {"role": "role", "focus": "focus", "keywords": "keywords", "summary": "summary", "company": "company",
                  "title": "title", "job_url": "job_url", "last_seen_at": "last_seen_at", "change_hash": "change_hash"}


def overlay_guard(source: DataFrame, deploy: DataFrame) -> DataFrame:
    """Keys missing on either side, as one row; the overlay is refused unless both are 0."""
    keys = lambda df, c: df.select(strip("id").alias("id")).where("id <> ''").distinct().withColumn(c, F.lit(1))
    j = keys(source, "s").join(keys(deploy, "d"), "id", "full_outer")
    return j.agg(F.coalesce(F.sum(F.when(F.col("s").isNull(), 1)), F.lit(0)).cast("bigint").alias("missing_from_source"),
                 F.coalesce(F.sum(F.when(F.col("d").isNull(), 1)), F.lit(0)).cast("bigint").alias("missing_from_deploy"))


def deploy_overlay(source: DataFrame, deploy: DataFrame, fields: Mapping[str, str] = OVERLAY_FIELDS,
                   strict: bool = True) -> DataFrame:
    """Source rows with filled, canonically different deploy values; `changed_fields` lists what changed."""
    d = last_wins(deploy).select(strip("id").alias("id"), *[F.col(c).alias(f"_d_{f}") for f, c in fields.items() if c in deploy.columns])
    use = {f: c for f, c in fields.items() if c in deploy.columns and c in source.columns}
    j = source.join(d, "id", "inner" if strict else "left")
    differs = {f: (strip(f"_d_{f}") != "") & (canon(strip(c)) != canon(strip(f"_d_{f}"))) for f, c in use.items()}
    changed = F.array_compact(F.array(*[F.when(cond, F.lit(f)) for f, cond in differs.items()]))
    out = j.withColumns({"changed_fields": changed,
                         **{c: F.when(differs[f], strip(f"_d_{f}")).otherwise(F.col(c)) for f, c in use.items()}})
    if strict:
        guard = overlay_guard(source, deploy)
        bad = guard.select((F.col("missing_from_source") + F.col("missing_from_deploy")).alias("x")).scalar()
        out = out.withColumn("id", F.when(bad == 0, F.col("id")).otherwise(
            F.raise_error(F.lit("overlay refused: source and deploy keys differ"))))
    return out.select(*source.columns, "changed_fields")


def overlay_counts(overlaid: DataFrame) -> DataFrame:
    return overlaid.select(F.explode(F.array_compact("changed_fields")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def override_applies(kind: str, roles: Sequence[str]) -> Column:
    """Is an override (columns prefixed `o_`) well-formed? Signature and domain are checked together."""
    unsigned = strip("o_signature") == ""
    fresh = unsigned | (strip("o_signature") == F.col("signature"))
    if kind == "scope":
        weak = F.lower(squeeze("o_source")).startswith("service_scope_model") & (F.lower(squeeze("o_confidence")) == "low")
        return fresh & F.lower(squeeze("o_action")).isin("include", "review", "exclude") & ~weak
    return fresh & is_in(squeeze("o_role"), roles)


def resolve_overrides(rows: DataFrame, overrides: DataFrame, kind: str, roles: Sequence[str] = ()) -> DataFrame:
    """Rows (with their current `signature`) and the override that counts for them; `o_*` is NULL otherwise."""
    cols = [c for c in overrides.columns if c not in ("id", "ord")]
    o = one_per_key(overrides).select("id", *[F.col(c).alias(f"o_{c}") for c in cols])
    j = rows.join(o, "id", "left").withColumn("_ok", F.coalesce(override_applies(kind, roles), F.lit(False)))
    return j.withColumns({f"o_{c}": F.when(F.col("_ok"), F.col(f"o_{c}")) for c in cols}).drop("_ok")


def stale_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides decided on a content that has changed since."""
    o = one_per_key(overrides).select("id", strip("signature").alias("stored_signature")).where("stored_signature <> ''")
    return rows.select("id", "signature").join(o, "id").where("stored_signature <> signature")


def summary_needs_refresh(stored: DataFrame) -> Column:
    return (squeeze("summarized_at") == "") | F.lower(squeeze("quality")).isin("", "low")


def incremental_targets(postings: DataFrame, delta: DataFrame, store: DataFrame, kind: str = "summary",
                        mode: str = "incremental", profile: str = "", limit: int | None = None) -> DataFrame:
    """Ids to refresh with their reason: added (by id), changed (by id), then refresh rows in source order.

    kind summary: the store holds summaries; modes incremental, missing (no usable record), stale (also another prompt profile), all.
    kind scope: the store holds overrides; modes incremental and stale (decided on another signature), missing (no override that is
    fresh), review (rows whose `scope_action` is review), all. kind role: the same without review; stale takes rows without a fresh
    override. Of several records of an id the last one counts.
    """
    modes = {"summary": ("incremental", "missing", "stale", "all"), "scope": ("incremental", "missing", "stale", "review", "all"), "role": ("incremental", "missing", "stale", "all")}
    if mode not in modes[kind]:
        raise ValueError(f"{kind} targets have no mode {mode}")
    p = last_wins(postings).select("id", "ord", *[c for c in ("signature", "last_seen_at", "scope_action") if c in postings.columns])
    st = one_per_key(store).select("id", *[F.col(c).alias(f"st_{c}") for c in store.columns if c not in ("id", "ord")], F.lit(True).alias("st_found"))
    j = p.join(st, "id", "left")
    found = F.coalesce("st_found", F.lit(False))
    if kind == "summary":
        weak = (squeeze("st_summarized_at") == "") | F.lower(squeeze("st_quality")).isin("", "low")
        need = ~found | weak
        if mode == "stale":
            need = need | (squeeze("st_profile") != profile)
        if mode == "all":
            need = F.lit(True)
    else:
        other = found & (strip("st_signature") != "") & (strip("st_signature") != F.col("signature"))
        need = {"incremental": other, "stale": other if kind == "scope" else ~found | other, "missing": ~found | other, "all": F.lit(True),
                "review": squeeze("scope_action") == "review" if kind == "scope" and mode == "review" else None}[mode]
    refresh = j.where(need).select("id", F.lit("refresh").alias("reason"), F.lit(2).alias("priority"), F.col("ord").alias("_o"))
    out = refresh
    if mode == "incremental":
        d = delta.where(F.col("change").isin("added", "changed")).select(
            "id", F.col("change").alias("reason"), F.when(F.col("change") == "added", 0).otherwise(1).alias("priority"),
            F.lit(0).cast("bigint").alias("_o"))
        out = first_per(d.unionByName(refresh), ["id"], ["priority"])
    out = out.withColumn("priority", F.col("priority").cast("bigint"))
    if limit is not None and "last_seen_at" in p.columns:
        out = (out.join(p.select("id", "last_seen_at"), "id", "left")
               .orderBy(F.col("last_seen_at").desc_nulls_last(), "priority", "_o", "id").limit(limit))
        return out.select("id", "reason", "priority", "last_seen_at")
    return out.orderBy("priority", "_o", "id").select("id", "reason", "priority")


def result_completeness(requested: DataFrame, returned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that came back without a result, and one row of processed / saved / missing counts."""
    want, got = requested.select("id").distinct(), returned.select("id").distinct()
    missing = want.join(got, "id", "left_anti")
    flags = want.join(got.withColumn("_got", F.lit(1)), "id", "left")
    counts = flags.agg(F.count(F.lit(1)).alias("processed"), F.count("_got").alias("saved"),
                       (F.count(F.lit(1)) - F.count("_got")).alias("missing"))
    return missing, counts


def layer_reconciliation(layers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows, distinct keys and keys the next layer lacks, for every layer of a pipeline.

    One aggregate over (layer, key) first: a key repeated a billion times is one row afterwards.
    """
    tagged = None
    for i, (name, df) in enumerate(layers):
        part = df.select(F.lit(i).alias("pos"), F.lit(name).alias("layer"), s("id").alias("id"))
        tagged = part if tagged is None else tagged.unionByName(part)
    per_key = tagged.groupBy("pos", "layer", "id").agg(F.count(F.lit(1)).alias("n"))
    nxt = per_key.where("id <> ''").select((F.col("pos") - 1).alias("pos"), "id", F.lit(1).alias("_next"))
    j = per_key.join(nxt, ["pos", "id"], "left")
    last = len(layers) - 1
    filled = F.col("id") != ""
    return j.groupBy("pos", "layer").agg(
        F.sum("n").alias("rows"), F.sum(F.when(filled, 1).otherwise(0)).cast("bigint").alias("distinct_keys"),
        F.sum(F.when(filled & F.col("_next").isNull() & (F.col("pos") < last), 1).otherwise(0)).cast("bigint").alias("absent_from_next")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def role_mismatches(rows: DataFrame, reviewed: str = "stage2_role", resolved: str = "role_group") -> DataFrame:
    return rows.where((s(reviewed) != "") & (s(resolved) != "") & (canon(reviewed) != canon(resolved)))


def compound_term_split_issues(rows: DataFrame, phrases: Sequence[Sequence[str]] = (("computer", "vision"),),
                               skills: str = "skills") -> DataFrame:
    """Rows whose skills hold all parts of a phrase but not the phrase; `split_phrases` lists which."""
    keys = F.transform(lst(skills), canon)
    hits = []
    for parts in phrases:
        whole = "".join(parts)
        cond = ~F.array_contains(keys, whole)
        for p in parts:
            cond = cond & F.array_contains(keys, p)
        hits.append(F.when(cond, F.lit(" ".join(parts))))
    return rows.withColumn("split_phrases", F.array_compact(F.array(*hits))).where(F.size("split_phrases") > 0)


QUALITY_RANK = {"low": 0, "medium": 1, "high": 2}


def quality_rank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(lit_map(QUALITY_RANK), F.lower(squeeze(c))), F.lit(-1))


def compare_runs(base: DataFrame, cand: DataFrame, quality: str = "quality") -> DataFrame:
    """Items in both runs with the direction their quality took."""
    b = base.select("id", F.col(quality).alias("base_quality"))
    c = cand.select("id", F.col(quality).alias("candidate_quality"))
    rb, rc = quality_rank("base_quality"), quality_rank("candidate_quality")
    outcome = F.when(rc > rb, "improved").when(rc < rb, "worsened").otherwise("unchanged")
    return b.join(c, "id").withColumns({"outcome": outcome, "low_to_non_low": (rb == 0) & (rc >= 1)})


def compare_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("low_to_non_low").cast("bigint")).alias("low_to_non_low"))


def clean_list(arr: str | Column, limit: int) -> Column:
    return ordered_distinct(F.transform(lst(arr), squeeze), limit)


SOURCE_LIMITS = {"tasks": 6, "requirements": 6, "preferred": 6, "skills": 8}


def source_struct(prefix: str = "") -> Column:
    return F.struct(squeeze(f"{prefix}detail_body").alias("detail_body"),
                    *[clean_list(f"{prefix}{c}", k).alias(c) for c, k in SOURCE_LIMITS.items()])


def merge_current(items: DataFrame, rows: DataFrame, postings: DataFrame, dataset: str) -> DataFrame:
    """Evaluation items refreshed from today's board row and posting; absent ones keep what they had.

    items: id, company, title, role_group, cluster_id, cluster_label, active, summary, focus_label, keywords, quality, source.
    """
    r = one_per_key(rows).select("id", F.struct(squeeze("summary").alias("summary"), squeeze("focus_label").alias("focus_label"),
                                   clean_list("keywords", 6).alias("keywords"), squeeze("quality").alias("quality")).alias("_row"))
    p = one_per_key(postings).select("id", source_struct().alias("_src"))
    j = items.join(r, "id", "left").join(p, "id", "left")
    own = F.struct(squeeze("summary").alias("summary"), squeeze("focus_label").alias("focus_label"),
                   clean_list("keywords", 6).alias("keywords"), squeeze("quality").alias("quality"))
    return j.select(
        F.lit(dataset).alias("source_dataset"), "id", *[squeeze(c).alias(c) for c in ("company", "title", "role_group", "cluster_id", "cluster_label")],
        F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("_row", own).alias("current"),
        (F.coalesce("_src", "source") if "source" in items.columns else F.col("_src")).alias("source"))


# Fall-back sentences; the pieces around the values are the wording of the result.
INSIGHT_BOTH = "%s는 현재 %s 축 채용이 강합니다. %s"
INSIGHT_SUMMARY = "%s 공고에서는 %s 흐름이 핵심으로 보입니다."
INSIGHT_NONE = "%s 공고의 핵심 신호를 아직 충분히 읽지 못했습니다."
THIS_COMPANY = "이 회사"


def insight_fallback() -> Column:
    company = F.when(s("company") == "", THIS_COMPANY).otherwise(F.col("company"))
    head, why, summ = squeeze("headline"), squeeze("reason"), squeeze("summary")
    return (F.when((head != "") & (why != ""), F.format_string(INSIGHT_BOTH, company, head, why)).when(why != "", why)
            .when(summ != "", F.format_string(INSIGHT_SUMMARY, company, summ)).otherwise(F.format_string(INSIGHT_NONE, company)))


def cached_or_related(rows: DataFrame, cache: DataFrame, board_ord: str = "ord") -> DataFrame:
    """Fresh entry, own stale entry, the first cached posting of the company, or a fall-back sentence.

    rows: id, company, signature, headline, reason, summary, ord. cache: id, signature, insight.
    """
    c = one_per_key(cache.where(squeeze("insight") != "")).select("id", F.col("signature").alias("_sig"), squeeze("insight").alias("_own"))
    # Cache entries meet their company on the (small) cached set; only one entry per company goes on.
    related = first_per(rows.select("id", "company", board_ord).join(c, "id").where(s("company") != ""), ["company"], [board_ord])
    related = related.select("company", F.col("_own").alias("_company"))
    j = rows.join(c, "id", "left").join(related, "company", "left")
    origin = (F.when(F.col("_own").isNotNull() & (F.col("_sig") == F.col("signature")), "fresh").when(F.col("_own").isNotNull(), "exact")
              .when(F.col("_company").isNotNull(), "company").otherwise("fallback"))
    return j.select("id", "company", origin.alias("origin"), F.coalesce("_own", "_company", insight_fallback()).alias("insight"))
