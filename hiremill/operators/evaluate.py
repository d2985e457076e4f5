"""Scores against gold tables, output metrics, anomaly families, target scores and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.rank import count_if, first_per, melt, ratio, top_k
from hiremill.functions.terms import TERMS, TermRules, canonical_term, generic_keyword
from hiremill.functions.text import at, canon, compact, is_in, let, lit_list, lit_map, lst, matches, non_blank, ordered_distinct, overlaps, s, squeeze
from hiremill.operators.signals import canon_py
from hiremill.rules import evaluation as EV
from hiremill.rules import wording as WR


def set_f1(expected: Column, predicted: Column) -> Column:
    """F1 of two label sets: 1 when both are empty, 0 when one is."""
    def score(p: Column) -> Column:
        e, q = F.size(p["e"]), F.size(p["p"])
        hit = F.size(F.array_intersect(p["e"], p["p"]))
        return F.when((e == 0) & (q == 0), 1.0).when((e == 0) | (q == 0) | (hit == 0), 0.0).otherwise(2.0 * hit / (e + q))

    return let(F.struct(ordered_distinct(expected).alias("e"), ordered_distinct(predicted).alias("p")), score)


def set_hit(expected: Column, predicted: Column) -> Column:
    e, p = F.size(expected) == 0, F.size(predicted) == 0
    return F.when(e & p, True).when(e | p, False).otherwise(F.arrays_overlap(expected, predicted))


def score_signal_items(items: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Per category exact, hit and F1 means, plus the strict rate under category '*'. Columns e_<c> and p_<c>."""
    clean = lambda c: ordered_distinct(F.transform(lst(c), squeeze))
    parts = [F.struct(F.lit(c).alias("category"), (clean(f"e_{c}") == clean(f"p_{c}")).alias("exact"), set_hit(clean(f"e_{c}"), clean(f"p_{c}")).alias("hit"),
                      set_f1(clean(f"e_{c}"), clean(f"p_{c}")).alias("f1"), (F.size(clean(f"e_{c}")) > 0).alias("filled")) for c in categories]
    df = items.select(F.array(*parts).alias("a"))
    strict = F.forall("a", lambda x: x["exact"])
    both = F.concat("a", F.array(F.struct(F.lit("*").alias("category"), strict.alias("exact"), strict.alias("hit"), F.when(strict, 1.0).otherwise(0.0).alias("f1"), strict.alias("filled"))))
    long = df.select(F.explode(both).alias("x")).select("x.*")
    mean = lambda c: F.bround(F.avg(F.col(c).cast("double")), 4)
    return long.groupBy("category").agg(F.count(F.lit(1)).alias("n"), mean("exact").alias("exact_rate"), mean("hit").alias("hit_rate"), F.bround(F.avg("f1"), 4).alias("avg_f1"), count_if(F.col("filled")).alias("filled"))


def judged(gold: DataFrame, pred: DataFrame, t: TermRules = TERMS) -> DataFrame:
    """Gold items (id, summary, focus_label, keywords, quality, company) against predictions with match flags and F1."""
    p = pred.select("id", *[F.col(c).alias(f"r_{c}") for c in ("summary", "focus_label", "keywords", "quality")])
    j = gold.join(p, "id", "left")
    low = lambda c: F.when(F.lower(squeeze(c)) == "", "low").otherwise(F.lower(squeeze(c)))
    terms = lambda c: F.transform(lst(c), lambda x: canonical_term(x, t))
    return j.withColumns({
        "summary_match": squeeze("summary") == squeeze("r_summary"), "focus_match": squeeze("focus_label") == squeeze("r_focus_label"), "quality_match": low("quality") == low("r_quality"),
        "target_low": low("quality") == "low", "result_low": low("r_quality") == "low", "f1": set_f1(terms("keywords"), terms("r_keywords")),
        "summary_gap": (squeeze("summary") == "") != (squeeze("r_summary") == ""), "focus_gap": (squeeze("focus_label") == "") != (squeeze("r_focus_label") == "")})


def strict_pass() -> Column:
    return F.col("summary_match") & F.col("focus_match") & F.col("quality_match") & (F.col("f1") >= 0.8)


def gold_metrics(j: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    rate = lambda c: ratio(count_if(c), n)
    return j.groupBy(*keys).agg(
        n.alias("requested_items"), rate(F.col("summary_match")).alias("summary_exact_rate"), rate(F.col("focus_match")).alias("focus_exact_rate"), rate(F.col("quality_match")).alias("quality_exact_rate"),
        ratio(count_if(F.col("target_low") & F.col("result_low")), count_if(F.col("target_low"))).alias("low_match_rate"), F.bround(F.avg("f1"), 4).alias("avg_keyword_f1"),
        rate(strict_pass()).alias("strict_pass_rate"), rate(F.col("summary_gap")).alias("summary_empty_mismatch_rate"), rate(F.col("focus_gap")).alias("focus_empty_mismatch_rate"))


def gold_failures(j: DataFrame, k: int = 10) -> DataFrame:
    return j.where(~strict_pass()).orderBy("summary_match", "focus_match", "quality_match", F.bround("f1", 3), "company", "id").limit(k)


def metric_diff(metrics: DataFrame, baseline: str, run: str = "run") -> DataFrame:
    """Long metrics (run, [dataset], metric, value): every other run minus the baseline."""
    keys = [c for c in ("dataset", "metric") if c in metrics.columns]
    b = metrics.where(F.col(run) == baseline).select(*keys, F.col("value").alias("base"))
    return metrics.where(F.col(run) != baseline).join(b, keys).select(run, *keys, F.bround(F.col("value") - F.col("base"), 4).alias("diff"))


def sentence_like(x: Column, endings: Sequence[str] = tuple(EV.SENTENCE_ENDINGS)) -> Column:
    end = F.lit(False)
    for e in endings:
        end = end | x.endswith(e)
    return (x != "") & ((F.length(x) >= 28) | end | (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 4) | x.rlike("[,.:;()]"))


def banned_term(x: Column, patterns: Sequence[str] = tuple(EV.KEYWORD_BANNED_PATTERNS), t: TermRules = TERMS) -> Column:
    return (x != "") & (generic_keyword(x, t) | matches(x, patterns, False))


def with_output_flags(requested: DataFrame, results: DataFrame, patterns: Sequence[str] = tuple(EV.KEYWORD_BANNED_PATTERNS), t: TermRules = TERMS,
                      endings: Sequence[str] = tuple(EV.SENTENCE_ENDINGS)) -> DataFrame:
    """Requested ids with their result (if any) and per-item keyword flags; keywords stay inside the row."""
    r = results.select("id", squeeze("summary").alias("summary"), squeeze("focus_label").alias("focus_label"), ordered_distinct(F.transform(lst("keywords"), squeeze), 6).alias("keywords"),
                       F.when(F.lower(squeeze("quality")) == "", "low").otherwise(F.lower(squeeze("quality"))).alias("quality"), F.lit(True).alias("returned"))
    j = requested.select("id", *[c for c in ("company", "title") if c in requested.columns]).join(r, "id", "left").withColumn("returned", F.coalesce("returned", F.lit(False)))
    return j.withColumns({"banned": F.filter(lst("keywords"), lambda x: banned_term(x, patterns, t)), "sentences": F.filter(lst("keywords"), lambda x: sentence_like(x, endings)),
                          "focus_banned": banned_term(s("focus_label"), patterns, t)})


def output_metrics(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ret = F.col("returned")
    n, got = F.count(F.lit(1)), count_if(ret)
    size = lambda c: F.coalesce(F.sum(F.when(ret, F.size(lst(c)))), F.lit(0))
    kw = size("keywords")
    chars = F.coalesce(F.sum(F.aggregate(lst("keywords"), F.lit(0), lambda a, x: a + F.length(x))), F.lit(0))
    long_kw = F.coalesce(F.sum(F.size(F.filter(lst("keywords"), lambda x: F.length(x) >= 18))), F.lit(0))
    usable = ret & (F.col("summary") != "") & (F.col("focus_label") != "") & (F.size(lst("keywords")) >= 2) & (F.col("quality") != "low")
    return flagged.groupBy(*keys).agg(
        n.alias("requested_items"), got.alias("returned_items"), ratio(got, n).alias("coverage_rate"), ratio(count_if(ret & (F.col("summary") == "")), got).alias("empty_summary_rate"),
        ratio(count_if(ret & (F.col("focus_label") == "")), got).alias("empty_focus_rate"), ratio(count_if(ret & (F.col("quality") == "low")), got).alias("low_rate"),
        ratio(count_if(usable), got).alias("usable_rate"), ratio(kw, got, 2).alias("keywords_per_item"), ratio(chars, kw, 2).alias("avg_keyword_length"), ratio(size("banned"), kw).alias("banned_rate"),
        ratio(count_if(ret & F.col("focus_banned")), got).alias("focus_banned_rate"), ratio(size("sentences"), kw).alias("sentence_rate"), ratio(long_kw, kw).alias("long_rate"))


def suspicious_terms(flagged: DataFrame, k: int = 12) -> DataFrame:
    terms = F.concat(F.when(F.col("focus_banned"), F.array("focus_label")).otherwise(F.array().cast("array<string>")), "banned", "sentences")
    n = flagged.where("returned").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return top_k(n, ["_one"], [F.col("n").desc(), "term"], k).select(F.col("rank").cast("bigint").alias("rank"), "term", "n")


def failure_examples(flagged: DataFrame, k: int = 8) -> DataFrame:
    reasons = compact(F.when(F.col("quality") == "low", F.lit("quality=low")), F.when(F.col("summary") == "", F.lit("empty_summary")), F.when(F.col("focus_label") == "", F.lit("empty_focus_label")),
                      F.when(F.size("banned") > 0, F.lit("banned_keyword")), F.when(F.size("sentences") > 0, F.lit("sentence_like_keyword")))
    df = flagged.where("returned").withColumn("reasons", reasons).where(F.size("reasons") > 0)
    no = lambda r: ~F.array_contains("reasons", r)
    return df.orderBy(no("banned_keyword"), no("sentence_like_keyword"), no("quality=low"), "company", "title", "id").limit(k)


# Fixed values: (dataset, metric, direction) of the suite gate and the release gate; weights of the release score.
SUITE_CHECKS = [("usable_rate", "min"), ("low_rate", "max"), ("banned_rate", "max"), ("empty_focus_rate", "max")]
RELEASE_CHECKS = [("core", "strict_pass_rate", "min"), ("core", "focus_exact_rate", "min"), ("core", "avg_keyword_f1", "min"), ("core", "low_match_rate", "min"),
                  ("incremental", "usable_rate", "min"), ("incremental", "low_rate", "max"), ("incremental", "banned_rate", "max"), ("incremental", "empty_focus_rate", "max")]
RELEASE_WEIGHTS = {("core", "strict_pass_rate"): 5.0, ("core", "focus_exact_rate"): 3.0, ("core", "avg_keyword_f1"): 2.5, ("core", "low_match_rate"): 1.5, ("incremental", "usable_rate"): 2.0,
                   ("incremental", "low_rate"): -1.5, ("incremental", "banned_rate"): -2.0, ("incremental", "empty_focus_rate"): -1.0}


def non_regression_gate(metrics: DataFrame, baseline: str, checks: Sequence[tuple] = tuple(RELEASE_CHECKS)) -> DataFrame:
    """Long metrics (run, dataset, metric, value): per candidate run, the checks failed and whether it passes.

    A check is (dataset, metric, direction), or (metric, direction) for every dataset.
    """
    cond = F.lit(None).cast("string")
    for c in checks:
        name, direction = c[-2], c[-1]
        hit = (F.col("metric") == name) & ((F.col("dataset") == c[0]) if len(c) == 3 else F.lit(True))
        cond = F.when(hit, direction).otherwise(cond)
    m = metrics.withColumn("direction", cond).where("direction IS NOT NULL")
    b = m.where(F.col("run") == baseline).select("dataset", "metric", F.col("value").alias("base"))
    j = m.where(F.col("run") != baseline).join(b, ["dataset", "metric"])
    ok = F.when(F.col("direction") == "min", F.col("value") >= F.col("base")).otherwise(F.col("value") <= F.col("base"))
    return j.withColumn("ok", ok).groupBy("run").agg(F.bool_and("ok").alias("passed"), count_if(~F.col("ok")).alias("failed_checks"))


def champion(metrics: DataFrame, gate: DataFrame, baseline: str, weights: Mapping[tuple, float] = RELEASE_WEIGHTS) -> DataFrame:
    """Best passing run by linear score; the baseline when none passes."""
    w = F.lit(0.0)
    for (dataset, metric), weight in weights.items():
        w = F.when((F.col("dataset") == dataset) & (F.col("metric") == metric), F.lit(weight)).otherwise(w)
    score = metrics.groupBy("run").agg(F.round(F.sum(F.col("value") * w), 6).alias("score"), F.max(F.when(F.col("metric") == "strict_pass_rate", F.col("value"))).alias("strict"),
                                       F.max(F.when(F.col("metric") == "usable_rate", F.col("value"))).alias("usable"))
    passed = gate.where("passed").select("run", F.lit(True).alias("gate_passed"))
    any_passed = gate.agg(F.coalesce(F.bool_or("passed"), F.lit(False))).scalar()
    pool = score.join(passed, "run", "left").withColumn("gate_passed", F.coalesce("gate_passed", F.lit(False))).where(F.col("gate_passed") | (~any_passed & (F.col("run") == baseline)))
    best = top_k(pool.withColumn("_one", F.lit(1)), ["_one"], [F.col("score").desc(), F.col("strict").desc(), F.col("usable").desc(), "run"], 1)
    return best.select("run", "score", "gate_passed", (~F.col("gate_passed")).alias("used_fallback_baseline"))


def role_accuracy(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Resolved and raw role accuracy on gold items. rows: id, role_group, raw_role. gold: id, expected."""
    j = rows.join(gold.select("id", "expected"), "id")
    ok, raw = F.col("role_group") == F.col("expected"), F.col("raw_role") == F.col("expected")
    n = F.count(F.lit(1))
    return j.agg(n.alias("n"), ratio(count_if(ok), n).alias("resolved_accuracy"), ratio(count_if(raw), n).alias("raw_accuracy"), count_if(ok & ~raw).alias("improved"), count_if(~ok).alias("mismatches"))


DECISIONS = ["include", "review", "exclude"]


def scope_benchmark(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Long metrics of scope predictions. gold: id, expected, quality. pred: id, decision."""
    norm = lambda c: F.when(is_in(F.lower(squeeze(c)), DECISIONS), F.lower(squeeze(c))).otherwise("")
    j = gold.select("id", norm("expected").alias("e"), squeeze("quality").alias("quality")).join(pred.select("id", norm("decision").alias("a")), "id", "left").withColumn("a", F.coalesce("a", F.lit("")))
    valid, inc = F.col("a") != "", F.col("e").isin("include", "review")
    false = inc & (F.col("a") == "exclude")
    n = F.count(F.lit(1))
    m = j.agg(n.alias("evaluated"), ratio(count_if(valid), n).alias("schema_valid_rate"), ratio(count_if((F.col("e") != "") & (F.col("e") == F.col("a"))), n).alias("exact_accuracy"),
              ratio(count_if(inc & ~false), count_if(inc)).alias("include_or_review_recall"), ratio(count_if(F.col("a") == "review"), count_if(valid)).alias("review_usage_rate"),
              count_if(false).alias("false_excludes"), count_if(false & (F.col("quality") == "high")).alias("high_quality_false_excludes"), count_if(~valid).alias("missing_predictions"))
    return melt(m, [], m.columns)


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    j = gold.select("id", "expected").join(pred.select("id", "decision"), "id", "left")
    return j.groupBy("expected", F.coalesce("decision", F.lit("missing")).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def anomaly_families(rows: DataFrame, analyst: Sequence[str] = (WR.ROLE_NAMES[3],), engineers: Sequence[str] = tuple(WR.ROLE_NAMES[:2]), deeptech: Sequence[str] = tuple(EV.FAMILY_DEEPTECH),
                     business: Sequence[str] = tuple(EV.FAMILY_BUSINESS), dominance: Sequence[str] = tuple(EV.FAMILY_BUSINESS_DOMINANCE), tools: Sequence[str] = tuple(EV.TOOL_FOCUS_LABELS),
                     broad: Sequence[str] = tuple(EV.FAMILY_BROAD_FOCUS), block: Sequence[str] = tuple(EV.SPECIFICITY_BLOCKLIST)) -> DataFrame:
    """Long (id, family) of display rows that break an expectation."""
    have = set(rows.columns)
    arr = lambda c: lst(c) if c in have else F.array().cast("array<string>")
    text = F.lower(F.concat_ws(" ", squeeze("company"), squeeze("title"), squeeze("summary"), squeeze("focus_label"), F.array_join(arr("keywords"), " "),
                               *[F.array_join(arr(f"{c}_signals"), " ") for c in ("domain", "problem", "system", "model", "data", "workflow", "role")]))
    lead = F.concat_ws(" ", squeeze("focus_label"), F.coalesce(at(arr("keywords"), 1), F.lit("")))
    role, focus = squeeze("role_group"), canon("focus_label")
    blocked = [canon_py(b) for b in block]
    good = lambda c: F.filter(F.transform(arr(c), squeeze), lambda x: (canon(x) != "") & ~is_in(canon(x), blocked))
    first = F.coalesce(at(good("problem_signals"), 1), F.when(~F.array_contains(arr("confidence_notes"), "missing_domain_problem_signal"), at(good("domain_signals"), 1)), F.lit(""))
    is_a, is_e = is_in(role, analyst), is_in(role, engineers)
    df = rows.withColumns({"_t": text, "_l": lead})
    fam = compact(
        F.when(~F.coalesce("scope_included", F.lit(True)), F.lit("excluded_leaked_into_display")), F.when(is_a & matches(F.col("_l"), deeptech, False), F.lit("deeptech_in_data_analyst")),
        F.when(is_a & matches(F.col("_t"), deeptech, False), F.lit("deeptech_context_present")), F.when(is_e & matches(F.col("_l"), dominance, False), F.lit("business_in_engineer_family")),
        F.when(is_e & matches(F.col("_t"), business, False), F.lit("business_context_present")), F.when(is_in(focus, {canon_py(t) for t in tools}), F.lit("tool_first_focus")),
        F.when(F.lower(squeeze("scope_action")) == "review", F.lit("service_scope_review_in_display")),
        F.when(is_in(focus, {canon_py(b) for b in broad}) & (first != "") & (canon(first) != focus), F.lit("broad_focus_specificity_gap")))
    return df.select("id", "ord", "company", "title", F.explode(fam).alias("family"))


def family_report(families: DataFrame, severity: Mapping[str, str] = EV.FAMILY_SEVERITY) -> DataFrame:
    n = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("severity", F.coalesce(F.try_element_at(lit_map(dict(severity)), F.col("family")), F.lit("info")))


def family_examples(families: DataFrame, k: int = 12) -> DataFrame:
    return top_k(families, ["family"], ["ord"], k)


def family_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts per family before and after candidate results."""
    both = before.select("family", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("family", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupBy("family").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def adjacent_scope_risk(text: Column, role: Column, quality: Column, ai: Sequence[str] = tuple(EV.AI_ADJACENT), data: Sequence[str] = tuple(EV.DATA_ADJACENT),
                        non_scope: Sequence[str] = tuple(EV.ADJACENT_NON_SCOPE), data_roles: Sequence[str] = tuple(WR.ROLE_NAMES[2:])) -> Column:
    """A confidently described row that is excluded although it looks like the board's own work."""
    return (F.lower(quality).isin("high", "medium") & ~matches(text, non_scope, False)
            & (matches(text, ai, False) | (is_in(role, data_roles) & matches(text, data, False))))


def quality_flags(rows: DataFrame, leak_terms: Sequence[str] = (), **risk) -> DataFrame:
    """One flag column per quality metric over all decided rows (display and excluded alike)."""
    have = set(rows.columns)
    col_ = lambda c: squeeze(c) if c in have else F.lit("")
    arr = lambda c: lst(c) if c in have else F.array().cast("array<string>")
    shown, hard = F.col("scope_included"), ~F.col("scope_included") & (F.col("scope_action") != "review")
    low = F.lower(squeeze("quality")) == "low"
    confirmed = F.coalesce("confirmed_exclude", F.lit(False)) if "confirmed_exclude" in have else F.lit(False)
    cls, conf = col_("classifier_role"), F.lower(col_("classifier_confidence"))
    text = F.lower(F.concat_ws(" ", squeeze("title"), squeeze("focus_label"), F.array_join(arr("keywords"), " "), col_("o_reason")))
    leaks = [canon_py(t) for t in leak_terms]
    every = F.flatten(F.array(*[arr(f"{c}_signals") for c in ("domain", "problem", "system", "model", "data", "workflow")]))
    leaked = F.exists(every, lambda x: is_in(canon(x), leaks)) if leaks else F.lit(False)
    display_leak = F.exists(F.concat(arr("keywords"), F.array(s("focus_label"))), lambda x: is_in(canon(x), leaks)) if leaks else F.lit(False)
    guard = shown & (F.lower(col_("o_action")) == "exclude")
    stale = F.coalesce("role_stale", F.lit(False)) if "role_stale" in have else F.lit(False)
    return rows.withColumns({
        "m_board_rows": shown, "m_low_rows": shown & low, "m_missing_summary_rows": shown & (squeeze("summary") == ""), "m_signal_leak_rows": shown & leaked, "m_display_leak_rows": shown & display_leak,
        "m_role_conflict_rows": shown & (cls != "") & (cls != squeeze("role_group")), "m_role_low_conflict_rows": shown & (cls != "") & (cls != squeeze("role_group")) & (conf == "low"),
        "m_role_missing_rows": shown & (cls == ""), "m_role_stale_rows": shown & stale, "m_excluded_rows": ~shown, "m_review_rows": F.col("scope_action") == "review",
        "m_excluded_high_rows": hard & ~confirmed & (F.lower(squeeze("quality")) == "high"), "m_excluded_medium_or_high_rows": hard & ~confirmed & F.lower(squeeze("quality")).isin("high", "medium"),
        "m_excluded_adjacent_rows": hard & ~confirmed & adjacent_scope_risk(text, squeeze("role_group"), squeeze("quality"), **risk),
        "m_excluded_confident_rows": hard & ~confirmed & (F.lower(col_("o_confidence")) == "high"), "m_guard_recovered_rows": guard, "m_guard_recovered_high_rows": guard & (F.lower(squeeze("quality")) == "high")})


def quality_metrics(flags: DataFrame) -> DataFrame:
    """All counters of one pass plus the rates derived from them (metric, value)."""
    names = [c for c in flags.columns if c.startswith("m_")]
    row = flags.agg(F.count(F.lit(1)).alias("source_rows"), *[count_if(F.col(c)).alias(c[2:]) for c in names])
    row = row.withColumns({"source_retention_rate": ratio(F.col("board_rows"), F.col("source_rows"), 6), "filtered_out_rate": ratio(F.col("excluded_rows"), F.col("source_rows"), 6),
                           "board_low_rate": ratio(F.col("low_rows"), F.col("board_rows"), 6)})
    return melt(row, [], row.columns)


def metric_samples(flags: DataFrame, k: int = 10) -> DataFrame:
    """First k ids per metric by source order."""
    names = [c for c in flags.columns if c.startswith("m_")]
    long = flags.select("id", "ord", F.explode(compact(*[F.when(F.col(c), F.lit(c[2:])) for c in names])).alias("metric"))
    return top_k(long, ["metric"], ["ord"], k)


def target_score(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Per-metric fraction and pass flag. targets: metric, comparator (max|min), target, weight."""
    j = metrics.select("metric", F.col("value").alias("actual")).join(targets, "metric")
    a, t = F.col("actual"), F.col("target")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))
    top = F.when(t <= 0, F.when(a <= 0, 1.0).otherwise(0.0)).when(a <= t, 1.0).otherwise(clip(F.try_divide(t, a)))
    bottom = F.when((t <= 0) | (a >= t), 1.0).otherwise(clip(F.try_divide(a, t)))
    up = F.col("comparator") == "max"
    return j.withColumns({"fraction": F.round(F.when(up, top).otherwise(bottom), 6), "passed": F.when(up, a <= t).otherwise(a >= t), "_f": F.when(up, top).otherwise(bottom)})


def overall_score(scored: DataFrame) -> DataFrame:
    w = F.sum("weight")
    return scored.agg(F.when(w > 0, F.bround(F.sum(F.col("_f") * F.col("weight")) / w * 100, 4)).otherwise(0.0).alias("score"), F.bool_and("passed").alias("all_passed"), count_if(~F.col("passed")).alias("failed"))


# Fixed values: (criterion, metric, comparison, target) of the improvement gate; flags are 1 for true.
IMPROVEMENT_CRITERIA = [
    ("operationalLoopConverged", "loop_converged", "eq", 1.0), ("goldsetConfirmed", "gold_confirmed", "eq", 1.0), ("benchmarkFalseExcludeCount", "false_excludes", "eq", 0.0),
    ("benchmarkHighQualityFalseExcludeCount", "high_quality_false_excludes", "eq", 0.0), ("benchmarkSchemaValidRate", "schema_valid_rate", "min", 1.0),
    ("benchmarkIncludeOrReviewRecall", "include_or_review_recall", "min", 1.0), ("modelBenchmarkPassed", "benchmark_passed", "eq", 1.0), ("modelImprovementEligible", "improvement_eligible", "eq", 1.0),
    ("shadowGuardOffTargetsPassed", "guard_off_passed", "eq", 1.0), ("guardRecoveredRows", "guard_recovered_rows", "eq", 0.0), ("guardRecoveredHighQualityRows", "guard_recovered_high_rows", "eq", 0.0)]


def improvement_gate(metrics: DataFrame, criteria: Sequence[tuple] = tuple(IMPROVEMENT_CRITERIA)) -> DataFrame:
    """The criteria with their actual value; a missing metric counts as 0. Blockers are rows with passed = false."""
    wide = metrics.agg(*[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(n) for n, m, _, _ in criteria])
    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(n).alias("name"), F.col(n).alias("actual"), F.lit(t).alias("target"),
                             ((F.col(n) >= t) if op == "min" else (F.col(n) == t)).alias("passed")) for i, (n, _, op, t) in enumerate(criteria, 1)])
    return wide.select(F.explode(arr).alias("c")).select("c.*")


PASS_FLAGS = ["summary_pass", "focus_pass", "keywords_pass", "overall_pass"]
CORRECTIONS = ["corrected_summary", "corrected_focus", "corrected_quality", "notes"]


def is_reviewed(flags: Sequence[str] = tuple(PASS_FLAGS), texts: Sequence[str] = tuple(CORRECTIONS), lists: Sequence[str] = ("corrected_keywords",)) -> Column:
    out = F.lit(False)
    for c in flags:
        out = out | F.col(c).isNotNull()
    for c in texts:
        out = out | (s(c) != "")
    for c in lists:
        out = out | (F.size(lst(c)) > 0)
    return out


def review_accuracy(items: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per dataset: totals, reviewed items and pass rates over flags that were set at all."""
    rv = is_reviewed()
    aggs = []
    for c in PASS_FLAGS:
        passed, judged_ = count_if(rv & F.col(c)), count_if(rv & F.col(c).isNotNull())
        aggs += [passed.alias(f"{c}ed"), judged_.alias(f"{c}_judged"), ratio(passed, judged_).alias(f"{c}_rate")]
    return items.groupBy(dataset).agg(F.count(F.lit(1)).alias("items"), count_if(rv).alias("reviewed"), *aggs)


def review_error_tags(items: DataFrame, broad: Sequence[str] = tuple(EV.WAVE_BROAD_FOCUS)) -> DataFrame:
    """Adds `error_tags` from pass flags and corrections."""
    cs, fs, kw = squeeze("summary"), squeeze("corrected_summary"), non_blank(F.transform(lst("keywords"), squeeze))
    cf, ff, fk = squeeze("focus_label"), squeeze("corrected_focus"), non_blank(F.transform(lst("corrected_keywords"), squeeze))
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    sn, fn, kn, low = no("summary_pass"), no("focus_pass"), no("keywords_pass"), F.lower(squeeze("corrected_quality")) == "low"
    tag = lambda cond, name: F.when(cond, F.lit(name))
    return items.withColumn("error_tags", compact(
        tag(sn, "summary_rewrite"), F.when(sn, F.when(cs == "", "summary_missing").when((F.length(cs) <= 12) | (cs == s("title")), "summary_title_like").when((fs != "") & (cs != fs), "summary_not_board_ready")),
        tag(fn, "focus_relabel"), tag(fn & is_in(cf, broad), "focus_too_broad_or_generic"), tag(fn & (ff != "") & (cf != "") & (ff != cf), "focus_semantic_mismatch"),
        tag(kn, "keywords_rewrite"), F.when(kn, F.when(F.size(kw) == 0, "keywords_missing").when((F.size(fk) > 0) & ~same(kw, fk), "keywords_not_groupable")),
        tag(low, "keep_low"), F.when(low, F.when(F.length(squeeze("detail_body")) < 80, "source_too_sparse").otherwise("source_not_actionable"))))


def tag_counts(tagged: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    pairs = F.concat(F.transform("error_tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("key"))), F.array(F.struct(F.lit("cluster").alias("kind"), s(cluster).alias("key"))))
    return tagged.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))
