"""Human decisions as data: triage, drafts, suggestions, decision sheets, gold tables and guarded publishing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill.functions.rank import count_if, first_per, last_wins, one_per_key
from hiremill.functions.terms import TERMS, TermRules, canonical_term, generic_keyword
from hiremill.functions.text import at, compact, contains_any, empty_list, is_in, let, lit_list, lit_map, lst, matches, non_blank, ordered_distinct, s, squeeze
from hiremill.operators.evaluate import is_reviewed
from hiremill.operators.prepare import DECISION_FIELDS, content_signature
from hiremill.operators.sampling import overlap_ratio
from hiremill.rules import evaluation as EV

BOOLEANS = ["summary_pass", "focus_pass", "keywords_pass", "overall_pass"]
CORRECTED = ["corrected_summary", "corrected_focus", "corrected_quality", "notes"]


def lowered_set(c: str) -> Column:
    return F.array_sort(F.array_distinct(non_blank(F.transform(lst(c), lambda x: F.lower(squeeze(x))))))


def triage_buckets(wave: DataFrame) -> DataFrame:
    """Adds `bucket`: what a reviewer has to look at. Columns summary, focus_label, keywords, quality and their `pre_*` suggestions."""
    q, pq = F.lower(squeeze("quality")), F.lower(squeeze("pre_quality"))
    sm, ps, fo, pf = squeeze("summary"), squeeze("pre_summary"), squeeze("focus_label"), squeeze("pre_focus_label")
    kw, pk = lowered_set("keywords"), lowered_set("pre_keywords")
    bucket = (F.when((pq == "low") & (ps == "") & (pf == ""), "keep_low").when((q == "low") & pq.isin("medium", "high"), "upgrade_review")
              .when((fo != "") & (pf != "") & (fo != pf), "focus_check").when((sm != "") & (ps != "") & (sm != ps), "summary_check")
              .when((F.size(kw) > 0) & (F.size(pk) > 0) & (kw != pk), "keyword_check").otherwise("quick_confirm"))
    return wave.withColumn("bucket", bucket)


HANDOFF_WEIGHT = {"low_confirm": 1, "upgrade_review": 4, "focus_keyword_check": 2, "summary_rewrite_check": 2, "full_rewrite_check": 3, "mixed_check": 2}
BACKLOG_BUCKETS = ["focus_keyword_check"]


def handoff_queue(wave: DataFrame) -> DataFrame:
    """One row per id with bucket, weight, how often it occurs, queue and default decision. Draft columns: `summary_pass`..., `corrected_*`."""
    n = wave.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    one = first_per(wave, ["id"], ["ord"]).join(n, "id")
    q, cq = F.lower(squeeze("quality")), F.lower(squeeze("corrected_quality"))
    sp, fp = F.col("summary_pass"), F.col("focus_pass")
    blank = (squeeze("corrected_summary") == "") & (squeeze("corrected_focus") == "") & (F.size(non_blank(F.transform(lst("corrected_keywords"), squeeze))) == 0)
    bucket = (F.when((cq == "low") & blank, "low_confirm").when((q == "low") & cq.isin("medium", "high"), "upgrade_review").when(sp & ~fp, "focus_keyword_check")
              .when(~sp & fp, "summary_rewrite_check").when(~sp & ~fp, "full_rewrite_check").otherwise("mixed_check"))
    df = one.withColumn("bucket", bucket)
    return df.withColumns({"weight": F.try_element_at(lit_map(HANDOFF_WEIGHT), F.col("bucket")).cast("bigint"), "queue": F.when(is_in(F.col("bucket"), BACKLOG_BUCKETS), "backlog").otherwise("confirm"),
                           "recommended_decision": F.when(F.col("bucket") == "low_confirm", "approve_low").otherwise("approve_draft")})


def queue_load(queue: DataFrame) -> DataFrame:
    return queue.groupBy("queue", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("load"))


def draft_review(wave: DataFrame) -> DataFrame:
    """Conservative draft for rows whose focus differs from the suggestion."""
    q, pq = F.lower(squeeze("quality")), F.lower(squeeze("pre_quality"))
    sp = (squeeze("summary") != "") & q.isin("high", "medium")
    pf, pk = squeeze("pre_focus_label"), lst("pre_keywords")
    first = lambda a, b: F.when(a != "", a).otherwise(b)
    return wave.withColumns({
        "d_summary_pass": sp, "d_focus_pass": ~((pf != "") & (pf != squeeze("focus_label"))), "d_keywords_pass": (F.size(pk) > 0) & (lst("keywords") == pk), "d_overall_pass": F.lit(False),
        "d_corrected_summary": F.when(sp, "").otherwise(first(squeeze("pre_summary"), squeeze("summary"))), "d_corrected_focus": first(pf, squeeze("focus_label")),
        "d_corrected_keywords": F.when(F.size(pk) > 0, pk).otherwise(lst("keywords")), "d_corrected_quality": first(q, pq)})


PREFILL = ["summary", "focus_label", "keywords", "quality", "notes"]


def prefill(wave: DataFrame, manual: DataFrame, suggested: DataFrame) -> DataFrame:
    """Manual proposal first, else the suggestion, with its source."""
    side = lambda df, p: one_per_key(df).select("id", *[F.col(c).alias(f"{p}_{c}") for c in PREFILL], F.lit(True).alias(f"{p}_hit"))
    j = wave.join(side(manual, "_m"), "id", "left").join(side(suggested, "_s"), "id", "left")
    m = F.coalesce("_m_hit", F.lit(False))
    out = j.withColumns({f"pre_{c}": F.when(m, F.col(f"_m_{c}")).otherwise(F.col(f"_s_{c}")) for c in PREFILL})
    out = out.withColumn("pre_source", F.when(m, "manual_prefill").when(F.coalesce("_s_hit", F.lit(False)), "model_suggestion").otherwise(""))
    return out.drop(*[f"{p}_{c}" for p in ("_m", "_s") for c in [*PREFILL, "hit"]])


# Words and openings that disqualify a summary line, and labels that are put in front of one.
SUMMARY_STOP = ["채용", "모집", "영입", "전형", "지원"]
SUMMARY_STARTS = ["모든 포지션", "제출하신", "확인해주세요", "공고명", "양식"]
SUMMARY_PARTS = ["근무가 가능", "혜택 및 복지"]
PARTICLE_STARTS = ["를 ", "을 ", "이 ", "가 ", "및 ", "는 "]
PREFIX_LABELS = ["RAG", "LLM", "NLP", "ONNX", "API", "MLOps"]
USABLE_STOP = ["모집", "채용", "영입", "공고"]


def clean_summary(c: Column, cleanups: Sequence[tuple] = tuple(EV.SUMMARY_CLEANUPS)) -> Column:
    text = squeeze(c)
    for pattern, repl in cleanups:
        text = squeeze(F.regexp_replace(text, f"(?iU){pattern}", repl))
    return squeeze(F.regexp_replace(text, "^[ \\-:·,./]+|[ \\-:·,./]+$", ""))


def heuristic_suggestions(wave: DataFrame, hints: Sequence[tuple] = tuple(EV.SUGGESTION_FOCUS_HINTS), t: TermRules = TERMS, cleanups: Sequence[tuple] = tuple(EV.SUMMARY_CLEANUPS)) -> DataFrame:
    """Suggested focus, summary, keywords and quality from the source fields; each hint counts in the first text that holds it."""
    import re

    few = lambda c, n: ordered_distinct(F.transform(lst(c), squeeze), n)
    texts = [squeeze("title"), squeeze("detail_body"), F.array_join(few("tasks", 8), " "), F.array_join(few("requirements", 8), " "), F.array_join(few("skills", 10), " ")]
    df = wave.withColumn("_x", F.transform(F.array(*texts), lambda x: F.lower(x)))
    # Label -> (text index, hint index) of its first mention, then the number of mentions there.
    found = []
    for i, (needle, label) in enumerate(hints):
        n = lambda x: F.regexp_count(x, F.lit(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", needle)))
        pos = F.array_position(F.transform("_x", lambda x: F.contains(x, F.lit(needle))), True)
        found.append(F.when(pos > 0, F.struct(F.lit(label).alias("v"), pos.alias("p"), F.lit(i).alias("i"), n(F.get("_x", (pos - 1).cast("int"))).alias("n"))))
    df = df.withColumn("_f", compact(*found))
    first = let(F.col("_f"), lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: (y["v"] == x["v"]) & ((y["p"] < x["p"]) | ((y["p"] == x["p"]) & (y["i"] < x["i"]))))))
    best = F.get(F.array_sort(F.transform(first, lambda x: F.struct((-x["n"]).alias("k"), F.length(x["v"]).alias("l"), x["v"].alias("v")))), 0)["v"]
    own = canonical_term("focus_label", t)
    df = df.withColumn("suggested_focus", F.coalesce(best, F.when(~generic_keyword(own, t) & (own != ""), own), F.lit("")))

    def usable(x: Column) -> Column:
        bad = contains_any(x, SUMMARY_STOP) | contains_any(x, SUMMARY_PARTS) | (F.length(x) < 8) | (overlap_ratio(x, F.col("title")) >= 0.7)
        for st in [*SUMMARY_STARTS, *PARTICLE_STARTS]:
            bad = bad | x.startswith(st)
        return ~bad

    cands = F.transform(F.concat(few("tasks", 6), non_blank(F.array(squeeze("detail_body")))), lambda x: clean_summary(x, cleanups))
    line = F.get(F.filter(cands, usable), 0)
    cut = lambda x: F.when(F.length(x) > 36, F.regexp_replace(F.substring(x, 1, 36), "[ ,.\\-]+$", "")).otherwise(x)
    df = df.withColumn("_line", F.coalesce(cut(line), F.lit("")))
    lead = is_in(F.col("suggested_focus"), PREFIX_LABELS) & ~F.contains(F.col("_line"), F.col("suggested_focus")) & (F.length("_line") <= 28) & (F.col("_line") != "")
    df = df.withColumn("suggested_summary", F.when(lead, F.regexp_replace(F.substring(F.concat("suggested_focus", F.lit(" 기반 "), "_line"), 1, 36), "[ ,.\\-]+$", "")).otherwise(F.col("_line")))
    skills = F.filter(F.transform(few("skills", 8), lambda x: canonical_term(x, t)), lambda x: ~generic_keyword(x, t))
    body = let(F.lower(squeeze("detail_body")), lambda b: compact(*[F.when(F.contains(b, F.lit(needle)), F.lit(label)) for needle, label in hints])) if hints else empty_list()
    df = df.withColumn("suggested_keywords", ordered_distinct(F.concat(F.array("suggested_focus"), skills, body), 5))
    ok = (F.col("suggested_summary") != "") & (F.col("suggested_focus") != "") & (F.size("suggested_keywords") >= 2)
    return df.withColumn("suggested_quality", F.when(ok, "medium").otherwise("low")).drop("_x", "_f", "_line")


def suggestion_usable(t: TermRules = TERMS) -> Column:
    sm, fo = squeeze("suggested_summary"), canonical_term("suggested_focus", t)
    return ((sm != "") & (fo != "") & (overlap_ratio(sm, F.col("title")) < 0.7) & ~contains_any(sm, USABLE_STOP) & ~generic_keyword(fo, t) & (F.size(lst("suggested_keywords")) >= 2))


# Spellings of a reviewed flag.
TRUE_WORDS = ["true", "1", "yes", "y", "pass", "ok"]
FALSE_WORDS = ["false", "0", "no", "n", "fail", "x"]


def parse_flag(c: str | Column) -> Column:
    """Tri-state flag: true, false or not judged."""
    v = F.lower(squeeze(c))
    return F.when(is_in(v, TRUE_WORDS), True).when(is_in(v, FALSE_WORDS), False)


def keyword_list(c: str) -> Column:
    return ordered_distinct(F.transform(F.split(s(c), "[|]"), squeeze))


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with the decided review (`review` struct) and its status: applied, unresolved or none.

    items carry current labels and a draft `d_*` (NULL pass flags and blank texts when there is none, `has_draft`).
    decisions: id, decision, recommended_decision, manual_summary, manual_focus_label, manual_keywords, manual_quality, confirm_notes.
    """
    cols = ["decision", "recommended_decision", "manual_summary", "manual_focus_label", "manual_keywords", "manual_quality", "confirm_notes"]
    d = last_wins(decisions).select("id", *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = items.join(d, "id", "left")
    dec = F.lower(F.when(squeeze("_decision") != "", squeeze("_decision")).otherwise(squeeze("_recommended_decision")))
    notes = squeeze("_confirm_notes")
    pick = lambda a, b: F.when(a != "", a).otherwise(b)

    def review(sp, fp, kp, op, cs, cf, ck, cq, nt) -> Column:
        return F.struct(sp.cast("boolean").alias("summary_pass"), fp.cast("boolean").alias("focus_pass"), kp.cast("boolean").alias("keywords_pass"), op.cast("boolean").alias("overall_pass"),
                        cs.alias("corrected_summary"), cf.alias("corrected_focus"), ck.alias("corrected_keywords"), cq.alias("corrected_quality"), nt.alias("notes"))

    yes, no, blank = F.lit(True), F.lit(False), F.lit("")
    draft = review(*[F.col(f"d_{c}") for c in BOOLEANS], s("d_corrected_summary"), s("d_corrected_focus"), lst("d_corrected_keywords"), s("d_corrected_quality"), pick(notes, s("d_notes") if "d_notes" in items.columns else blank))
    current = review(yes, yes, yes, yes, blank, blank, empty_list(), s("quality"), pick(notes, F.lit("현재 모델 출력을 유지합니다.")))
    mk = keyword_list("_manual_keywords")
    manual = review(no, no, no, no, squeeze("_manual_summary"), squeeze("_manual_focus_label"), mk, squeeze("_manual_quality"), pick(notes, F.lit("수동 수정안 반영")))
    filled = (squeeze("_manual_summary") != "") | (squeeze("_manual_focus_label") != "") | (F.size(mk) > 0) | (squeeze("_manual_quality") != "")
    use_draft = dec.isin("approve_draft", "approve_low") & F.coalesce("has_draft", F.lit(False))
    use_manual = (dec == "needs_edit") & filled
    out = j.withColumn("decision", F.when(F.col("_hit"), dec))
    out = out.withColumn("review", F.when(use_draft, draft).when(dec == "approve_current", current).when(use_manual, manual))
    status = F.when(F.col("_hit").isNull(), "none").when(F.col("review").isNotNull(), "applied").otherwise("unresolved")
    return out.withColumn("decision_status", status).drop(*[f"_{c}" for c in [*cols, "hit"]])


def decision_counts(applied: DataFrame) -> DataFrame:
    return applied.where("decision_status <> 'none'").groupBy("decision", "decision_status").agg(F.count(F.lit(1)).alias("n"))


def merge_reviews(eval_items: DataFrame, wave: DataFrame) -> DataFrame:
    """Evaluation items with the wave's review where it holds anything, by (dataset, id)."""
    cols = [*BOOLEANS, *CORRECTED, "corrected_keywords"]
    content = F.col("overall_pass").isNotNull()
    for c in BOOLEANS[:3]:
        content = content | F.coalesce(F.col(c), F.lit(False))
    for c in CORRECTED:
        content = content | (s(c) != "")
    content = content | (F.size(lst("corrected_keywords")) > 0)
    w = first_per(wave.where(content), ["dataset", "id"], [F.col("ord").desc()]).select("dataset", "id", *[F.col(c).alias(f"_w_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = eval_items.join(w, ["dataset", "id"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return j.withColumns({**{c: F.when(hit, F.col(f"_w_{c}")).otherwise(F.col(c)) for c in cols}, "merged": hit}).drop("_hit", *[f"_w_{c}" for c in cols])


DATASET_RANK = {"core": 0, "incremental": 1}


def gold_seed(items: DataFrame) -> DataFrame:
    """Reviewed items once per id (core first) with their target: correction, else the current value that passed."""
    passed = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = lambda corr, cur, flag: F.when(s(corr) != "", s(corr)).when(passed(flag), s(cur)).otherwise("")
    kw = F.when(F.size(lst("corrected_keywords")) > 0, lst("corrected_keywords")).when(passed("keywords_pass"), lst("keywords")).otherwise(empty_list())
    df = items.where(is_reviewed()).withColumns({
        "target_summary": one("corrected_summary", "summary", "summary_pass"), "target_focus": one("corrected_focus", "focus_label", "focus_pass"), "target_keywords": kw,
        "target_quality": F.when(s("corrected_quality") != "", s("corrected_quality")).otherwise(s("quality"))})
    return first_per(df, ["id"], [F.try_element_at(lit_map(DATASET_RANK), F.col("dataset")), "ord"])


def recommend_decision(candidates: DataFrame, broad: Sequence[str] = tuple(EV.GOLD_BROAD_FOCUS)) -> DataFrame:
    """Adds `recommended_decision`. Needs reason, raw_focus, board_focus, raw_quality."""
    raw, brd, q, why = squeeze("raw_focus"), squeeze("board_focus"), F.lower(squeeze("raw_quality")), s("reason")
    dec = (F.when(why == "low_or_empty", "approve_low").when((brd != "") & (brd != raw), "approve_draft").when((q == "low") & (brd == ""), "approve_low").when(why == "domain_specific", "approve_current")
           .when(why == "focus_keyword_conflict", "needs_edit").when((why == "broad_focus") & (brd != "") & ~is_in(brd, broad), "approve_draft").when(why == "broad_focus", "needs_edit").otherwise("approve_current"))
    return candidates.withColumn("recommended_decision", dec)


def confirm_queue(candidates: DataFrame, decisions: Sequence[str] = ("needs_edit", "approve_draft")) -> DataFrame:
    return candidates.where(is_in(F.col("recommended_decision"), decisions))


LABELS = ["summary", "focus_label", "keywords", "quality"]


def adoption_report(items: DataFrame) -> DataFrame:
    """Adds `adopted_from`: which payload the expected labels equal. Columns `e_*`, `c_*`, `d_*` and `resolved`."""
    pay = lambda p: F.struct(squeeze(f"{p}_summary").alias("a"), squeeze(f"{p}_focus_label").alias("b"), non_blank(F.transform(lst(f"{p}_keywords"), squeeze)).alias("c"), F.lower(squeeze(f"{p}_quality")).alias("d"))
    e, c, d = pay("e"), pay("c"), pay("d")
    low = (F.lower(squeeze("e_quality")) == "low") & (squeeze("e_summary") == "") & (squeeze("e_focus_label") == "") & (F.size(lst("e_keywords")) == 0)
    kind = F.when(~F.coalesce("resolved", F.lit(False)), "unresolved").when(e == d, "board_projection").when(e == c, "raw_extractor").when(low, "keep_low").otherwise("manual_override")
    return items.withColumn("adopted_from", kind)


DECISIONS = ["include", "review", "exclude"]
PACK_ORDER = {"critical_prompt_failure": 0, "goldset_conflict_review": 1, "human_boundary_review": 2, "confirm_positive": 3}


def _decision(c: str | Column) -> Column:
    v = F.lower(squeeze(c))
    return F.when(is_in(v, DECISIONS), v).otherwise("")


def adjudication_pack(guard: DataFrame, model_review: DataFrame, strong: Sequence[str] = tuple(EV.STRONG_AI_CONTEXT), peripheral: Sequence[str] = tuple(EV.PERIPHERAL_AI),
                      low_info: Sequence[str] = tuple(EV.LOW_INFORMATION), generic_ai: Sequence[str] = (r"\bai\b", "인공지능")) -> DataFrame:
    """Guard candidates with a suggested decision and priority. guard: id, company, title, summary, focus_label, keywords, quality.
    model_review: id, decision, confidence, reason and optional text fields."""
    texts = [c for c in ("detail_body", "tasks", "requirements", "preferred", "skills") if c in model_review.columns]
    types = dict(model_review.dtypes)
    extra = F.concat_ws(" ", *[F.array_join(lst(c), " ") if types[c].startswith("array") else squeeze(c) for c in texts]) if texts else F.lit("")
    m = last_wins(model_review).select("id", _decision("decision").alias("model_decision"), squeeze("confidence").alias("model_confidence"), squeeze("reason").alias("model_reason"), extra.alias("_x"))
    j = guard.where(squeeze("id") != "").join(m, "id", "left")
    dec, reason = F.coalesce("model_decision", F.lit("")), s("model_reason")
    text = F.lower(squeeze(F.concat_ws(" ", "company", "title", "summary", "focus_label", F.array_join(lst("keywords"), " "), reason, s("_x"))))
    specific = [p for p in strong if p not in set(generic_ai)]
    j = j.withColumn("_t", text)
    ai = matches(F.col("_t"), strong) & (~matches(F.col("_t"), peripheral) | matches(F.col("_t"), specific))
    thin = (F.lower(squeeze("quality")) == "low") | (squeeze("summary") == "") | matches(reason, low_info)
    pack = lambda d, p: F.struct(F.lit(d).alias("d"), F.lit(p).alias("p"))
    pick = (F.when(dec == "include", pack("include", "confirm_positive")).when(dec == "review", pack("review", "human_boundary_review")).when(thin | ai, pack("review", "critical_prompt_failure"))
            .otherwise(pack("exclude", "goldset_conflict_review")))
    j = j.withColumn("_p", pick)
    out = j.withColumns({"model_decision": F.when(dec == "", "missing").otherwise(dec), "suggested_scope": F.col("_p.d"), "review_priority": F.col("_p.p"),
                         "priority_rank": F.try_element_at(lit_map(PACK_ORDER), F.col("_p.p")).cast("bigint")})
    q = F.coalesce(F.try_element_at(lit_map({"high": 0, "medium": 1, "low": 2}), squeeze("quality")), F.lit(9))
    return out.drop("_x", "_t", "_p").orderBy("priority_rank", q, "company", "title", "id")


def scope_gold(candidates: DataFrame, postings: DataFrame, decisions: DataFrame | None = None, allow_provisional: bool = False, provisional: str = "scope_action") -> DataFrame:
    """Gold items: confirmed decision, else a provisional one, else unconfirmed; with the posting's current signature."""
    c = candidates.where(squeeze("id") != "")
    names = ["confirm_scope", "confirm_role", "confirm_focus", "confirm_source", "reviewer_notes"]
    if decisions is not None:
        d = last_wins(decisions).select("id", *[F.col(n).alias(f"_d_{n}") for n in names])
        c = c.join(d, "id", "left")
        c = c.withColumns({n: F.coalesce(F.nullif(squeeze(f"_d_{n}"), F.lit("")), s(n) if n in candidates.columns else F.lit("")) for n in names}).drop(*[f"_d_{n}" for n in names])
    else:
        c = c.withColumns({n: (s(n) if n in candidates.columns else F.lit("")) for n in names})
    sig = postings.select("id", content_signature(postings, DECISION_FIELDS).alias("signature"))
    ok = _decision("confirm_scope")
    prov = F.coalesce(F.nullif(_decision(provisional), F.lit("")), F.nullif(_decision("scope_action"), F.lit("")), F.lit("review")) if allow_provisional else F.lit("")
    named = "adjudication_suggestion_provisional" if provisional == "suggested_scope" else "guard_recovery_provisional"
    out = c.withColumns({
        "target_scope": F.when(ok != "", ok).otherwise(prov),
        "decision_source": F.when(ok != "", F.when(squeeze("confirm_source") != "", squeeze("confirm_source")).otherwise("human_confirmed")).otherwise(named if allow_provisional else "unconfirmed"),
        "requires_confirmation": ok == "", "target_role": F.when(squeeze("confirm_role") != "", squeeze("confirm_role")).otherwise(squeeze("role_group")),
        "target_focus": F.when(squeeze("confirm_focus") != "", squeeze("confirm_focus")).otherwise(squeeze("focus_label"))})
    return out.join(sig, "id", "left").withColumn("signature", s("signature"))


def gold_status(gold: DataFrame) -> DataFrame:
    row = gold.agg(F.count(F.lit(1)).alias("items"), count_if(~F.col("requires_confirmation")).alias("confirmed_items"), count_if(F.col("requires_confirmation")).alias("provisional_items"),
                   *[count_if(F.col("target_scope") == d).alias(d) for d in DECISIONS], count_if(F.col("target_scope") == "").alias("unconfirmed"))
    return row.withColumn("status", F.when(F.col("provisional_items") == 0, "confirmed").otherwise("provisional_requires_human_confirmation"))


def gold_to_overrides(gold: DataFrame, postings: DataFrame, updated_at: str, allow_provisional: bool = False, source: str = "service_scope_goldset_001") -> DataFrame:
    """Override rows of confirmed gold items, signed with today's content. Provisional or unknown items fail the job."""
    sig = postings.select("id", content_signature(postings, DECISION_FIELDS).alias("_sig"))
    j = gold.drop("signature").join(sig, "id", "left")
    refuse = lambda cond, text: F.when(cond, F.raise_error(F.concat(F.lit(text), "id")))
    ident = F.coalesce(refuse(F.col("requires_confirmation") & F.lit(not allow_provisional), "provisional gold item: "), refuse(F.col("_sig").isNull(), "no posting for gold item: "),
                       refuse(F.col("target_scope") == "", "no decision for gold item: "), F.col("id"))
    why = F.when(squeeze("reviewer_notes") != "", squeeze("reviewer_notes")).otherwise(F.concat(F.lit("service scope goldset confirmed "), "target_scope"))
    return j.select(ident.alias("id"), F.col("target_scope").alias("action"), F.lit(source).alias("source"), F.substring(why, 1, 80).alias("reason"),
                    F.when(F.col("target_scope") == "include", F.col("target_role")).otherwise("").alias("mapped_role"), F.lit("high").alias("confidence"), F.col("_sig").alias("signature"), F.lit(updated_at).alias("updated_at"))


def _files(spark: SparkSession, root: str):
    """The Hadoop file system of a folder and a function that makes paths in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: path(f"{root}/{name}")


def _numbers(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the pointers (no prefix) or claims of a store, falling."""
    fs, path = _files(spark, root)
    if not fs.exists(path("pointers")):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path("pointers"))]
    return sorted((int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()), reverse=True)


def guarded_apply(spark: SparkSession, root: str, store: DataFrame, batch: DataFrame, gate_passed: bool, measure: Callable[[DataFrame], bool], dry_run: bool = False,
                  version: str | None = None) -> str:
    """Publish an upserted override table as a new version directory and point to it only when gate and re-measurement hold.

    Returns the status: dry_run, blocked, rolled_back, refused or published. `version` is a new name (a fresh one by default); a name that
    exists is refused with an error, so no published version is ever touched. A pointer is a numbered file that is made once and never
    changed: of two writers that started from the same pointer one is refused, and at every moment the last whole pointer is readable.
    """
    import uuid

    from hiremill.sources.io import upsert_by_key

    version = version or uuid.uuid4().hex

    if dry_run:
        return "dry_run"
    if not gate_passed:
        return "blocked"
    state = lambda: (_numbers(spark, root, "")[:1], _numbers(spark, root, "claim-")[:1])
    started = state()
    path = f"{root}/version={version}"
    upsert_by_key(store, batch).write.mode("errorifexists").parquet(path)
    if not measure(spark.read.parquet(path)):
        return "rolled_back"
    fs, at = _files(spark, root)
    # The claim of a writer that died leaves a gap in the numbers and nothing else.
    number = max([0, *started[0], *started[1]]) + 1
    if state() != started:
        return "refused"
    # The pointer is whole before it gets its number; a number that is taken is not given again.
    part = at(f"pointers/part-{version}")
    out = fs.create(part, False)
    out.write(bytearray(f"version={version}".encode()))
    out.close()
    try:
        taken = not fs.createNewFile(at(f"pointers/claim-{number}"))
    except Exception as e:
        if "Exists" not in str(e):
            raise
        taken = True
    if taken or not fs.rename(part, at(f"pointers/{number}")):
        return "refused"
    return "published"


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """The table that the last pointer names."""
    number = _numbers(spark, root, "")[0]
    return spark.read.parquet(f"{root}/" + spark.read.text(f"{root}/pointers/{number}").first()["value"])


def publish_report(current: DataFrame, statuses: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of the published table beside what became of each attempt: (part, name, value)."""
    attempts = current.sparkSession.createDataFrame([("attempt", n, v) for n, v in statuses], "part string, name string, value string")
    return attempts.unionByName(current.select(F.lit("override").alias("part"), F.col("id").cast("string").alias("name"), F.col("action").alias("value")))
