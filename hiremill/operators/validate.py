"""Row-level quality rules, two-stage candidates, release gate, triage and repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.rank import count_if, last_wins, melt, top_k
from hiremill.functions.text import canon, compact, is_in, lit_list, matches, non_blank, s, split_terms, squeeze
from hiremill.rules import repair as P
from hiremill.rules import review_stage as V


@dataclass(frozen=True)
class StageRules:
    """Rule families of the validation. The defaults are the fixed values of the domain."""

    roles: Sequence[str] = tuple(V.ALLOWED_ROLES)
    analyst_roles: Sequence[str] = ("데이터 분석가",)
    ai_roles: Sequence[str] = ("인공지능 엔지니어", "인공지능 리서처")
    noise_terms: Sequence[str] = tuple(V.NOISE_TERMS)
    deeptech: Sequence[str] = tuple(V.DEEPTECH_PATTERNS)
    business_context: Sequence[str] = tuple(V.BUSINESS_CONTEXT_PATTERNS)
    business_dominance: Sequence[str] = tuple(V.BUSINESS_DOMINANCE_PATTERNS)
    data_titles: Sequence[str] = tuple(V.DATA_ENGINEERING_TITLE_PATTERNS)
    analytics_titles: Sequence[str] = tuple(V.DATA_ANALYTICS_TITLE_PATTERNS)
    ai_dominance: Sequence[str] = tuple(V.AI_DOMINANCE_PATTERNS)
    clinical: Sequence[str] = tuple(V.CLINICAL_SCIENCE_PATTERNS)
    approvals: Sequence[str] = ("true", "y", "yes", "approved", "승인")


DEFAULT = StageRules()
FIELDS = ["role", "focus", "keywords", "summary"]


def issue(code: str, severity: str | Column, detail: Column | None = None) -> Column:
    text = F.lit(P.MESSAGES.get(code, code))
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(code).alias("code"), sev.alias("severity"),
                    (F.concat(text, detail) if detail is not None else text).alias("message"))


def evidence(df: DataFrame) -> DataFrame:
    """Evidence texts as columns, so that every rule family reads a text that is built once per row."""
    present = lambda c: squeeze(c) if c in df.columns else F.lit("")
    body = [present(c) for c in ("detail_body", "tasks_text", "requirements_text", "preferred_text")]
    df = df.withColumn("_terms", split_terms("keywords"))
    kw = F.array_join("_terms", " ")
    head = [present("title"), squeeze("focus"), squeeze("summary")]
    return df.withColumns({
        "_text": F.concat_ws(" ", present("company"), present("title"), squeeze("role"), squeeze("focus"),
                             squeeze("summary"), kw, *body),
        "_lead": F.concat_ws(" ", *head, F.array_join(F.slice("_terms", 1, 6), " ")),
        "_ai_text": F.concat_ws(" ", *head, kw, *body),
    })


def quality_issues(rows: DataFrame, rules: StageRules = DEFAULT, out: str = "issues") -> DataFrame:
    """Adds `array<struct<code,severity,message>>`; needs id, change_hash, role, focus, keywords, summary, title."""
    df = evidence(rows)
    role, focus, summary, title = (squeeze(c) for c in ("role", "focus", "summary", "title"))
    terms, text, lead, ai_text = F.col("_terms"), F.col("_text"), F.col("_lead"), F.col("_ai_text")
    noise = sorted({n for n in rules.noise_terms})
    noise_keys = F.transform(lit_list(noise), canon)
    noisy = F.array_sort(F.array_distinct(F.filter(
        F.concat(F.array(focus, summary), terms), lambda x: F.array_contains(noise_keys, canon(x)))))
    keys = F.filter(F.transform(F.concat(F.array(focus), terms), canon), lambda k: k != "")
    analyst, ai = is_in(role, rules.analyst_roles), is_in(role, rules.ai_roles)
    data_title, dominance = matches(title, rules.data_titles), matches(lead, rules.business_dominance)
    ai_title, ai_any = matches(title, rules.ai_dominance), matches(ai_text, rules.ai_dominance)
    ladder = (F.when(matches(title, rules.analytics_titles) & ~ai_title, issue("analytics_engineering_as_ai_role", "high"))
              .when(data_title & ~ai_title & ~ai_any, issue("data_engineering_as_ai_role", "high"))
              .when(data_title & ai_title, issue("data_engineering_ai_title_context", "info"))
              .when(data_title, issue("data_engineering_ai_context", "info"))
              .when(dominance & ~ai_any, issue("business_role_as_ai_role", "high"))
              .when(dominance, issue("business_focus_in_ai_role", "medium"))
              .when(matches(text, rules.business_context), issue("business_context_in_ai_role", "info")))
    found = compact(
        F.when(squeeze("id") == "", issue("missing_job_id", "high")),
        F.when(squeeze("change_hash") == "", issue("missing_change_hash", "high")),
        F.when(~is_in(role, rules.roles), issue("invalid_role", "high", F.when(role == "", "-").otherwise(role))),
        F.when(focus == "", issue("missing_focus", "medium")),
        F.when(summary == "", issue("missing_group_summary", "medium")),
        F.when(F.size(terms) == 0, issue("missing_keywords", "medium")),
        F.when(F.size(noisy) > 0, issue("noise_keyword", "high", F.array_join(noisy, ", "))),
        F.when(F.size(keys) != F.size(F.array_distinct(keys)), issue("duplicate_signal", "medium")),
        F.when(analyst & matches(text, rules.clinical), issue("clinical_scientist_as_analyst", "high")),
        F.when(analyst & matches(text, rules.deeptech),
               issue("deeptech_as_analyst", F.when(dominance, "medium").otherwise("high"))),
        F.when(ai, ladder),
        F.when((summary != "") & (F.length(canon(summary)) <= 4), issue("summary_too_short", "low")))
    return df.withColumn(out, found).drop("_terms", "_text", "_lead", "_ai_text")


def codes_of(issues: str | Column) -> Column:
    return F.transform(F.col(issues) if isinstance(issues, str) else issues, lambda i: i["code"])


def blocking(issues: str | Column) -> Column:
    c = F.col(issues) if isinstance(issues, str) else issues
    return F.filter(c, lambda i: i["severity"].isin("high", "medium"))


def pair_diffs(df: DataFrame, out: str = "diffs") -> DataFrame:
    """Info issues where the reviewed value (`s2_*`) is filled and canonically different."""
    items = []
    for name, label in P.DIFF_LABELS:
        left, right = squeeze(name), squeeze(f"s2_{name}")
        diff = F.struct(F.lit(f"{name}_diff").alias("code"), F.lit("info").alias("severity"),
                        F.lit(f"1차와 2차 {label} 값이 다릅니다.").alias("message"))
        items.append(F.when((right != "") & (canon(left) != canon(right)), diff))
    return df.withColumn(out, compact(*items))


def state_status_priority(df: DataFrame, stage2_error: str = "", rules: StageRules = DEFAULT) -> DataFrame:
    """State precedence: unreadable, missing, stale, quality issue, approved or pending."""
    h1, h2 = squeeze("change_hash"), squeeze("s2_change_hash")
    approved = is_in(F.lower(squeeze("s2_approval")), rules.approvals)
    state = (F.when(F.lit(bool(stage2_error)), "stage2_unreadable")
             .when(~F.coalesce("s2_found", F.lit(False)), "stage2_missing")
             .when((h1 != "") & (h2 != "") & (h1 != h2), "stage2_stale")
             .when(F.size(blocking("issues")) > 0, "quality_issue")
             .when(approved, "stage2_approved").otherwise("stage2_pending"))
    df = df.withColumn("state", state)
    has = lambda sev: F.exists("issues", lambda i: i["severity"] == sev)
    status = F.when(F.col("state") == "stage2_approved", "approved").when(F.col("state") == "stage2_pending", "pending").otherwise("needs_review")
    priority = (F.when(has("high") | F.col("state").isin("stage2_missing", "stage2_stale", "stage2_unreadable"), "high")
                .when(has("medium"), "medium").when(F.size("issues") > 0, "low").otherwise("pass"))
    return df.withColumns({"status": status, "priority": priority})


def with_stage2(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """Stage-1 rows (duplicates kept) with the last stage-2 row of their key."""
    right = last_wins(stage2.withColumn("id", squeeze("id")))
    cols = [F.col(c).alias(f"s2_{c}") for c in ("change_hash", *FIELDS, "approval", "memo")]
    right = right.select("id", *cols, F.lit(True).alias("s2_found"))
    return stage1.withColumn("id", squeeze("id")).join(right, "id", "left")


def validate_pair(stage1: DataFrame, stage2: DataFrame, stage2_error: str = "", rules: StageRules = DEFAULT) -> DataFrame:
    """One candidate per stage-1 row."""
    j = with_stage2(stage1, stage2)
    originals = {f"s1_{c}": squeeze(c) for c in FIELDS}
    effective = {c: F.when(squeeze(f"s2_{c}") != "", squeeze(f"s2_{c}")).otherwise(squeeze(c)) for c in FIELDS}
    checked = quality_issues(j.withColumns(originals).withColumns(effective), rules, "_quality")
    back = checked.withColumns({c: F.col(f"s1_{c}") for c in FIELDS})
    both = pair_diffs(back).withColumn("issues", F.concat("_quality", "diffs")).drop("_quality", "diffs")
    out = state_status_priority(both, stage2_error, rules)
    return out.select(
        "ord", "id", squeeze("change_hash").alias("change_hash"), "status", "priority", "state", "issues",
        F.concat(F.array("state"), codes_of("issues")).alias("codes"),
        F.substring(F.array_join(F.transform("issues", lambda i: i["message"]), " / "), 1, 500).alias("issue_summary"),
        *[F.col(f"s1_{c}").alias(f"stage1_{c}") for c in FIELDS], *[squeeze(f"s2_{c}").alias(f"stage2_{c}") for c in FIELDS],
        squeeze("company").alias("company"), squeeze("title").alias("title"), squeeze("job_url").alias("job_url"),
        squeeze("last_seen_at").alias("last_seen_at"), squeeze("s2_memo").alias("memo"), squeeze("s2_approval").alias("approval"))


# Column of the candidate sheet -> column of `validate_pair`.
SHEET_COLUMNS = dict(zip(V.STAGE2_FIELDNAMES, [
    "id", "change_hash", "status", "priority", "issue_codes", "issue_summary", "stage1_role", "stage2_role", "stage1_focus",
    "stage2_focus", "stage1_keywords", "stage2_keywords", "stage1_summary", "stage2_summary", "company", "title", "job_url",
    "last_seen_at", "memo", "approval"]))


def candidate_sheet(candidates: DataFrame) -> DataFrame:
    """Candidates under the sheet's own headers, codes joined."""
    flat = candidates.withColumn("issue_codes", F.array_join("codes", " | "))
    return flat.select(*[F.col(c).alias(h) for h, c in SHEET_COLUMNS.items()])


def read_candidate_sheet(sheet: DataFrame) -> DataFrame:
    """The inverse of `candidate_sheet`, for gates that start from the file."""
    out = sheet.select(*[c for c in ["ord"] if c in sheet.columns],
                       *[(squeeze(f"`{h}`") if h in sheet.columns else F.lit("")).alias(c) for h, c in SHEET_COLUMNS.items()])
    return out.withColumn("codes", non_blank(F.transform(F.split("issue_codes", "\\|"), squeeze)))


def validation_report(candidates: DataFrame, stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """Long report (section, key, n): state, issue, blocking and severity counts plus row metrics."""
    tag = lambda section, arr: F.transform(arr, lambda x: F.struct(F.lit(section).alias("section"), x.alias("key")))
    tags = F.concat(tag("state", F.array("state")), tag("issue", codes_of("issues")),
                    tag("blocking", codes_of(blocking("issues"))),
                    tag("severity", F.transform("issues", lambda i: i["severity"])),
                    tag("metric", F.array(F.lit("candidateRows"))))
    counts = candidates.select(F.explode(tags).alias("t")).groupBy("t.section", "t.key").agg(F.count(F.lit(1)).alias("n"))
    metric = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("metric").alias("section"), F.lit(name).alias("key"), "n")
    return counts.unionByName(metric(stage1, "stage1Rows")).unionByName(metric(stage2, "stage2Rows")).unionByName(
        metric(removed_keys(stage1, stage2), "removedFromStage1"))


def removed_keys(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """Distinct keys of the reviewed table that the first table no longer has."""
    key = lambda df: df.select(squeeze("id").alias("id")).where("id <> ''").distinct()
    return key(stage2).join(key(stage1), "id", "left_anti")


def deploy_rows(candidates: DataFrame) -> DataFrame:
    """Deploy values: reviewed value, else first-stage value."""
    val = lambda c: F.when(squeeze(f"stage2_{c}") != "", squeeze(f"stage2_{c}")).otherwise(squeeze(f"stage1_{c}"))
    return candidates.select("ord", squeeze("id").alias("id"), squeeze("change_hash").alias("change_hash"),
                             *[val(c).alias(c) for c in FIELDS],
                             *[squeeze(c).alias(c) for c in ("company", "title", "job_url", "last_seen_at", "approval", "memo")])


def deployable(approved: Sequence[str] = tuple(V.GATE_APPROVED), blocking_states: Sequence[str] = tuple(V.BLOCKING_STATES)) -> Column:
    return ((squeeze("status") == "approved") & is_in(F.lower(squeeze("approval")), approved)
            & ~F.arrays_overlap("codes", lit_list(sorted(blocking_states))) & squeeze("priority").isin("pass", "low"))


def deployable_rows(candidates: DataFrame) -> DataFrame:
    return deploy_rows(candidates.where(deployable()))


def _missing(cols: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.when(squeeze(c) == "", F.lit(c)) for c in cols]), lambda x: x.isNotNull())


DEPLOY_REQUIRED = ["id", "change_hash", *FIELDS]


def gate_metrics(candidates: DataFrame, deploy: DataFrame, report: DataFrame, roles: Sequence[str],
                 has_blocking_counts: bool = True) -> DataFrame:
    """All counts a gate needs, as one row; every part is a partial aggregate before it meets the others."""
    c = candidates.agg(
        F.count(F.lit(1)).alias("rows"), count_if(is_in(F.lower(squeeze("approval")), V.GATE_APPROVED)).alias("approved"),
        count_if(squeeze("status") == "pending").alias("pending"), count_if(squeeze("status") == "needs_review").alias("needs_review"),
        count_if(squeeze("priority").isin("high", "medium")).alias("high_or_medium"),
        count_if(F.size(_missing(["id", "change_hash"])) > 0).alias("identity_missing"))
    dup = (candidates.select(squeeze("id").alias("id")).where("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("k"))
           .agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicates")))
    d = deploy.agg(F.count(F.lit(1)).alias("deploy"), count_if(F.size(_missing(DEPLOY_REQUIRED)) > 0).alias("deploy_missing"),
                   count_if(~is_in(squeeze("role"), roles)).alias("deploy_bad_role"))
    r = report.select("section", "key", "n")
    in_states = (F.col("section") == "state") & is_in(F.col("key"), V.BLOCKING_STATES)
    in_issues = (F.col("section") == "blocking") if has_blocking_counts else (
        (F.col("section") == "issue") & ~is_in(F.col("key"), V.NON_BLOCKING_ISSUES))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    metric = lambda k: (F.col("section") == "metric") & (F.col("key") == k)
    rep = r.agg(total(metric("stage1Rows")).alias("stage1_rows"), total(metric("stage2Rows")).alias("stage2_rows"),
                total(metric("candidateRows")).alias("candidate_rows"), total(metric("removedFromStage1")).alias("removed"),
                total(in_states).alias("blocking_states"), total(in_issues).alias("blocking_issues"),
                total(F.col("section") == "issue").alias("issue_total"))
    parts = [melt(x, [], x.columns, cast="bigint") for x in (c, dup, d, rep)]
    names = [n for x in (c, dup, d, rep) for n in x.columns]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def release_gate(candidates: DataFrame, deploy: DataFrame, report: DataFrame, roles: Sequence[str] = tuple(V.ALLOWED_ROLES),
                 has_blocking_counts: bool = True, stage2_error: str = "") -> DataFrame:
    """The 13 criteria (ord, name, actual, target, passed); a blocker is a row with passed = false."""
    m = gate_metrics(candidates, deploy, report, roles, has_blocking_counts)
    c = lambda n: F.col(n)
    zero = lambda name, n: (name, c(n).cast("string"), F.lit("0"), c(n) == 0)
    rows = [
        ("stage2Readable", F.lit(str(not stage2_error).lower()), F.lit("true"), F.lit(not stage2_error)),
        ("rowCountAligned", F.concat_ws("/", "stage1_rows", "stage2_rows", "candidate_rows"), F.lit("stage1 == stage2 == candidates > 0"),
         (c("stage1_rows") > 0) & (c("stage1_rows") == c("stage2_rows")) & (c("stage2_rows") == c("candidate_rows")) & (c("candidate_rows") == c("rows"))),
        zero("noRemovedFromStage1", "removed"), zero("noBlockingStates", "blocking_states"), zero("noBlockingIssueCounts", "blocking_issues"),
        zero("noPendingRows", "pending"), zero("noNeedsReviewRows", "needs_review"),
        ("allRowsApproved", c("approved").cast("string"), c("rows").cast("string"), (c("rows") > 0) & (c("approved") == c("rows"))),
        ("deployRowsMatchStage1", c("deploy").cast("string"), c("stage1_rows").cast("string"), (c("stage1_rows") > 0) & (c("deploy") == c("stage1_rows"))),
        zero("candidateIdentityComplete", "identity_missing"), zero("candidateKeysUnique", "duplicates"),
        zero("deployFieldsComplete", "deploy_missing"), zero("deployRolesAllowed", "deploy_bad_role"),
    ]
    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(n).alias("name"), a.alias("actual"), t.alias("target"), p.alias("passed"))
                    for i, (n, a, t, p) in enumerate(rows, 1)])
    return m.select(F.explode(arr).alias("r")).select("r.*")


def gate_examples(candidates: DataFrame, k: int = 10) -> DataFrame:
    """First k rows per example kind, in source order."""
    kinds = compact(
        F.when(squeeze("status") == "pending", F.lit("pending")), F.when(squeeze("status") == "needs_review", F.lit("needsReview")),
        F.when(~is_in(F.lower(squeeze("approval")), V.GATE_APPROVED), F.lit("unapproved")),
        F.when(F.arrays_overlap("codes", lit_list(sorted(V.BLOCKING_STATES))), F.lit("blocking")),
        F.when(F.size(_missing(["id", "change_hash"])) > 0, F.lit("missingCandidateIdentity")))
    long = candidates.select(F.explode(kinds).alias("kind"), "ord", "id", "company", "title", "status", "priority", "approval")
    return top_k(long, ["kind"], ["ord"], k)


def triage_groups(candidates: DataFrame, groups: Mapping[str, Sequence[str]] = P.TRIAGE_GROUPS) -> DataFrame:
    """Rows in long form (triage group, matched codes); the non-blocking group takes only pass and low rows."""
    def matched(name: str, wanted: Sequence[str]) -> Column:
        hit = F.filter("codes", lambda x: x.isin(list(wanted)))
        ok = squeeze("priority").isin("pass", "low") if name == "non_blocking_context" else F.lit(True)
        return F.when(ok & (F.size(hit) > 0), F.struct(F.lit(name).alias("group"), hit.alias("matched")))

    arr = compact(*[matched(n, w) for n, w in groups.items()])
    return candidates.select("ord", "id", "company", "title", "priority", F.explode(arr).alias("g")).select(
        "ord", "id", "company", "title", "priority", "g.group", "g.matched")


def triage_report(candidates: DataFrame, groups: Mapping[str, Sequence[str]] = P.TRIAGE_GROUPS) -> DataFrame:
    """Rows per group and occurrences per (group, code); `code` is blank for the group total."""
    t = triage_groups(candidates, groups)
    keys = t.select("group", F.explode(F.concat(F.array(F.lit("")), F.col("matched"))).alias("code"))
    return keys.groupBy("group", "code").agg(F.count(F.lit(1)).alias("n"))


def triage_examples(candidates: DataFrame, k: int = 12) -> DataFrame:
    return top_k(triage_groups(candidates), ["group"], ["ord"], k)


@dataclass(frozen=True)
class RepairRules:
    roles: Sequence[str] = tuple(V.ALLOWED_ROLES)
    role_rules: Sequence[tuple] = tuple(P.ROLE_RULES)
    focus_by_role: Sequence[tuple] = tuple(P.FOCUS_BY_ROLE)
    focus_rules: Sequence[tuple] = tuple(V.REPAIR_FOCUS)
    keyword_rules: Sequence[tuple] = tuple(V.REPAIR_KEYWORDS)
    validation: StageRules = field(default_factory=StageRules)


REPAIR = RepairRules()


def repair_group(codes: Column) -> Column:
    sync = F.exists(codes, lambda x: x.startswith("stage2_") & (x != "stage2_pending"))
    return (F.when(sync, "stage2_sync").when(F.arrays_overlap(codes, lit_list(P.REPAIR_ROLE_CODES)), "role_mismatch")
            .when(F.arrays_overlap(codes, lit_list(P.TRIAGE_GROUPS["signal_extraction"])), "signal_extraction").otherwise("other"))


def first_match(rules, otherwise: Column) -> Column:
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise) if out is not None else otherwise


def repair_candidates(candidates: DataFrame, stage1: DataFrame, rules: RepairRules = REPAIR) -> DataFrame:
    """Suggested role, focus, keywords and summary for every row that needs review."""
    present = [c for c in ("detail_body", "tasks_text", "requirements_text", "preferred_text", "experience", "track") if c in stage1.columns]
    src = last_wins(stage1).select("id", F.col("company").alias("_company"), F.col("title").alias("_title"),
                                   *[F.col(c).alias(f"_{c}") for c in (*FIELDS, *present)])
    j = candidates.where(squeeze("status") == "needs_review").join(src, "id", "left")
    have = set(j.columns)
    src_col = lambda c: squeeze(f"_{c}") if f"_{c}" in have else F.lit("")
    pick = lambda c, alt: F.when(src_col(c) != "", src_col(c)).otherwise(squeeze(alt))
    j = j.withColumns({
        "cur_role": pick("role", "stage1_role"), "cur_focus": pick("focus", "stage1_focus"),
        "cur_keywords": pick("keywords", "stage1_keywords"), "cur_summary": pick("summary", "stage1_summary"),
        "title": pick("title", "title"), "group": repair_group(F.col("codes")),
        "_text": F.concat_ws(" ", *[src_col(c) for c in ("company", "title", *FIELDS, "detail_body", "tasks_text", "requirements_text",
                                                         "preferred_text")], squeeze("issue_summary"))})
    title, text = F.lower("title"), F.col("_text")
    pack = lambda role, conf, why: F.struct(role.alias("role"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"))
    kept = pack(F.when(is_in(F.col("cur_role"), rules.roles), F.col("cur_role")).otherwise(""), "low", P.ROLE_KEPT)
    role = first_match([(matches(title, [t]) & (matches(text, [x]) if x else F.lit(True)), pack(F.lit(r), conf, why))
                        for t, x, r, conf, why in rules.role_rules], kept)
    j = j.withColumn("_role", role)
    both, raw = F.concat_ws(" ", title, text), F.concat_ws(" ", "title", text)
    fpack = lambda f, why: F.struct(f.alias("focus"), F.lit(why).alias("reason"))
    ladder = [(is_in(F.col("_role.role"), rs) & (matches(title if only else both, [p]) if p else F.lit(True)), fpack(F.lit(f), why))
              for rs, only, p, f, why in rules.focus_by_role]
    ladder += [(matches(raw, [p]), fpack(F.lit(f), f"focus rule: {f}")) for p, f in rules.focus_rules]
    ladder += [(F.col("cur_focus") != "", fpack(F.col("cur_focus"), P.FOCUS_KEPT))]
    j = j.withColumn("_focus", first_match(ladder, fpack(F.lit(""), P.FOCUS_NONE)))
    found = F.array_distinct(compact(*[F.when(matches(text, [p]), F.lit(label)) for p, label in rules.keyword_rules])) if rules.keyword_rules else lit_list([])
    own = split_terms("cur_keywords")
    j = j.withColumn("_kw", F.slice(F.when(F.size(own) > 0, own).otherwise(found), 1, 8))
    focus_parts = F.transform(F.split(F.col("_focus.focus"), "[/,]+"), squeeze)
    parts = F.array_distinct(non_blank(F.concat(F.array(src_col("experience"), src_col("track")), focus_parts)))
    built = F.size(parts) >= 2
    j = j.withColumn("_sum", F.when(built, F.array_join(F.slice(parts, 1, 4), " / ")).otherwise(F.col("cur_summary")))
    sync = F.col("group") == "stage2_sync"
    complete = (F.col("_focus.focus") != "") & (F.size("_kw") > 0) & (F.col("_sum") != "")
    confidence = F.when(sync, "high").when(~complete, "low").when(F.col("_role.confidence") == "high", "high").otherwise("medium")
    why_summary = F.when(built, P.SUMMARY_BUILT).when(F.col("cur_summary") != "", P.SUMMARY_KEPT).otherwise(P.SUMMARY_NONE)
    why_kw = F.when(F.size(own) > 0, P.KEYWORDS_KEPT).otherwise(P.KEYWORDS_FOUND)
    rationale = F.substring(F.concat_ws(" / ", "_role.reason", "_focus.reason", why_kw, why_summary), 1, 240)
    return j.select(
        "ord", "id", "title", "priority", "codes", F.col("group").alias("repair_group"), F.lit("heuristic").alias("source"),
        F.when(sync, F.col("cur_role")).otherwise(F.col("_role.role")).alias("suggested_role"),
        F.when(sync, F.col("cur_focus")).otherwise(F.col("_focus.focus")).alias("suggested_focus"),
        F.array_join(F.when(sync, F.slice(own, 1, 8)).otherwise(F.col("_kw")), ", ").alias("suggested_keywords"),
        F.when(sync, F.col("cur_summary")).otherwise(F.col("_sum")).alias("suggested_summary"),
        confidence.alias("confidence"),
        F.when(sync, "resync_stage2_candidate").when(confidence != "low", "repair_then_review")
        .otherwise("model_or_human_review_required").alias("recommended_action"),
        F.when(sync, P.RESYNC_NOTE).otherwise(rationale).alias("rationale"))


def merge_model_repairs(repairs: DataFrame, model: DataFrame) -> DataFrame:
    """Filled values of an external repair table (id, role, focus, keywords, summary, confidence, rationale) win."""
    m = last_wins(model).select("id", *[F.col(c).alias(f"_m_{c}") for c in ("role", "focus", "keywords", "summary", "confidence", "rationale")],
                                F.lit(True).alias("_hit"))
    j = repairs.join(m, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    take = lambda c, old: F.when(hit & (squeeze(f"_m_{c}") != ""), squeeze(f"_m_{c}")).otherwise(F.col(old))
    conf = F.when(hit & F.lower(squeeze("_m_confidence")).isin("high", "medium", "low"), F.lower(squeeze("_m_confidence"))).otherwise(F.col("confidence"))
    return j.withColumns({
        "suggested_role": take("role", "suggested_role"), "suggested_focus": take("focus", "suggested_focus"),
        "suggested_keywords": take("keywords", "suggested_keywords"), "suggested_summary": take("summary", "suggested_summary"),
        "rationale": take("rationale", "rationale"), "source": F.when(hit, "model").otherwise(F.col("source")),
        "recommended_action": F.when(hit & conf.isin("high", "medium"), "repair_then_review").when(hit, "human_review_required")
        .otherwise(F.col("recommended_action")), "confidence": conf}).select(*repairs.columns)


def repair_effect(repairs: DataFrame, stage1: DataFrame, rules: StageRules = DEFAULT) -> DataFrame:
    """Blocking issue codes before and after the suggestion."""
    src = last_wins(stage1)
    sug = repairs.select("id", *[F.col(f"suggested_{c}").alias(f"_n_{c}") for c in FIELDS])
    j = sug.join(src, "id")
    before = quality_issues(j, rules, "_b").withColumn("before_codes", codes_of(blocking("_b"))).drop("_b")
    after = quality_issues(before.withColumns({c: F.col(f"_n_{c}") for c in FIELDS}), rules, "_a")
    res = after.select("id", "before_codes", codes_of(blocking("_a")).alias("after_codes"))
    out = repairs.join(res, "id", "left")
    b, a = F.coalesce("before_codes", lit_list([])), F.coalesce("after_codes", lit_list([]))
    effect = (F.when(F.size(a) == 0, "clears_blocking_issues").when(F.size(a) < F.size(b), "reduces_blocking_issues")
              .when(a == b, "no_change").otherwise("needs_more_review"))
    return out.withColumns({"before_codes": b, "after_codes": a, "after_count": F.size(a).cast("bigint"), "repair_effect": effect})


def apply_repairs(stage1: DataFrame, stage2: DataFrame, repairs: DataFrame, applied_at: str,
                  keyword_fallbacks: Mapping[str, str] | None = None) -> DataFrame:
    """New reviewed table: repair over current review over first stage, with a memo of where values came from."""
    j = with_stage2(stage1, stage2)
    r = last_wins(repairs).select("id", *[F.col(f"suggested_{c}").alias(f"_r_{c}") for c in FIELDS],
                                  F.col("source").alias("_src"), F.col("confidence").alias("_conf"),
                                  (F.col("repair_effect") if "repair_effect" in repairs.columns else F.lit("")).alias("_eff"), F.lit(True).alias("_hit"))
    j = j.join(r, "id", "left")
    hit, found = F.coalesce("_hit", F.lit(False)), F.coalesce("s2_found", F.lit(False))
    pick = lambda c: F.coalesce(*[F.nullif(squeeze(x), F.lit("")) for x in (f"_r_{c}", f"s2_{c}", c)], F.lit(""))
    j = j.withColumns({f"_v_{c}": pick(c) for c in FIELDS})
    manual = F.lit("")
    if keyword_fallbacks:
        manual = first_match([(F.col("id") == k, F.lit(v)) for k, v in keyword_fallbacks.items()], F.lit(""))
    use_manual = (F.col("_v_keywords") == "") & (manual != "")
    short = F.length("_v_summary") <= 4
    present = lambda c: squeeze(c) if c in stage1.columns else F.lit("")
    focus_parts = F.transform(F.split(F.col("_v_focus"), "[/,]"), squeeze)
    parts = F.array_distinct(non_blank(F.concat(F.array(present("experience"), present("track")), focus_parts)))
    built = F.array_join(F.slice(parts, 1, 4), " / ")
    fallback = F.when(F.length(squeeze("summary")) > 4, squeeze("summary")).when(built != "", built).otherwise(P.CHECKED_SUMMARY)
    memo = F.concat(
        F.when(hit, F.array(F.concat(F.lit("stage2 repair source="), "_src"), F.concat(F.lit("confidence="), "_conf"), F.concat(F.lit("effect="), "_eff")))
        .when(found, lit_list(["stage2 carry-forward"])).otherwise(lit_list(["stage2 pass-through from stage1"])),
        compact(F.when(use_manual, F.lit("manual keyword fallback")), F.when(F.col("_v_focus") == "", F.lit("missing focus after apply")),
                F.when(short, F.lit("summary fallback"))))
    return j.select(
        "ord", "id", squeeze("change_hash").alias("change_hash"), F.lit("approved").alias("status"), F.lit("pass").alias("priority"),
        F.array(F.lit("stage2_applied")).alias("codes"), F.lit(P.APPLIED_SUMMARY).alias("issue_summary"),
        *[squeeze(c).alias(f"stage1_{c}") for c in FIELDS],
        F.col("_v_role").alias("stage2_role"), F.col("_v_focus").alias("stage2_focus"),
        F.when(use_manual, manual).otherwise(F.col("_v_keywords")).alias("stage2_keywords"),
        F.when(short, fallback).otherwise(F.col("_v_summary")).alias("stage2_summary"),
        *[present(c).alias(c) for c in ("company", "title", "job_url", "last_seen_at")],
        F.concat(F.lit(f"{applied_at}; "), F.array_join(memo, "; ")).alias("memo"), F.lit(P.APPROVED_MARK).alias("approval"))
