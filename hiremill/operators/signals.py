"""Structured signals, section and row facets, focus choice, keyword rebuild, confidence gates, label validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.rank import first_per
from hiremill.functions.terms import (TERMS, TermRules, board_broad, board_focus, board_invalid, broad_focus, canonical_each, canonical_term, canonical_terms,
                                      generic_keyword, is_tool, keyword_candidates, signal_text, text_terms, unique_non_generic, weak_focus)
from hiremill.functions.text import (at, canon, compact, contains_any, empty_list, first_made, is_in, let, lit_list, lit_map, lst, matches, non_blank,
                                     ordered_distinct, s, squeeze)
from hiremill.rules import board as BR
from hiremill.rules import focus_ladder as FL
from hiremill.rules import signals as SR
from hiremill.rules import wording as WR

CATEGORIES = ["domain", "problem", "system", "model", "data", "workflow"]
KEY_OF = {f"{c}Signals": c for c in [*CATEGORIES, "role"]}
SECTIONS = ["detail_body", "tasks", "requirements", "preferred", "skills"]
SECTION_OF = {"detailBody": "detail_body", "tasks": "tasks", "requirements": "requirements", "preferred": "preferred", "skills": "skills"}


def _section_map(raw: Mapping) -> dict:
    return {SECTION_OF[k]: {f: [KEY_OF[c] for c in v.get(f, ())] for f in ("keyword", "tag", "context")} for k, v in raw.items()}


@dataclass(frozen=True)
class SignalRules:
    """Signal dictionary: per category an ordered list of (label, patterns), plus limits and focus tables."""

    terms: TermRules = field(default_factory=TermRules)
    rules: Mapping[str, Sequence[tuple]] = field(default_factory=lambda: {
        KEY_OF[k]: [(r["label"], tuple(r["patterns"])) for r in v] for k, v in SR.STRUCTURED_SIGNAL_RULES.items()})
    limits: Mapping[str, int] = field(default_factory=lambda: {KEY_OF.get(k, "notes"): v for k, v in SR.STRUCTURED_SIGNAL_LIMITS.items()})
    hints: Sequence[tuple] = tuple(SR.SUMMARY_HINT_LABELS)
    composites: Sequence[Mapping] = tuple(SR.FOCUS_COMPOSITE_RULES)
    focus_hints: Sequence[str] = tuple(SR.FOCUS_SIGNAL_HINTS)
    support: Mapping[str, Sequence[tuple]] = field(default_factory=lambda: dict(SR.FOCUS_KEYWORD_SUPPORT_RULES))
    priority: Sequence[tuple] = field(default_factory=lambda: [(KEY_OF[k], w) for k, w in SR.STRUCTURED_FOCUS_PRIORITY])
    projection_block: Sequence[str] = tuple(SR.RAW_SIGNAL_PROJECTION_BLOCKLIST)
    retry_broad: Sequence[str] = tuple(SR.BROAD_RETRY_FOCUS_LABELS)
    sections: Mapping[str, Mapping] = field(default_factory=lambda: _section_map(SR.SECTION_SIGNAL_CATEGORY_MAP))
    board_sections: Mapping[str, Mapping] = field(default_factory=lambda: _section_map(BR.SECTION_SIGNAL_STRUCTURED_MAP))
    ladder: Sequence[tuple] = tuple(FL.FOCUS_LADDER)
    board_hints: Sequence[Mapping] = tuple(BR.BOARD_FOCUS_HINTS)


SIGNALS = SignalRules()


def pattern_hit(text: Column, pattern: str) -> Column:
    """Latin patterns count only between non-alphanumerics, all others anywhere; the substring test comes first."""
    import re

    p = " ".join(pattern.lower().split())
    found = F.contains(text, F.lit(p))
    if re.fullmatch("[a-z0-9/+.-]+", p):
        # The literal comes first, so that the search runs from one occurrence to the next and tests the borders only there.
        return found & text.rlike("\\Q" + p + "\\E(?![a-z0-9])(?<![a-z0-9]\\Q" + p + "\\E)")
    return found


def any_hit(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | pattern_hit(text, p)
    return out


def rule_labels(text: Column, rules: Sequence[tuple]) -> Column:
    """Labels of a category whose patterns occur in the (lower-case) text, in rule order."""
    if not rules:
        return empty_list()
    return let(text, lambda x: compact(*[F.when(any_hit(x, ps), F.lit(label)) for label, ps in rules]))


def text_hints(text: Column, hints: Sequence[tuple]) -> Column:
    if not hints:
        return empty_list()
    return let(F.lower(text), lambda low: F.array_distinct(compact(*[F.when(F.contains(low, F.lit(p)), F.lit(label)) for p, label in hints])))


def composite_labels(text: Column, rules: Sequence[Mapping]) -> Column:
    if not rules:
        return empty_list()

    def found(low: Column) -> Column:
        out = []
        for r in rules:
            cond = low != ""
            for t in r.get("all", []):
                cond = cond & F.contains(low, F.lit(t.lower()))
            if r.get("any"):
                cond = cond & contains_any(low, [t.lower() for t in r["any"]])
            out.append(F.when(cond, F.lit(r["label"])))
        return F.array_distinct(compact(*out))

    return let(F.lower(text), found)


def joined_terms(summary: Column, keywords: Column, t: TermRules, canonical: bool = False) -> Column:
    """Canonical terms as one text; `canonical` keywords are so already."""
    terms = keywords if canonical else canonical_each(keywords, t)
    return F.array_join(non_blank(F.concat(F.array(canonical_term(summary, t)), terms)), " ")


def match_signals(rows: DataFrame, r: SignalRules = SIGNALS) -> DataFrame:
    """Adds `<category>_signals`, `role_signals`, `confidence_notes` to rows with cleaned lines (`c_*`).

    Given values (`m_<category>`, optional) come first and keep the rules of their category out.
    """
    have, t = set(rows.columns), r.terms
    given = {c: canonical_terms(f"m_{c}", r.limits[c], t) if f"m_{c}" in have else empty_list() for c in CATEGORIES}
    low = F.lower(squeeze("quality")).isin("low", "")
    roles = [lst("m_role")] if "m_role" in have else []
    roles += [F.array(s(c)) for c in ("item_role", "role_display", "role") if c in have]
    df = rows.withColumns({f"_g_{c}": v for c, v in given.items()})
    source = F.concat(F.array(s("title"), s("summary"), s("focus_label")), lst("keywords"), lst("c_detail"), lst("c_tasks"), lst("c_skills"))
    df = df.withColumn("_text", F.lower(signal_text(F.array_join(non_blank(source), " "), t)))
    base = {c: F.when(F.size(f"_g_{c}") > 0, F.col(f"_g_{c}")).otherwise(
        F.slice(F.array_distinct(rule_labels(F.col("_text"), r.rules.get(c, ()))), 1, r.limits[c])) for c in CATEGORIES}
    df = df.withColumns({f"_b_{c}": F.when(low, F.col(f"_g_{c}")).otherwise(v) for c, v in base.items()})
    # Focus, keywords and summary hints seed their own category; tools only while no real signal precedes them.
    label_of = {label: c for c, rules in r.rules.items() for label, _ in rules}
    # Each keyword is made canonical once; only seeds that are some rule's label go on.
    df = df.withColumn("_kw", canonical_each("keywords", t))
    near = F.concat(text_hints(signal_text("summary", t), r.hints), composite_labels(joined_terms(s("summary"), F.col("_kw"), t, True), r.composites))
    seeds = F.concat(F.array(canonical_term("focus_label", t)), F.col("_kw"), F.transform(near, lambda x: canonical_term(x, t)))
    known = F.filter(F.transform(seeds, lambda y, i: F.struct(y.alias("v"), i.alias("i"))), lambda x: is_in(x["v"], label_of))
    tagged = F.transform(known, lambda x: F.struct(x["v"].alias("v"), x["i"].alias("i"), (F.try_element_at(lit_map(label_of), x["v"]) if label_of else F.lit(None).cast("string")).alias("c"),
                                                   is_tool(x["v"], t).alias("t")))
    real = ("domain", "problem", "system", "workflow")
    empty = F.lit(True)
    for c in real:
        empty = empty & (F.size(f"_b_{c}") == 0)
    df = df.withColumn("_seeds", F.when(low, F.expr("cast(array() as array<struct<v:string,i:int,c:string,t:boolean>>)")).otherwise(tagged))
    first_real = F.coalesce(F.array_min(F.transform(F.filter("_seeds", lambda x: x["c"].isin(*real)), lambda x: x["i"])), F.lit(1 << 30))
    df = df.withColumn("_first", first_real)
    ok = lambda x: ~x["t"] | (empty & (x["i"] <= F.col("_first")))
    final = {c: F.slice(ordered_distinct(F.concat(F.col(f"_b_{c}"), F.transform(
        F.filter("_seeds", _in_category(c, ok)), lambda x: x["v"]))), 1, r.limits[c])
        for c in CATEGORIES}
    df = df.withColumns({f"{c}_signals": v for c, v in final.items()})
    role_list = ordered_distinct(F.transform(F.concat(*roles), lambda x: signal_text(x, t)), r.limits["role"]) if roles else empty_list()
    sparse = F.when(F.size(lst("c_detail")) + F.size(lst("c_tasks")) <= 1, F.lit("sparse_input_signal"))
    none = (F.size("domain_signals") == 0) & (F.size("problem_signals") == 0)
    notes = F.when(low, compact(F.lit("low_confidence"), sparse)).otherwise(compact(
        F.when((s("focus_label") != "") & broad_focus(canonical_term("focus_label", t), t), F.lit("broad_focus_input")),
        F.when(none, F.lit("missing_domain_problem_signal")),
        F.when((F.size("system_signals") > 0) & none, F.lit("system_only_signal")), sparse))
    out = df.withColumns({"role_signals": role_list, "confidence_notes": F.slice(notes, 1, r.limits.get("notes", 4))})
    return out.drop("_text", "_kw", "_seeds", "_first", *[f"_g_{c}" for c in CATEGORIES], *[f"_b_{c}" for c in CATEGORIES])


def _in_category(c: str, ok):
    return lambda x: (x["c"] == c) & ok(x)


def signals_long(rows: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Long form (keys, category, rank, label) for aggregation."""
    def tag(c: str) -> Column:
        return F.transform(lst(f"{c}_signals"), lambda x, i: F.struct(F.lit(c).alias("category"), (i + 1).cast("bigint").alias("rank"), x.alias("label")))

    arr = F.flatten(F.array(*[tag(c) for c in [*CATEGORIES, "role"]]))
    return rows.select(*keys, F.explode(arr).alias("s")).select(*keys, "s.category", "s.rank", "s.label")


def flat(categories: Sequence[str]) -> Column:
    return ordered_distinct(F.transform(F.concat(*[lst(f"{c}_signals") for c in categories]), squeeze)) if categories else empty_list()


FACETS = ("keyword", "tag", "context")
FACET_LIMITS = {"keyword": 4, "tag": 4, "context": 4}
BOARD_FACET_LIMITS = {"keyword": 6, "tag": 4, "context": 6}


def _facet_map(values: Mapping[str, Mapping[str, Column]]) -> Column:
    parts = []
    for section, facets in values.items():
        parts += [F.lit(section), F.struct(*[facets[f].alias(f) for f in FACETS])]
    return F.create_map(*parts)


def section_facets(rows: DataFrame, r: SignalRules = SIGNALS, given: str | None = None, out: str = "section_facets") -> DataFrame:
    """Section x facet lists: given ones when any is filled, else projected from the signal categories."""
    t = r.terms
    projected = {sec: {f: F.slice(canonical_terms(F.concat(*[lst(f"{c}_signals") for c in m[f]]), None, t), 1, FACET_LIMITS[f]) if m[f] else empty_list()
                       for f in FACETS} for sec, m in r.sections.items()}
    own = _facet_map(projected)
    if given and given in rows.columns:
        clean = lambda sec: F.struct(*[canonical_terms(F.try_element_at(F.col(given), F.lit(sec))[f], FACET_LIMITS[f], t).alias(f) for f in FACETS])
        parts = []
        for sec in r.sections:
            parts += [F.lit(sec), clean(sec)]
        m = F.create_map(*parts)
        df = rows.withColumn("_given", m)
        filled = F.exists(F.map_values("_given"), lambda v: (F.size(v["keyword"]) + F.size(v["tag"]) + F.size(v["context"])) > 0)
        return df.withColumn(out, F.when(filled, F.col("_given")).otherwise(own)).drop("_given")
    return rows.withColumn(out, own)


def board_section_facets(rows: DataFrame, r: SignalRules = SIGNALS, given: str | None = "section_facets", out: str = "board_facets") -> DataFrame:
    """Facets shown on the board: stored ones first, else signals of the section's categories; skills fall back to raw terms."""
    t = r.terms
    raw = F.concat(ordered_distinct(F.transform(lst("skills"), squeeze), 8),
                   F.flatten(F.transform(lst("skills"), lambda x: text_terms(x, s("company"), t))))
    values = {}
    for sec, m in r.board_sections.items():
        values[sec] = {}
        for f in FACETS:
            v = unique_non_generic(flat(m[f]), BOARD_FACET_LIMITS[f], t) if m[f] else empty_list()
            if sec == "skills" and f == "keyword":
                raw_terms = unique_non_generic(unique_non_generic(raw, 8, t), 6, t)
                v = F.when(F.size(v) > 0, v).otherwise(raw_terms)
            if given and given in rows.columns:
                stored = keyword_candidates(F.try_element_at(F.col(given), F.lit(sec))[f], 4, t)
                v = F.when(F.size(stored) > 0, stored).otherwise(v)
            values[sec][f] = v
    return rows.withColumn(out, _facet_map(values))


def row_facets(rows: DataFrame, r: SignalRules = SIGNALS) -> DataFrame:
    """Adds `f_role` (4), `f_keyword` (6), `f_tag` (4), `f_context` (6)."""
    t = r.terms
    return rows.withColumns({
        "f_role": ordered_distinct(F.transform(F.concat(lst("role_signals"), F.array(s("role"), s("role_group"))), squeeze), 4),
        "f_keyword": unique_non_generic(F.concat(flat(["problem", "model"]), F.array(s("focus_label")), lst("keywords")), 6, t),
        "f_tag": unique_non_generic(flat(["domain", "data"]), 4, t),
        "f_context": unique_non_generic(flat(["system", "workflow"]), 6, t)})


def _others(arr: Column, c: Column) -> Column:
    return F.exists(arr, lambda x: x != c)


def focus_label(role: Column, summary: Column, focus: Column, keywords: Column, context: Column, r: SignalRules = SIGNALS) -> Column:
    """Best focus among the given label, keywords, text hints and composite rules."""
    t = r.terms
    tag = lambda src, arr: F.transform(canonical_each(arr, t), lambda x: F.struct(F.lit(src).alias("s"), x.alias("v")))
    full = F.trim(F.concat_ws(" ", summary, context))
    pool = F.concat(tag("focus", non_blank(F.array(focus))), tag("keyword", keywords), tag("summary_hint", text_hints(signal_text(summary, t), r.hints)),
                    tag("context_hint", text_hints(signal_text(context, t), r.hints)),
                    tag("composite_hint", composite_labels(joined_terms(full, keywords, t), r.composites)))
    flagged = F.transform(F.filter(pool, lambda x: x["v"] != ""), lambda x, i: F.struct(
        x["v"].alias("v"), x["s"].alias("s"), i.alias("i"), broad_focus(x["v"], t).alias("b"), weak_focus(x["v"], t).alias("w"), is_tool(x["v"], t).alias("t")))

    def best(cands: Column) -> Column:
        specific = F.array_distinct(F.transform(F.filter(cands, lambda x: ~x["b"] & ~x["w"]), lambda x: x["v"]))
        serious = F.array_distinct(F.transform(F.filter(cands, lambda x: ~x["b"] & ~x["w"] & ~x["t"]), lambda x: x["v"]))
        # Summary and role are brought into shape once, not once for each candidate.
        summ, rol = F.lower(signal_text(summary, t)), F.lower(signal_text(role, t))
        return let(F.struct(cands.alias("c"), specific.alias("sp"), serious.alias("se"), summ.alias("summ"), rol.alias("rol")), rank)

    def rank(p: Column) -> Column:
        summ, rol = p["summ"], p["rol"]

        def score(x: Column) -> Column:
            v, low, src = x["v"], F.lower(x["v"]), x["s"]
            add = lambda cond, w: F.when(cond, w).otherwise(0.0)
            return (F.least(F.length(v), F.lit(18)) / 10 + add(F.contains(v, F.lit(" ")), 0.6) + add(v.rlike("[A-Z0-9]"), 0.6)
                    + add(contains_any(low, list(r.focus_hints)), 2.0) - add(x["t"], 1.6) + add((summ != "") & F.contains(summ, low), 0.4)
                    + add(src == "summary_hint", 1.2) - add((rol != "") & (low == rol), 1.5) - add(is_in(low, WR.FOCUS_MINUS), 0.8)
                    + add(src == "composite_hint", 1.4) + add(src == "context_hint", 0.9) + add((src == "focus") & ~x["b"], 0.9)
                    - F.when(x["b"] & _others(p["sp"], v), F.when(src == "focus", 2.9).otherwise(2.3)).otherwise(0.0)
                    - F.when(x["t"] & _others(p["se"], v), 2.4).when(x["t"] & (src == "focus"), 0.4).otherwise(0.0))

        firsts = F.filter(p["c"], lambda x: ~x["w"])
        # First mention of a label decides its source: smallest index per label, found by sorting, so that long keyword lists cost n log n.
        by_label = F.sort_array(F.transform(firsts, lambda x: F.struct(x["v"].alias("v"), x["i"].alias("i"), x["s"].alias("s"), x["b"].alias("b"), x["t"].alias("t"))))
        lead = let(by_label, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["v"] != x["v"])))
        return F.coalesce(F.array_min(F.transform(lead, lambda x: F.struct(F.round(-score(x), 9).alias("k"), F.length(x["v"]).alias("n"), x["v"].alias("v"))))["v"], F.lit(""))

    return let(flagged, best)


def choose_focus(rows: DataFrame, r: SignalRules = SIGNALS, out: str = "chosen_focus") -> DataFrame:
    """Needs role, summary, focus_label, keywords, context_text."""
    ctx = s("context_text") if "context_text" in rows.columns else F.lit("")
    return rows.withColumn(out, focus_label(s("role"), s("summary"), s("focus_label"), lst("keywords"), ctx, r))


def project_focus(current: Column, keywords: Column, r: SignalRules, board: bool = False) -> Column:
    """Best label of the structured categories, the current label standing in with a base weight."""
    t = r.terms
    clean = (lambda c: board_focus(c, t)) if board else (lambda c: canonical_term(c, t))
    bad = (lambda c: board_invalid(c, t)) if board else (lambda c: weak_focus(c, t))
    broad = (lambda c: board_broad(c, t)) if board else (lambda c: broad_focus(c, t))
    key = canon if board else (lambda c: c)
    cur = clean(current)
    kws = F.transform(keywords, key) if board else canonical_each(keywords, t)

    def tag(c: str, w: float) -> Column:
        return F.transform(lst(f"{c}_signals"), lambda x, i: F.struct(clean(x).alias("v"), (F.lit(float(w)) - i * F.lit(0.18)).alias("k")))

    def rank(p: Column) -> Column:
        good = F.filter(p["c"], lambda x: (x["v"] != "") & ~bad(x["v"]))
        scored = F.transform(good, lambda x: F.struct(x["v"].alias("v"), broad(x["v"]).alias("b"), (
            x["k"] + F.when(F.array_contains(p["kw"], key(x["v"])), 0.3).otherwise(0.0)
            + F.when((p["cur"] != "") & (x["v"] == p["cur"]), 0.45).otherwise(0.0) - F.when(broad(x["v"]), 1.35).otherwise(0.0)).alias("k")))
        own = F.when((p["cur"] != "") & ~bad(p["cur"]), F.array(F.struct(
            p["cur"].alias("v"), broad(p["cur"]).alias("b"), F.when(broad(p["cur"]), F.lit(1.9)).otherwise(4.2).alias("k"))))
        return let(F.struct(scored.alias("s"), F.coalesce(own, F.expr("cast(array() as array<struct<v:string,b:boolean,k:double>>)")).alias("o"), p["cur"].alias("cur")), final)

    def final(q: Column) -> Column:
        specific = F.exists(q["s"], lambda x: ~x["b"])
        return let(F.struct(F.concat(q["s"], q["o"]).alias("a"), specific.alias("sp"), q["cur"].alias("cur")), order)

    def order(q: Column) -> Column:
        ranked = F.array_sort(F.transform(q["a"], lambda x: F.struct(
            F.round(-(x["k"] - F.when(q["sp"] & x["b"], 1.15).otherwise(0.0)), 9).alias("k"), F.length(x["v"]).alias("n"), x["v"].alias("v"))))
        return F.coalesce(F.get(ranked, 0)["v"], q["cur"])

    pool = F.concat(*[tag(c, w) for c, w in r.priority])
    return let(F.struct(pool.alias("c"), kws.alias("kw"), cur.alias("cur")), rank)


def apply_projection(current: Column, projected: Column, r: SignalRules = SIGNALS) -> Column:
    """The projected label, unless it is blank, blocked next to a current one, or a step from specific to broad."""
    t = r.terms
    strong = sum((F.size(lst(f"{c}_signals")) for c in ("problem", "domain", "system", "workflow")), F.lit(0))
    blocked = is_in(projected, r.projection_block) & ((current != "") | (strong == 0))
    worse = (current != "") & ~broad_focus(current, t) & broad_focus(projected, t)
    return F.when((projected != "") & (projected != current) & ~blocked & ~worse, projected).otherwise(current)


def override_focus(current: Column, context: Column, r: SignalRules = SIGNALS) -> Column:
    """First context rule that applies to the current label; `context` is one evidence text per row."""
    def ladder(p: Column) -> Column:
        cur, low = p["cur"], p["low"]
        out = F.when((cur == "") | (low == ""), cur)
        for labels, groups, never, result in r.ladder:
            cond = is_in(cur, labels)
            for g in groups:
                cond = cond & contains_any(low, [x.lower() for x in g])
            if never:
                cond = cond & ~contains_any(low, [x.lower() for x in never])
            out = out.when(cond, cur if result is None else F.lit(result))
        return out.otherwise(cur)

    return let(F.struct(current.alias("cur"), F.lower(context).alias("low")), ladder)


def _hint_scores(text: Column, r: SignalRules) -> Column:
    best: dict[str, list] = {}
    for h in r.board_hints:
        best.setdefault(h["label"], []).append((h["patterns"], float(h["weight"])))
    items = []
    for label, specs in best.items():
        w = None
        for patterns, weight in sorted(specs, key=lambda x: -x[1]):
            cond = contains_any(text, [p.lower() for p in patterns])
            w = F.when(cond, weight) if w is None else w.when(cond, weight)
        items.append(F.when(w.isNotNull(), F.struct(F.lit(label).alias("v"), w.alias("k"))))
    return compact(*items) if items else F.expr("cast(array() as array<struct<v:string,k:double>>)")


def board_hint_scores(text: Column, r: SignalRules) -> Column:
    """(label, weight) of board hints found in the text, the best weight per label; the text is bound once."""
    return let(text, lambda x: _hint_scores(x, r))


def refine_focus(current: Column, keywords: Column, hint_text: Column, summary: Column, r: SignalRules = SIGNALS) -> Column:
    """Board refinement: current label, keywords and hints compete; broad labels yield to specific ones."""
    t = r.terms
    one = lambda v, hi, lo: F.struct(board_focus(v, t).alias("v"), F.when(board_broad(board_focus(v, t), t), lo).otherwise(hi).alias("k"))
    pool = F.concat(F.transform(non_blank(F.array(current)), lambda v: one(v, 4.2, 2.0)), F.transform(F.slice(keywords, 1, 5), lambda v: one(v, 2.6, 1.2)),
                    F.transform(board_hint_scores(hint_text, r), lambda x: F.struct(board_focus(x["v"], t).alias("v"), x["k"].alias("k"))))

    def rank(a: Column) -> Column:
        summ = F.lower(squeeze(summary))
        rivals = F.exists(a, lambda y: is_in(canon(y["v"]), [canon_py(x) for x in WR.SOFT_BROAD_RIVALS]))
        other = lambda x: F.exists(a, lambda y: ~board_broad(y["v"], t) & (y["v"] != x["v"]))
        scored = F.transform(a, lambda x: F.struct(F.round(-(
            x["k"] + F.when((summ != "") & F.contains(summ, F.lower(x["v"])), 0.45).otherwise(0.0)
            - F.when(board_broad(x["v"], t) & other(x), 1.6).otherwise(0.0)
            - F.when(is_in(canon(x["v"]), [canon_py(y) for y in WR.SOFT_BROAD]) & rivals, 0.8).otherwise(0.0)), 9).alias("k"),
            F.length(x["v"]).alias("n"), x["v"].alias("v")))
        return F.coalesce(F.get(F.array_sort(scored), 0)["v"], F.lit(""))

    return let(F.filter(pool, lambda x: ~board_invalid(x["v"], t)), rank)


def low_confidence_focus(hint_text: Column, r: SignalRules = SIGNALS, floor: float = 7.8) -> Column:
    """Focus for a low-quality row, only from a strong and specific hint."""
    t = r.terms
    pool = F.filter(F.transform(board_hint_scores(hint_text, r), lambda x: F.struct(board_focus(x["v"], t).alias("v"), x["k"].alias("k"))),
                    lambda x: ~board_invalid(x["v"], t))
    ranked = F.array_sort(F.transform(pool, lambda x: F.struct((-(x["k"] - F.when(board_broad(x["v"], t), 1.5).otherwise(0.0))).alias("k"),
                                                              F.length(x["v"]).alias("n"), x["v"].alias("v"))))
    return let(F.get(ranked, 0), lambda x: F.when(x.isNotNull() & (x["k"] <= -floor) & ~board_broad(x["v"], t), x["v"]).otherwise(F.lit("")))


ENGINEER_ROLES = tuple(WR.ROLE_NAMES[:2])


def business_dominant(c: Column, patterns: Sequence[str] = tuple(BR.ENGINEER_BUSINESS_DOMINANCE_PATTERNS),
                      block: Sequence[str] = tuple(BR.ENGINEER_FOCUS_BLOCKLIST)) -> Column:
    low = F.lower(squeeze(c))
    return (low != "") & (is_in(canon(c), [canon_py(b) for b in block]) | matches(low, patterns, False))


def canon_py(x: str) -> str:
    import re

    return re.sub("[^0-9a-z가-힣]+", "", x.lower())


def rebalance_focus(rows: DataFrame, roles: Sequence[str] = ENGINEER_ROLES, r: SignalRules = SIGNALS,
                    patterns: Sequence[str] = tuple(BR.ENGINEER_BUSINESS_DOMINANCE_PATTERNS),
                    block: Sequence[str] = tuple(BR.ENGINEER_FOCUS_BLOCKLIST)) -> DataFrame:
    """For technical roles a business-dominant focus gives way to the best technical signal; keywords are rebuilt (5)."""
    t = r.terms
    biz = lambda c: business_dominant(c, patterns, block)
    blocked = [canon_py(b) for b in [*block, *WR.REBALANCE_BLOCK]]
    fit = lambda c: ~board_invalid(c, t) & ~biz(c) & ~is_in(canon(c), blocked)
    previews = F.array_join(F.transform(F.slice(lst("preview_lines"), 1, 4), squeeze), " ") if "preview_lines" in rows.columns else F.lit("")
    evidence = F.lower(F.concat_ws(" ", squeeze("title"), squeeze("summary"), previews))

    def tag(c: str, w: float) -> Column:
        return F.transform(lst(f"{c}_signals"), lambda x, i: let(board_focus(x, t), lambda v: F.struct(v.alias("v"), (F.lit(float(w)) - i * F.lit(0.2)).alias("k"))))

    df = rows.withColumn("_ev", evidence)
    pool = F.filter(F.concat(*[tag(c, w) for c, w in WR.REBALANCE_PRIORITY]), lambda x: fit(x["v"]))
    scored = F.transform(pool, lambda x: F.struct(F.round(-(x["k"] + F.when(F.contains(F.col("_ev"), F.lower(x["v"])), 1.2).otherwise(0.0)), 9).alias("k"),
                                                 F.length(x["v"]).alias("n"), x["v"].alias("v")))
    hints = F.filter(F.transform(board_hint_scores(F.col("_ev"), r), lambda x: F.struct((-x["k"]).alias("k"), F.length(board_focus(x["v"], t)).alias("n"), board_focus(x["v"], t).alias("v"))),
                     lambda x: fit(x["v"]))
    df = df.withColumn("_best", F.get(F.array_sort(F.when(F.size(pool) > 0, scored).otherwise(hints)), 0)["v"])
    due = is_in(s("role"), roles) & (biz(s("focus_label")) | biz(F.coalesce(at(lst("keywords"), 1), F.lit("")))) & F.col("_best").isNotNull()
    kept = F.filter(F.transform(lst("keywords"), lambda k: board_focus(k, t)), lambda k: fit(k) & (canon(k) != canon("_best")))
    return df.withColumns({"keywords": F.when(due, F.slice(F.concat(F.array(F.col("_best")), kept), 1, 5)).otherwise(lst("keywords")),
                           "focus_label": F.when(due, F.col("_best")).otherwise(s("focus_label")), "rebalanced": due}).drop("_ev", "_best")


KEYWORD_SOURCES = ["problem", "domain", "data", "workflow", "system", "model"]


def keep_with_tool_cap(arr: Column, t: TermRules, limit: int = 5, tools: int = 2, others: int = 2) -> Column:
    """Ordered fold: once two tools and two other terms are kept, further tools are skipped."""
    start = F.struct(empty_list().alias("a"), F.lit(0).alias("t"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        tool = is_tool(x, t)
        skip = (F.size(acc["a"]) >= limit) | (tool & (acc["n"] >= others) & (acc["t"] >= tools))
        return F.when(skip, acc).otherwise(F.struct(F.concat(acc["a"], F.array(x)).alias("a"), (acc["t"] + F.when(tool, 1).otherwise(0)).alias("t"),
                                                    (acc["n"] + F.when(tool, 0).otherwise(1)).alias("n")))

    return F.aggregate(arr, start, step, lambda acc: acc["a"])


def rebuild_keywords(rows: DataFrame, r: SignalRules = SIGNALS, out: str = "keywords") -> DataFrame:
    """At most five keywords: focus, terms that support it, signals, then what was there."""
    t = r.terms
    focus = canonical_term("focus_label", t)
    signals = non_blank(F.transform(F.concat(*[lst(f"{c}_signals") for c in KEYWORD_SOURCES]), lambda x: canonical_term(x, t)))
    existing = non_blank(canonical_each("keywords", t))
    df = rows.withColumns({"_f": focus, "_s": signals, "_e": existing})
    text = F.lower(signal_text(F.concat_ws(" ", F.array_join(lst("c_detail"), " "), F.array_join(lst("c_tasks"), " "),
                                           F.array_join(F.slice(lst("c_skills"), 1, 6), " "), s("summary"), "_f", F.array_join("_e", " "), F.array_join("_s", " ")), t))
    df = df.withColumn("_t", text)
    support = [F.when((F.col("_f") == label) & contains_any(F.col("_t"), [p.lower() for p in ps]), F.lit(term))
               for label, specs in r.support.items() for ps, term in specs]
    pool = F.concat(F.array("_f"), compact(*support) if support else empty_list(), F.col("_s"), F.col("_e"))
    # A full list takes nothing more, so the fold rarely needs the whole pool.
    kept = lambda a: keep_with_tool_cap(F.filter(ordered_distinct(canonical_each(a, t)), lambda x: ~generic_keyword(x, t)), t)
    return df.withColumn(out, first_made(pool, kept, 5)).drop("_f", "_s", "_e", "_t")


def force_low(t: TermRules) -> Column:
    """Input too thin for a confident summary."""
    lines = sum((F.size(lst(f"c_{c}")) for c in ("detail", "tasks", "requirements", "preferred")), F.lit(0))
    skills, title, summ = F.size(lst("c_skills")), F.lower(signal_text("title", t)), signal_text("summary", t)
    return (((lines == 0) & (skills <= 1)) | ((lines <= 1) & (skills == 0)) | (title.rlike(WR.THIN_TITLE) & (lines <= 1))
            | (title.rlike(WR.RECRUIT_TITLE) & (skills <= 1) & ~summ.rlike(WR.RECRUIT_RESCUE)) | (summ.rlike(WR.THIN_SUMMARY) & (lines <= 1))
            | ((summ == "") & (F.size(lst("keywords")) <= 1) & (lines <= 1)))


def strong_input() -> Column:
    dt = F.size(lst("c_detail")) + F.size(lst("c_tasks"))
    sup, sk = F.size(lst("c_requirements")) + F.size(lst("c_preferred")), F.size(lst("c_skills"))
    return (dt >= 4) | ((dt >= 2) & (sk >= 2)) | ((sup >= 2) & (sk >= 2)) | (sk >= 4)


def context_text(t: TermRules) -> Column:
    return signal_text(F.array_join(F.concat(lst("c_detail"), lst("c_tasks")), " "), t)


def worth_retry(r: SignalRules) -> Column:
    """Rows a model should see once more."""
    t = r.terms
    focus, low, strong = canonical_term("focus_label", t), s("quality") == "low", strong_input()
    made = composite_labels(joined_terms(context_text(t), lst("keywords"), t), r.composites)
    missed = (F.size(made) > 0) & (focus != "") & ~F.array_contains(made, focus) & (is_in(focus, r.retry_broad) | weak_focus(focus, t))
    return ((low & strong) | (~low & (focus == "") & strong) | missed | ((F.size(made) > 0) & (focus == "") & ~low)
            | signal_text("summary", t).rlike(WR.RETRY_SUMMARY))


def confidence_gate(rows: DataFrame, r: SignalRules = SIGNALS) -> DataFrame:
    return rows.withColumns({"force_low": force_low(r.terms), "strong_input": strong_input(), "retry": worth_retry(r)})


def postprocess_labels(rows: DataFrame, r: SignalRules = SIGNALS) -> DataFrame:
    """The whole label pipeline on cleaned rows: focus, context override, confidence, signals, projection, facets, keywords."""
    t = r.terms
    df = rows.withColumn("keywords", F.transform(F.slice(lst("keywords"), 1, 6), lambda x: canonical_term(x, t))).withColumn("context_text", context_text(t))
    role = F.when(s("item_role") != "", s("item_role")).otherwise(s("role_display")) if "item_role" in rows.columns else s("role_display")
    df = df.withColumn("focus_label", F.substring(focus_label(role, s("summary"), s("focus_label"), F.col("keywords"), F.col("context_text"), r), 1, 24))
    full = signal_text(F.concat_ws(" ", s("title"), s("role_display"), "context_text", F.array_join(F.slice(lst("c_skills"), 1, 6), " "), s("summary"),
                                   F.array_join("keywords", " ")), t)
    df = df.withColumn("focus_label", F.when(s("quality") != "low", F.substring(override_focus(F.col("focus_label"), full, r), 1, 24)).otherwise(F.col("focus_label")))
    df = df.withColumn("_low", (s("quality") == "low") | force_low(t))
    blank = lambda c, empty: F.when(F.col("_low"), empty).otherwise(F.col(c))
    was_low = s("quality") == "low"
    df = df.withColumn("_was_low", was_low).withColumns({
        "summary": blank("summary", F.lit("")), "keywords": blank("keywords", empty_list()), "focus_label": blank("focus_label", F.lit("")),
        "quality": F.when(F.col("_low"), "low").otherwise(s("quality"))}).drop("_low")
    df = match_signals(df, r)
    projected = apply_projection(F.col("focus_label"), project_focus(F.col("focus_label"), lst("keywords"), r), r)
    df = df.withColumn("focus_label", F.when(F.col("_was_low"), F.col("focus_label")).otherwise(F.substring(projected, 1, 24)))
    df = section_facets(df, r, "m_section_facets" if "m_section_facets" in df.columns else None)
    rebuilt = rebuild_keywords(df, r, "_kw")
    return rebuilt.withColumn("keywords", F.when(F.col("_was_low"), F.col("keywords")).otherwise(F.col("_kw"))).drop("_kw", "_was_low")


def fill_missing_labels(rows: DataFrame, k: int = 6, detail_k: int = 4) -> DataFrame:
    """Focus falls back to the first facet keyword, then to signals; keyword lists to the first filled source."""
    first = lambda *arrs: F.coalesce(*[F.nullif(at(non_blank(F.transform(a, squeeze)), 1), F.lit("")) for a in arrs], F.lit(""))
    focus = F.when(squeeze("focus_label") != "", squeeze("focus_label")).otherwise(
        first(lst("f_keyword"), lst("problem_signals"), lst("domain_signals"), lst("data_signals"), lst("system_signals")))
    everything = F.concat(lst("keywords"), lst("f_keyword"), lst("f_tag"), lst("f_context"), *[lst(f"{c}_signals") for c in ("problem", "domain", "system", "data", "workflow")])
    shown = lambda a: ordered_distinct(F.transform(a, squeeze))
    return rows.withColumns({"filled_focus": focus, "filled_keywords": first_made(everything, shown, k), "detail_keywords": first_made(F.concat(F.array(focus), everything), shown, detail_k)})


QUALITIES = ["high", "medium", "low"]


def normalize_model_items(items: DataFrame, r: SignalRules = SIGNALS, ord_col: str = "ord") -> DataFrame:
    """External labels (id, role, summary, focus_label, keywords, quality, m_*) checked and reduced; first row per id wins."""
    t = r.terms
    # The first row of an id is chosen before anything is reduced: only rows that stay are worked on.
    first = first_per(items.withColumn("id", squeeze("id")).where("id <> ''"), ["id"], [ord_col])
    df = first.withColumns({"role": squeeze("role"), "summary": squeeze("summary"),
                            "keywords": canonical_terms("keywords", None, t), "focus_label": canonical_term("focus_label", t)})
    q = F.lower(squeeze("quality"))
    df = df.withColumn("quality", F.when(is_in(q, QUALITIES), q).when(F.col("summary") != "", "medium").otherwise("low"))
    df = df.withColumn("focus_label", focus_label(F.col("role"), F.col("summary"), F.col("focus_label"), F.col("keywords"), F.lit(""), r))
    low = F.col("quality") == "low"
    given = {f"m_{c}": canonical_terms(f"m_{c}", r.limits[c], t) for c in CATEGORIES if f"m_{c}" in items.columns}
    return df.withColumns({"summary": F.when(low, "").otherwise(F.col("summary")), "keywords": F.when(low, empty_list()).otherwise(F.slice("keywords", 1, 6)),
                           "focus_label": F.when(low, "").otherwise(F.substring("focus_label", 1, 24)), **given})


BLOCKED_LABELS = ["", "미분류", "unknown", "n/a", "none", "null"]


def normalize_enrichment(items: DataFrame) -> DataFrame:
    """Enrichment values from outside: placeholders become blank, lists distinct."""
    one = lambda c: F.when(is_in(F.lower(squeeze(c)), BLOCKED_LABELS), "").otherwise(squeeze(c))
    many = lambda c: ordered_distinct(F.filter(F.transform(lst(c), squeeze), lambda x: ~is_in(F.lower(x), BLOCKED_LABELS)))
    return items.withColumns({"experience_label": one("experience_label"), "reviewer_note": one("reviewer_note"),
                              "track_labels": many("track_labels"), "focus_labels": many("focus_labels"), "skills": many("skills")})


def normalize_tone_items(items: DataFrame, ord_col: str = "ord") -> DataFrame:
    df = items.withColumns({"tone": squeeze("tone"), "description": squeeze("description")})
    df = df.where("tone <> '' and description <> ''").withColumn("description", F.substring("description", 1, 120))
    return first_per(df, ["tone"], [ord_col])
