"""Checked queries for text cleaning, signals and classification (groups B and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill.functions.terms import TermRules, canonical_terms
from hiremill.functions.text import empty_list, join_list, lst
from hiremill.operators import classify as K
from hiremill.operators import lines as L
from hiremill.operators import signals as S
from hiremill.plans.adapters import POSTING_SQL, posting_doc
from hiremill.plans.base import query, table

# Rule tables made of words that occur in the documents.
TERMS = TermRules(
    inline=(("thatin", "Thatin"), ("\\bononst\\b", "Ononst")), canonical={"thatin": "Thatin", "inoran": "Thatin"}, generic=("^ertion$", "^retion$"),
    weak_suffixes=("ing",), weak_focus_patterns=("^error",), weak_focus_terms=("attion",), broad=("click", "hehely"), tools=("purchase", "orantion", "hetion"),
    board_canonical={"click": "Clicks"}, board_broad=("view",), board_generic=("error",), bad_suffixes=("ly",), stop_words=("the", "and"), role_names=("en",))
LINES = L.LineRules(
    terms=TERMS, noise=("^the ",), detail_noise=("^ein ",), field_noise=("^as",), fragments=(), hints=("thanea",), hint_words="",
    bonuses=(("(tion|ing)", 4.5), ("[0-9]", 1.6)), wish_penalty=("(with|und)", 0.6), penalties=(("(the|der)", 2.4),), drop_always=("^of ", "http"),
    drop_unhinted=("stupid",), drop_wish=("[0-9]",), drop_tasks=("^(and|is) ",), detail_breaks="", field_breaks="")

SEG_SQL = POSTING_SQL + """,
seg0 AS (SELECT id, unnest(s) AS raw, generate_subscripts(s, 1) AS pos FROM (SELECT id, regexp_split_to_array(
  regexp_replace(regexp_replace(detail_body, '\\s+[·•▪]\\s+', chr(10), 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS s FROM posting)),
seg1 AS (SELECT id, pos, trim(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '(?i)thatin', 'Thatin', 'g'),
  '(?i)\\bononst\\b', 'Ononst', 'g'), ' -–—·•▪*') AS v FROM seg0),
seg AS (SELECT *, contains(lower(v), 'thanea') AS h, regexp_replace(lower(v), '[^0-9a-z가-힣]+', '', 'g') AS k FROM seg1 WHERE v <> '')"""
SCORE_SQL = """round(CASE WHEN h THEN 8.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(v), 'tion|ing') THEN 4.5 ELSE 0.0 END
  + CASE WHEN regexp_matches(v, '[0-9]') THEN 1.6 ELSE 0.0 END - CASE WHEN regexp_matches(lower(v), 'the|der') AND NOT h THEN 2.4 ELSE 0.0 END
  + CAST(least(length(v), 90) AS DOUBLE) / 90, 9)"""
NOISE_SQL = "(length(v) <= 2 OR regexp_matches(v, '^(the |ein )'))"


@query("b5_clean_detail", "WITH " + SEG_SQL + f"""
, kept AS (SELECT id, v, k, pos, {SCORE_SQL} AS sc FROM seg WHERE NOT (({NOISE_SQL} AND NOT h) OR regexp_matches(v, '^as'))
  QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY pos) = 1)
SELECT p.id, coalesce(x.lines, '') AS lines FROM posting p LEFT JOIN (SELECT id, string_agg(v, chr(10) ORDER BY rk) AS lines FROM (
  SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY sc DESC, pos) AS rk FROM kept) WHERE rk <= 6 GROUP BY id) x ON x.id = p.id""")
def b5(spark, sf):
    p = posting_doc(spark, sf)
    return p.select("id", F.array_join(L.clean_detail("detail_body", 6, LINES), "\n").alias("lines"))


@query("b5_clean_tasks", "WITH " + SEG_SQL + f"""
, kept AS (SELECT id, v, k, pos, {SCORE_SQL} AS sc FROM seg WHERE NOT ((({NOISE_SQL} AND NOT h OR regexp_matches(v, '^as')) AND NOT h)
    OR regexp_matches(lower(v), '^of |http') OR v LIKE '%ing' OR (NOT h AND contains(v, 'stupid')) OR regexp_matches(lower(v), '^(and|is) ') OR length(k) <= 4)
  QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY pos) = 1)
SELECT p.id, coalesce(x.lines, '') AS lines FROM posting p LEFT JOIN (SELECT id, string_agg(v, chr(10) ORDER BY rk) AS lines FROM (
  SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY sc DESC, pos) AS rk FROM kept) WHERE rk <= 5 GROUP BY id) x ON x.id = p.id""")
def b5t(spark, sf):
    p = posting_doc(spark, sf)
    return p.select("id", F.array_join(L.clean_field("tasks", "tasks", 5, LINES), "\n").alias("lines"))


CANON_SQL = POSTING_SQL + """,
ct AS (SELECT *, list_transform(skills, lambda x: CASE WHEN x = 'inoran' THEN 'Thatin' WHEN x = 'ononst' THEN 'Ononst' ELSE replace(x, 'thatin', 'Thatin') END) AS c0 FROM posting),
ct1 AS (SELECT *, list_filter(c0, lambda x: x NOT IN ('ertion', 'retion') AND NOT x LIKE '%ing') AS c1 FROM ct),
terms AS (SELECT *, list_filter(c1, lambda x, i: list_position(c1, x) = i) AS c2 FROM ct1)"""


@query("b6_canonicalize_terms", "WITH " + CANON_SQL + " SELECT id, array_to_string(c2[1:10], '|') AS terms FROM terms")
def b6(spark, sf):
    return posting_doc(spark, sf).select("id", join_list(canonical_terms("skills", 10, TERMS)).alias("terms"))


DISPLAY = L.DisplayRules(
    terms=TERMS, noise=("^the ",), drop=("^and ",), as_terms=("[0-9]",), bad_tokens=("stupid",), admin=("tion",), nav=("http",), duty=("ing", "ment"),
    role_nouns=("ble",), meta_words="(zu|ion)", struct_meta_words="(zu|ion)", office_words="(den|une)", duty_words="(ation|chen)", prefixes=("^Is ", "^Er "),
    clauses=",", verbs="(tion|ing|en)", summary_verbs="(tion|ing)", summary_bad=("^[0-9]",), summary_endings=("is.",), indistinct=("thatin",))


@query("b7_display_lines")
def b7(spark, sf):
    d = L.display_lines(posting_doc(spark, sf), DISPLAY)
    return d.select("id", "detail_body", *[join_list(c, "\n").alias(c) for c in ("tasks", "requirements", "preferred")])


@query("b8_preview_lines")
def b8(spark, sf):
    return L.preview_lines(posting_doc(spark, sf), DISPLAY).select("id", join_list("preview_lines", "\n").alias("preview_lines"), "detail_line_count")


@query("b8_detail_line_count", "WITH " + POSTING_SQL + """,
dl AS (SELECT id, tasks, list_distinct(list_transform(tasks, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS d FROM posting),
dc AS (SELECT id, tasks, len(list_filter(d, lambda x: length(x) > 2 AND NOT starts_with(x, 'the '))) AS n FROM dl)
SELECT d.id, CASE WHEN n > 0 THEN n ELSE len(p.tasks) + len(p.requirements) + len(p.preferred) END AS detail_line_count FROM dc d JOIN posting p ON p.id = d.id""")
def b8c(spark, sf):
    return L.preview_lines(posting_doc(spark, sf), DISPLAY).select("id", "detail_line_count")


@query("b9_flag_sparse_postings")
def b9(spark, sf):
    return L.flag_sparse_postings(posting_doc(spark, sf), DISPLAY).select("id", "meta_lines", "duty_lines", "sparse")


@query("b10_choose_display_summary", "WITH " + POSTING_SQL + """,
s0 AS (SELECT id, role, keywords, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS sm, substring(trim(regexp_replace(regexp_replace(title, '^\\[[^\\]]+\\]\\s*', ''), '\\s+', ' ', 'g')), 1, 64) AS t,
  array_to_string(keywords[1:2], ' · ') AS ph FROM posting),
s1 AS (SELECT *, sm = '' OR length(sm) > 42 OR sm LIKE '%is.' OR regexp_matches(sm, '^[0-9]')
    OR (len(list_filter(keywords, lambda k: length(k) >= 3 AND k <> 'thatin')) = 0 AND length(sm) <= 18) AS bad,
  length(regexp_replace(lower(t), '[^0-9a-z가-힣]+', '', 'g')) <= 6 OR regexp_matches(t, '(?i)\\b(sr\\.?|staff|senior|principal)\\b')
    OR (regexp_matches(t, '(?i)(engineer|developer|researcher|scientist|analyst)') AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= greatest(6, length(t) // 4)) AS bt FROM s0)
SELECT id, CASE WHEN NOT bad THEN sm WHEN ph <> '' AND bt THEN ph WHEN t <> '' AND NOT bt THEN t WHEN ph <> '' THEN ph WHEN role <> '' THEN role ELSE sm END AS display_summary FROM s1""")
def b10(spark, sf):
    p = posting_doc(spark, sf).withColumn("preview_lines", empty_list())
    return L.choose_display_summary(p, DISPLAY).select("id", "display_summary")


SIG = S.SignalRules(
    terms=TERMS,
    rules={"domain": [("Worth", ("worthless", "stupid")), ("Der", ("der",)), ("Que", ("que", "qui"))], "problem": [("Tion", ("thtion", "ontion")), ("Inoran", ("inoran",))],
           "system": [("Ment", ("ment",)), ("Eau", ("eau",))], "model": [("view", ("view",)), ("Ing", ("oning",))], "data": [("hetion", ("hetion",)), ("purchase", ("purchase",))],
           "workflow": [("attion", ("attion",))]},
    limits={"domain": 2, "problem": 2, "system": 1, "model": 2, "data": 2, "workflow": 1, "role": 3, "notes": 4},
    hints=(("thtion", "Tion"), ("thanea", "Hint"), ("ono", "Ono")), composites=({"label": "Both", "all": ["the"], "any": ["tion", "ing"]}, {"label": "hehely", "any": ["ein"]}),
    focus_hints=("tion", "clic"), support={"click": [(["tion"], "Support"), (["zzz"], "Never")], "view": [(["the"], "Seen")]},
    priority=(("problem", 9.2), ("domain", 8.1), ("data", 7.4), ("system", 6.6), ("workflow", 5.8), ("model", 4.8)),
    projection_block=("view",), retry_broad=("click",), ladder=((["click"], [["ing"], ["tion"]], ["stupid"], "Clicking"), (["view"], [["der"]], [], ""), (["view"], [], [], None)),
    board_hints=({"label": "Tion", "patterns": ["thtion"], "weight": 8.0}, {"label": "view", "patterns": ["ein"], "weight": 9.0}, {"label": "Ing", "patterns": ["inging", "oning"], "weight": 7.0}))


def cleaned(spark, sf):
    """Rows with their cleaned lists: all lines of the text, its long lines as tasks and all long words as skills."""
    p = posting_doc(spark, sf)
    return p.withColumns({"c_detail": F.col("tasks"), "c_tasks": F.col("requirements"), "c_requirements": empty_list(), "c_preferred": empty_list(),
                          "c_skills": F.col("skills"), "m_model": F.when(F.col("n_chars") % 5 == 0, F.array(F.lit("given"), F.lit("ertion"), F.lit("given"))).otherwise(empty_list())})


def sig(name, col="txt"):
    return f"regexp_matches({col}, '(^|[^a-z0-9]){name}([^a-z0-9]|$)')"


SIG_SQL = POSTING_SQL + """,
sg0 AS (SELECT *, lower(regexp_replace(concat_ws(' ', nullif(title, ''), nullif(summary, ''), nullif(focus_label, ''), nullif(array_to_string(keywords, ' '), ''), nullif(array_to_string(tasks, ' '), ''), nullif(array_to_string(requirements, ' '), ''), nullif(array_to_string(skills, ' '), '')), '\\s+', ' ', 'g')) AS txt,
  lower(summary) AS sml, quality = 'low' AS low FROM posting),
kw0 AS (SELECT *, list_transform(keywords, lambda x: CASE WHEN x = 'inoran' THEN 'Thatin' WHEN x = 'ononst' THEN 'Ononst' ELSE replace(x, 'thatin', 'Thatin') END) AS ckw FROM sg0),
kw1 AS (SELECT *, lower(concat_ws(' ', nullif(trim(summary, ' -–—·•▪*'), ''), nullif(array_to_string(ckw, ' '), ''))) AS joined FROM kw0),
sg1 AS (SELECT *,
  list_filter([CASE WHEN """ + sig("worthless") + " OR " + sig("stupid") + " THEN 'Worth' END, CASE WHEN " + sig("der") + " THEN 'Der' END, CASE WHEN " + sig("que") + " OR " + sig("qui") + """ THEN 'Que' END], lambda x: x IS NOT NULL)[1:2] AS bdom,
  list_filter([CASE WHEN """ + sig("thtion") + " OR " + sig("ontion") + " THEN 'Tion' END, CASE WHEN " + sig("inoran") + """ THEN 'Inoran' END], lambda x: x IS NOT NULL) AS bpro,
  list_filter([CASE WHEN """ + sig("ment") + " THEN 'Ment' END, CASE WHEN " + sig("eau") + """ THEN 'Eau' END], lambda x: x IS NOT NULL)[1:1] AS bsys,
  CASE WHEN n_chars % 5 = 0 THEN ['given'] ELSE list_filter([CASE WHEN """ + sig("view") + " THEN 'view' END, CASE WHEN " + sig("oning") + """ THEN 'Ing' END], lambda x: x IS NOT NULL) END AS bmod,
  list_filter([CASE WHEN """ + sig("hetion") + " THEN 'hetion' END, CASE WHEN " + sig("purchase") + """ THEN 'purchase' END], lambda x: x IS NOT NULL) AS bdat,
  list_filter([CASE WHEN """ + sig("attion") + """ THEN 'attion' END], lambda x: x IS NOT NULL) AS bwor,
  [focus_label] || ckw || list_filter([CASE WHEN contains(sml, 'thtion') THEN 'Tion' END, CASE WHEN contains(sml, 'thanea') THEN 'Hint' END, CASE WHEN contains(sml, 'ono') THEN 'Ono' END], lambda x: x IS NOT NULL)
    || list_filter([CASE WHEN contains(joined, 'the') AND (contains(joined, 'tion') OR contains(joined, 'ing')) THEN 'Both' END, CASE WHEN contains(joined, 'ein') THEN 'hehely' END], lambda x: x IS NOT NULL) AS seeds FROM kw1),
sg2 AS (SELECT *, list_filter(list_transform(seeds, lambda x, i: {'v': x, 'i': i, 'c': CASE WHEN x IN ('Worth', 'Der', 'Que') THEN 'domain' WHEN x IN ('Tion', 'Inoran') THEN 'problem'
    WHEN x IN ('Ment', 'Eau') THEN 'system' WHEN x IN ('view', 'Ing') THEN 'model' WHEN x IN ('hetion', 'purchase') THEN 'data' WHEN x = 'attion' THEN 'workflow' END, 't': x IN ('purchase', 'orantion', 'hetion')}),
    lambda x: x.c IS NOT NULL) AS tagged, len(bdom) + len(bpro) + len(bsys) + len(bwor) = 0 AS empt FROM sg1),
sg3 AS (SELECT *, coalesce(list_min(list_transform(list_filter(tagged, lambda x: x.c IN ('domain', 'problem', 'system', 'workflow')), lambda x: x.i)), 1000000) AS fr FROM sg2),
sg4 AS (SELECT *, list_filter(tagged, lambda x: NOT x.t OR (empt AND x.i <= fr)) AS ok FROM sg3),
sg5 AS (SELECT *, bdom || list_transform(list_filter(ok, lambda x: x.c = 'domain'), lambda x: x.v) AS ld, bpro || list_transform(list_filter(ok, lambda x: x.c = 'problem'), lambda x: x.v) AS lp,
  bsys || list_transform(list_filter(ok, lambda x: x.c = 'system'), lambda x: x.v) AS ls, bmod || list_transform(list_filter(ok, lambda x: x.c = 'model'), lambda x: x.v) AS lm,
  bdat || list_transform(list_filter(ok, lambda x: x.c = 'data'), lambda x: x.v) AS la, bwor || list_transform(list_filter(ok, lambda x: x.c = 'workflow'), lambda x: x.v) AS lw FROM sg4),
signals AS (SELECT *, CASE WHEN low THEN [] ELSE list_filter(ld, lambda x, i: list_position(ld, x) = i)[1:2] END AS domain_signals,
  CASE WHEN low THEN [] ELSE list_filter(lp, lambda x, i: list_position(lp, x) = i)[1:2] END AS problem_signals, CASE WHEN low THEN [] ELSE list_filter(ls, lambda x, i: list_position(ls, x) = i)[1:1] END AS system_signals,
  CASE WHEN low THEN CASE WHEN n_chars % 5 = 0 THEN ['given'] ELSE [] END ELSE list_filter(lm, lambda x, i: list_position(lm, x) = i)[1:2] END AS model_signals,
  CASE WHEN low THEN [] ELSE list_filter(la, lambda x, i: list_position(la, x) = i)[1:2] END AS data_signals, CASE WHEN low THEN [] ELSE list_filter(lw, lambda x, i: list_position(lw, x) = i)[1:1] END AS workflow_signals FROM sg5)"""
SIG_COLS = [f"{c}_signals" for c in S.CATEGORIES]


def signal_rows(spark, sf):
    return S.match_signals(cleaned(spark, sf), SIG)


@query("f1_match_signals", "WITH " + SIG_SQL + " SELECT id, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in SIG_COLS) + """,
  array_to_string(CASE WHEN low THEN list_filter(['low_confidence', sprs], lambda x: x IS NOT NULL) ELSE list_filter([CASE WHEN focus_label IN ('click', 'hehely') THEN 'broad_focus_input' END,
    CASE WHEN len(domain_signals) + len(problem_signals) = 0 THEN 'missing_domain_problem_signal' END,
    CASE WHEN len(domain_signals) + len(problem_signals) = 0 AND len(system_signals) > 0 THEN 'system_only_signal' END, sprs], lambda x: x IS NOT NULL) END, '|') AS notes,
  array_to_string(list_distinct([upper(role), role]), '|') <> '' AS has_role
FROM (SELECT *, CASE WHEN len(tasks) + len(requirements) <= 1 THEN 'sparse_input_signal' END AS sprs FROM signals)""")
def f1(spark, sf):
    m = signal_rows(spark, sf)
    return m.select("id", *[join_list(c).alias(c) for c in SIG_COLS], join_list("confidence_notes").alias("notes"), (F.size("role_signals") > 0).alias("has_role"))


@query("f1_signals_long", "WITH " + SIG_SQL + """
SELECT category, label, count(*) AS n FROM (SELECT 'domain' AS category, unnest(domain_signals) AS label FROM signals UNION ALL SELECT 'problem', unnest(problem_signals) FROM signals
  UNION ALL SELECT 'system', unnest(system_signals) FROM signals UNION ALL SELECT 'model', unnest(model_signals) FROM signals UNION ALL SELECT 'data', unnest(data_signals) FROM signals
  UNION ALL SELECT 'workflow', unnest(workflow_signals) FROM signals) GROUP BY ALL""")
def f1l(spark, sf):
    return S.signals_long(signal_rows(spark, sf)).where("category <> 'role'").groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))


SECTION_RULES = {"detail_body": {"keyword": ["problem", "domain"], "tag": ["domain", "data"], "context": ["system", "workflow", "model"]},
                 "tasks": {"keyword": ["problem", "workflow"], "tag": ["domain"], "context": ["system", "workflow"]}}


def uniq(expr, k, alias):
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)[1:{k}] AS {alias}"


@query("f2_section_facets", "WITH " + SIG_SQL + ", g AS (SELECT id, list_filter(problem_signals || domain_signals, lambda x: true) AS a, domain_signals || data_signals AS b, system_signals || workflow_signals || model_signals AS c, "
       "problem_signals || workflow_signals AS d FROM signals) SELECT id, 'detail_body' AS section, array_to_string(a[1:4], '|') AS keyword, array_to_string(b[1:4], '|') AS tag, array_to_string(c[1:4], '|') AS context FROM g "
       "UNION ALL SELECT g.id, 'tasks', array_to_string(d[1:4], '|'), array_to_string(s.domain_signals[1:4], '|'), array_to_string((s.system_signals || s.workflow_signals)[1:4], '|') FROM g JOIN signals s ON s.id = g.id")
def f2(spark, sf):
    import dataclasses

    rules = dataclasses.replace(SIG, sections=SECTION_RULES, terms=dataclasses.replace(TERMS, inline=(), canonical={}, generic=(), weak_suffixes=()))
    m = S.section_facets(signal_rows(spark, sf), rules)
    return m.select("id", F.explode(F.map_filter("section_facets", lambda k, v: k.isNotNull())).alias("section", "v")).select("id", "section", *[join_list(F.col(f"v.{f}")).alias(f) for f in S.FACETS])


ROWFACET_SQL = SIG_SQL + """,
rf0 AS (SELECT *, [upper(role), role] AS r0, problem_signals || model_signals || [focus_label] || keywords AS k0, domain_signals || data_signals AS t0, system_signals || workflow_signals AS x0 FROM signals),
rf1 AS (SELECT *, list_filter(k0, lambda x: x <> '' AND lower(x) <> 'error' AND NOT lower(x) LIKE '%ly') AS k1 FROM rf0),
facets AS (SELECT *, r0 AS f_role, list_filter(k1, lambda x, i: list_position(k1, x) = i)[1:6] AS f_keyword, t0[1:4] AS f_tag, x0[1:6] AS f_context FROM rf1)"""


@query("f3_row_facets", "WITH " + ROWFACET_SQL + " SELECT id, array_to_string(f_role, '|') AS f_role, array_to_string(f_keyword, '|') AS f_keyword, array_to_string(f_tag, '|') AS f_tag, array_to_string(f_context, '|') AS f_context FROM facets")
def f3(spark, sf):
    m = facet_rows(spark, sf)
    return m.select("id", *[join_list(c).alias(c) for c in ("f_role", "f_keyword", "f_tag", "f_context")])


def facet_rows(spark, sf):
    return S.row_facets(signal_rows(spark, sf).withColumn("role_group", F.col("role")), SIG)


@query("f4_choose_focus", "WITH " + SIG_SQL + """,
cf0 AS (SELECT id, role, summary, trim(regexp_replace(summary, '\\s+', ' ', 'g'), ' -–—·•▪*') AS sm0, focus_label, ckw, list_filter([{'s': 'focus', 'v': focus_label}], lambda x: x.v <> '') || list_transform(ckw, lambda x: {'s': 'keyword', 'v': x})
  || list_transform(seeds[len(ckw) + 2:], lambda x: {'s': CASE WHEN x IN ('Both', 'hehely') THEN 'composite_hint' ELSE 'summary_hint' END, 'v': x}) AS pool FROM sg1),
cf1 AS (SELECT id, role, lower(replace(replace(sm0, 'thatin', 'Thatin'), 'ononst', 'Ononst')) AS sml, unnest(pool) AS p, generate_subscripts(pool, 1) AS i FROM cf0),
cf2 AS (SELECT id, role, sml, p.s AS s, p.v AS v, i, p.v IN ('click', 'hehely') AS b, p.v IN ('purchase', 'orantion', 'hetion') AS t,
  p.v IN ('ertion', 'retion') OR lower(p.v) LIKE '%ing' OR lower(p.v) LIKE 'error%' OR lower(p.v) = 'attion' OR length(regexp_replace(lower(p.v), '[^0-9a-z]', '', 'g')) <= 1 AS w FROM cf1),
sp AS (SELECT id, list(DISTINCT v) FILTER (NOT b AND NOT w) AS sp, list(DISTINCT v) FILTER (NOT b AND NOT w AND NOT t) AS se FROM cf2 GROUP BY id),
cf3 AS (SELECT c.*, len(list_filter(coalesce(sp, []), lambda y: y <> v)) > 0 AS os, len(list_filter(coalesce(se, []), lambda y: y <> v)) > 0 AS oe FROM cf2 c JOIN sp USING (id)
  WHERE NOT w QUALIFY row_number() OVER (PARTITION BY id, v ORDER BY i) = 1),
cf4 AS (SELECT id, v, round(-(least(length(v), 18) / 10 + CASE WHEN contains(v, ' ') THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(v, '[A-Z0-9]') THEN 0.6 ELSE 0 END
  + CASE WHEN regexp_matches(lower(v), 'tion|clic') THEN 2.0 ELSE 0 END - CASE WHEN t THEN 1.6 ELSE 0 END + CASE WHEN sml <> '' AND contains(sml, lower(v)) THEN 0.4 ELSE 0 END
  + CASE WHEN s = 'summary_hint' THEN 1.2 WHEN s = 'composite_hint' THEN 1.4 WHEN s = 'focus' AND NOT b THEN 0.9 ELSE 0 END - CASE WHEN lower(v) = role THEN 1.5 ELSE 0 END
  - CASE WHEN b AND os THEN CASE WHEN s = 'focus' THEN 2.9 ELSE 2.3 END ELSE 0 END - CASE WHEN t AND oe THEN 2.4 WHEN t AND s = 'focus' THEN 0.4 ELSE 0 END), 9) AS k FROM cf3)
SELECT p.id, coalesce(c.v, '') AS chosen_focus FROM posting p LEFT JOIN (SELECT id, v FROM cf4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, length(v), v) = 1) c ON c.id = p.id""")
def f4(spark, sf):
    return S.choose_focus(posting_doc(spark, sf), SIG).select("id", "chosen_focus")


@query("f4_project_focus", "WITH " + SIG_SQL + """,
pf AS (SELECT id, focus_label AS cur, ckw, list_transform(problem_signals, lambda x, i: {'v': x, 'k': 9.2 - (i - 1) * 0.18}) || list_transform(domain_signals, lambda x, i: {'v': x, 'k': 8.1 - (i - 1) * 0.18})
  || list_transform(data_signals, lambda x, i: {'v': x, 'k': 7.4 - (i - 1) * 0.18}) || list_transform(system_signals, lambda x, i: {'v': x, 'k': 6.6 - (i - 1) * 0.18})
  || list_transform(workflow_signals, lambda x, i: {'v': x, 'k': 5.8 - (i - 1) * 0.18}) || list_transform(model_signals, lambda x, i: {'v': x, 'k': 4.8 - (i - 1) * 0.18}) AS pool FROM signals),
pf1 AS (SELECT id, cur, ckw, unnest(pool) AS p FROM pf),
pf2 AS (SELECT id, CASE WHEN p.v = 'Inoran' THEN 'Thatin' ELSE p.v END AS v, p.k + CASE WHEN list_contains(ckw, CASE WHEN p.v = 'Inoran' THEN 'Thatin' ELSE p.v END) THEN 0.3 ELSE 0 END + CASE WHEN cur <> '' AND p.v = cur THEN 0.45 ELSE 0 END AS k
  FROM pf1 WHERE NOT (lower(p.v) LIKE '%ing' OR lower(p.v) = 'attion')),
own AS (SELECT id, cur AS v, CASE WHEN cur = 'click' THEN 1.9 ELSE 4.2 END - CASE WHEN cur = 'click' AND id IN (SELECT id FROM pf2) THEN 1.15 ELSE 0 END AS k FROM pf WHERE cur <> '' AND NOT cur LIKE 'error%'),
al AS (SELECT * FROM pf2 UNION ALL SELECT * FROM own)
SELECT p.id, coalesce(c.v, p.cur) AS projected FROM pf p LEFT JOIN (SELECT id, v FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(-k, 9), length(v), v) = 1) c ON c.id = p.id""")
def f4p(spark, sf):
    m = signal_rows(spark, sf)
    return m.select("id", S.project_focus(F.col("focus_label"), F.col("keywords"), SIG).alias("projected"))


@query("f4_override_focus", "WITH " + SIG_SQL + """,
oc AS (SELECT id, focus_label, lower(concat_ws(' ', title, role, array_to_string(problem_signals, ' '), array_to_string(domain_signals, ' '), array_to_string(system_signals, ' '), summary, array_to_string(keywords, ' '))) AS c FROM signals)
SELECT id, CASE WHEN focus_label = 'click' AND contains(c, 'ing') AND contains(c, 'tion') AND NOT contains(c, 'stupid') THEN 'Clicking'
  WHEN focus_label = 'view' AND contains(c, 'der') THEN '' ELSE focus_label END AS focus FROM oc""")
def f4o(spark, sf):
    # The ladder sees title, role, signals, summary and keywords.
    context = F.concat_ws(" ", "title", "role", *[F.array_join(lst(f"{c}_signals"), " ") for c in ("problem", "domain", "system")], "summary", F.array_join("keywords", " "))
    return signal_rows(spark, sf).select("id", S.override_focus(F.col("focus_label"), context, SIG).alias("focus"))


@query("f5_rebalance_focus", "WITH " + SIG_SQL + """,
rb AS (SELECT id, role, focus_label, keywords, lower(concat_ws(' ', nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(summary, '\\s+', ' ', 'g')), ''))) AS ev,
  list_transform(problem_signals, lambda x, i: {'v': x, 'k': 9.4 - (i - 1) * 0.2}) || list_transform(model_signals, lambda x, i: {'v': x, 'k': 9.2 - (i - 1) * 0.2}) || list_transform(system_signals, lambda x, i: {'v': x, 'k': 8.4 - (i - 1) * 0.2})
  || list_transform(workflow_signals, lambda x, i: {'v': x, 'k': 7.5 - (i - 1) * 0.2}) || list_transform(domain_signals, lambda x, i: {'v': x, 'k': 6.4 - (i - 1) * 0.2}) AS pool FROM signals),
rb1 AS (SELECT id, ev, unnest(pool) AS p FROM rb),
best AS (SELECT id, p.v AS v FROM rb1 WHERE p.v <> 'Que' AND NOT regexp_matches(lower(p.v), 'view') QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(-(p.k + CASE WHEN contains(ev, lower(p.v)) THEN 1.2 ELSE 0 END), 9), length(p.v), p.v) = 1),
hint AS (SELECT id, unnest(list_filter([CASE WHEN contains(ev, 'thtion') THEN {'v': 'Tion', 'k': 8.0} END, CASE WHEN contains(ev, 'inging') OR contains(ev, 'oning') THEN {'v': 'Ing', 'k': 7.0} END], lambda x: x IS NOT NULL)) AS h FROM rb WHERE id NOT IN (SELECT id FROM best)),
pick AS (SELECT * FROM best UNION ALL SELECT id, h.v FROM hint QUALIFY row_number() OVER (PARTITION BY id ORDER BY -h.k) = 1),
rb2 AS (SELECT rb.*, pick.v, role IN ('en', 'fr') AND (focus_label = 'view' OR contains(coalesce(keywords[1], ''), 'view')) AND pick.v IS NOT NULL AS due,
  list_filter(list_transform(keywords, lambda x: CASE WHEN x = 'click' THEN 'Clicks' ELSE x END), lambda x: length(x) <= 28 AND NOT contains(lower(x), 'view') AND lower(x) <> lower(coalesce(pick.v, '')) AND lower(x) <> 'que') AS kept FROM rb LEFT JOIN pick ON pick.id = rb.id)
SELECT id, due AS rebalanced, CASE WHEN due THEN v ELSE focus_label END AS focus_label, array_to_string(CASE WHEN due THEN ([v] || kept)[1:5] ELSE keywords END, '|') AS keywords FROM rb2""")
def f5(spark, sf):
    m = S.rebalance_focus(signal_rows(spark, sf), ["en", "fr"], SIG, patterns=("view",), block=("Que",))
    return m.select("id", "rebalanced", "focus_label", join_list("keywords").alias("keywords"))


@query("f6_rebuild_keywords")
def f6(spark, sf):
    return S.rebuild_keywords(signal_rows(spark, sf), SIG).select("id", join_list("keywords").alias("keywords"))


@query("f7_confidence_gate", "WITH " + POSTING_SQL + """,
cg AS (SELECT *, len(tasks) + len(requirements) AS dt, len(skills) AS sk, len(keywords) AS kn FROM posting)
SELECT id, (dt = 0 AND sk <= 1) OR (dt <= 1 AND sk = 0) OR (summary = '' AND kn <= 1 AND dt <= 1) AS force_low, dt >= 4 OR (dt >= 2 AND sk >= 2) OR sk >= 4 AS strong_input FROM cg""")
def f7(spark, sf):
    return S.confidence_gate(cleaned(spark, sf), SIG).select("id", "force_low", "strong_input")


@query("f7_postprocess_labels")
def f7p(spark, sf):
    m = S.postprocess_labels(L.clean_posting_text(posting_doc(spark, sf), LINES), SIG)
    return m.select("id", "quality", "summary", "focus_label", join_list("keywords").alias("keywords"), *[join_list(c).alias(c) for c in SIG_COLS])


ROLE_RULES = K.RoleRules(
    roles=("en", "fr", "de", "es"), title_votes=(("tion", None, 0, 5.0), ("eau|que", "les", 1, 6.0), ("der", None, 2, 6.0)), extra_title_votes=(("ein", "der", 3, 5.5),),
    evidence_votes=(("ing|ment", 0, 1.0), ("den", 2, 1.0)), no_role="none")


def vote_rows(p):
    n = F.col("n_chars")
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "xx")]), ((n / k).cast("bigint") % 5 + 1).cast("int"))
    return p.select("id", "title", "quality", "focus_label", "keywords", F.col("role").alias("raw_role"), pick(1).alias("summary_role"), F.array(pick(3)).alias("role_signals"),
                    pick(7).alias("mapped_role"), F.when(n % 4 < 2, pick(11)).otherwise("").alias("classifier_role"),
                    F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low").alias("classifier_confidence"), F.lower(F.concat_ws(" ", "title", "summary", F.array_join("keywords", " "))).alias("evidence"))


VOTE_SQL = POSTING_SQL + """,
v0 AS (SELECT id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS t, lower(concat_ws(' ', title, summary, array_to_string(keywords, ' '))) AS ev, role AS raw, ['en', 'fr', 'de', 'es', NULL][n_chars % 5 + 1] AS sm, ['en', 'fr', 'de', 'es', NULL][n_chars // 3 % 5 + 1] AS sg,
  ['en', 'fr', 'de', 'es', NULL][n_chars // 7 % 5 + 1] AS mp, CASE WHEN n_chars % 4 < 2 THEN ['en', 'fr', 'de', 'es', NULL][n_chars // 11 % 5 + 1] END AS cl, ['high', 'medium', 'low'][n_chars % 3 + 1] AS cf FROM posting),
v1 AS (SELECT *, unnest(['en', 'fr', 'de', 'es']) AS r, unnest([0, 1, 2, 3]) AS rk FROM v0),
v2 AS (SELECT *, round(CASE WHEN raw = r THEN 3.0 ELSE 0 END + CASE WHEN sm = r THEN 3.5 ELSE 0 END + CASE WHEN sg = r THEN 4.0 ELSE 0 END + CASE WHEN mp = r THEN 1.25 ELSE 0 END
  + CASE WHEN cl = r THEN CASE cf WHEN 'high' THEN 5.25 WHEN 'medium' THEN 3.75 ELSE 2.0 END ELSE 0 END + CASE WHEN raw = sg AND raw = r THEN 2.25 ELSE 0 END + CASE WHEN raw = sm AND raw = r THEN 1.5 ELSE 0 END
  + CASE WHEN sg = sm AND sg = r THEN 1.75 ELSE 0 END + CASE WHEN cl = sg AND cl = r THEN 1.0 ELSE 0 END + CASE WHEN cl = raw AND cl = r THEN 0.75 ELSE 0 END
  + CASE WHEN r = 'en' AND contains(t, 'tion') THEN 5.0 ELSE 0 END + CASE WHEN r = 'fr' AND regexp_matches(t, 'eau|que') AND NOT contains(t, 'les') THEN 6.0 ELSE 0 END + CASE WHEN r = 'de' AND contains(t, 'der') THEN 6.0 ELSE 0 END
  + CASE WHEN r = 'es' AND contains(t, 'ein') AND contains(t, 'der') THEN 5.5 ELSE 0 END + CASE WHEN r = 'en' AND regexp_matches(ev, 'ing|ment') THEN 1.0 ELSE 0 END + CASE WHEN r = 'de' AND contains(ev, 'den') THEN 1.0 ELSE 0 END, 9) AS sc,
  (CASE WHEN raw = r THEN 1 ELSE 0 END + CASE WHEN sm = r THEN 1 ELSE 0 END + CASE WHEN sg = r THEN 1 ELSE 0 END) AS cn FROM v1),
v3 AS (SELECT id, any_value(cl) AS cl, any_value(cf) AS cf, arg_max(r, sc * 100 - rk) AS voted, arg_max(r, cn * 10 - rk) AS agreed, max(cn) AS an FROM v2 GROUP BY id),
roles AS (SELECT id, CASE WHEN cl IS NOT NULL AND (cf = 'high' OR (cf = 'medium' AND (agreed = cl OR an < 3))) THEN cl ELSE voted END AS role_group FROM v3)"""


@query("f8_resolve_role", "WITH " + VOTE_SQL + " SELECT * FROM roles")
def f8(spark, sf):
    return K.resolve_role(vote_rows(posting_doc(spark, sf)), ROLE_RULES).select("id", "role_group")


SCOPE = K.ScopeRules(roles=("en", "fr", "de"), analyst="de", data_roles=("de",), analyst_titles=("der",), excluded=("tion", "que"), low_titles=("ing",), review=("the", "les"),
                     strong=("is",), ai=("thanea",), deeptech=("attion",), data=("und",), non_scope=("stupid",), low_evidence=("^the",))


def scope_rows(spark, sf):
    p, n = posting_doc(spark, sf), F.col("n_chars")
    return p.withColumns({"raw_role": F.col("role"), "o_action": F.when(n % 6 == 0, "exclude").when(n % 6 == 1, "review").when(n % 12 == 2, "include"),
                          "o_source": F.when(n % 4 < 3, "service_scope_model_x").otherwise("manual"), "o_reason": F.lit("")})


SCOPE_SQL = POSTING_SQL + """,
sc0 AS (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t, CASE WHEN n_chars % 6 = 0 THEN 'exclude' WHEN n_chars % 6 = 1 THEN 'review' WHEN n_chars % 12 = 2 THEN 'include' ELSE '' END AS act,
  n_chars % 4 < 3 AS mdl, lower(concat_ws(' ', company, title, role_display, role, summary, focus_label, detail_body)) AS ev FROM posting),
sc1 AS (SELECT *, act = 'exclude' AND mdl AND NOT contains(concat_ws(' ', t, focus_label, array_to_string(keywords[1:2], ' ')), 'stupid') AND (regexp_matches(ev, 'thanea|attion') OR (role = 'de' AND contains(ev, 'und')))
    AND (quality <> 'low' OR NOT starts_with(t, 'the')) AS rec,
  role = 'de' AND contains(t, 'der') AS fam, list_filter([CASE WHEN role = 'es' THEN 'role:es' END, CASE WHEN contains(t, 'tion') THEN 'pattern:tion' END, CASE WHEN contains(t, 'que') THEN 'pattern:que' END,
    CASE WHEN quality = 'low' AND contains(t, 'ing') THEN 'low_title:ing' END], lambda x: x IS NOT NULL) AS rs FROM sc0),
scope AS (SELECT *, CASE WHEN rec THEN 'include' WHEN act <> '' THEN act WHEN fam OR len(rs) = 0 THEN 'include'
    WHEN quality IN ('high', 'medium') AND regexp_matches(t, 'the|les') AND NOT contains(t, 'is') THEN 'review' ELSE 'exclude' END AS scope_action,
  CASE WHEN rec THEN ['override_guard:model_exclude_recovered'] WHEN act <> '' THEN [CASE WHEN mdl THEN 'override:service_scope_model_x' ELSE 'override:manual' END] WHEN fam THEN ['analyst_family:data_analyst'] ELSE rs END AS reasons FROM sc1)"""


@query("f9_scope_decision", "WITH " + SCOPE_SQL + " SELECT id, scope_action, scope_action = 'include' AS scope_included, array_to_string(reasons, '|') AS reasons FROM scope")
def f9(spark, sf):
    d = K.scope_decision(scope_rows(spark, sf), SCOPE)
    return d.select("id", "scope_action", "scope_included", F.array_join(F.transform("scope_reasons", lambda x: x["label"]), "|").alias("reasons"))


@query("f10_split_by_scope", "WITH " + SCOPE_SQL + """
SELECT 'included' AS part, count(*) AS n FROM scope WHERE scope_action = 'include' UNION ALL SELECT 'excluded', count(*) FROM scope WHERE scope_action <> 'include'
UNION ALL SELECT 'review', count(*) FROM scope WHERE scope_action = 'review'""")
def f10(spark, sf):
    parts = K.split_by_scope(K.scope_decision(scope_rows(spark, sf), SCOPE))
    rows = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, d in zip(("included", "excluded", "review"), parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("f11_scope_guard_off", "WITH " + SCOPE_SQL + """,
off AS (SELECT s.*, CASE WHEN rec THEN 'exclude' ELSE scope_action END AS oa, l.quality AS g, s.quality = 'high' AS hi,
  (regexp_matches(ev, 'thanea|attion') OR (role = 'de' AND contains(ev, 'und'))) AND NOT contains(concat_ws(' ', t, focus_label, array_to_string(keywords[1:2], ' ')), 'stupid') AS sgn
  FROM scope s LEFT JOIN labels l ON l.doc_id = s.ord),
offf AS (SELECT *, (rec AND coalesce(g, 1) = 1) OR (act = 'exclude' AND coalesce(g, 0) = 1) AS rcv, oa = 'exclude' AND CASE WHEN g IS NOT NULL THEN g = 1 ELSE sgn END AS fx FROM off),
m AS (SELECT count(*) AS n, count(*) FILTER (oa = 'include') AS b, count(*) FILTER (scope_action = 'include') AS onb, count(*) FILTER (oa = 'review') AS rv, count(*) FILTER (oa = 'exclude') AS hx,
  count(*) FILTER (rcv) AS r, count(*) FILTER (rcv AND hi) AS rh, count(*) FILTER (fx) AS f, count(*) FILTER (fx AND hi) AS fh FROM offf)
SELECT metric, CAST(value AS DOUBLE) AS value, target, CASE WHEN target IS NULL THEN NULL WHEN metric = 'retention_rate' THEN value >= target ELSE value <= target END AS passed FROM (
  SELECT 'source_rows' AS metric, CAST(n AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS target FROM m UNION ALL SELECT 'guard_on_board_rows', onb, NULL FROM m UNION ALL SELECT 'board_rows', b, NULL FROM m
  UNION ALL SELECT 'filtered_rows', n - b, NULL FROM m UNION ALL SELECT 'review_rows', rv, NULL FROM m UNION ALL SELECT 'hard_excluded_rows', hx, NULL FROM m
  UNION ALL SELECT 'guard_recovered_rows', r, 0 FROM m UNION ALL SELECT 'guard_recovered_high_rows', rh, 0 FROM m UNION ALL SELECT 'excluded_ai_adjacent_rows', f, 0 FROM m
  UNION ALL SELECT 'excluded_high_quality_rows', fh, 10 FROM m UNION ALL SELECT 'retention_rate', round_even(b / n, 6), 0.8 FROM m UNION ALL SELECT 'filtered_out_rate', round_even((n - b) / n, 6), 0.2 FROM m)""")
def f11(spark, sf):
    gold = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("expected"))
    return K.scope_guard_off(scope_rows(spark, sf), gold, SCOPE)


@query("f12_needs_adjudication", "WITH " + VOTE_SQL + """,
a AS (SELECT id, cf, cl, CASE WHEN raw = sg OR raw = sm THEN raw WHEN sg = sm THEN sg END AS ag FROM v0 WHERE cl IS NOT NULL)
SELECT id, cl AS result_role, cf AS confidence, ag AS agreed_role, cf <> 'high' OR coalesce(ag <> cl, false) AS needs_adjudication FROM a""")
def f12(spark, sf):
    v = vote_rows(posting_doc(spark, sf))
    res = v.where(F.col("classifier_role").isin(*ROLE_RULES.roles)).select("id", F.col("classifier_role").alias("role"), F.col("classifier_confidence").alias("confidence"))
    return K.needs_adjudication(v, res, ROLE_RULES.roles)


@query("f13_fill_missing_labels", "WITH " + ROWFACET_SQL + """,
fm AS (SELECT *, CASE WHEN n_chars % 2 = 0 THEN '' ELSE focus_label END AS fl, keywords || f_keyword || f_tag || f_context || problem_signals || domain_signals || system_signals || data_signals || workflow_signals AS ev0 FROM facets),
fm1 AS (SELECT *, CASE WHEN fl <> '' THEN fl ELSE coalesce(f_keyword[1], problem_signals[1], domain_signals[1], data_signals[1], system_signals[1], '') END AS ff FROM fm)
SELECT id, ff AS filled_focus, array_to_string(list_filter(ev0, lambda x, i: list_position(ev0, x) = i)[1:6], '|') AS filled_keywords,
  array_to_string(list_filter(list_filter([ff] || ev0, lambda x: x <> ''), lambda x, i: list_position(list_filter([ff] || ev0, lambda y: y <> ''), x) = i)[1:4], '|') AS detail_keywords FROM fm1""")
def f13(spark, sf):
    m = facet_rows(spark, sf).withColumn("focus_label", F.when(F.col("n_chars") % 2 == 0, "").otherwise(F.col("focus_label")))
    return S.fill_missing_labels(m).select("id", "filled_focus", join_list("filled_keywords").alias("filled_keywords"), join_list("detail_keywords").alias("detail_keywords"))


@query("b14_normalize_model_items")
def b14(spark, sf):
    items = posting_doc(spark, sf).select("id", "ord", "role", "summary", "focus_label", "keywords", F.when(F.col("n_chars") % 3 == 0, "?").otherwise(F.col("quality")).alias("quality"))
    twice = items.unionByName(items.withColumns({"ord": F.col("ord") + 10_000_000, "role": F.lit("later")}))
    return S.normalize_model_items(twice, SIG).select("id", "role", "summary", "focus_label", "quality", join_list("keywords").alias("keywords"))


def board_inputs(spark, sf):
    """Postings, stored summaries, scope and role overrides, and the small rule set."""
    p = posting_doc(spark, sf)
    n = F.col("n_chars")
    summ = p.where(n % 7 != 0).select("id", "role", "summary", "focus_label", "keywords", "quality")
    so = p.where(n % 6 < 2).select("id", F.when(n % 6 == 0, "exclude").otherwise("include").alias("action"), F.lit("service_scope_model").alias("source"), F.lit("").alias("signature"),
                                  F.lit("high").alias("confidence"), F.lit("").alias("reason"), F.lit("en").alias("mapped_role"))
    ro = p.where(n % 5 == 0).select("id", F.lit("fr").alias("role"), F.lit("").alias("signature"), F.lit("high").alias("confidence"))
    rules = K.BoardRules(display=DISPLAY, signals=SIG, roles=ROLE_RULES, scope=SCOPE, terms=TERMS, engineer_roles=("en",), business=("view",))
    sig_rows = S.match_signals(cleaned(spark, sf), SIG).select("id", *SIG_COLS, "role_signals")
    return (p.drop("summary", "quality", "focus_label", "keywords"), summ.join(sig_rows, "id"), so, ro), rules


def board_rows(spark, sf):
    args, rules = board_inputs(spark, sf)
    return K.build_base_rows(*args, rules)


@query("b13_build_base_rows")
def b13(spark, sf):
    b = board_rows(spark, sf)
    return b.select("id", "role_group", "quality", "summary", "focus_label", join_list("keywords").alias("keywords"), "sparse", "scope_action", "detail_line_count", "has_summary")
