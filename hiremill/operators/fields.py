"""Terms of posting fields and the clusters of a field: seeded by frequent terms or by themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.rank import count_if, first_per, gathered, top_k
from hiremill.functions.terms import TOKEN
from hiremill.functions.text import canon, compact, contains_any, distinct_by_canon, empty_list, is_in, let, lit_map, lst, matches, non_blank, s, squeeze
from hiremill.operators.signals import canon_py
from hiremill.rules import fields as FR
from hiremill.session import checkpointed


@dataclass(frozen=True)
class FieldRules:
    aliases: Sequence[tuple] = tuple(FR.TERM_ALIASES)
    stop_words: Sequence[str] = (*FR.STOPWORDS, *FR.FIELD_STOPWORDS)
    weak: Sequence[str] = tuple(FR.WEAK_FIELD_TERM_KEYS)
    short_ok: Sequence[str] = tuple(FR.ALLOWED_SHORT_TERM_KEYS)
    skill_only: Sequence[str] = tuple(FR.NON_SKILL_GENERIC_KEYS)
    broad: Sequence[str] = tuple(FR.BROAD_CLUSTER_LABEL_KEYS)
    endings: Sequence[str] = tuple(FR.TERM_ENDINGS)
    themes: Sequence[tuple] = tuple((t["id"], t["tone"], t["label"], tuple(t["tokens"])) for t in FR.SECTION_THEMES)
    bonus_terms: Sequence[str] = ("전문연구요원",)
    malus_terms: Sequence[str] = ("석사", "박사", "학사", "학력", "학위", "전공")
    limits: Mapping[str, int] = field(default_factory=lambda: {"detail_body": 6, "tasks": 6, "requirements": 6, "preferred": 4, "skills": 6})


FIELDS = FieldRules()
# Shapes of words that are no term.
WEAK_SHAPES = ["(지사|오피스|센터|홈원)$", "[가-힣]{2,}(의|를|을|이|가|와|과|에|에서|으로|로)$", "^[0-9]+$"]
DETAIL = "detail_body"


def keys_of(values: Sequence[str]) -> set[str]:
    return {canon_py(v) for v in values}


def weak_field_term(term: Column, section: Column, r: FieldRules) -> Column:
    def judge(k: Column) -> Column:
        out = ((k == "") | is_in(k, keys_of([*r.stop_words, *r.weak])) | matches(term, [*WEAK_SHAPES, *r.endings], False)
               | (contains_any(term, ["모집", "채용"]) & term.rlike("(모집|채용)$") & (F.length(term) <= 24))
               | ((F.length(term) <= 4) & (term.rlike("^[가-힣]{2}$") | term.rlike("^[A-Za-z]{1,3}$")) & ~is_in(k, keys_of(r.short_ok))))
        return out | (is_in(k, keys_of(r.skill_only)) & (section != "skills"))

    return let(canon(term), judge)


def term_label(token: Column, r: FieldRules) -> Column:
    """Alias label when the token holds one of its spellings, else Latin tokens in title or upper case."""
    def named(k: Column) -> Column:
        out = None
        for label, patterns in r.aliases:
            cond = contains_any(k, [canon_py(p) for p in patterns])
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
        latin = F.when((F.length(token) <= 4) | token.rlike("[+/#]"), F.upper(token)).otherwise(F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.right(token, F.length(token) - 1))))
        plain = F.when(token.rlike("^[A-Za-z0-9+./#-]+$"), latin).otherwise(token)
        return out.otherwise(plain) if out is not None else plain

    return let(canon(token), named)


def own_keys(company: Column) -> Column:
    return F.transform(F.regexp_extract_all(company, F.lit("[A-Za-z][A-Za-z0-9]+|[가-힣]{2,}"), F.lit(0)), canon)


def text_aliases(text: Column, r: FieldRules) -> Column:
    """Labels of the aliases whose spellings a text holds."""
    return let(canon(text), lambda k: compact(*[F.when(contains_any(k, [canon_py(x) for x in ps]), F.lit(label)) for label, ps in r.aliases])) if r.aliases else empty_list()


def text_tokens(text: Column) -> Column:
    """Repeated tokens are dropped before the costlier label and weakness tests."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def raw_terms(aliases: Column, tokens: Column, own: Column, section: Column, r: FieldRules) -> Column:
    """Alias labels, then the labels of the tokens, in order; distinct by canonical key, company tokens and weak terms out.

    The list is read from left to right: fewer tokens at the end give the same terms but for the last ones.
    """
    once = distinct_by_canon(F.concat(aliases, F.transform(tokens, lambda x: term_label(x, r))))
    return F.filter(once, lambda x: let(canon(x), lambda k: (F.length(k) >= 2) & ~F.array_contains(own, k)) & ~weak_field_term(x, section, r))


def field_terms(values: Column, company: Column, section: Column, r: FieldRules = FIELDS) -> Column:
    """Alias labels, then tokens, of a field's lines; distinct by canonical key, company tokens and weak terms out."""
    shaped = F.struct(F.array_join(non_blank(values), " ").alias("t"), own_keys(company).alias("o"), section.alias("s"))
    return let(shaped, lambda p: raw_terms(text_aliases(p["t"], r), text_tokens(p["t"]), p["o"], p["s"], r))


#: Signals of a section, and how many tokens or lines are tried before all of them.
MOST_SIGNALS, HEADS = 10, (20, 80)
MADE = "struct<seen:int,raw:array<string>,labels:int,signals:array<string>,terms:array<string>>"
SECTION_SIGNALS = {"detail_body": ["problem", "domain", "system", "model", "data"], "tasks": ["problem", "workflow", "system"],
                   "requirements": ["model", "system", "data", "domain"], "preferred": ["domain", "data", "workflow"], "skills": ["model", "data", "system"]}


def section_documents(rows: DataFrame, sections: Sequence[str], r: FieldRules = FIELDS, facets: str | None = None) -> DataFrame:
    """Long (section, id, ord, company, terms, theme columns, evidence lines): one row per posting and section with terms.

    `raw` holds the raw terms of a row without signals; elsewhere nothing reads them and it is empty.
    """
    have = set(rows.columns)
    parts = []
    for sec in sections:
        values = F.split(s(sec), "\n") if sec == DETAIL else lst(sec)
        if facets and facets in have:
            v = F.try_element_at(F.col(facets), F.lit(sec))
            extra = F.concat(lst(v["keyword"]), lst(v["tag"]), lst(v["context"]))
        else:
            extra = F.concat(empty_list(), *[lst(f"{c}_signals") for c in SECTION_SIGNALS[sec] if f"{c}_signals" in have])
        parts.append(F.struct(F.lit(sec).alias("section"), non_blank(F.transform(values, squeeze)).alias("lines"), extra.alias("extra")))
    long = rows.select("id", "ord", s("company").alias("company"), F.explode(F.array(*parts)).alias("d")).select("id", "ord", "company", "d.*")

    projected = bool(facets) and facets in have

    def made(p: Column, n: Column) -> Column:
        def signals(d: Column) -> Column:
            given = p["extra"] if projected else F.concat(d, p["extra"])
            labelled = F.slice(distinct_by_canon(F.transform(given, lambda x: term_label(x, r))), 1, MOST_SIGNALS)
            return let(labelled, lambda x: F.struct(d.alias("raw"), F.size(x).alias("labels"), F.filter(x, lambda y: ~weak_field_term(y, p["section"], r)).alias("signals")))

        def terms(d: Column) -> Column:
            plus = F.when(F.size(d["signals"]) >= 2, d["signals"]).when(p["section"] == "skills", F.concat(d["signals"], d["raw"])).otherwise(d["signals"])
            raw = F.when(F.size(d["signals"]) > 0, empty_list()).otherwise(d["raw"])
            return F.struct(n.alias("seen"), raw.alias("raw"), d["labels"].alias("labels"), d["signals"].alias("signals"), distinct_by_canon(plus).alias("terms"))

        return let(let(raw_terms(p["aliases"], F.slice(p["tokens"], F.lit(1), n), p["own"], p["section"], r), signals), terms)

    # Signals come from the first labels. Where the head of the tokens gives all of them, and so many that nothing else is asked for, the
    # rest of a long text is not worked on; otherwise the whole list is.
    def rounds(p: Column) -> Column:
        def enough(d: Column) -> Column:
            full = F.lit(True) if projected else d["labels"] >= MOST_SIGNALS
            return d.isNotNull() & ((F.size(p["tokens"]) <= d["seen"]) | (full & (F.size(d["signals"]) >= 2)))

        return F.aggregate(F.array(*map(F.lit, (*HEADS, 2**31 - 1))), F.expr(f"cast(null as {MADE})"), lambda d, n: F.when(enough(d), d).otherwise(made(p, n)))

    # A filter on the terms would be pushed below them and make all lists again, several times over; the rows come out of a generator instead.
    text = let(F.array_join(F.col("lines"), " "), lambda x: F.struct(text_aliases(x, r).alias("aliases"), text_tokens(x).alias("tokens")))
    shaped = let(text, lambda x: F.struct(x["aliases"].alias("aliases"), x["tokens"].alias("tokens"), own_keys(F.col("company")).alias("own"), F.col("extra").alias("extra"), F.col("section").alias("section")))
    found = F.explode_outer(let(let(shaped, rounds), lambda d: F.when(F.size(d["terms"]) > 0, F.array(d))))
    return long.select("id", "ord", "company", "section", "lines", found.alias("d")).where("d is not null").select("id", "ord", "company", "section", "lines", "d.raw", "d.signals", "d.terms")


def pick_theme(docs: DataFrame, r: FieldRules = FIELDS) -> DataFrame:
    """Adds theme id, tone and label: 3 per token met by a term, 1 per token met by the text."""
    source = F.when(F.size("signals") > 0, F.col("signals")).when(F.size("raw") > 0, F.col("raw")).otherwise(F.col("lines"))
    keys = F.transform("terms", canon)

    def vote(p: Column) -> Column:
        scored = []
        for i, (tid, tone, label, tokens) in enumerate(r.themes[:-1]):
            total = F.lit(0)
            for tok in tokens:
                k = canon_py(tok)
                total = total + F.when(F.exists(p["k"], lambda x: F.contains(x, F.lit(k)) | F.contains(F.lit(k), x)), 3).otherwise(0)
                total = total + F.when(F.contains(p["t"], F.lit(tok.lower())), 1).otherwise(0)
            scored.append(F.struct(total.alias("score"), F.lit(-i).alias("i"), F.lit(tid).alias("id"), F.lit(tone).alias("tone"), F.lit(label).alias("label")))
        best = F.array_max(F.array(*scored))
        last = r.themes[-1]
        return F.when(best["score"] > 0, F.struct(best["id"].alias("id"), best["tone"].alias("tone"), best["label"].alias("label"))).otherwise(
            F.struct(F.lit(last[0]).alias("id"), F.lit(last[1]).alias("tone"), F.lit(last[2]).alias("label")))

    theme = let(F.struct(keys.alias("k"), F.lower(F.array_join(source, " ")).alias("t")), vote)
    return docs.withColumn("theme", theme)


def evidence_line(terms: Column, lines: Column) -> Column:
    """First line holding one of the three leading terms, else the first line, cut at 88 characters."""
    def choose(p: Column) -> Column:
        # The first lines often hold it; the whole list is searched where they do not.
        first = lambda lines: F.get(F.filter(lines, lambda x: let(canon(x), lambda k: F.exists(p["k"], lambda t: F.contains(k, t)))), 0)
        hit = F.coalesce(*[first(F.slice(p["l"], 1, n)) for n in HEADS], F.when(F.size(p["l"]) > max(HEADS), first(p["l"])))
        return F.coalesce(hit, F.get(p["l"], 0), F.lit(""))

    line = let(F.struct(F.transform(F.slice(terms, 1, 3), canon).alias("k"), lines.alias("l")), choose)
    return let(line, lambda x: F.when(F.length(x) > 88, F.concat(F.trim(F.substring(x, 1, 88)), F.lit("..."))).otherwise(x))


def label_parts(terms: Column, fallback: Column, r: FieldRules) -> Column:
    """Cluster label: the two strongest keywords."""
    score = lambda x: F.least(F.length(x), F.lit(18)) - F.when(is_in(canon(x), keys_of(r.broad)), 12).otherwise(0) + F.when(F.contains(x, F.lit(" ")), 2).otherwise(0) + F.when(x.rlike("[A-Z]"), 1).otherwise(0)
    ranked = F.transform(F.array_sort(F.transform(distinct_by_canon(terms), lambda x: F.struct((-score(x)).alias("k"), x.alias("v")))), lambda y: y["v"])
    return F.when(F.size(terms) > 0, F.array_join(F.slice(ranked, 1, 2), " · ")).otherwise(fallback)


def _cluster_tables(assigned: DataFrame, kw: DataFrame, k: int, r: FieldRules) -> DataFrame:
    """Shared tail: counts, tone, keywords, samples per (section, key)."""
    g = ["section", "key"]
    per = assigned.groupBy(*g, "company", "tone").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"), F.min_by("name", "ord").alias("name"))
    base = per.groupBy(*g).agg(F.sum("n").alias("posting_count"), F.countDistinct(F.nullif(F.col("company"), F.lit(""))).alias("company_count"), F.min_by("name", "o").alias("name"))
    tone = first_per(per.groupBy(*g, "tone").agg(F.sum("n").alias("n"), F.min("o").alias("o")), g, [F.col("n").desc(), "o"]).select(*g, "tone")
    words = gathered(top_k(kw, g, [F.col("score").desc(), "label"], k), g, "keywords")
    ev = assigned.where("evidence <> ''").groupBy(*g, "evidence").agg(F.min("ord").alias("o"))
    samples = gathered(top_k(ev, g, ["o"], 2).withColumnRenamed("evidence", "label"), g, "samples")
    j = base.join(tone, g).join(words, g, "left").join(samples, g, "left").withColumns({"keywords": lst("keywords"), "samples": lst("samples")})
    return j.withColumn("label", label_parts(F.col("keywords"), F.col("name"), r))


def written_once(docs: DataFrame) -> DataFrame:
    """The term lists are read by several aggregates; they are written once so that no text is tokenised twice."""
    return checkpointed(docs.drop("raw"))


def seed_clusters(docs: DataFrame, r: FieldRules = FIELDS) -> DataFrame:
    """Clusters around the strongest frequent term of every posting."""
    return _seed_clusters(written_once(docs), r)


def _seed_clusters(docs: DataFrame, r: FieldRules) -> DataFrame:
    long = docs.select("section", "id", "ord", F.posexplode("terms").alias("pos", "label"))
    support = long.groupBy("section", "label").agg(F.count(F.lit(1)).alias("df"))
    n = docs.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    floor = n.select("section", F.when(F.col("n") >= 60, 4).when(F.col("n") >= 24, 3).otherwise(2).alias("floor"))
    t = long.join(support, ["section", "label"]).join(F.broadcast(floor), "section")
    lab = F.col("label")
    shape = (F.least(F.length(lab), F.lit(12)) + F.when(lab.rlike("^[A-Z0-9+.#/-]+$"), 4).otherwise(0) + F.when(F.col("section") == "skills", 5).otherwise(0)
             + F.when(is_in(canon(lab), keys_of(r.bonus_terms)), 2).otherwise(0) - F.when(is_in(lab, r.malus_terms), 18).otherwise(0)
             - F.when((F.col("section") != "skills") & is_in(canon(lab), keys_of(r.skill_only)), 10).otherwise(0))
    t = t.withColumn("score", F.col("df") * 10 + shape)
    seeds = first_per(t, ["section", "id"], [(F.col("df") >= F.col("floor")).desc(), F.col("score").desc(), "label"]).select("section", "id", lab.alias("seed"))
    lead = gathered(top_k(t, ["section", "id"], [F.col("score").desc(), "label"], 3), ["section", "id"], "lead")
    d = docs.join(seeds, ["section", "id"]).join(lead, ["section", "id"])
    assigned = d.select("section", canon("seed").alias("key"), "id", "ord", "company", F.col("theme.tone").alias("tone"), F.col("seed").alias("name"),
                        evidence_line(F.col("lead"), F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.col("signals"))).alias("evidence"))
    kw = (t.where("pos < 8").join(assigned.select("section", "id", "key"), ["section", "id"])
          .groupBy("section", "key", "label").agg(F.sum(F.greatest(7 - F.col("pos"), F.lit(1)) + F.least(F.col("df"), F.lit(4))).alias("score")))
    return _cluster_tables(assigned, kw, 5, r).where("posting_count >= 2")


def theme_clusters(docs: DataFrame, r: FieldRules = FIELDS) -> DataFrame:
    """Clusters by theme."""
    return _theme_clusters(written_once(docs), r)


def _theme_clusters(docs: DataFrame, r: FieldRules) -> DataFrame:
    assigned = docs.select("section", F.col("theme.id").alias("key"), "id", "ord", "company", F.col("theme.tone").alias("tone"), F.col("theme.label").alias("name"),
                           evidence_line(F.col("terms"), F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.col("signals"))).alias("evidence"))
    kw = (docs.select("section", F.col("theme.id").alias("key"), F.posexplode("terms").alias("pos", "label")).where("pos < 8")
          .groupBy("section", "key", "label").agg(F.sum(F.greatest(5 - F.col("pos"), F.lit(1))).alias("score")))
    return _cluster_tables(assigned, kw, 4, r)


def limited(clusters: DataFrame, r: FieldRules, order: Sequence | None = None) -> DataFrame:
    ranked = top_k(clusters, ["section"], order or [F.col("posting_count").desc(), "label"], max(r.limits.values()), "position")
    return ranked.where(F.col("position") <= F.coalesce(F.try_element_at(lit_map(dict(r.limits)), F.col("section")), F.lit(6)))


def section_clusters(docs: DataFrame, r: FieldRules = FIELDS) -> DataFrame:
    """Seeded clusters where a field has at least three, else themes; the detail text takes both. Unique by label."""
    docs = written_once(docs)
    seeds = limited(_seed_clusters(docs, r), r).withColumn("kind", F.lit("seed"))
    themes = limited(_theme_clusters(docs, r), r).withColumn("kind", F.lit("theme"))
    n = seeds.groupBy("section").agg(F.count(F.lit(1)).alias("seeds"))
    both = seeds.unionByName(themes).join(n, "section", "left").withColumn("seeds", F.coalesce("seeds", F.lit(0)))
    use = (F.col("section") == DETAIL) | ((F.col("kind") == "seed") == (F.col("seeds") >= 3))
    label_key = F.array_join(F.array_sort(F.transform(F.split("label", " · "), canon)), "|")
    once = first_per(both.where(use).withColumn("label_key", label_key), ["section", "label_key"], ["kind", "position"])
    return limited(once.drop("position"), r).select("section", "position", "kind", "key", "label", "tone", "keywords", "posting_count", "company_count", "samples")
