"""Themes, company clusters, weighted vectors, term-pair bundles, the signal graph and reading order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.functions.rank import count_if, explode_labels, first_per, gathered, label_counts, melt, place, ratio, top_k
from hiremill.functions.terms import TERMS, TermRules, board_focus, ends_with, non_generic_filter, unique_non_generic
from hiremill.functions.text import (at, canon, compact, distinct_by_canon, empty_list, epoch_seconds, is_in, let, lit_list, lit_map, lst, non_blank,
                                     ordered_distinct, s, squeeze)
from hiremill.operators.signals import CATEGORIES, canon_py, flat
from hiremill.rules import board as BR
from hiremill.rules import wording as WR
from hiremill.session import checkpointed

SIGNAL_ORDER = ["problem", "domain", "data", "system", "workflow", "model"]


@dataclass(frozen=True)
class ThemeRules:
    """Ordered themes (id, tokens) with bonuses: (theme, keyword canon list, points) and (theme, roles, points)."""

    themes: Sequence[tuple] = tuple((t["id"], tuple(t["tokens"])) for t in BR.DISPLAY_CLUSTER_THEMES)
    default: str = WR.DEFAULT_THEME
    keyword_bonus: Sequence[tuple] = tuple((t, tuple(ks), 4) for t, ks in WR.THEME_BONUSES)
    role_bonus: Sequence[tuple] = ((*WR.THEME_ROLE_BONUS, 4),)
    terms: TermRules = field(default_factory=TermRules)


THEMES = ThemeRules()


def signal_terms(t: TermRules, include_role: bool, limit: int) -> Column:
    parts = [F.array(s("focus_label")), lst("keywords"), flat(SIGNAL_ORDER)]
    if include_role:
        parts.append(F.array(s("role"), s("role_group")))
    return unique_non_generic(F.concat(*parts), limit, t)


def _either(arr: Column, token: str) -> Column:
    return F.size(F.filter(arr, lambda x: F.contains(x, F.lit(token)) | F.contains(F.lit(token), x)))


def assign_themes(rows: DataFrame, r: ThemeRules = THEMES) -> DataFrame:
    """Adds `cluster_id` and `theme_score`. The whole vote is a row expression over literal tokens: no shuffle."""
    kw = F.array_distinct(non_blank(F.transform(F.concat(F.array(s("focus_label")), lst("keywords")), canon)))
    terms = F.transform(signal_terms(r.terms, True, 20), canon)

    def vote(p: Column) -> Column:
        scored = []
        for i, (theme, tokens) in enumerate(r.themes):
            total = F.lit(0)
            for tok in (canon_py(x) for x in tokens):
                if tok:
                    total = total + _either(p["k"], tok) * 3 + _either(p["t"], tok)
            for name, keys, points in r.keyword_bonus:
                if name == theme:
                    total = total + F.when(F.arrays_overlap(p["k"], lit_list([canon_py(k) for k in keys])), points).otherwise(0)
            for name, roles, points in r.role_bonus:
                if name == theme:
                    total = total + F.when(is_in(p["r"], roles), points).otherwise(0)
            scored.append(F.struct(total.alias("score"), F.lit(-i).alias("i"), F.lit(theme).alias("theme")))
        # The first theme of a tie wins; a row without any hit therefore lands in the first theme, as it always did.
        return F.array_max(F.array(*scored))

    best = let(F.struct(kw.alias("k"), terms.alias("t"), s("role_group").alias("r")), vote)
    return rows.withColumn("_best", best).withColumns({"cluster_id": F.col("_best.theme"), "theme_score": F.col("_best.score").cast("bigint")}).drop("_best")


def theme_clusters_summary(rows: DataFrame, r: ThemeRules = THEMES, k: int = 6) -> DataFrame:
    """Per theme: postings, companies, first k keywords in row order (else signal terms)."""
    base = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.nullif(s("company"), F.lit(""))).alias("company_count"))
    lists = {"a": non_generic_filter(F.concat(F.array(s("focus_label")), lst("keywords")), r.terms), "b": signal_terms(r.terms, True, 20)}
    long = None
    for tag, arr in lists.items():
        part = explode_labels(rows, ["cluster_id"], arr).withColumn("src", F.lit(tag))
        long = part if long is None else long.unionByName(part)
    firsts = long.groupBy("cluster_id", "src", "label").agg(F.min(place()).alias("p"))
    best = top_k(firsts, ["cluster_id", "src"], ["p"], k)
    lists = best.groupBy("cluster_id").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("src") == x, F.struct("rank", "label")))), lambda y: y["label"]).alias(f"_{x}") for x in ("a", "b")])
    out = base.join(lists, "cluster_id", "left")
    return out.withColumn("keywords", F.when(F.size("_a") > 0, F.col("_a")).otherwise(lst("_b"))).drop("_a", "_b")


def company_themes(rows: DataFrame, profiles: DataFrame, r: ThemeRules = THEMES) -> DataFrame:
    """Company grain: 3 per profile keyword holding a token, 1 per signal text; hits are summed per posting first."""
    low = s("quality") == "low"
    texts = F.concat(F.array(s("focus_label")), lst("keywords"), flat(["problem", "domain", "system", "data", "workflow", "model"]), F.array(s("role_group")),
                     F.when(low, empty_list()).otherwise(F.array(s("summary"))))

    names = [f"h{i}" for i in range(len(r.themes))]
    per_row = rows.select(s("company").alias("company"), F.transform(texts, canon).alias("_x"))
    per_row = per_row.select("company", *[h.alias(n) for h, n in zip((_token_hits(F.col("_x"), tokens) for _, tokens in r.themes), names)])
    per_company = per_row.groupBy("company").agg(*[F.sum(n).alias(n) for n in names])
    j = profiles.select("company", "postings", "keywords").join(per_company, "company", "left")
    kw = F.transform(lst("keywords"), canon)
    j = j.withColumn("_kw", kw)
    scored = [F.struct((F.coalesce(F.col(n), F.lit(0)) + _token_hits(F.col("_kw"), tokens) * 3).alias("score"), F.lit(-i).alias("i"), F.lit(theme).alias("theme"))
              for i, ((theme, tokens), n) in enumerate(zip(r.themes, names))]
    j = j.withColumn("_best", F.array_max(F.array(*scored)))
    theme = F.when(F.col("_best.score") > 0, F.col("_best.theme")).otherwise(r.default)
    return j.select("company", "postings", "keywords", theme.alias("theme"), F.col("_best.score").cast("bigint").alias("score"))


def _token_hits(arr: Column, tokens: Sequence[str]) -> Column:
    total = F.lit(0)
    for tok in (canon_py(x) for x in tokens):
        if tok:
            total = total + _size_containing(arr, tok)
    return total


def _size_containing(arr: Column, tok: str) -> Column:
    return F.size(F.filter(arr, lambda x: F.contains(x, F.lit(tok))))


def company_theme_clusters(assigned: DataFrame, labels: Mapping[str, str] | None = None, k: int = 6) -> DataFrame:
    """Clusters of companies, largest first, with sequential ids; one row per theme."""
    labels = labels or {t["id"]: t["label"] for t in BR.DISPLAY_CLUSTER_THEMES}
    base = assigned.groupBy("theme").agg(F.sum("postings").alias("postings"), F.count(F.lit(1)).alias("company_count"))
    long = assigned.select("theme", "company", F.posexplode("keywords").alias("pos", "label"))
    firsts = long.groupBy("theme", "label").agg(F.min("company").alias("c"), F.min_by("pos", "company").alias("p"))
    kws = gathered(top_k(firsts, ["theme"], ["c", "p"], k), ["theme"], "keywords")
    label = F.coalesce(F.try_element_at(lit_map(dict(labels)), F.col("theme")), F.col("theme"))
    out = base.join(kws, "theme", "left").withColumn("label", label)
    # One row per theme, all of them ranked.
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("postings").desc(), "label")))
    return ranked.select(F.concat(F.lit("cluster-"), F.col("rank")).alias("id"), "theme", "label", "postings", "company_count", lst("keywords").alias("keywords"))


def merge_stored_clusters(stored: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company -> cluster, cluster counts): the first claim of a company wins, unclaimed companies join the first cluster.

    stored: ord, id, label, companies. companies: company, postings.
    """
    claims = stored.select("ord", "id", F.posexplode("companies").alias("pos", "company")).withColumn("company", squeeze("company"))
    valid = claims.join(companies.select("company"), "company", "left_semi")
    first = first_per(valid, ["company"], ["ord", "pos"]).select("company", F.col("id").alias("cluster_id"), F.col("ord").alias("cluster_ord"))
    lead = first.agg(F.min_by("cluster_id", "cluster_ord")).scalar()
    members = companies.join(first, "company", "left").withColumn("cluster_id", F.coalesce("cluster_id", lead)).select("company", "postings", "cluster_id")
    counts = members.groupBy("cluster_id").agg(F.sum("postings").alias("n"), F.count(F.lit(1)).alias("company_count"))
    return members, counts


def best_overlap_cluster(companies: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster sharing most terms with a company: term equi-join, so only shared terms meet. Terms per side are distinct."""
    c = companies.select("company", F.explode(F.array_distinct(F.transform(lst("keywords"), canon))).alias("term")).where("term <> ''")
    k = clusters.select(F.col("id").alias("cluster_id"), "ord", F.explode(F.array_distinct(F.transform(lst("keywords"), canon))).alias("term")).where("term <> ''")
    hits = c.join(k, "term").groupBy("company", "cluster_id", "ord").agg(F.count(F.lit(1)).alias("overlap"))
    return first_per(hits, ["company"], [F.col("overlap").desc(), "ord"]).select("company", "cluster_id", "overlap")


def company_vectors(rows: DataFrame, fallback: DataFrame | None = None, t: TermRules = TERMS, k: int = 10) -> DataFrame:
    """(company, term, weight): summed term weights scaled by 1 + companies/df; the best k terms of every company."""
    w = F.when(s("quality") == "low", 2.2).otherwise(3.4)
    terms = F.transform(signal_terms(t, False, 18), lambda x: F.struct(x.alias("term"), w.alias("w")))
    role = F.when(squeeze("role_group") != "", F.array(F.struct(squeeze("role_group").alias("term"), F.lit(0.25).alias("w"))))
    none = F.expr("cast(array() as array<struct<term:string,w:double>>)")
    long = rows.where(s("company") != "").select("company", F.explode(F.concat(terms, F.coalesce(role, none))).alias("x")).select("company", "x.term", "x.w")
    raw = long.groupBy("company", "term").agg(F.sum("w").alias("w"))
    if fallback is not None:
        extra = (fallback.join(raw.select("company").distinct(), "company", "left_anti")
                 .select("company", F.explode(lst("keywords")).alias("term")).withColumn("term", squeeze("term")).where("term <> ''")
                 .groupBy("company", "term").agg((F.count(F.lit(1)) * 0.6).alias("w")))
        raw = raw.unionByName(extra)
    df_ = raw.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = raw.agg(F.countDistinct("company")).scalar()
    scored = raw.join(df_, "term").select("company", "term", F.round(F.col("w") * (1 + F.greatest(total, F.lit(1)) / F.col("df")), 3).alias("weight"))
    return top_k(scored, ["company"], [F.col("weight").desc(), "term"], k)


def merge_vectors(vectors: DataFrame, members: DataFrame, k: int = 12) -> DataFrame:
    """Mean vector of every cluster of companies, best k terms. members: cluster_id, company."""
    size = members.join(vectors.select("company").distinct(), "company", "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
    total = vectors.select("company", "term", "weight").join(members, "company").groupBy("cluster_id", "term").agg(F.sum("weight").alias("w"))
    mean = total.join(size, "cluster_id").select("cluster_id", "term", F.round(F.col("w") / F.col("m"), 3).alias("weight"))
    return top_k(mean, ["cluster_id"], [F.col("weight").desc(), "term"], k)


def weighted_jaccard(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of minima over sum of maxima for the given pairs (l, r) of vectors (key, term, weight).

    Pairs come as a table, so the work grows with them; the sum of maxima follows from the totals of both sides.
    """
    lt = left.groupBy("key").agg(F.sum("weight").alias("lt"))
    rt = right.groupBy("key").agg(F.sum("weight").alias("rt"))
    p = pairs.select("l", "r").distinct()
    shared = (p.join(left.select(F.col("key").alias("l"), "term", F.col("weight").alias("lw")), "l")
              .join(right.select(F.col("key").alias("r"), "term", F.col("weight").alias("rw")), ["r", "term"])
              .groupBy("l", "r").agg(F.sum(F.least("lw", "rw")).alias("mins")))
    j = (p.join(shared, ["l", "r"], "left").join(lt.withColumnRenamed("key", "l"), "l", "left").join(rt.withColumnRenamed("key", "r"), "r", "left"))
    mins = F.coalesce("mins", F.lit(0.0))
    both = F.coalesce("lt", F.lit(0.0)) + F.coalesce("rt", F.lit(0.0)) - mins
    return j.select("l", "r", F.when(F.col("lt").isNotNull() & F.col("rt").isNotNull() & (both > 0), mins / both).otherwise(0.0).alias("similarity"))


@dataclass(frozen=True)
class SchemaRules:
    """Company schemas (id, tokens), bonuses (schema, where: role|text, words, points) and the role fall-back."""

    schemas: Sequence[tuple] = tuple((x["id"], tuple(x["tokens"])) for x in BR.CLUSTER_SCHEMAS)
    bonuses: Sequence[tuple] = (("cluster-data", "role", ("데이터",), 4), ("cluster-edge", "text", ("검증", "최적화"), 3),
                                ("cluster-platform", "text", ("인프라", "서빙"), 3), ("cluster-model", "role", ("리서처",), 2))
    data_roles: Sequence[str] = ("데이터 분석가", "데이터 사이언티스트")
    data_schema: str = "cluster-data"
    other_schema: str = "cluster-model"
    terms: TermRules = field(default_factory=TermRules)


SCHEMAS = SchemaRules()


def company_schema_clusters(rows: DataFrame, r: SchemaRules = SCHEMAS) -> DataFrame:
    """Schema per company by token occurrences (2 each) plus bonuses. Occurrences are counted per posting and summed;
    a company's texts are never put together."""
    texts = F.concat(F.array(s("role"), s("summary"), s("group_summary")), signal_terms(r.terms, False, 12))
    blob = F.lower(F.array_join(non_blank(F.transform(texts, squeeze)), " "))
    df = rows.select(F.when(s("company") == "", WR.UNKNOWN_COMPANY).otherwise(F.col("company")).alias("company"), blob.alias("_b"), s("role_group").alias("_r"))
    import re

    counts, flags = [], []
    for i, (_, tokens) in enumerate(r.schemas):
        total = F.lit(0)
        for tok in tokens:
            total = total + F.regexp_count("_b", F.lit(re.escape(tok.lower()).replace("\\ ", " ")))
        counts.append(F.sum(total).alias(f"c{i}"))
    for i, (_, where, words, _) in enumerate(r.bonuses):
        src = F.col("_r") if where == "role" else F.col("_b")
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(src, F.lit(w))
        flags.append(F.max(cond.cast("int")).alias(f"b{i}"))
    data = F.max(is_in(F.col("_r"), r.data_roles).cast("int")).alias("_d")
    agg = df.groupBy("company").agg(*counts, *flags, data)
    scored = []
    for i, (sid, _) in enumerate(r.schemas):
        total = F.col(f"c{i}") * 2
        for j, (bid, _, _, points) in enumerate(r.bonuses):
            if bid == sid:
                total = total + F.col(f"b{j}") * points
        scored.append(F.struct(total.alias("score"), F.lit(-i).alias("i"), F.lit(sid).alias("id")))
    agg = agg.withColumn("_best", F.array_max(F.array(*scored)))
    fallback = F.when(F.col("_d") == 1, r.data_schema).otherwise(r.other_schema)
    return agg.select("company", F.when(F.col("_best.score") > 0, F.col("_best.id")).otherwise(fallback).alias("cluster_id"), F.col("_best.score").cast("bigint").alias("score"))


@dataclass(frozen=True)
class PairRules:
    """Terms that make no pair, aliases, axis skills and named pairs (terms, label, thesis)."""

    terms: TermRules = field(default_factory=TermRules)
    noise: Sequence[str] = tuple(BR.SEMANTIC_NOISE_TERMS)
    noise_pattern: str = "(경력|신입|인턴|[0-9]+년|\\d+\\+)"
    aliases: Mapping[str, str] = field(default_factory=lambda: dict(BR.SEMANTIC_ALIAS_MAP))
    axis_skills: Sequence[str] = tuple(BR.SEMANTIC_SKILL_AXIS_TERMS)
    templates: Sequence[tuple] = tuple(BR.SEMANTIC_TEMPLATE_SPECS)
    thesis: str = "%s 축의 공고가 %s 역량과 함께 설명되는 채용군입니다."


PAIRS = PairRules()


def semantic_terms(arr: Column, limit: int, r: PairRules) -> Column:
    noise = {canon_py(x) for x in r.noise}
    alias = {canon_py(k): v for k, v in r.aliases.items()}

    def one(x: Column) -> Column:
        return let(board_focus(x, r.terms), lambda c: let(canon(c), lambda k: F.when(
            (k == "") | is_in(k, noise) | c.rlike(r.noise_pattern), "").otherwise(F.coalesce(F.try_element_at(lit_map(alias), k), c) if alias else c)))

    good = F.filter(F.transform(arr, one), lambda x: (F.length(x) <= 24) & ~is_in(canon(x), noise))
    return distinct_by_canon(good, limit)


def semantic_profile(rows: DataFrame, r: PairRules = PAIRS) -> DataFrame:
    """(grp columns kept) id, ord, company, active plus axes (6), tags (6), skills (12), skill axes."""
    have = set(rows.columns)
    arr = lambda c: lst(c) if c in have else empty_list()
    axes = semantic_terms(arr("axes"), 6, r)
    focus = semantic_terms(F.array(s("focus_label")), 3, r) if "focus_label" in have else empty_list()
    df = rows.withColumns({"_axes": axes, "_tags": semantic_terms(arr("tags"), 6, r), "_skills": semantic_terms(arr("skills"), 12, r)})
    df = df.withColumn("_axes", F.when(F.size("_axes") > 0, F.col("_axes")).otherwise(focus))
    return df.withColumn("_skill_axes", F.filter("_skills", lambda x: is_in(canon(x), {canon_py(a) for a in r.axis_skills})))


def pair_list(axes: Column, skills: Column) -> Column:
    """Pairs of one posting (at most about fifty): axis x axis, axis x skill, else skill x skill; each pair once."""
    def combos(a: Column) -> Column:
        return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.lit(12)), lambda y: F.struct(x.alias("l"), y.alias("r")))))

    def build(p: Column) -> Column:
        cross = F.flatten(F.transform(p["a"], lambda x: F.transform(p["s"], lambda y: F.struct(x.alias("l"), y.alias("r")))))
        return let(F.filter(F.concat(combos(p["a"]), cross), lambda z: canon(z["l"]) != canon(z["r"])), lambda c: F.when(F.size(c) > 0, c).otherwise(
            F.filter(combos(F.slice(p["s"], 1, 6)), lambda z: canon(z["l"]) != canon(z["r"]))))

    raw = let(F.struct(F.slice(axes, 1, 5).alias("a"), F.slice(skills, 1, 8).alias("s")), build)
    keyed = F.transform(raw, lambda z: F.struct(F.array_join(F.array_sort(F.array(canon(z["l"]), canon(z["r"]))), "|").alias("k"), z["l"].alias("l"), z["r"].alias("r")))
    return distinct_by_canon(keyed, key=lambda x: x["k"])


def pair_members(profiles: DataFrame, group: str | None = None) -> DataFrame:
    """Long (grp, pair, id, company, active, ord, pos, left, right): linear in the postings."""
    grp = squeeze(group) if group else F.lit("")
    long = profiles.select(grp.alias("grp"), "id", s("company").alias("company"), F.coalesce("active", F.lit(False)).alias("active"), "ord",
                           F.posexplode(pair_list(F.col("_axes"), F.col("_skill_axes"))).alias("pos", "p"))
    out = long.select("grp", F.col("p.k").alias("pair"), "id", "company", "active", "ord", "pos", F.col("p.l").alias("left"), F.col("p.r").alias("right"))
    return out.where("grp <> ''") if group else out


def pair_stats(members: DataFrame) -> DataFrame:
    """Per pair: postings, companies, active postings and the spelling first seen. Ids are unique within a pair."""
    per_company = members.groupBy("grp", "pair", "company").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("active")).alias("a"), F.min("ord").alias("o"), F.min_by("pos", "ord").alias("p"),
        F.min_by("left", "ord").alias("l"), F.min_by("right", "ord").alias("r"))
    return per_company.groupBy("grp", "pair").agg(
        F.sum("n").alias("postings"), count_if(F.col("company") != "").alias("companies"), F.sum("a").alias("active_postings"),
        F.min("o").alias("first_ord"), F.min_by("p", "o").alias("first_pos"), F.min_by("l", "o").alias("left"), F.min_by("r", "o").alias("right"))


def pair_term_counts(members: DataFrame, profiles: DataFrame, r: PairRules = PAIRS) -> DataFrame:
    """Term counts of the given pairs' postings (grp, pair, label, n, first place); use it on selected pairs."""
    terms = F.concat("_axes", "_tags", "_skills")
    p = profiles.select("id", terms.alias("terms"))
    long = members.select("grp", "pair", "id", "ord").join(p, "id").select("grp", "pair", "ord", F.posexplode("terms").alias("pos", "label"))
    return label_counts(long, ["grp", "pair"])


def describe_pairs(stats: DataFrame, r: PairRules = PAIRS) -> DataFrame:
    keys = F.split("pair", "\\|")
    label, thesis, hit = None, None, F.lit(False)
    for terms, lab, the in r.templates:
        cond = F.lit(True)
        for x in terms:
            cond = cond & F.array_contains(keys, canon_py(x))
        label = F.when(cond, lab) if label is None else label.when(cond, lab)
        thesis = F.when(cond, the) if thesis is None else thesis.when(cond, the)
        hit = hit | cond
    own_label = F.concat_ws(" · ", "left", "right")
    own_thesis = F.format_string(r.thesis, F.col("left"), F.col("right"))
    df = stats.withColumns({"templated": hit, "label": label.otherwise(own_label) if label is not None else own_label,
                            "thesis": thesis.otherwise(own_thesis) if thesis is not None else own_thesis})
    return df.withColumns({"label_key": canon("label"), "score": F.col("postings") * 5 + F.col("companies") * 3 + F.col("active_postings") + F.when(F.col("templated"), 18).otherwise(0)})


def bundle_candidates(stats: DataFrame, k: int, r: PairRules = PAIRS) -> DataFrame:
    """Pairs with at least three postings and two companies; groups short of k also get pairs with two."""
    d = describe_pairs(stats, r).where((F.col("companies") >= 2) & (F.col("postings") >= 2))
    strong = F.col("postings") >= 3
    n = d.groupBy("grp").agg(count_if(strong).alias("strong_n"))
    return d.join(n, "grp").where(strong | (F.col("strong_n") < k)).withColumn("tier", F.when(strong, 0).otherwise(1)).drop("strong_n")


def semantic_bundles(members: DataFrame, k: int = 12, r: PairRules = PAIRS) -> DataFrame:
    """Greedy coverage for every group at once: at most k rounds, each one distributed aggregate.

    A round counts, per candidate, the postings no earlier bundle of its group covers, and takes the best candidate per
    group. Only the chosen rows (one per group and round) are checkpointed; posting sets stay distributed.
    """
    stats = pair_stats(members)
    cand = checkpointed(bundle_candidates(stats, k, r))
    pool = checkpointed(members.select("grp", "pair", "id").join(cand.select("grp", "pair"), ["grp", "pair"], "left_semi"))
    chosen: DataFrame | None = None
    for i in range(1, k + 1):
        if chosen is None:
            left, open_pairs = pool, cand
        else:
            covered = pool.join(chosen.select("grp", "pair"), ["grp", "pair"], "left_semi").select("grp", "id").distinct()
            open_pairs = cand.join(chosen.select("grp", "label_key"), ["grp", "label_key"], "left_anti")
            left = pool.join(open_pairs.select("grp", "pair"), ["grp", "pair"], "left_semi").join(covered, ["grp", "id"], "left_anti")
        fresh = left.groupBy("grp", "pair").agg(F.count(F.lit(1)).alias("new_postings"))
        need = 0 if chosen is None else 2
        scored = open_pairs.join(fresh, ["grp", "pair"]).where(F.col("new_postings") >= need).withColumn(
            "diversity", F.round(F.col("new_postings") * 12 + F.least(F.col("postings"), F.lit(18)) * 2 + F.col("companies") * 3
                                 + F.when(F.col("templated"), 22).otherwise(0) + F.col("score") * 0.2, 6))
        best = first_per(scored, ["grp"], [F.col("diversity").desc(), F.col("new_postings").desc(), F.col("postings").desc(), F.col("companies").desc(),
                                           "tier", "first_ord", "first_pos"])
        step = checkpointed(best.withColumn("position", F.lit(i).cast("bigint")))
        if step.isEmpty():
            break
        chosen = step if chosen is None else chosen.unionByName(step)
    if chosen is None:
        chosen = cand.withColumns({"new_postings": F.lit(0).cast("bigint"), "diversity": F.lit(0.0), "position": F.lit(0).cast("bigint")}).where(F.lit(False))
    conf = F.least(F.lit(0.95), 0.42 + F.least(F.col("postings"), F.lit(14)) * 0.026 + F.least(F.col("companies"), F.lit(10)) * 0.025
                   + F.when(F.col("templated"), 0.12).otherwise(0.0))
    return chosen.withColumn("confidence", F.round(conf, 3)).drop("tier")


def bundle_evidence(bundles: DataFrame, members: DataFrame, profiles: DataFrame, k: int = 7) -> DataFrame:
    """Evidence terms of the chosen bundles: the pair's own spelling, then the ten most frequent profile terms."""
    m = members.join(bundles.select("grp", "pair"), ["grp", "pair"], "left_semi")
    top = top_k(pair_term_counts(m, profiles), ["grp", "pair"], [F.col("n").desc(), "first_place"], 10)
    terms = gathered(top, ["grp", "pair"], "terms")
    j = bundles.join(terms, ["grp", "pair"], "left")
    return j.withColumn("evidence_terms", distinct_by_canon(F.concat(F.array("left", "right"), lst("terms")), k)).drop("terms")


def bundle_filter(bundles: DataFrame, members: DataFrame, rows: DataFrame, role_set: bool, k: int = 12) -> DataFrame:
    """Bundles restricted to the given rows; counts are recomputed, bundles without postings vanish."""
    m = members.join(bundles.select("grp", "pair"), ["grp", "pair"], "left_semi").join(rows.select("id"), "id", "left_semi")
    n = m.groupBy("grp", "pair", "company").agg(F.count(F.lit(1)).alias("n")).groupBy("grp", "pair").agg(
        F.sum("n").alias("posting_count"), count_if(F.col("company") != "").alias("company_count"))
    j = bundles.join(n, ["grp", "pair"])
    if role_set:
        j = j.where((F.col("posting_count") >= 2) & (F.col("company_count") >= 2))
    return top_k(j, ["grp"], ["position"], k, "shown").drop("shown")


def bundle_health(rows: DataFrame, members: DataFrame, bundles: DataFrame, role_bundles: DataFrame | None = None, mismatches: DataFrame | None = None,
                  splits: DataFrame | None = None) -> DataFrame:
    """Eight gates on coverage, spread and consistency (name, actual, expected, passed)."""
    ids = members.join(bundles.select("grp", "pair"), ["grp", "pair"], "left_semi").select("id").distinct().withColumn("_c", F.lit(1))
    flags = rows.select("id", F.coalesce("active", F.lit(False)).alias("active")).join(ids, "id", "left")
    cover = flags.agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("active")).alias("active"), F.count("_c").alias("covered"),
                      count_if(F.col("active") & F.col("_c").isNotNull()).alias("covered_active"))
    b = bundles.agg(F.count(F.lit(1)).alias("bundles"), count_if(F.col("companies") >= 2).alias("multi"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    count = lambda df, cond=None: (df.where(cond) if cond is not None else df).agg(F.count(F.lit(1)).alias("x")).scalar() if df is not None else F.lit(0)
    single = (F.col("postings") < 2) | (F.col("companies") < 2)
    long = melt(cover, [], cover.columns).unionByName(melt(b, [], b.columns))
    wide = long.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("rows", "active", "covered", "covered_active", "bundles", "multi", "confidence")])
    r3 = lambda a, c: ratio(F.col(a), F.col(c), 3)
    gates = [("bundleCount", F.col("bundles"), 6.0, True), ("coverageRate", r3("covered", "rows"), 0.55, True), ("activeCoverageRate", r3("covered_active", "active"), 0.55, True),
             ("multiCompanyBundleRate", r3("multi", "bundles"), 0.75, True), ("averageConfidence", F.bround(F.col("confidence"), 3), 0.55, True),
             ("stage2RoleMismatches", count(mismatches).cast("double"), 0.0, False), ("compoundSkillSplitIssues", count(splits).cast("double"), 0.0, False),
             ("roleSpecificSingletonBundles", count(role_bundles, single).cast("double"), 0.0, False)]
    arr = F.array(*[F.struct(F.lit(n).alias("name"), a.cast("double").alias("actual"), F.lit(f"{'>= ' if up else ''}{e:g}").alias("expected"),
                             ((a >= e) if up else (a == e)).alias("passed")) for n, a, e, up in gates])
    return wide.select(F.explode(arr).alias("g")).select("g.*")


FACET_WEIGHTS = {"role": 6, "keyword": 5, "tag": 3, "context": 2}


def facet_edges(rows: DataFrame, weights: Mapping[str, int] = FACET_WEIGHTS, first: int = 4) -> DataFrame:
    """Long facets: posting -> signal with its weight; at most four labels per facet count."""
    def tag(f: str, w: int) -> Column:
        return F.transform(F.slice(lst(f"f_{f}"), 1, first), lambda x, i: F.struct(
            F.lit(f).alias("facet"), i.alias("pos"), squeeze(x).alias("label"), canon(x).alias("key"), F.greatest(F.lit(w) - i, F.lit(1)).cast("bigint").alias("weight"), F.lit(w).cast("bigint").alias("base")))

    arr = F.flatten(F.array(*[tag(f, w) for f, w in weights.items()]))
    long = rows.select("id", "ord", s("cluster_id").alias("cluster_id"), F.explode(F.filter(arr, lambda x: x["key"] != "")).alias("e"))
    return long.select("id", "ord", "cluster_id", "e.*", F.concat_ws(":", F.lit("signal"), "e.facet", "e.key").alias("signal_id"))


def signal_graph(rows: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables: signals, posting_edges, cluster_edges, cluster_summary (six labels per facet)."""
    e = facet_edges(rows)
    per = e.groupBy("cluster_id", "signal_id", "facet").agg(F.sum("base").alias("weight"), F.min("ord").alias("o"), F.min_by("label", "ord").alias("label"))
    signals = per.groupBy("signal_id", "facet").agg(F.min_by("label", "o").alias("label"))
    best = top_k(per.select("cluster_id", "facet", "signal_id", "weight").join(signals.select("signal_id", "label"), "signal_id"),
                 ["cluster_id", "facet"], [F.col("weight").desc(), "signal_id"], 6)
    return {"signals": signals, "posting_edges": e.select("id", "signal_id", "facet", "weight"), "cluster_edges": per.select("cluster_id", "signal_id", "weight"),
            "cluster_summary": gathered(best, ["cluster_id", "facet"], "labels")}


def connection_signals(rows: DataFrame, t: TermRules = TERMS) -> DataFrame:
    """Long (id, cluster_id, key, weight): what a posting can share with another, heaviest source of a label first."""
    tag = lambda arr, w: F.transform(arr, lambda x: F.struct(canon(x).alias("key"), F.lit(w).alias("w")))
    pool = F.concat(tag(F.slice(flat(["problem"]), 1, 5), 7), tag(F.slice(flat(["domain", "data"]), 1, 5), 6), tag(F.slice(flat(["system", "workflow", "model"]), 1, 6), 5),
                    tag(F.slice(lst("keywords"), 1, 6), 6), tag(F.array(s("focus_label")), 5), tag(F.array(s("role"), s("role_group")), 4))
    generic = {canon_py(x) for x in t.board_generic}
    good = F.filter(pool, lambda x: (x["key"] != "") & ~is_in(x["key"], generic) & ~ends_with(x["key"], t.bad_suffixes))
    # Heaviest weight per key, inside the row: sort by (key, -weight) and keep group heads.
    ranked = F.array_sort(F.transform(good, lambda x: F.struct(x["key"].alias("key"), (-x["w"]).alias("n"))))
    heads = let(ranked, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["key"] != x["key"])))
    long = rows.select("id", s("cluster_id").alias("cluster_id"), F.explode(heads).alias("x"))
    return long.select("id", "cluster_id", "x.key", (-F.col("x.n")).cast("bigint").alias("weight"))


def _bonus() -> Column:
    same = lambda c: (squeeze(f"l_{c}") != "") & (squeeze(f"l_{c}") == squeeze(f"r_{c}"))
    return (F.when(same("focus_label"), 4).otherwise(0) + F.when(same("role"), 5).otherwise(0)
            + F.when((s("l_quality") != "low") & (s("r_quality") != "low"), 1).otherwise(0))


def row_similarity(rows: DataFrame, pairs: DataFrame, t: TermRules = TERMS) -> DataFrame:
    """Similarity of the given pairs (l, r) of postings: shared signal weight plus focus, role and quality bonuses."""
    sig = connection_signals(rows, t)
    p = pairs.select("l", "r").distinct()
    shared = (p.join(sig.select(F.col("id").alias("l"), "key", F.col("weight").alias("lw")), "l")
              .join(sig.select(F.col("id").alias("r"), "key", F.col("weight").alias("rw")), ["r", "key"]).groupBy("l", "r").agg(F.sum(F.least("lw", "rw")).alias("shared")))
    side = lambda n: rows.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("focus_label", "role", "quality")])
    j = p.join(shared, ["l", "r"], "left").join(side("l"), "l").join(side("r"), "r")
    return j.select("l", "r", (F.coalesce("shared", F.lit(0)) + _bonus()).cast("bigint").alias("similarity"))


def related_postings(rows: DataFrame, t: TermRules = TERMS, k: int | None = None) -> DataFrame:
    """Every posting against the richest posting of its cluster, best first.

    Rows: (cluster_id, leader, id, similarity, richness). One leader per cluster meets the rest, so the work is linear in
    the postings, however large a cluster is.
    """
    sig = connection_signals(rows, t)
    rich = sig.groupBy("id").agg(F.sum("weight").alias("richness"))
    seen = epoch_seconds("last_seen_at")
    base = rows.select("id", s("cluster_id").alias("cluster_id"), "company", "title", "focus_label", "role", "quality", "active", seen.alias("seen")).join(rich, "id", "left")
    base = base.withColumn("richness", F.coalesce("richness", F.lit(0)))
    order = [F.col("richness").desc(), F.col("active").desc(), "seen", F.lower(squeeze("company")).desc(), F.lower(squeeze("title")).desc(), F.col("id")]
    lead = first_per(base, ["cluster_id"], order).select("cluster_id", F.col("id").alias("leader"), *[F.col(c).alias(f"l_{c}") for c in ("focus_label", "role", "quality")])
    lead_sig = sig.join(lead.select(F.col("leader").alias("id")), "id", "left_semi").select("cluster_id", "key", F.col("weight").alias("lw"))
    shared = sig.join(lead_sig, ["cluster_id", "key"]).groupBy("id").agg(F.sum(F.least("weight", "lw")).alias("shared"))
    j = base.join(lead, "cluster_id").where("id <> leader").join(shared, "id", "left").withColumns({f"r_{c}": F.col(c) for c in ("focus_label", "role", "quality")})
    out = j.select("cluster_id", "leader", "id", (F.coalesce("shared", F.lit(0)) + _bonus()).cast("bigint").alias("similarity"), "richness")
    return top_k(out, ["cluster_id"], [F.col("similarity").desc(), F.col("richness").desc(), "id"], k) if k else out
