"""Jobs without a check SQL against plain Python on small fixtures."""

import random

import pytest

from hiremill.operators import clusters as H
from hiremill.plans.queries_board import PAIR_RULES

RULES = H.PairRules(terms=PAIR_RULES.terms, noise=(), aliases={}, axis_skills=tuple(f"s{i}" for i in range(8)), templates=((("a0", "s1"), "Named", "named thesis"),), thesis="%s with %s")


def fixture(seed, n=160):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # One term and one company hold about a third of the rows.
        axis = "a0" if rnd.random() < 0.35 else f"a{rnd.randrange(1, 5)}"
        company = "c0" if rnd.random() < 0.35 else f"c{rnd.randrange(1, 9)}"
        out.append((str(i), i, company, f"r{i % 2}", [axis], rnd.sample([f"s{k}" for k in range(8)], rnd.randrange(0, 4)), rnd.random() < 0.5))
    return out


def pairs_of(row):
    axes, skills = row[4], row[5]
    found = [(a, s) for a in axes for s in skills]
    if not found:
        found = [(x, y) for i, x in enumerate(skills[:6]) for y in skills[i + 1:6]]
    return found


def greedy(rows, k):
    stats = {}
    for r in rows:
        for pos, (l, x) in enumerate(pairs_of(r)):
            b = stats.setdefault("|".join(sorted((l, x))), {"ids": set(), "co": set(), "act": 0, "pair": (l, x), "at": (r[1], pos)})
            b["ids"].add(r[0])
            b["co"].add(r[2])
            b["act"] += r[6]
    cands = []
    for tier, least in ((0, 3), (1, 2)):
        if tier == 1 and len(cands) >= k:
            break
        for key, b in sorted(stats.items(), key=lambda kv: kv[1]["at"]):
            if len(b["ids"]) < least or len(b["co"]) < 2 or any(c["key"] == key for c in cands):
                continue
            named = key == "a0|s1"
            cands.append({**b, "key": key, "named": named, "label": "Named" if named else " · ".join(b["pair"]), "score": len(b["ids"]) * 5 + len(b["co"]) * 3 + b["act"] + 18 * named})
    chosen, covered, labels = [], set(), set()
    while len(chosen) < k:
        best = None
        for c in cands:
            new = len(c["ids"] - covered)
            if c["label"] in labels or (chosen and new < 2):
                continue
            rank = (round(new * 12 + min(len(c["ids"]), 18) * 2 + len(c["co"]) * 3 + 22 * c["named"] + c["score"] * 0.2, 6), new, len(c["ids"]), len(c["co"]))
            if best is None or rank > best[0]:
                best = (rank, c)
        if best is None:
            break
        c = best[1]
        chosen.append((c["key"], len(c["ids"]), best[0][1]))
        labels.add(c["label"])
        covered |= c["ids"]
    return chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_bundles_follow_the_greedy_rule(spark, seed):
    data = fixture(seed)
    df = spark.createDataFrame(data, "id string, ord bigint, company string, role_group string, axes array<string>, skills array<string>, active boolean")
    prof = H.semantic_profile(df, RULES)
    got = H.semantic_bundles(H.pair_members(prof), 6, RULES).orderBy("position").collect()
    assert [(r["pair"], r["postings"], r["new_postings"]) for r in got] == greedy(data, 6)
    by_role = H.semantic_bundles(H.pair_members(prof, "role_group"), 3, RULES).collect()
    for role in ("r0", "r1"):
        mine = sorted((r for r in by_role if r["grp"] == role), key=lambda r: r["position"])
        assert [(r["pair"], r["postings"], r["new_postings"]) for r in mine] == greedy([d for d in data if d[3] == role], 3)


def test_similarity_is_symmetric(spark):
    from pyspark.sql import functions as F

    data = [(str(i), "c", ["alpha", f"k{i % 3}"], "focus" if i % 2 else "", "r", "high" if i % 3 else "low") for i in range(12)]
    df = spark.createDataFrame(data, "id string, cluster_id string, keywords array<string>, focus_label string, role string, quality string").withColumn("role_group", F.col("role"))
    df = df.withColumns({f"{c}_signals": F.array().cast("array<string>") for c in ("problem", "domain", "data", "system", "workflow", "model")})
    pairs = spark.createDataFrame([(str(i), str(j)) for i in range(12) for j in range(12) if i != j], "l string, r string")
    sim = {(r["l"], r["r"]): r["similarity"] for r in H.row_similarity(df, pairs).collect()}
    assert all(sim[(a, b)] == sim[(b, a)] for a, b in sim)
    # Same keyword and focus, same keyword only, neither.
    assert sim[("1", "7")] > sim[("1", "4")] > sim[("1", "2")] and sim[("1", "7")] == max(v for (a, _), v in sim.items() if a == "1")


def test_checkpoint_dir_comes_from_the_session(spark):
    from hiremill.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert first and spark.sparkContext.getCheckpointDir() == first
