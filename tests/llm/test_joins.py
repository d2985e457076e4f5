"""Jaccard components and vector search against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiremill.llm import jaccard, vafile
from tests.llm.samples import documents, rows

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(pairs):
    return Counter((i, len(shingles(t)), c) for (i, t), c in zip(pairs, brute_rows(pairs)))


def brute_rows(pairs):
    """Component of every row."""
    sets = [shingles(t) for _, t in pairs]
    unique = list({s for s, (i, _) in zip(sets, pairs) if s and i is not None})
    parent = list(range(len(unique)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(unique):
        shared = Counter(o for g in s for o in index[g])
        for o, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(unique[o]) - c):
                parent[find(k)] = find(o)
        for g in s:
            index[g].append(k)
    place, least = {s: k for k, s in enumerate(unique)}, {}
    for s, (i, _) in zip(sets, pairs):
        if s and i is not None:
            root = find(place[s])
            least[root] = min(least.get(root, i), i)
    return [least[find(place[s])] if s and i is not None else i for s, (i, _) in zip(sets, pairs)]


def noisy(seed, count):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 160))] for _ in range(25)]
    passage = [f"p{i}" for i in range(50)]
    out = []
    for _ in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = [f"x{rng.randint(0, 10**6)}"] * rng.randint(0, 1) if len(words) > 1 else ["y"]
            words = words or ["z"]
        if rng.random() < 0.2:
            words = [*words, *passage]
        text = " ".join(words)
        out.append((rng.randint(0, 5000), text.upper() if rng.random() < 0.1 else text))
    return out


@pytest.mark.parametrize("tile", [2_000_000, 300])
def test_components_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_KEYS", tile)
    pairs = noisy(tile, 600) + [(r[0], r[1]) for r in rows()] + [(1, None), (7002, "é É"), (7003, "é É"), (7004, "É é"), (7005, "A b"), (7006, "a B")]
    docs = spark.createDataFrame([(*p, 1, "x") for p in pairs], "doc_id long, text string, n int, node string")
    want = brute(pairs)
    got = jaccard.components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    if tile == 300:
        kept = jaccard.keep_one(docs)
        assert kept.schema == docs.schema
        stay = [(r.doc_id, r.text) for r in kept.where("doc_id IS NOT NULL").collect()]
        part = {p: c for p, c in zip(pairs, brute_rows(pairs)) if p[0] is not None}
        worded = [part[p] for p in stay if shingles(p[1])]
        assert sorted(worded) == sorted({c for p, c in part.items() if shingles(p[1])}) and all(c == p[0] for p, c in part.items() if p in stay)
        assert sorted(map(str, (p for p in stay if not shingles(p[1])))) == sorted(map(str, {p for p in part if not shingles(p[1])}))
        assert kept.where("doc_id IS NULL").count() == sum(p[0] is None for p in pairs)


def test_no_rows_and_one_row(spark):
    empty = documents(spark, [])
    assert jaccard.components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    assert [tuple(r) for r in jaccard.components(documents(spark, rows()[3:4])).collect()] == [(3, 1, 3)]


def test_prefixes_and_bitmaps_are_bounds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, n // 8 + 1)).astype(np.uint64)]))
        b = np.unique(np.concatenate([common[rng.random(n) < 0.97], rng.integers(0, 2**63, rng.integers(0, n // 8 + 1)).astype(np.uint64)]))
        if not jaccard.alike(a, b):
            continue
        assert set(a[:jaccard.prefix_length(len(a))].tolist()) & set(b[:jaccard.prefix_length(len(b))].tolist())
        x, y = (jaccard.parity_bitmap(s, jaccard.bitmap_words(len(s))) for s in (a, b))
        least = int(jaccard.Bitmaps([x.tobytes(), y.tobytes()]).difference(np.asarray([0]), np.asarray([1]))[0])
        assert least <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def brute_top(vectors, k, every):
    fine = [(i, np.floor(256 * np.asarray(v, float)).astype(np.int64)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in fine:
        if i % every == 0:
            best = sorted((-int(w @ v), j) for j, w in fine if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 1024), (17, 3)])
def test_search_matches_brute_force(spark, sizes):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(12)]
    vectors += [(300, None), (301, []), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (305, [float("inf")] * 8), (306, [1.0, 2.0]), (310, [3.0, 4.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    q = vafile.quantised(table, "vec_id", "embedding", 256)
    got = vafile.search(q.where("id % 5 = 0"), q, 5, *sizes)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors, 5, 5)
    assert vafile.search(q.where("id < 0"), q, 5).count() == 0 and vafile.search(q, q.where("id < 0"), 5).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    exact, queries = rng.integers(-300, 300, (400, 16)), rng.integers(-300, 300, (9, 16))
    made = vafile.Approximation.of(exact)
    for q in queries:
        lower, upper = made.bounds(q.astype(float))
        assert (lower <= exact @ q).all() and (exact @ q <= upper).all() and (upper - lower).mean() < 0.2 * np.abs(exact @ q).max()


def test_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 32))
    vectors = [(i, (centres[i % 20] + 0.2 * rng.normal(size=32)).tolist()) for i in range(2000)]
    q = vafile.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256).withColumn("mark", F.xxhash64("id", "v"))
    asked = q.where("id % 50 = 0")
    near = vafile.survivors(asked, vafile.files(q, 4), 5, 4, 1)
    assert near.count() < 0.1 * asked.count() * 2000


def test_kept_rows_tell_null_from_empty_and_stand_clashing_names(spark):
    text = "one two three four five six seven"
    data = [(1, None, "zz", 1), (1, "", "yy", 2), (1, "", "yy", 2), (2, text, "a", 3), (3, text.upper(), "b", 4), (None, text, "c", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, __id string, mark int").withColumnsRenamed({"__id": "row"})
    docs = docs.selectExpr("*", "'p' AS place", "'x' AS __mark", "7 AS node")
    kept = jaccard.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((str(r.doc_id), str(r.text), r.row, r.mark) for r in kept.collect()) == [("1", "", "yy", 2), ("1", "None", "zz", 1), ("2", text, "a", 3), ("None", text, "c", 5)]
