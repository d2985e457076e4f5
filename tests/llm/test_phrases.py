"""Collocations against a brute-force version in plain Python; double arrays against sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hiremill.llm import phrases
from hiremill.llm.double_array import DoubleArray
from tests.llm.samples import documents, prose, rows

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(data, least, top):
    """data: (text, lang) of every row."""
    count, n = defaultdict(Counter), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                count[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i:i + w] for p, a in candidates.items() for w in range(2, len(p)) for i in range(len(p) - w + 1) if 100 * a >= 80 * f[p[i:i + w]]}
        found = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = "the of House Éß water green tree big dog cat".split()
    out = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + ["New", "York", "city", "Hall"] * rng.randint(0, 2)
        out.append(("".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "!\n", "; "]) for w in words), rng.choice(["en", "en", "en", "fr", None, ""])))
    return out


@pytest.mark.parametrize("least,top,entries,held", [(30, 2000, 1 << 20, 3_000_000), (5, 20, 37, 100), (3, 1, 1 << 20, 50)])
def test_mining_matches_brute_force(spark, monkeypatch, least, top, entries, held):
    monkeypatch.setattr(phrases, "PART_ENTRIES", entries)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "SHARD", min(entries, 4096))
    more = texts(least)
    data = [(r[1], r[2]) for r in rows()] + more
    table = documents(spark, rows() + [(900 + i, t, x, "s", 1, 0.0, True, 1, "a", "b") for i, (t, x) in enumerate(more)])
    got = phrases.mine(table, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(data, least, top)


def test_ties_at_the_last_rank(spark):
    data = [(f"w{i} v{i}. " * 30, "en") for i in range(40)]
    got = phrases.mine(spark.createDataFrame(data, "text string, lang string"), top=7)
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 30, 7)


def test_empty_tables(spark):
    assert phrases.mine(documents(spark, [])).count() == 0
    assert phrases.mine(documents(spark, rows()[:3])).count() == 0
    assert phrases.mine(spark.createDataFrame([(prose(1, 5), "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("seed,symbols,n", [(1, 9, 60), (2, 400, 3000), (3, 5, 5), (4, 3000, 20_000)])
def test_double_arrays_hold_just_their_phrases(seed, symbols, n):
    rng = np.random.default_rng(seed)
    own = {tuple((1 + (rng.zipf(1.3, rng.integers(1, 5)) - 1) % symbols).tolist()) for _ in range(n)}
    listed = sorted(own)
    table = np.zeros((len(listed), 4), np.int64)
    for i, p in enumerate(listed):
        table[i, :len(p)] = p
    trie = DoubleArray(table, symbols)
    stream = 1 + (rng.zipf(1.3, 3000) - 1) % symbols
    stream[rng.random(3000) < 0.05] = 0
    run = np.cumsum(rng.random(3000) < 0.1)
    for size, (at, state) in enumerate(trie.walk(stream, run, 4), 1):
        ends = trie.accept[state]
        got = {(int(i), listed[e]) for i, e in zip(at, ends) if e >= 0}
        want = {(i, tuple(stream[i:i + size].tolist())) for i in range(3001 - size) if run[i] == run[i + size - 1] and tuple(stream[i:i + size].tolist()) in own}
        assert got == want
