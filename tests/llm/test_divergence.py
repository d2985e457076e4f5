"""Source divergence against a brute-force version in plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from hiremill.llm import divergence
from tests.llm.samples import documents, rows

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(data, ranks=200):
    """data: (text, lang, source) of every row."""
    n, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in data:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        n[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in seen[lang].items() if c >= 3]
        sources = [s for x, s in groups if x == lang]

        def p(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        probability = {s: p(n[lang, s]) for s in sources}
        whole = p(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            own = probability[s]
            pairs = sorted((-sum((own[t] - q[t]) ** 2 // q[t] for t in kept), o.encode()) for o, q in probability.items() if o != s)
            terms = sorted((-((own[t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if n[lang, s][t] and own[t] > whole[t])
            for part, found in (("pair", pairs), ("term", terms[:ranks])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("shard,band,held", [(64, 64, 1_500_000), (1, 2, 50)])
def test_audit_matches_brute_force(spark, monkeypatch, shard, band, held):
    monkeypatch.setattr(divergence, "SHARD_WORDS", shard)
    monkeypatch.setattr(divergence, "BAND_SOURCES", band)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PART_CHARS", 100 * held)
    extra = [(None, "Ünïcode_word straße-ß ÀÉ éa", "de", f"q{i % 5}") for i in range(9)] + [(1, "solo", "xx", "a"), (2, None, "xx", "b"), (3, "tie tie", None, None), (4, "tie", None, "z"), (5, "tie", "", "z")]
    data = [(r[1], r[2], r[3]) for r in rows()] + [(t, x, s) for _, t, x, s in extra]
    table = documents(spark, rows() + [(i, t, x, s, 1, 0.0, True, 1, "a", "b") for i, t, x, s in extra])
    got = divergence.audit(table)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert result(got) == brute(data)


def test_hot_source_and_many_levels(spark):
    data = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400) for _ in range(1 + (i * k) % 37)), "en", "hot" if k % 3 else f"s{k}") for k in range(24)]
    assert result(divergence.audit(spark.createDataFrame(data, "text string, lang string, source string"))) == brute(data)


def test_empty_tables(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    assert result(divergence.audit(documents(spark, rows()[:1]))) == set()
