"""Quality classifier, language identification and perplexity rules: held-out accuracy, brute force and awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hiremill.llm import langid, perplexity, quality_model
from tests.llm.samples import documents, prose, rows

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_agrees_with_labels_it_never_saw(tables):
    docs, labels = tables
    kept = {r.doc_id: r.kept for r in quality_model.score_documents(docs).collect()}
    right = [kept[i] == bool(r.quality) for i, r in labels.items()]
    clean = [kept[i] for i, r in labels.items() if r.quality]
    assert np.mean(right) >= 0.96 and np.mean(clean) >= 0.98


def test_expectation_maximisation_finds_the_accuracies():
    rng, k = np.random.default_rng(4), len(quality_model.LABELLERS)
    truth = rng.random(20_000) < 0.8
    accuracy = np.linspace(0.7, 0.95, k)
    votes = np.where((rng.random((len(truth), k)) < accuracy) == truth[:, None], 1, -1)
    patterns, counts = np.unique(quality_model.pattern_codes(votes), return_counts=True)
    model = quality_model.estimate(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(np.asarray(list(model.accuracies().values())) - accuracy).max() < 0.04
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    got = quality_model.score_documents(docs, sample_rows=10)
    assert got.columns == ["doc_id", "n_words", "label_good", "score", "kept"] and got.count() == len(rows())
    assert all(not r.kept and r.score == 0 for r in got.where("doc_id IN (0, 1, 2)").collect())
    assert len({r.score for r in got.where("doc_id IN (10, 11)").collect()}) == 1
    kept = quality_model.keep_good(docs, sample_rows=10)
    assert kept.schema == docs.schema and kept.count() == got.where("kept").count()
    assert quality_model.score_documents(documents(spark, [])).count() == 0 and quality_model.keep_good(documents(spark, [])).count() == 0


def test_language_accuracy_held_out(tables):
    docs, _ = tables
    got = langid.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 250 and np.mean([r.lang_pred == r.lang for r in got]) >= 0.97
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"] and got.count() == len(rows())
    found = {r.doc_id: r for r in got.where("doc_id IS NOT NULL").collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 5, 6))
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und" or r.lang_pred in ("en", "fr", "")) for r in found.values())
    assert langid.identify(documents(spark, [])).count() == 0
    nothing = documents(spark, [(i, "some text", None, None, 1, None, None, None, None, None) for i in range(4)])
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    data = [(i, prose(i, 150), "en", "s", 1, None, None, None, None, None) for i in range(60)] + [(900, "zzxq wvkj " * 30, "en", "s", 1, None, None, None, None, None)]
    model = langid.fit(documents(spark, data[:60]), langid.F.lit(True))
    got = {r.doc_id: r for r in langid.predict(documents(spark, data), model, ["doc_id"]).collect()}
    assert got[900].rejected and sum(r.rejected for r in got.values()) <= 3


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_rules_match_brute_force(spark, tables):
    for docs in (documents(spark), tables[0]):
        texts = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
        got = perplexity.judge_documents(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)


def test_clean_documents_stay_in_their_band(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in perplexity.judge_documents(docs).collect()}
    clean = [got[i].kept for i, r in labels.items() if r.quality and not got[i].base_failed]
    assert np.mean(clean) >= 0.99


def test_kneser_ney_is_a_distribution():
    rng = random.Random(2)
    text = "".join(rng.choice("abcd ") for _ in range(5000)).encode()
    grams, _ = perplexity.trigrams(np.frombuffer(text, np.uint8), np.asarray([0, len(text)]))
    keys, counts = np.unique(grams, return_counts=True)
    model = perplexity.Model.of(keys, counts)
    for context in (ord("a") << 8 | ord("b"), ord("z") << 8 | ord("a"), ord("z") << 8 | ord("y")):
        all_next = np.asarray([context << 8 | w for w in range(256)], np.uint32)
        assert math.isclose(np.exp(model.log_probability(all_next)).sum(), 1, rel_tol=1e-4)
    seen = perplexity.trigrams(np.frombuffer(b"abcd", np.uint8), np.asarray([0, 4]))[0]
    odd = perplexity.trigrams(np.frombuffer(b"#~#~", np.uint8), np.asarray([0, 4]))[0]
    assert model.log_probability(seen).mean() > model.log_probability(odd).mean()


def test_trigram_counts_match_brute_force(spark):
    got = {r.ngram: r.n for r in perplexity.ngram_counts(documents(spark)).collect()}
    classes, want = perplexity._classes(), Counter()
    for r in rows():
        if r[1]:
            symbols = [0, 0, *(int(classes[ord(c)]) for c in r[1]), 2]
            want.update(a << 16 | b << 8 | c for a, b, c in zip(symbols, symbols[1:], symbols[2:]))
    assert got == dict(want)


def test_garbage_leaves_the_band(spark):
    rng = random.Random(8)
    data = [(i, prose(i, 120), "en", "s", 1, None, None, None, None, None) for i in range(80)]
    data.append((900, " ".join("".join(chr(rng.randint(33, 126)) for _ in range(9)) for _ in range(80)), "en", "s", 1, None, None, None, None, None))
    got = {r.doc_id: r for r in perplexity.judge_documents(documents(spark, data)).collect()}
    assert not got[900].kept and not got[900].base_failed
    assert sum(r.base_failed or r.kept for r in got.values()) >= 80
    kept = perplexity.keep_fluent(documents(spark, data))
    assert kept.schema == documents(spark, data).schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert perplexity.judge_documents(documents(spark, [])).count() == 0 and perplexity.keep_fluent(documents(spark, [])).count() == 0


def test_planted_junk_leaves_the_band(tables):
    """Symbol spam and word lists of the table: labelled 0, yet long and varied enough for the base rules."""
    docs, labels = tables
    got = {r.doc_id: r for r in perplexity.judge_documents(docs).collect()}
    junk = [got[i].kept for i, r in labels.items() if not r.quality and not got[i].base_failed]
    assert len(junk) > 20 and not any(junk)


def test_spam_and_lists_leave_the_band_and_prose_stays(spark):
    data = [(i, prose(i, 120), "en", "s", 1, None, None, None, None, None) for i in range(80)]
    data += [(900 + i, " ".join(w + "#$%"[(i + k) % 3] * 3 for k, w in enumerate(prose(100 + i, 120).split())), "en", "s", 1, None, None, None, None, None) for i in range(6)]
    data += [(950 + i, " ".join(w + "|" for w in prose(200 + i, 120).split()), "en", "s", 1, None, None, None, None, None) for i in range(6)]
    got = {r.doc_id: r for r in perplexity.judge_documents(documents(spark, data)).collect()}
    assert not any(r.kept or r.base_failed for i, r in got.items() if i >= 900)
    assert sum(r.kept or r.base_failed for i, r in got.items() if i < 900) >= 79
