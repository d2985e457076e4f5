"""Quality classifier: heuristic labellers vote, expectation-maximisation weighs them, a hashed linear scorer learns the posterior.

1. Every whole text gets the votes of overlapping labellers (good, bad or no vote). Spark counts the vote patterns; there are at most
   3**7 of them, whatever the corpus.
2. Expectation-maximisation over the pattern counts estimates each labeller's accuracies and the share of good texts. No human label is used.
3. A logistic model over hashed features learns the posteriors of a bounded sample: the `sample_rows` documents with the smallest hash
   of their text. All documents are scored; a document is kept if its score reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.arrays import LEAD, SPACE, mixed, per_row, text_chunks, windows, words_of
from hiremill.llm.shared import freed, ship_package

#: Documents that train the scorer at most, hashed features, passes, step and penalty of the training, least score that is kept.
SAMPLE_ROWS, FEATURES, PASSES, RATE, PENALTY, THRESHOLD = 20_000, 4096, 300, 2.0, 1e-4, 0.5
GOOD, BAD, NONE = 1, -1, 0
#: Labellers in the order of their votes: (name, measure, good up to, bad from).
LABELLERS = [
    ("symbols", "symbol_share", 0.005, 0.03),
    ("capitals", "capital_share", 0.08, 0.3),
    ("repeats", "repeat_share", 0.10, 0.35),
    ("same_words", "same_share", 0.01, 0.2),
    ("marks", "mark_share", 0.04, 0.12),
    ("decorated", "decorated_share", 0.02, 0.2),
    ("short", "shortness", 0.05, 0.2),
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@+"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?#*$%&|<>{}[]\\^~=_@+;:/\"()"]] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True


def _byte_classes() -> np.ndarray:
    """Letters by case, digits, white space, other bytes as they are."""
    out = np.arange(256, dtype=np.uint64)
    out[65:91], out[97:123], out[48:58] = 65, 97, 48
    out[128:] = 128
    out[SPACE] = 32
    out[10] = 10
    return out


_CLASS = _byte_classes()


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Shares that the labellers look at, for each row; 0 where there is nothing to measure."""
    rows = len(offsets) - 1
    words = words_of(data, offsets, False)
    n_words = np.diff(words.first).astype(float)
    inside = per_row(LEAD[data] & ~SPACE[data], offsets).astype(float)
    letters = per_row(_LOWER[data] | _UPPER[data], offsets).astype(float)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(rows), where=b > 0)

    at, hashes = windows(words, 3)
    key = mixed(hashes + words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    again = order[1:][key[order][1:] == key[order][:-1]]
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1]))
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    decorated = _SYMBOL[last] | (last == ord("!"))
    return {
        "symbol_share": share(per_row(_SYMBOL[data], offsets), inside),
        "capital_share": share(per_row(_UPPER[data], offsets), letters),
        "repeat_share": share(np.bincount(words.row[at[again]], minlength=rows), n_words),
        "same_share": share(np.bincount(words.row[same], minlength=rows), n_words),
        "mark_share": share(per_row(_MARK[data], offsets), inside),
        "decorated_share": share(np.bincount(words.row[decorated], minlength=rows), n_words),
        "shortness": 1 / np.maximum(n_words, 1),
        "n_words": n_words,
        "repeat_words": np.bincount(words.row[at[again]], minlength=rows),
    }


def votes_of(found: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of each row: GOOD, BAD or NONE by labeller. A text without words has only bad votes."""
    votes = np.stack([np.where(found[m] <= good, GOOD, np.where(found[m] >= bad, BAD, NONE)) for _, m, good, bad in LABELLERS], axis=1)
    votes[found["n_words"] == 0] = BAD
    return votes


def pattern_codes(votes: np.ndarray) -> np.ndarray:
    return (votes + 1) @ (3 ** np.arange(votes.shape[1]))


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n) over all documents; patterns are votes as base-3 numbers."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                total += np.bincount(pattern_codes(votes_of(measures(data, offsets))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pattern", "n"])

    return docs.select(text).mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass
class LabelModel:
    """Share of good texts, and the probability of each vote of each labeller for good and for bad texts."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        which = np.arange(votes.shape[1])
        odds = np.log(self.prior / (1 - self.prior)) + np.log(self.good[which, votes + 1] / self.bad[which, votes + 1]).sum(1)
        return 1 / (1 + np.exp(-odds))

    def accuracies(self) -> dict[str, float]:
        """Probability that a vote that was cast is right."""
        out = {}
        for i, (name, *_) in enumerate(LABELLERS):
            right = self.prior * self.good[i, GOOD + 1] + (1 - self.prior) * self.bad[i, BAD + 1]
            wrong = self.prior * self.good[i, BAD + 1] + (1 - self.prior) * self.bad[i, GOOD + 1]
            out[name] = float(right / (right + wrong))
        return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, started from the majority vote; a bad vote weighs more as it is rarer."""
    k = len(LABELLERS)
    votes = patterns[:, None] // 3 ** np.arange(k) % 3 - 1
    p = np.where((votes == BAD).any(1), 0.1, 0.95)
    onehot = (votes[:, :, None] == np.asarray([BAD, NONE, GOOD])).astype(float)
    model = LabelModel(0.5, np.full((k, 3), 1 / 3), np.full((k, 3), 1 / 3))
    for _ in range(rounds):
        g, b = counts * p, counts * (1 - p)
        model = LabelModel(
            float((g.sum() + 1) / (counts.sum() + 2)),
            (np.einsum("i,ijk->jk", g, onehot) + 1) / (g.sum() + 3), (np.einsum("i,ijk->jk", b, onehot) + 1) / (b.sum() + 3))
        new = model.posterior(votes)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return model


def features(data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each row: (row * FEATURES + feature, weight). Shares of byte-class trigrams and binned measures; rows have unit length."""
    rows = len(offsets) - 1
    cls = _CLASS[data]
    cells = np.zeros(0, np.int64)
    if len(data) > 2:
        row = np.searchsorted(offsets, np.arange(len(data) - 2), "right") - 1
        own = offsets[1:][row] >= np.arange(len(data) - 2) + 3
        gram = mixed(cls[:-2] << np.uint64(16) | cls[1:-1] << np.uint64(8) | cls[2:]) % np.uint64(FEATURES)
        cells = (row * FEATURES + gram.astype(np.int64))[own]
    cell, n = np.unique(cells, return_counts=True)
    weight = np.sqrt(n.astype(float))
    bins = []
    for i, (_, m, good, bad) in enumerate(LABELLERS):
        step = np.digitize(found[m], [good / 2, good, (good + bad) / 2, bad, 2 * bad])
        bins.append(np.arange(rows) * FEATURES + (mixed((step + 100 * i + 7).astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64))
    norm = np.sqrt(np.bincount(cell // FEATURES, weights=weight**2, minlength=rows))
    weight = weight / np.maximum(norm[cell // FEATURES], 1e-9)
    extra = np.concatenate(bins)
    return np.concatenate([cell, extra]), np.concatenate([weight, np.full(len(extra), 0.5)])


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Logistic regression on soft labels by full gradient steps with momentum; the last weight is the constant."""
    if not rows:
        return np.zeros(FEATURES + 1)
    at = np.concatenate([np.full(len(c), i) for i, (c, _, _) in enumerate(rows)])
    cell, value = np.concatenate([c for c, _, _ in rows]), np.concatenate([v for _, v, _ in rows])
    label = np.asarray([p for _, _, p in rows])
    weight, speed = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for _ in range(PASSES):
        odds = np.bincount(at, weights=weight[cell] * value, minlength=len(rows)) + weight[-1]
        off = 1 / (1 + np.exp(-odds)) - label
        step = np.append(np.bincount(cell, weights=off[at] * value, minlength=FEATURES), off.sum()) / len(rows) + PENALTY * weight
        speed = 0.9 * speed - RATE * step
        weight += speed
    return weight


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Vote patterns of all documents, then the scorer from at most `sample_rows` of them (the smallest hashes of text)."""
    counted = vote_patterns(docs, text).toPandas().sort_values("pattern")
    labels = estimate(counted["pattern"].to_numpy(), counted["n"].to_numpy().astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, values, goods = [], [], []
            for _, end, data, offsets in text_chunks(batch.column(0)):
                found = measures(data, offsets)
                cell, value = features(data, offsets, found)
                p = labels.posterior(votes_of(found))
                order = np.argsort(cell, kind="stable")
                cell, value = cell[order], value[order]
                cut = np.searchsorted(cell, np.arange(len(offsets)) * FEATURES)
                for i in range(len(offsets) - 1):
                    part = slice(cut[i], cut[i + 1])
                    cells.append((cell[part] % FEATURES).astype("<u2").tobytes())
                    values.append(value[part].astype("<f4").tobytes())
                    goods.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), pa.array(values, pa.binary()), pa.array(goods, pa.float64())], names=["cells", "values", "good"])

    # The order is by a hash of the text, so copies stand together and the sample does not depend on ids or partitions.
    total = int(counted["n"].sum())
    share = min(1.0, 4.0 * sample_rows / max(total, 1))
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    near = docs.select(mark.alias("mark"), text).where(F.col("mark") <= F.lit(int(-2**63 + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    cut = near.select("mark").orderBy("mark").limit(sample_rows).agg(F.max("mark")).first()[0]
    chosen = near.where(F.col("mark") <= F.lit(cut if cut is not None else 0)).dropDuplicates(["mark"]).select(text)
    sample = chosen.mapInArrow(run, "cells binary, values binary, good double").toPandas()
    rows = [(np.frombuffer(c, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float), p) for c, v, p in zip(sample["cells"], sample["values"], sample["good"])]
    return QualityModel(labels, train(rows))


def _assess(column: pa.Array, model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, posterior of the votes and words of each row."""
    scores, posterior, words = [], [], []
    for first, end, data, offsets in text_chunks(column):
        found = measures(data, offsets)
        cell, value = features(data, offsets, found)
        odds = np.bincount(cell // FEATURES, weights=model.weights[cell % FEATURES] * value, minlength=end - first) + model.weights[-1]
        score = 1 / (1 + np.exp(-odds))
        score[found["n_words"] == 0] = 0
        scores.append(score)
        posterior.append(model.labels.posterior(votes_of(found)))
        words.append(found["n_words"])
    join = lambda x: np.concatenate(x) if x else np.zeros(0)
    return join(scores), join(posterior), join(words).astype(np.int64)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, label_good, score, kept) of every document.

    Null and empty texts have score 0 and are rejected; repeated rows get equal scores; other columns are not read; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, posterior, words = _assess(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(posterior), pa.array(score), pa.array(score >= threshold)], names=[key, "n_words", "label_good", "score", "kept"])
        freed()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, label_good double, score double, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold; columns as given."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_assess(batch.column(text), shared.value)[0] >= threshold))
        freed()

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
