"""Quality rules: an n-gram model counted by Spark, modified Kneser-Ney smoothing, and perplexity bands per language.

The model is one trigram model of symbols for the whole corpus, so that a text that mixes languages stays likely; every language has
its own lower and upper perplexity band. A symbol is a code point below 128 or one of 128 classes into which the others are hashed:
there are at most 2**24 trigrams, hence the sorted hash arrays have a proven bound (about 200 MB) and are broadcast. A code point of a
class is as likely as its class after the symbols before, times its own share of the class, so that no two code points are taken for
one another; these shares are one number for each code point (4.5 MB).

Texts that a model is trained on look likely to it, junk too. A first model therefore counts a trigram once in each document, which
takes from spam the weight of its repetitions; then the model is counted anew `REFITS` times, from the documents in the core of their
language under the model before. A scan scores all documents under a model and counts their trigrams by language and coarse loss in the
same go, so that the core can be chosen and counted afterwards without reading them again. All documents are read and scored by every
model, and the bands are those of the last one: two scans and REFITS. Only (n-gram, count) rows and histograms are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from hiremill.llm.arrays import LEAD, SPACE, code_points, mixed, per_row, sliced, text_chunks, windows, words_of
from hiremill.llm.shared import dropped, freed, ship_package, written

#: Base rules: fewest words, and the largest share of words in repeated three-word windows (per cent).
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
#: Width of a band in robust standard deviations, its least half width in nats, and the same for texts by length: a text of n symbols
#: strays by about 1 / sqrt(n).
BAND_WIDTH, LEAST_HALF_WIDTH, LENGTH_TERM = 8.0, 0.12, 2.0
#: Counts anew, and the core that they are taken from, in robust standard deviations below and above the median.
REFITS, CORE_BELOW, CORE_ABOVE = 2, 4.0, 1.0
#: Histogram of the mean negative log-likelihood in nats. It reaches to 327: no symbol can be less likely than about exp(-112) (two
#: back-off weights of at least a tenth of 1 / 2**63 each, and the floor of a single symbol), and no code point's share of its class less
#: than exp(-58) (1 / 2**63 of its counts and 1 / 2**20 of the new ones), so that no text lies beyond the last bin.
BIN, BINS = 0.005, 1 << 16
#: Histogram bins that trigrams are counted by together.
COARSE = 4
#: Bytes of texts whose trigrams are in memory at once.
SCORED_BYTES = 1 << 18
#: Counted n-grams that a task holds before it merges them, and the same by language and loss.
HELD, SCAN_HELD = 1_000_000, 1_000_000
NO_LANGUAGE = "und"
_START, _END = 0, 2
_POINTS = 0x110000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        points = np.arange(_POINTS, dtype=np.uint64)
        _CLASSES.append(np.where(points < 128, points, np.uint64(128) + mixed(points) % np.uint64(128)).astype(np.uint8))
    return _CLASSES[0]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of symbols (two starts before, one end after each row that has text) and their rows."""
    symbols = _classes()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    lengths = code_points(data, offsets)
    full = np.flatnonzero(lengths)
    if not len(full):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    own = lengths[full]
    row = np.repeat(np.arange(len(full)), own + 3)
    begin = np.concatenate([[0], np.cumsum(own + 3)])[:-1]
    padded = np.full(len(row), _START, np.uint32)
    padded[np.arange(len(symbols)) + 3 * np.repeat(np.arange(len(full)), own) + 2] = symbols
    padded[begin + own + 2] = _END
    keep = np.ones(len(row), bool)
    keep[begin] = keep[begin + 1] = False
    at = np.flatnonzero(keep)
    return padded[at - 2] << np.uint32(16) | padded[at - 1] << np.uint32(8) | padded[at], full[row[at]]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points above 127 and their rows."""
    at = np.flatnonzero(data >= 0xC0)
    first, rest = data[at].astype(np.int64), [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    two, three = (first & 0x1F) << 6 | rest[0], (first & 0x0F) << 12 | rest[0] << 6 | rest[1]
    four = (first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
    point = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return np.minimum(point, _POINTS - 1), np.searchsorted(offsets, at, "right") - 1


def letter_shares(points: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural logarithm of each code point's share of its class, by Witten and Bell: new code points have as many counts as kinds were seen."""
    kind = _classes()
    count = np.zeros(_POINTS)
    count[points] = n
    total, seen, size = (np.bincount(kind, weights=w, minlength=256) for w in (count, count > 0, np.ones(_POINTS)))
    new = np.maximum(seen, 1)
    out = np.log((count + (new / size)[kind]) / (total + new)[kind]).astype(np.float32)
    out[:128] = 0
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def _counted(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One batch (ngram, n) over all arrays of trigrams of a task."""
    keys, counts, held = [], [], 0
    for grams in parts:
        unique, n = np.unique(grams, return_counts=True)
        keys.append(unique)
        counts.append(n)
        held += len(unique)
        if held > HELD:
            unique, n = _summed(keys, counts)
            keys, counts, held = [unique], [n], 0
    if keys:
        unique, n = _summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(unique.astype(np.int32)), pa.array(n)], names=["ngram", "n"])
    freed()


def ngram_counts(docs: DataFrame, text: str = "text", once: bool = False) -> DataFrame:
    """(ngram, n): trigrams of all whole texts, summed within each task before the shuffle. once: in how many rows each stands."""
    ship_package(docs.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), SCORED_BYTES):
                grams, row = trigrams(data, offsets)
                yield np.unique(row.astype(np.uint64) << np.uint64(32) | grams).astype(np.uint32) if once else grams

    return docs.select(text).mapInArrow(lambda batches: _counted(parts(batches)), "ngram int, n long").groupBy("ngram").agg(F.sum("n").alias("n"))


def first_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(ngram, n): in how many rows each trigram stands, and each code point above 127, which is below zero as an ngram."""
    ship_package(docs.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), SCORED_BYTES):
                (grams, row), (points, of) = trigrams(data, offsets), letters(data, offsets)
                code, own = np.append(grams.astype(np.int64), -points) & 0xFFFFFFFF, np.append(row, of)
                yield np.unique(own.astype(np.int64) << 32 | code).astype(np.uint32).view(np.int32)

    return docs.select(text).mapInArrow(lambda batches: _counted(parts(batches)), "ngram int, n long").groupBy("ngram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3 and more, from the counts of counts; fixed fractions where those are too few."""
    n1, n2, n3, n4 = ((counts == k).sum() for k in (1, 2, 3, 4))
    if min(n1, n2, n3, n4) == 0:
        return np.asarray([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.asarray([0, *(min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), raw))])


def _level(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated probabilities of the n-grams of one order; contexts and their back-off weights. keys are sorted."""
    d = _discounts(counts)[np.minimum(counts, 3)]
    contexts, of = np.unique(keys >> 8, return_inverse=True)
    total = np.bincount(of, weights=counts)
    weight = np.bincount(of, weights=d) / total
    return (counts - d) / total[of] + weight[of] * lower, contexts, weight


@dataclass
class Model:
    """Sorted n-gram hashes with log probabilities, sorted context hashes with log back-off weights."""

    three: np.ndarray
    log_three: np.ndarray
    contexts_two: np.ndarray
    back_two: np.ndarray
    two: np.ndarray
    log_two: np.ndarray
    contexts_one: np.ndarray
    back_one: np.ndarray
    log_one: np.ndarray
    #: Of code points in their classes; None takes all of a class for one.
    log_shares: np.ndarray | None = None

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, log_shares: np.ndarray | None = None) -> Model:
        order = np.argsort(grams)
        three, c3 = grams[order].astype(np.int64), counts[order]
        two, c2 = np.unique(three & 0xFFFF, return_counts=True)
        c1 = np.bincount(two & 0xFF, minlength=256)
        seen = c1 > 0
        d = _discounts(c1[seen])[np.minimum(c1, 3)] * seen
        one = (c1 - d) / c1.sum() + d.sum() / c1.sum() / 256
        p2, ctx1, w1 = _level(two, c2, one[two & 0xFF])
        p3, ctx2, w2 = _level(three, c3, p2[np.searchsorted(two, three & 0xFFFF)])
        f = np.float32
        return cls(three.astype(np.uint32), np.log(p3).astype(f), ctx2.astype(np.uint32), np.log(w2).astype(f),
                   two.astype(np.uint32), np.log(p2).astype(f), ctx1.astype(np.uint32), np.log(w1).astype(f), np.log(one).astype(f), log_shares)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithms, backing off from trigram to bigram to symbol."""
        out, miss = _found(self.three, self.log_three, grams)
        if len(miss):
            rest = grams[miss]
            low, missing = _found(self.two, self.log_two, rest & np.uint32(0xFFFF))
            if len(missing):
                last = rest[missing]
                back, none = _found(self.contexts_one, self.back_one, last >> np.uint32(8) & np.uint32(0xFF))
                back[none] = 0
                low[missing] = back + self.log_one[last & np.uint32(0xFF)]
            back, none = _found(self.contexts_two, self.back_two, rest >> np.uint32(8))
            back[none] = 0
            out[miss] = low + back
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at].astype(np.float64), np.flatnonzero(keys[at] != wanted)


def _model(counted: DataFrame, log_shares: np.ndarray | None = None) -> Model | None:
    """From rows of trigrams, and of code points unless their shares are given."""
    rows = counted.toPandas()
    grams, n = rows["ngram"].to_numpy(), rows["n"].to_numpy()
    if log_shares is None:
        log_shares = letter_shares(-grams[grams < 0], n[grams < 0])
        grams, n = grams[grams >= 0], n[grams >= 0]
    return Model.of(grams, n, log_shares) if len(grams) else None


def _chunk_scores(column: pa.Array, model: Model) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their mean negative log-likelihood (nan: no text) and symbols; trigrams and their row within the chunk."""
    for first, end, data, offsets in text_chunks(column, SCORED_BYTES):
        grams, row = trigrams(data, offsets)
        n = np.bincount(row, minlength=end - first)
        total = np.bincount(row, weights=-model.log_probability(grams), minlength=end - first)
        if model.log_shares is not None:
            points, of = letters(data, offsets)
            total -= np.bincount(of, weights=model.log_shares[points], minlength=end - first)
        yield slice(first, end), np.divide(total, n, out=np.full(end - first, np.nan), where=n > 0), n, grams, row


def _scores(column: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log-likelihood (nan: no text) and symbols of each row."""
    loss, symbols = np.full(len(column), np.nan), np.zeros(len(column), np.int64)
    if model is not None:
        for part, found, n, _, _ in _chunk_scores(column, model):
            loss[part], symbols[part] = found, n
    return loss, symbols


def _bands(histogram: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[float, float]]:
    """Median and robust spread of the mean negative log-likelihood of each language's documents.

    The spread is that of the half below the median: junk is unlikely and would widen the other half.
    """
    out = {}
    for name, (bins, n) in histogram.items():
        order = np.argsort(bins)
        values, weight = (bins[order] + 0.5) * BIN, n[order]

        def middle(v: np.ndarray, w: np.ndarray) -> float:
            total = np.cumsum(w)
            return float(v[np.searchsorted(total, total[-1] / 2)])

        centre = middle(values, weight)
        below = values <= centre
        out[name] = (centre, max(1.4826 * middle((centre - values[below])[::-1], weight[below][::-1]), BIN))
    return out


def base_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts."""
    rows = len(column)
    out = {k: np.zeros(rows, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for first, end, data, offsets in text_chunks(column):
        words = words_of(data, offsets, False)
        part = slice(first, end)
        out["n_words"][part] = np.diff(words.first)
        out["word_chars"][part] = per_row(LEAD[data] & ~SPACE[data], offsets)
        out["n_symbols"][part] = per_row(_IS_SYMBOL[data], offsets)
        at, hashes = windows(words, WINDOW)
        if len(at):
            key = mixed(hashes + words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(at), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            covered = np.zeros(len(words.row), bool)
            for k in range(WINDOW):
                covered[at[again] + k] = True
            out["n_repeat_words"][part] = np.bincount(words.row[covered], minlength=end - first)
        raw = data.tobytes()
        for i in np.flatnonzero(per_row(data == 10, offsets)):
            lines = [line for line in raw[offsets[i]:offsets[i + 1]].split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
            out["n_dup_lines"][first + i] = len(lines) - len(set(lines))
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def scan(docs: DataFrame, text: str, lang: str, shared: Broadcast) -> DataFrame:
    """Scratch table (lang, bin, ngram, n) of all documents under a model: documents by bin (ngram null), and trigrams by coarse bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        hist: dict[int, int] = {}
        keys, counts, held = [], [], 0

        def report() -> Iterator[pa.RecordBatch]:
            key, n = _summed(keys, counts)
            langs = pa.array(list(names), pa.string()).take(pa.array((key >> np.uint64(40)).astype(np.int32)))
            yield from sliced(pa.RecordBatch.from_arrays(
                [langs, pa.array((key >> np.uint64(24) & np.uint64(0xFFFF)).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array(n)], names=["lang", "bin", "ngram", "n"]))

        for batch in batches:
            own = np.asarray([names.setdefault(x or NO_LANGUAGE, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            for part, loss, _, grams, row in _chunk_scores(batch.column(0), shared.value):
                bins = np.minimum(np.nan_to_num(loss) / BIN, BINS - 1).astype(np.int64)
                code = own[part] << 16 | bins
                for c, n in zip(*np.unique(code[~np.isnan(loss)], return_counts=True)):
                    hist[int(c)] = hist.get(int(c), 0) + int(n)
                # Rows of one language and coarse bin are counted together: one histogram of trigrams for each.
                group = own[part] << 16 | bins // COARSE
                unique, n = np.unique((group[row] << 24).astype(np.uint64) | grams, return_counts=True)
                keys.append(unique)
                counts.append(n)
                held += len(unique)
                if held > SCAN_HELD:
                    merged = _summed(keys, counts)
                    keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                    if held > SCAN_HELD // 2:
                        yield from report()
                        keys, counts, held = [], [], 0
        if keys:
            yield from report()
        if hist:
            langs, code = list(names), list(hist)
            yield pa.RecordBatch.from_arrays([pa.array([langs[c >> 16] for c in code], pa.string()), pa.array([c & 0xFFFF for c in code], pa.int32()), pa.nulls(len(code), pa.int32()), pa.array(list(hist.values()), pa.int64())],
                                             names=["lang", "bin", "ngram", "n"])
        freed()

    counted = docs.select(F.col(f"`{text}`"), F.col(f"`{lang}`")).mapInArrow(run, "lang string, bin int, ngram int, n long").groupBy("lang", "bin", "ngram").agg(F.sum("n").alias("n"))
    return written(counted, "scan")


def _language_bands(histogram: DataFrame) -> dict[str, tuple[float, float]]:
    """Bands of all languages from (lang, bin, n)."""
    rows = histogram.toPandas()
    return _bands({k: (g["bin"].to_numpy(), g["n"].to_numpy()) for k, g in rows.groupby("lang")})


def core_counts(scanned: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(ngram, n): trigrams of the documents in the core of their language, by the middle of their coarse bin."""
    ranges = [(k, centre - CORE_BELOW * spread, centre + CORE_ABOVE * spread) for k, (centre, spread) in bands.items()]
    cores = scanned.sparkSession.createDataFrame(ranges, "lang string, low double, high double")
    middle = (F.col("bin") + 0.5) * (BIN * COARSE)
    inside = scanned.where("ngram IS NOT NULL").join(cores, "lang").where(middle.between(F.col("low"), F.col("high")))
    return inside.groupBy("ngram").agg(F.sum("n").alias("n"))


def fit_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> Broadcast:
    """The model of the languages' cores; None where there is no text."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(_model(first_counts(docs.select(F.col(f"`{text}`").alias("text")))))
    if shared.value is None:
        return shared
    for _ in range(REFITS):
        before, scanned = shared, scan(docs, text, lang, shared)
        bands = _language_bands(scanned.where("ngram IS NULL").select("lang", "bin", "n"))
        shared = sc.broadcast(_model(core_counts(scanned, bands), before.value.log_shares))
        before.unpersist()
        dropped(scanned)
    return shared


_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(docs: DataFrame, row: Column, text: str, lang: str, inside: bool) -> DataFrame:
    """(row, base statistics, base_failed, loss, lower, upper, kept) of all documents; row is any expression of theirs.

    inside: row is a struct of all columns, from which the text is taken, so that it is sent once.
    """
    ship_package(docs.sparkSession)
    shared = fit_model(docs, text, lang)
    sent = [] if inside else [F.col(f"`{text}`").alias("text")]
    given = docs.select(row.alias("row"), F.coalesce(F.nullif(F.col(f"`{lang}`"), F.lit("")), F.lit(NO_LANGUAGE)).alias("lang"), *sent)
    place = docs.columns.index(text)
    kind = given.schema["row"].dataType
    more = [*((c, LongType()) for c in _LONGS), ("base_failed", BooleanType()), ("loss", DoubleType()), ("symbols", LongType())]
    schema = StructType([StructField("row", kind), StructField("lang", StringType()), *(StructField(c, k) for c, k in more)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [place]) if inside else batch.column(2)
            loss, symbols = _scores(texts, shared.value)
            stats = base_stats(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(stats[c]) for c in _LONGS), pa.array(base_failed(stats)), pa.array(loss, mask=np.isnan(loss)), pa.array(symbols)],
                                             names=schema.names)
        freed()

    scored = written(given.mapInArrow(score, schema), "scored")
    shared.unpersist()
    bands = _language_bands(scored.where("loss IS NOT NULL").groupBy("lang", F.least(F.floor(F.col("loss") / BIN), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n")))
    # One bounded entry for each language, so the bands are a small map in the row and no join moves texts.
    centre, spread = (F.try_element_at(F.create_map(*[x for name, band in bands.items() for x in (F.lit(name), F.lit(band[i]))]), F.col("lang")) if bands
                      else F.lit(None).cast("double") for i in (0, 1))
    known = scored.withColumns({"centre": centre, "spread": spread})
    half = F.greatest(F.col("spread") * BAND_WIDTH, F.lit(LEAST_HALF_WIDTH)) + F.lit(LENGTH_TERM) / F.sqrt(F.greatest("symbols", F.lit(1)))
    judged = known.withColumns({"lower": F.col("centre") - half, "upper": F.col("centre") + half})
    out = F.coalesce((F.col("loss") < F.col("lower")) | (F.col("loss") > F.col("upper")), F.lit(False))
    return judged.withColumn("kept", ~out & ~F.col("base_failed"))


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: (key, base statistics, base_failed, perplexity, its band, kept). Key, text and lang differ.

    Null text counts as empty: no words, no perplexity, base_failed. A null or empty language is a language of its own. Repeated rows
    are judged alike. Other columns are not read, whatever they are called; an empty table gives an empty result.
    """
    judged = _judged(docs, F.col(f"`{key}`"), text, lang, False)
    bounds = [F.exp("loss").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper")]
    return judged.select(F.col("row").alias(key), *_LONGS, "base_failed", *bounds, "kept")


def keep_fluent(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass the base rules and lie in their language's perplexity band; columns as given, of any names."""
    judged = _judged(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text, lang, True)
    return judged.where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
