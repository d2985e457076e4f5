"""Phrase collocation mining: double-array tries of Apriori-safe candidates, walked by numpy over all text positions at once.

1. Words are counted per language; those below the threshold are in no candidate.
2. Candidates of two words: neighbours that are both frequent. The tasks report each of their neighbours with how often it stands
   there; what stays below the threshold over all tasks is no candidate.
3. Candidates of three and four words: runs in which each two neighbours are frequent together, found by walking a trie of the pairs
   over all positions level by level, and reported and pruned in the same way.
4. Counts: all candidates stand in double-array tries that are broadcast in parts of a bounded size. A task advances the states of all
   positions level by level, bincounts the accepting states, and these shards are summed.

A language's words are symbols of their own (64-bit hashes of language and word), so one trie holds all languages. A trie holds at most
about PART_ENTRIES phrases; where there are more, they are dealt into parts by hash and the texts are read once for each part. A filter
of bits of all phrases then tells what the other parts hold; what it lets pass wrongly falls below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiremill.llm.arrays import Tokens, lower_strings, mixed, sliced, text_chunks, tokens_of
from hiremill.llm.double_array import DoubleArray
from hiremill.llm.shared import freed, ship_package, short_batches, written

if TYPE_CHECKING:
    import pandas as pd

#: Least count of a candidate, most words, ranks, scale of the scores, per cent of a phrase's count that a longer one must reach to drop it.
MIN_COUNT, MAX_WORDS, TOP, SCALE, COVERED = 30, 4, 2000, 2_000_000, 80
#: Phrases of a trie (about), positions that a task holds before it reports, bins of the scores, counts of a shard and parts of the shards.
PART_ENTRIES, HELD, SCORE_BINS, SHARD, SHARDS = 1 << 21, 1_000_000, 1000, 4096, 64
#: Bits of the filter of all phrases at most. Beyond some 10^7 phrases it lets more candidates pass; the results stay right.
FILTER_BITS = 1 << 27
NO_LANGUAGE = "und"

#: Bytes that end a piece, and bytes that are in no word.
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


class Texts:
    """Chunks of texts as symbols: (tokens, language of each row, symbol of each token, run of each token)."""

    def __init__(self) -> None:
        self.seeds: dict[str, int] = {}

    def _seed(self, lang: str) -> int:
        if lang not in self.seeds:
            self.seeds[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        return self.seeds[lang]

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tokens, list[str], np.ndarray, np.ndarray]]:
        for batch in batches:
            langs = [NO_LANGUAGE if x is None else x for x in batch.column(1).to_pylist()]
            seeds = np.asarray([self._seed(x) for x in langs], np.uint64)
            for first, end, data, offsets in text_chunks(batch.column(0)):
                tokens = tokens_of(data, offsets, _WORD, _BREAK)
                if len(tokens.hash):
                    run = np.cumsum(np.append(False, (tokens.piece[1:] != tokens.piece[:-1]) | (tokens.row[1:] != tokens.row[:-1])))
                    yield tokens, langs[first:end], mixed(tokens.hash ^ seeds[first + tokens.row]), run


def grouped(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first row of each code, and its sum of n (its rows, if n is not given)."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    start = np.flatnonzero(np.append(np.ones(min(len(codes), 1), bool), ordered[1:] != ordered[:-1]))
    total = np.diff(np.append(start, len(codes))) if n is None else np.add.reduceat(n[order], start) if len(start) else np.zeros(0, np.int64)
    return order[start], total


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, symbol, n) over all texts, each chunk's and then each task's words summed before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> Iterator[pa.RecordBatch]:
            symbols = np.concatenate([x[0] for x in held])
            first, n = grouped(symbols, np.concatenate([x[1] for x in held]))
            begin, length = (np.concatenate([x[k] for x in held])[first] for k in (3, 4))
            words = lower_strings(np.concatenate([x[2] for x in held]), begin + np.repeat(np.cumsum([0, *(len(x[2]) for x in held[:-1])]), [len(x[0]) for x in held])[first], length)
            langs = pa.array([lang for x in held for lang in x[6]], pa.string())
            row = np.concatenate([x[5] + at for x, at in zip(held, np.cumsum([0, *(len(x[6]) for x in held)]))])[first]
            columns = [langs.take(pa.array(row)), words, pa.array(symbols[first].view(np.int64)), pa.array(n.astype(np.int64))]
            yield from sliced(pa.RecordBatch.from_arrays(columns, names=["lang", "word", "symbol", "n"]))

        for tokens, langs, symbols, _ in Texts().chunks(batches):
            first, n = grouped(symbols)
            held.append((symbols[first], n, tokens.data.copy(), tokens.start[first], (tokens.end - tokens.start)[first], tokens.row[first], langs))
            size += len(symbols)
            if size > HELD:
                yield from report()
                held, size = [], 0
        if held:
            yield from report()
        held = []
        freed()

    return texts.mapInArrow(run, "lang string, word string, symbol long, n long").groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n"))


class PhraseFilter:
    """Bits of the hashes of all phrases of one length: has() is true for each of them, and seldom for others."""

    def __init__(self, parts: Iterator[np.ndarray], n: int):
        bits = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
        found = np.zeros(bits, bool)
        for phrases in parts:
            for at in self._places(list(phrases.T), bits):
                found[at] = True
        self.bits, self.size = np.packbits(found, bitorder="little"), bits

    @staticmethod
    def _places(words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
        code = np.zeros(len(words[0]), np.uint64)
        for word in words:
            code = mixed(code * np.uint64(3) ^ word)
        return code & np.uint64(bits - 1), code >> np.uint64(32) & np.uint64(bits - 1)

    def has(self, words: list[np.ndarray]) -> np.ndarray:
        one, two = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for at in self._places(words, self.size))
        return (one & two).astype(bool)


class PhraseTrie:
    """A part of the phrases, given as rows of 64-bit symbols filled up with 0, in a double array over the symbols that occur.

    others: filter of the phrases of all parts, None where this part is the only one.
    """

    def __init__(self, phrases: np.ndarray, others: PhraseFilter | None):
        self.width = phrases.shape[1]
        used = phrases != 0
        self.symbols, place, often = np.unique(phrases[used], return_inverse=True, return_counts=True)
        # The more phrases hold a symbol the smaller its id, so that children lie close together.
        self._rank = np.empty(len(often), np.int32)
        self._rank[np.argsort(-often, kind="stable")] = np.arange(1, len(often) + 1)
        self._ids = np.zeros(phrases.shape, np.int32)
        self._ids[used] = self._rank[place]
        self.array, self.others = DoubleArray(self._ids, len(self.symbols)), others

    def __len__(self) -> int:
        return len(self._ids)

    def phrases(self, at: np.ndarray) -> np.ndarray:
        """Rows of symbols of the phrases of those places."""
        by_rank = np.zeros(len(self.symbols) + 1, np.uint64)
        by_rank[self._rank] = self.symbols
        return by_rank[self._ids[at]]

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.symbols):
            return np.zeros(len(symbols), np.int64)
        at = np.minimum(np.searchsorted(self.symbols, symbols), len(self.symbols) - 1)
        return np.where(self.symbols[at] == symbols, self._rank[at], 0)


def _matrix(phrases: DataFrame) -> np.ndarray:
    """Rows of symbols, filled up with 0. No symbol is 0 but by a chance of 2**-64."""
    column = phrases.select("symbols").toArrow()["symbols"].combine_chunks()
    if not len(column):
        return np.zeros((0, 1), np.uint64)
    size = column.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(size), int(size.max())), np.uint64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy().view(np.uint64)
    return out


def tries(phrases: DataFrame, filtered: bool = False) -> Iterator[PhraseTrie]:
    """The phrases (symbols array<long>) as tries of about PART_ENTRIES each. filtered: parts know the phrases of the others, which have one length."""
    n = phrases.count()
    parts = max(1, -(-n // PART_ENTRIES))

    def matrices() -> Iterator[np.ndarray]:
        for part in range(parts):
            yield _matrix(phrases if parts == 1 else phrases.where(F.pmod(F.xxhash64("symbols"), F.lit(parts)) == part))

    others = PhraseFilter(matrices(), n) if filtered and parts > 1 else None
    for found in matrices():
        yield PhraseTrie(found, others)


def observed(texts: DataFrame, phrases: DataFrame, size: int, tails: list[int], least: int) -> DataFrame:
    """(symbols, n): candidates that extend the phrases of `size` words by each number of words in tails, at least `least` times.

    Every phrase of `size` words inside the candidate is one of them, for all that a filter tells where one trie does not hold all.
    """
    found = []
    for trie in tries(phrases, True):
        shared = texts.sparkSession.sparkContext.broadcast(trie)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, held, rows = shared.value, [], 0

            def report() -> Iterator[pa.RecordBatch]:
                first, n = grouped(*(np.concatenate([x[k] for x in held]) for k in range(2)))
                # One column is put together at a time.
                columns = [pa.array(np.concatenate([x[k] for x in held])[first]) for k in range(2, 5)] + [pa.array(n)]
                held.clear()
                yield from sliced(pa.RecordBatch.from_arrays(columns, names=["prefix", "one", "two", "n"]))

            for _, _, symbols, runs in Texts().chunks(batches):
                *_, (at, state) = own.array.walk(own.ids(symbols), runs, size)
                place = np.full(len(symbols) + max(tails), -1, np.int64)
                place[at] = own.array.accept[state]
                at = at[place[at] >= 0]
                for tail in range(1, max(tails) + 1):
                    at = at[at + size - 1 + tail < len(symbols)]
                    at = at[runs[at + size - 1 + tail] == runs[at]]
                    at = at[place[at + tail] >= 0 if own.others is None else own.others.has([symbols[at + tail + k] for k in range(size)])]
                    if tail in tails and len(at):
                        prefix, one = place[at], symbols[at + size]
                        two = symbols[at + size + 1] if tail == 2 else np.zeros(len(at), np.uint64)
                        codes = mixed(mixed(one) + mixed(two ^ np.uint64(0x5DEECE66D)) * np.uint64(3) + prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        # What a chunk repeats is held once.
                        first, n = grouped(codes)
                        held.append((codes[first], n, prefix[first].astype(np.int32), one[first].view(np.int64), two[first].view(np.int64)))
                        rows += len(at)
                if rows > HELD:
                    yield from report()
                    rows = 0
            if held:
                yield from report()
            freed()

        def named(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                head = shared.value.phrases(batch.column(0).to_numpy())[:, :size].view(np.int64).tolist()
                ends = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                symbols = [[*h, one] if two == 0 else [*h, one, two] for h, (one, two) in zip(head, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.list_(pa.int64())), batch.column(3)], names=["symbols", "n"])

        summed = texts.mapInArrow(run, "prefix int, one long, two long, n long").groupBy("prefix", "one", "two").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found.append(written(summed.mapInArrow(named, "symbols array<long>, n long"), "observed"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def counted(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(symbols, a): how often each candidate occurs, overlaps included; bincounts of accepting states, summed over the tasks."""
    found = []
    for trie in tries(candidates):
        shared = texts.sparkSession.sparkContext.broadcast(trie)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            total = np.zeros(len(own), np.int64)
            for _, _, symbols, runs in Texts().chunks(batches):
                for _, state in own.array.walk(own.ids(symbols), runs, own.width):
                    ends = own.array.accept[state]
                    total += np.bincount(ends[ends >= 0], minlength=len(total))
            part = TaskContext.get().partitionId() % SHARDS
            for at in range(0, len(total), SHARD):
                if total[at:at + SHARD].any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([total[at:at + SHARD].tobytes()], pa.binary())], names=["at", "part", "n"])
            del total
            freed()

        def summed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            import pandas as pd

            total = np.frombuffer(frame["n"].iloc[0], np.int64).copy()
            for more in frame["n"].iloc[1:]:
                total += np.frombuffer(more, np.int64)
            return pd.DataFrame({"at": [key[0]], "part": [0], "n": [total.tobytes()]})

        def named(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    n = np.frombuffer(blob, np.int64)
                    some = np.flatnonzero(n)
                    symbols = [[x for x in row if x] for row in shared.value.phrases(at + some).view(np.int64).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.list_(pa.int64())), pa.array(n[some])], names=["symbols", "a"])

        # Shards meet in two steps, so that no task gets more than a share of them.
        schema = "at int, part int, n binary"
        shards = texts.mapInArrow(run, schema).groupBy("at", "part").applyInPandas(summed, schema).groupBy("at").applyInPandas(summed, schema)
        found.append(written(shards.mapInArrow(named, "symbols array<long>, a long"), "counted"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(symbols, a, l, r, score) by the lowest-scoring cut of each phrase; a tie goes to the shorter first part."""
    known = phrases.unionByName(words.select(F.array("symbol").alias("symbols"), F.col("n").alias("a")))
    cuts = phrases.select("symbols", "a", F.explode(F.sequence(F.lit(1), F.size("symbols") - 1)).alias("k"))
    cuts = cuts.select("symbols", "a", "k", F.expr("slice(symbols, 1, k)").alias("left"), F.expr("slice(symbols, k + 1, size(symbols))").alias("right"))
    cuts = cuts.join(known.select(F.col("symbols").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("symbols").alias("right"), F.col("a").alias("r")), "right")
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    least = cuts.groupBy("symbols", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("symbols", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame) -> DataFrame:
    """The phrases without those of which a longer one has COVERED per cent of the occurrences."""
    spans = F.expr("flatten(transform(sequence(2, size(symbols) - 1), w -> transform(sequence(1, size(symbols) - w + 1), i -> slice(symbols, i, w))))")
    inside = phrases.where(F.size("symbols") > 2).select(F.explode(spans).alias("symbols"), F.col("a").alias("longer")).groupBy("symbols").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inside, "symbols", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * COVERED))
    return kept.drop("longer")


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language by score, count and phrase, with their rank.

    Counts of score bins give the bin in which a language's last rank lies, so that only rows from there upward meet in a ranking.
    """
    step = SCALE // 2 // SCORE_BINS
    bins = rows.withColumn("bin", F.floor(F.col("score") / step))
    above = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    full = bins.groupBy("lang", "bin").agg(F.count("*").alias("m")).withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0)))
    least = full.where(F.col("above") < top).groupBy("lang").agg(F.min("bin").alias("least"))
    near = bins.join(least, "lang").where("bin >= least").drop("bin", "least")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first collocations of each language.

    Words are runs of bytes other than space and tab in pieces between punctuation marks and line ends, A-Z taken as a-z. A phrase of
    two to four words is a candidate if it occurs `least` times in the language. Null text is empty, a null language is NO_LANGUAGE.
    Repeated rows count each time; other columns are not read; texts without words and empty tables add nothing.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    with short_batches(docs.sparkSession):
        words = written(word_counts(texts), "words")
        frequent = words.where(F.col("n") >= least)
        pairs = observed(texts, frequent.select(F.array("symbol").alias("symbols")), 1, [1], least)
        longer = observed(texts, pairs.select("symbols"), 2, [1, 2], least)
        candidates = pairs.select("symbols").unionByName(longer.select("symbols"))
        phrases = counted(texts, candidates)
    best = written(uncovered(scored(phrases, frequent)), "scored")
    each = best.select("symbols", F.posexplode("symbols").alias("at", "symbol")).join(frequent.select("symbol", "lang", "word"), "symbol")
    named = each.groupBy("symbols").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first_of_each(best.join(named, "symbols"), top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
