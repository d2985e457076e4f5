"""Source divergence audit: how far the term frequencies of the sources of a language lie apart, from count-level bitmaps.

A group is a (lang, source) pair. A term's probability in a group follows from its count alone, so terms of equal count are one level
of the group. Kept terms of a language are numbered, frequent ones first, and stand in words of 64; a level is stored as one bitset for
each word in which it occurs. For two groups the AND of two bitsets and its popcount give the number of terms in a joint cell (count in
the one, count in the other), which is multiplied by the cell's divergence once. Cells with a count of zero follow by complement: from
the popcounts of the levels and the number of kept terms.

The scan reports counts by 64-bit hashes of (language, term) and numbers of groups; they are dealt by hash into parts of bounded size,
where the numbering and the bitsets are made. For the pairs, words are dealt into shards and, where a language has many sources, sources
into bands, so that a task holds a bounded piece. Strings are shuffled once for each term and task. Divisions and squares are integer
arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.llm.arrays import lower_strings, mixed, sliced, text_chunks, tokens_of
from hiremill.llm.shared import ship_package, written

#: Documents of the language in which a kept term stands at least, ranks of the terms, scale of the probabilities.
MIN_DOCS, TERM_RANKS, SCALE = 3, 200, 1_000_000_000
#: Terms of a word, words of a shard (about), sources of a band.
WORD, SHARD_WORDS, BAND_SOURCES = 64, 64, 64
#: (Row, term) pairs that a task holds before it reports them, characters of the texts for each part.
HELD, PART_CHARS = 1_000_000, 10_000_000

#: Bytes that terms consist of, letters and all code points above 127.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_NO_BREAK = np.zeros(256, bool)


def _report(held: list[tuple], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """Summed (symbol, grp, n) rows, and (symbol, lang, term, docs) rows, of some chunks."""
    symbol, group, lang, n = (np.concatenate([x[k] for x in held]) for k in range(4))
    names = ["symbol", "grp", "n", "lang", "term", "docs"]
    code = mixed(symbol ^ mixed(group.astype(np.uint64)))
    order = np.argsort(code)
    start = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
    some = order[start]
    none = pa.nulls(len(some), pa.string())
    columns = [pa.array(symbol[some].view(np.int64)), pa.array(group[some]), pa.array(np.add.reduceat(n[order], start)), none, none, pa.nulls(len(some), pa.int64())]
    yield from sliced(pa.RecordBatch.from_arrays(columns, names=names))
    unique, first, docs = np.unique(symbol, return_index=True, return_counts=True)
    data = np.concatenate([x[4] for x in held])
    begin = np.concatenate([x[5] + at for x, at in zip(held, np.cumsum([0, *(len(x[4]) for x in held)]))])
    size = np.concatenate([x[6] for x in held])
    none = pa.nulls(len(unique), pa.int64())
    named = pa.array(langs, pa.string()).take(pa.array(lang[first]))
    columns = [pa.array(unique.view(np.int64)), none, none, named, lower_strings(data, begin[first], size[first]), pa.array(docs.astype(np.int64))]
    yield from sliced(pa.RecordBatch.from_arrays(columns, names=names))


def term_counts(docs: DataFrame) -> DataFrame:
    """What the tasks report: (symbol, grp, n) of a group's term, and (symbol, lang, term, docs) of a term. A group's number is a hash of
    its language and source. docs: (text, lang, grp, seed) without nulls; seed is a hash of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held, size = [], 0
        for batch in batches:
            lang_of = np.asarray([langs.setdefault(x, len(langs)) for x in batch.column(1).to_pylist()], np.int32)
            group_of, seed_of = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            for first, _, data, offsets in text_chunks(batch.column(0)):
                tokens = tokens_of(data, offsets, _TERM, _NO_BREAK)
                if not len(tokens.hash):
                    continue
                row = first + tokens.row
                symbol = mixed(tokens.hash ^ seed_of[row])
                _, at, n = np.unique(mixed(symbol + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                held.append((symbol[at], group_of[row[at]], lang_of[row[at]], n.astype(np.int64), data.copy(), tokens.start[at], (tokens.end - tokens.start)[at]))
                size += len(at)
                if size > HELD:
                    yield from _report(held, list(langs))
                    held, size = [], 0
        if held:
            yield from _report(held, list(langs))

    return docs.mapInArrow(run, "symbol long, grp long, n long, lang string, term string, docs long")


def levels_of(reported: DataFrame, parts: int) -> DataFrame:
    """Scratch table of the kept terms by parts: (word, grp, n, bits) of a level, and (symbol, lang, term, all_n) of a term, and
    (symbol, grp, n, all_n) of a term in a group.

    Terms are dealt into parts by hash. Within a part those of a language are placed by falling counts, WORD to a word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.filter(pc.is_valid(table["term"]))
        counts = table.filter(pc.is_valid(table["grp"]))
        symbol, first, inverse = np.unique(names["symbol"].to_numpy(), return_index=True, return_inverse=True)
        kept = np.bincount(inverse, weights=names["docs"].to_numpy(), minlength=len(symbol)) >= MIN_DOCS
        own, group, n = (counts[c].to_numpy() for c in ("symbol", "grp", "n"))
        at = np.searchsorted(symbol, own)
        order = np.lexsort((group, at))
        at, group, n = at[order], group[order], n[order]
        start = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (group[1:] != group[:-1])))
        at, group, n = at[start], group[start], np.add.reduceat(n, start)
        stay = kept[at]
        at, group, n = at[stay], group[stay], n[stay]
        if not len(at):
            return
        total = np.zeros(len(symbol), np.int64)
        np.add.at(total, at, n)
        strings = names.select(["lang", "term"]).take(pa.array(first))
        lang = strings["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
        some = np.flatnonzero(kept)
        some = some[np.lexsort((symbol[some], -total[some], lang[some]))]
        place = np.zeros(len(symbol), np.int64)
        # A language's first place is the first of a word.
        begins = np.flatnonzero(np.append(True, lang[some][1:] != lang[some][:-1]))
        sizes = np.diff(np.append(begins, len(some)))
        word_starts = np.append(0, np.cumsum(-(-sizes // WORD)))[:-1]
        place[some] = np.arange(len(some)) - np.repeat(begins, sizes) + np.repeat(word_starts, sizes) * WORD
        columns = ["word", "grp", "n", "bits", "symbol", "lang", "term", "all_n"]
        none = lambda m, kind=pa.int64(): pa.nulls(m, kind)
        text = lambda m: none(m, pa.string())
        word, bit = place[at] // WORD, np.left_shift(np.uint64(1), (place[at] % WORD).astype(np.uint64))
        order = np.lexsort((n, group, word))
        fresh = (word[order][1:] != word[order][:-1]) | (group[order][1:] != group[order][:-1]) | (n[order][1:] != n[order][:-1])
        start = np.flatnonzero(np.append(True, fresh))
        bits, lead = np.bitwise_or.reduceat(bit[order], start), order[start]
        m = len(lead)
        yield pa.RecordBatch.from_arrays([pa.array(word[lead] + (part << 32)), pa.array(group[lead]), pa.array(n[lead]), pa.array(bits.view(np.int64)), none(m), text(m), text(m), none(m)], names=columns)
        m = len(some)
        chosen = strings.take(pa.array(some)).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(place[some] // WORD + (part << 32)), none(m), none(m), none(m), pa.array(symbol[some]), chosen["lang"].chunk(0), chosen["term"].chunk(0), pa.array(total[some])], names=columns)
        m = len(at)
        yield pa.RecordBatch.from_arrays([none(m), pa.array(group), pa.array(n), none(m), pa.array(symbol[at]), text(m), text(m), pa.array(total[at])], names=columns)

    dealt = reported.repartition(parts, "symbol")
    return written(dealt.mapInArrow(run, "word long, grp long, n long, bits long, symbol long, lang string, term string, all_n long"), "levels")


def _probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    share = F.call_function("div", (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))
    return (share + 1).cast("long")


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q), exact: probabilities are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _floor_squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def joint_cells(frame: pd.DataFrame, left_band: int, right_band: int) -> pd.DataFrame:
    """(source, item, value): the sums of a shard's kept terms for each pair of different sources with one in each band.

    frame: rows (source, band, word, bits, p, p0, terms); a row without bits stands for each source and has p0 and terms.
    """
    frame = frame.sort_values(["source", "bits", "word"], key=lambda c: c != 0 if c.name == "bits" else c, kind="stable")
    names = frame["source"].to_numpy()
    start = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    ends = np.append(start[1:], len(names))
    word, bits, p = frame["word"].to_numpy(np.int64), frame["bits"].to_numpy(np.int64).view(np.uint64), frame["p"].to_numpy(np.int64)
    p0, band, terms = frame["p0"].to_numpy(), frame["band"].to_numpy(np.int64), int(frame["terms"].max())
    size = np.bitwise_count(bits).astype(np.int64)
    parts = []
    for s, e in zip(start.tolist(), ends.tolist()):
        own = slice(s + 1, e)
        parts.append((names[s], int(band[s]), int(p0[s]), word[own], bits[own], p[own], size[own]))
    out: list[tuple[str, str, int]] = []
    for x, (name, own_band, zero, words, sets, prob, n) in enumerate(parts):
        for name2, band2, zero2, words2, sets2, prob2, n2 in parts[x + 1:]:
            if {own_band, band2} != {left_band, right_band}:
                continue
            # Levels of the two sources that stand in one word meet; the AND of their bitsets is the joint cell within the word.
            lo, hi = np.searchsorted(words2, words, "left"), np.searchsorted(words2, words, "right")
            met = hi - lo
            a = np.repeat(np.arange(len(words)), met)
            b = np.arange(len(a)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(lo, met)
            both = np.bitwise_count(sets[a] & sets2[b]).astype(np.int64)
            some = both > 0
            a, b, both = a[some], b[some], both[some]
            alone = n - np.bincount(a, weights=both, minlength=len(n)).astype(np.int64)
            alone2 = n2 - np.bincount(b, weights=both, minlength=len(n2)).astype(np.int64)
            neither = terms - int(both.sum() + alone.sum() + alone2.sum())
            for left, right, u, v, u0, v0, own, other in ((name, name2, prob[a], prob2[b], zero, zero2, (prob, alone), (prob2, alone2)),
                                                          (name2, name, prob2[b], prob[a], zero2, zero, (prob2, alone2), (prob, alone))):
                total = int((both * _floor_squares(u, v)).sum()) + int((own[1] * _floor_squares(own[0], np.int64(v0))).sum())
                total += int((other[1] * _floor_squares(np.int64(u0), other[0])).sum()) + neither * ((u0 - v0) * (u0 - v0) // v0)
                out.append((left, right, total))
    return pd.DataFrame(out, columns=["source", "item", "value"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Kept terms stand in at least MIN_DOCS rows of their language. Part `pair`: item is each other source of the language and value the
    divergence over all its kept terms. Part `term`: item is a kept term that the group has and uses more than its language does, with
    its divergence, first TERM_RANKS only. Ranks start at 1, ties in the order of the item's bytes.

    Null text, language and source are ''. Rows count even if they are repeated or have no id; other columns are not read. A group
    without terms has pairs but no terms; a language without kept terms has pairs of value 0. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(as_text(text).alias("text"), as_text(lang).alias("lang"), as_text(source).alias("source"))
    rows = rows.withColumns({"grp": F.xxhash64("lang", "source"), "seed": F.xxhash64("lang")})
    parts = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS))
    groups = rows.select("grp", "lang", "source").distinct()
    made = levels_of(term_counts(rows.select("text", "lang", "grp", "seed")), parts)
    levels = made.where("bits IS NOT NULL").select("word", "grp", F.col("n").alias("count"), "bits")
    terms = made.where("term IS NOT NULL").select("word", "symbol", "lang", "term", "all_n")
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("kept_terms"), F.sum("all_n").alias("lang_total"))
    sums = levels.groupBy("grp").agg(F.sum(F.col("count") * F.bit_count("bits")).alias("total"))
    totals = written(groups.join(sums, "grp", "left").join(by_lang, "lang", "left").select(
        "grp", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept_terms", F.lit(0)).alias("kept_terms"), "lang_total"), "totals")
    cells = made.where("word IS NULL").select("symbol", "grp", "n", "all_n")
    return pair_part(levels, terms, totals).unionByName(term_part(cells, terms, totals))


def pair_part(levels: DataFrame, terms: DataFrame, totals: DataFrame) -> DataFrame:
    """Pairs of sources. Every shard has a row of count 0 for each source of its languages, so that sources without terms there count too."""
    most = totals.agg(F.max("kept_terms").alias("most"), F.count("*").alias("groups")).first()["most"] or 0
    shards = max(1, -(-most // (WORD * SHARD_WORDS)))
    shard = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard")
    used = terms.groupBy("lang", shard).agg(F.count("*").alias("terms"))
    widest = totals.groupBy("lang").count().agg(F.max("count").alias("n")).first()["n"] or 0
    bands = max(1, -(-widest // BAND_SOURCES))
    own = totals.where("kept_terms > 0").select("grp", "lang", "source", "total", "kept_terms", F.pmod(F.xxhash64("source"), F.lit(bands)).cast("int").alias("band"))
    p = lambda count: _probability(count, F.col("total"), F.col("kept_terms"))
    zero = own.join(used, "lang").select(
        "lang", "source", "shard", "terms", "band", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"), p(F.lit(0)).alias("p"), p(F.lit(0)).alias("p0"))
    found = levels.select("word", "grp", "count", "bits", shard).join(own, "grp").select(
        "lang", "source", "shard", F.lit(None).cast("long").alias("terms"), "band", "word", "bits", p(F.col("count")).alias("p"), F.lit(None).cast("long").alias("p0"))
    rows = found.unionByName(zero)
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))) if bands > 1 else rows.withColumn("met", F.col("band"))
    rows = rows.select("*", F.least("band", "met").alias("low"), F.greatest("band", "met").alias("high"))

    def cells(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = joint_cells(frame, key[2], key[3])
        out.insert(0, "lang", key[0])
        return out

    sums = rows.groupBy("lang", "shard", "low", "high").applyInPandas(cells, "lang string, source string, item string, value long")
    summed = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    valued = pairs.join(summed, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def term_part(cells: DataFrame, terms: DataFrame, totals: DataFrame) -> DataFrame:
    """Terms of the groups: ranked by value with ties first, so that strings are fetched for the first ranks only."""
    p, q = _probability(F.col("n"), F.col("total"), F.col("kept_terms")), _probability(F.col("all_n"), F.col("lang_total"), F.col("kept_terms"))
    valued = cells.join(totals, "grp").select("lang", "source", "symbol", p.alias("p"), q.alias("q")).where("p > q")
    valued = valued.select("lang", "source", "symbol", _divergence(F.col("p"), F.col("q")).alias("value"))
    near = valued.withColumn("rank", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("rank") <= TERM_RANKS).drop("rank")
    named = near.join(terms.select("symbol", F.col("term").alias("item")), "symbol")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = named.withColumn("rank", rank).where(F.col("rank") <= TERM_RANKS)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
