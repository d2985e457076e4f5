"""N-gram Jaccard join: exact links between documents whose sets of word shingles are alike, and their connected components.

Every scan hashes words and shingles as arrays; a document's set is a sorted array of 64-bit shingle hashes, and equal sets are one node.

1. Nodes: size and a digest of the set. The same scan reports shingles that several sets of a task share; of those the `FREQUENT` most
   frequent are the tail of the global order of shingles (any order is right, a rare-first one is fast).
2. Tiles: two linked sets must share a shingle among the first |x| - ceil(0.8 |x|) + 1 of each. These prefixes are dealt by shingle
   into tiles of bounded size, as packed arrays; shingles that one component has alone are dropped there. In a tile the sets of a
   shingle stand in order of size and meet within their size band only (n to 1.25 n).
3. Rounds: in each size band of a shingle a few sets lead, and every other set of another component proposes the leader with which it
   shares most shingles of the tile. Over all tiles each set keeps its best proposal, which is verified if it shares enough; links join components,
   and rounds go on while they join many. A family of near copies becomes one component in work that is linear in its size.
4. The rest: all pairs across components that are left, if the hashed bitmap signatures allow it: the bit count of the difference of two
   parity bitmaps is a lower bound of the sets' difference, hence bounds the overlap from above. A tile gets the bitmaps
   of the sets left in it and tests a pair where it meets it, so that only pairs that may link are shuffled.
5. Verification: pairs fetch whole texts and intersect the sorted arrays exactly. Components by alternating large-star and small-star steps.

No step gathers the members of a group or component in the driver; no candidate is dropped by a cap. Scratch tables go when their last
reader is done.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.llm.arrays import mixed, text_chunks, windows, words_of
from hiremill.llm.shared import dropped, freed, ship_package, written

SHINGLE_WORDS, PERCENT = 5, 80
#: Frequent shingles that are broadcast at most; sets of one task that share a shingle before it is reported.
FREQUENT, SHARED_SETS = 1 << 18, 2
#: Shingles that long sets have to share in their prefixes, which are so much longer; prefix shingles of a tile (about) and tiles at least; ratio of a size band and leaders of a shingle in it; proposals of a set in a tile;
#: a round follows while the one before linked one of so many of its proposals; rounds at most.
COMMON, TILE_KEYS, TILES, BAND, LEADERS, PROPOSALS, WORTH, ROUNDS = 4, 2_000_000, 24, 1.25, 4, 2, 8, 6
#: A proposal is verified if it shares one of so many shingles of the prefix; the others are left to the last step, which tests all pairs.
PROPOSED = 4
#: Shingles that a task counts at once, nodes that a task packs at once, pairs that a tile tests at once, bits of an id filter for each id
#: and at most.
COUNTED, PACKED, TESTED, BITS_EACH, MAX_BITS = 3_000_000, 6_000, 1 << 18, 16, 1 << 27
_SEEDS = [np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, row by row, and the bounds of the rows.

    A row with fewer words than a shingle has its whole word sequence as the only one; a row without words has none.
    """
    rows = len(offsets) - 1
    words = words_of(data, offsets, True)
    at, hashes = windows(words, SHINGLE_WORDS)
    row = words.row[at]
    n_words = np.diff(words.first)
    extra_row, extra = [], []
    for size in range(1, SHINGLE_WORDS):
        own = np.flatnonzero(n_words == size)
        if len(own):
            total = np.full(len(own), np.uint64(size))
            for k in range(size):
                total = mixed(total ^ words.hash[words.first[own] + k])
            extra_row.append(own)
            extra.append(total)
    if extra:
        row, hashes = np.concatenate([row, *extra_row]), np.concatenate([hashes, *extra])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    row, hashes = row[fresh], hashes[fresh]
    return hashes, np.searchsorted(row, np.arange(rows + 1))


def set_digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signed 64-bit digest of each set: sums of two mixes and the size, mixed. Empty sets have 0."""
    def sums(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    size = np.diff(bounds).astype(np.uint64)
    out = mixed(sums(mixed(hashes ^ _SEEDS[0])) ^ mixed(sums(mixed(hashes ^ _SEEDS[1])) + size))
    out[size == 0] = 0
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted arrays reach the similarity."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles of a set of n of which a linked set must have one: n - ceil(percent n / 100) + 1."""
    return n - (n * percent + 99) // 100 + 1


def common(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that the longer prefixes of two linked sets share at least: the smaller of both sets' values."""
    return np.minimum(COMMON, (n * percent + 99) // 100)


def bitmap_words(n: int) -> int:
    """64-bit words of the parity bitmap of a set of n: a power of two, one to two bits for each shingle."""
    return 1 << (n // 64).bit_length()


def parity_bitmap(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each shingle flips one bit."""
    odd = np.bincount((mixed(hashes) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Rows of parity bitmaps at a smaller width."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def nodes_of(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Scratch tables: (doc_id, mark, n, node) of every row, and (shingle, n) shared within tasks. mark is a hash that tells null from ''."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "n", "node"]
        seen, held, size = set(), [], 0

        def shared() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            # All but the first occurrence of each shingle: few, so that little is held beside the sorted array.
            unique, again = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
            n = again + 1
            some = n >= SHARED_SETS
            none = pa.nulls(int(some.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(n[some].astype(np.int64)), pa.array(unique[some].view(np.int64))], names=names)

        for batch in batches:
            ns, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in text_chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets)
                node = set_digests(hashes, bounds)
                ns.append(np.diff(bounds))
                nodes.append(node)
                fresh = [i for i, x in enumerate(node.tolist()) if x not in seen and not seen.add(x)]
                held += [np.concatenate([hashes[bounds[i]:bounds[i + 1]] for i in fresh])] if fresh else []
                size += sum(int(bounds[i + 1] - bounds[i]) for i in fresh)
                if size > COUNTED:
                    yield shared()
                    size = 0
                    seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(np.concatenate(ns)), pa.array(np.concatenate(nodes))], names=names)
        if held:
            yield shared()
        freed()

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    both = written(source.mapInArrow(run, "doc_id long, mark long, n long, node long"), "sets")
    return both.where("mark IS NOT NULL"), both.where("mark IS NULL").select(F.col("node").alias("shingle"), "n")


def frequent_shingles(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shared shingles, and the rank of each by frequency; at most FREQUENT.

    The histogram of the counts gives the least count that is taken; the driver gets no more rows than that.
    """
    counted = shared.groupBy("shingle").agg(F.sum("n").alias("n"))
    total, least = 0, None
    for r in counted.groupBy("n").agg(F.count("*").alias("shingles")).orderBy(F.desc("n")).collect():
        total += r["shingles"]
        if total > FREQUENT:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = counted.where(F.col("n") >= least).toPandas()
    hashes, n = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    rank = np.empty(len(rows), np.uint64)
    rank[np.lexsort((hashes, n))] = np.arange(len(rows), dtype=np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rank[order]


class IdFilter:
    """Bits of hashes: a filter that lets every wanted id pass and few others. It is made by a grouped bit_or; ids are hashed by Spark."""

    def __init__(self, ids: DataFrame, *columns: str):
        self.columns = columns
        n = ids.count()
        self.bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (BITS_EACH * n).bit_length()))
        place = F.pmod(F.xxhash64(*columns), F.lit(self.bits))
        words = ids.select(place.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("bits")).toArrow()
        held = np.zeros(self.bits // 64, np.int64)
        held[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def place(self, *columns: str | Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))


def hits(words: np.ndarray, places: pa.Array) -> np.ndarray:
    at = places.to_numpy()
    return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text) of the documents whose ids are wanted, and of few others."""
    near = IdFilter(wanted, "doc_id")
    shared = near.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(shared.value, batch.column(2)))).select([0, 1])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    return rows.withColumn("place", near.place("doc_id")).mapInArrow(run, "doc_id long, text string")


def verified(pairs: DataFrame, docs: DataFrame, homes: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose sets are alike, from whole texts. homes: (node, doc_id), one document for each node.

    Partners of one node a are dealt into parts of a few hundred; the set of a comes first in each part and the others stream past it.
    """
    spark = docs.sparkSession
    parts = pairs.groupBy("a").agg((F.lit(1) + F.floor(F.count("*") / 256)).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    sides = dealt.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("side")).unionByName(
        dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("node"), F.lit(0).alias("side")))
    wanted = written(sides.join(homes, "node"), "wanted")
    rows = texts_of(docs, wanted, key, text).join(wanted, "doc_id").select("a", "part", "side", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, None
        for batch in batches:
            left, right = [], []
            a, part, side, node = (batch.column(i).to_pylist() for i in range(4))
            for first, _, data, offsets in text_chunks(batch.column(4)):
                hashes, bounds = shingle_sets(data, offsets)
                digest = set_digests(hashes, bounds)
                for i in range(len(bounds) - 1):
                    r = first + i
                    if (a[r], part[r]) != group:
                        group, leader = (a[r], part[r]), None
                    if digest[i] != node[r]:
                        continue  # another text under the same id
                    own = hashes[bounds[i]:bounds[i + 1]]
                    if side[r] == 0:
                        leader = own.copy()
                    elif leader is not None and alike(leader, own):
                        left.append(a[r])
                        right.append(node[r])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    out = written(rows.repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(run, "a long, b long").distinct(), "links")
    dropped(wanted)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """Scratch table (u, v) after a large-star and a small-star step on edges (u, v) with u > v; components stay as they are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return written(small.where("u <> v").distinct(), "edges")


def _falling(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches; nodes without edges are not listed."""
    state, before = written(_falling(edges), "edges"), None
    while True:
        state, old = stars(state), state
        dropped(old)
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


@dataclass
class Tile:
    """Entries (shingle, node) of a tile in order of shingle and size. keys and who go together; node, n and comp are by node, sorted by n."""

    node: np.ndarray
    n: np.ndarray
    comp: np.ndarray
    keys: np.ndarray
    who: np.ndarray

    @classmethod
    def of(cls, node: np.ndarray, n: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> Tile:
        """From entries; a node may come from several tasks."""
        node, first, inverse = np.unique(node, return_index=True, return_inverse=True)
        n = n[first]
        order = np.argsort(n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = np.unique(keys.astype(np.uint64) << np.uint64(32) | place[inverse][owner].astype(np.uint64))
        return cls(node[order], n[order], node[order], (code >> np.uint64(32)).astype(np.uint32), (code & np.uint64(2**32 - 1)).astype(np.int64))

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Start of each shingle's entries, and the number of the shingle of each entry."""
        start = np.flatnonzero(np.append(True, self.keys[1:] != self.keys[:-1]))
        return start, np.repeat(np.arange(len(start)), np.diff(np.append(start, len(self.keys))))

    def fitting(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the entries of the same shingle whose sizes allow a link with the entries `at`."""
        size, most = self.n[self.who], int(self.n.max())
        ordered, base = group * (most + 1) + size, group[at] * (most + 1)
        return (np.searchsorted(ordered, base + -(-size[at] * PERCENT // 100), "left"),
                np.searchsorted(ordered, base + np.minimum(size[at] * 100 // PERCENT, most), "right"))

    def across(self) -> Tile:
        """Only the entries that have another component of fitting size at their shingle, and their nodes."""
        if not len(self.keys):
            return self
        comp = self.comp[self.who]
        low, high = self.fitting(np.arange(len(comp)), self.groups()[1])
        changes = np.cumsum(np.append(False, comp[1:] != comp[:-1]))
        stay = changes[low] != changes[high - 1]
        used, who = np.unique(self.who[stay], return_inverse=True)
        return Tile(self.node[used], self.n[used], self.comp[used], self.keys[stay], who)

    def with_components(self, node: np.ndarray, comp: np.ndarray) -> Tile:
        order = np.argsort(node)
        at = np.minimum(np.searchsorted(node[order], self.node), max(len(node) - 1, 0))
        held = node[order][at] == self.node if len(node) else np.zeros(len(self.node), bool)
        return Tile(self.node, self.n, np.where(held, comp[order][at], self.node) if len(node) else self.node, self.keys, self.who)

    def row(self, tile: int) -> dict:
        return {"tile": tile, "nodes": self.node.astype(np.int64).tobytes(), "sizes": self.n.astype(np.int32).tobytes(), "keys": self.keys.tobytes(), "who": self.who.astype(np.int32).tobytes()}

    @classmethod
    def read(cls, row: pd.Series) -> Tile:
        node = np.frombuffer(row["nodes"], np.int64)
        return cls(node, np.frombuffer(row["sizes"], np.int32).astype(np.int64), node, np.frombuffer(row["keys"], np.uint32), np.frombuffer(row["who"], np.int32).astype(np.int64))

    def proposals(self, salt: int) -> pd.DataFrame:
        """(a, b, shared, need): for each node b its best leaders a of other components, by the shingles at which a leads, and how many
        such shingles over all tiles make a verification worth while."""
        if not len(self.keys):
            return pd.DataFrame({"a": [], "b": [], "shared": [], "need": []})
        band = np.floor(np.log(np.maximum(self.n, 1)) / math.log(BAND)).astype(np.int64)[self.who]
        start = np.flatnonzero(np.append(True, (self.keys[1:] != self.keys[:-1]) | (band[1:] != band[:-1])))
        sizes = np.diff(np.append(start, len(self.keys)))
        m, codes = len(self.node), []
        for leader in range(LEADERS):
            rank = mixed(self.node.view(np.uint64) ^ np.uint64(1 + leader + LEADERS * salt))
            # In the first round one leader is the set with most shared shingles: the original of a family of near copies.
            order = np.lexsort((rank, -np.bincount(self.who, minlength=m))) if leader == salt == 0 else np.argsort(rank)
            place = np.empty(m, np.int64)
            place[order] = np.arange(m)
            first = np.repeat(order[np.minimum.reduceat(place[self.who], start)], sizes)
            fits = (self.comp[first] != self.comp[self.who]) & (100 * np.minimum(self.n[first], self.n[self.who]) >= PERCENT * np.maximum(self.n[first], self.n[self.who]))
            codes.append(self.who[fits] * m + first[fits])
        code, shared = np.unique(np.concatenate(codes), return_counts=True)
        who, leader = code // m, code % m
        order = np.lexsort((self.node[leader], -shared, who))
        who, leader, shared = who[order], leader[order], shared[order]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        best = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < PROPOSALS
        return pd.DataFrame({"a": self.node[leader[best]], "b": self.node[who[best]], "shared": shared[best],
                             "need": np.maximum(common(self.n[who[best]]), prefix_length(self.n[who[best]]) // PROPOSED)})

    def pairs(self, nodes: np.ndarray, bitmaps: Bitmaps) -> pd.DataFrame:
        """(a, b, shared, need): all pairs of nodes of different components with a common shingle and fitting sizes, whose bitmaps (in the
        order of `nodes`) allow a link, how many shingles of the tile they share, and how many they must share over all tiles.

        The entries of a shingle that are not of its largest component meet all others of fitting size.
        """
        if not len(self.keys):
            return pd.DataFrame({"a": [], "b": [], "shared": [], "need": []})
        m, comp = len(self.node), self.comp[self.who]
        sorter = np.argsort(nodes)
        place = sorter[np.searchsorted(nodes, self.node, sorter=sorter)]
        _, group = self.groups()
        _, number = np.unique(comp, return_inverse=True)
        code, held = np.unique(group * (number.max() + 1) + number, return_counts=True)
        order = np.lexsort((held, code // (number.max() + 1)))
        last = np.flatnonzero(np.append(code[order][1:] // (number.max() + 1) != code[order][:-1] // (number.max() + 1), True))
        largest = (code[order][last] % (number.max() + 1))[group]
        small = np.flatnonzero(number != largest)
        low, high = self.fitting(small, group)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            return codes, np.bincount(inverse, weights=np.concatenate([n for _, n in found])).astype(np.int64)

        ends = np.cumsum(high - low)
        at, held = 0, TESTED
        while at < len(small):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TESTED, "right")))
            for lo in range(0, int(max(high[at:upto] - low[at:upto])), TESTED):
                begin, end = low[at:upto] + lo, np.minimum(high[at:upto], low[at:upto] + lo + TESTED)
                met = np.maximum(end - begin, 0)
                left = np.repeat(small[at:upto], met)
                right = np.arange(len(left)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(begin, met)
                new = (number[left] != number[right]) & ((number[right] == largest[right]) | (left < right))
                x, y = self.who[left[new]], self.who[right[new]]
                code, n = np.unique(np.minimum(x, y) * m + np.maximum(x, y), return_counts=True)
                total = self.n[code // m] + self.n[code % m]
                most = (total - bitmaps.difference(place[code // m], place[code % m])) // 2
                able = 100 * most >= PERCENT * (total - most)
                found.append((code[able], n[able]))
            at = upto
            if sum(len(c) for c, _ in found) > held:
                found = [merged()]
                held = max(TESTED, 2 * len(found[0][0]))
        codes, shared = merged() if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        x, y = codes // m, codes % m
        return pd.DataFrame({"a": self.node[x], "b": self.node[y], "shared": shared, "need": np.minimum(common(self.n[x]), common(self.n[y]))})


class Bitmaps:
    """Parity bitmaps by width, for bounds of many pairs at once."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.asarray([len(b) // 8 for b in blobs])
        self.place = np.zeros(len(blobs), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(blobs[i] for i in own), np.uint64).reshape(-1, w)

    def difference(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lower bounds of the sets' differences for pairs of rows."""
        out = np.zeros(len(x), np.int64)
        widths = self.width[x] * (1 << 32) + self.width[y]
        for code in np.unique(widths).tolist():
            at, a, b = np.flatnonzero(widths == code), code >> 32, code & (2**32 - 1)
            low = min(a, b)
            for part in np.array_split(at, 1 + len(at) * max(a, b) // 500_000):
                left, right = self.rows[a][self.place[x[part]]], self.rows[b][self.place[y[part]]]
                out[part] = np.bitwise_count((folded(left, low) if a > low else left) ^ (folded(right, low) if b > low else right)).sum(1)
        return out


def _packed(docs: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray], tiles: int) -> DataFrame:
    """(tile, nodes, sizes, lens, keys): the prefixes of sets in the rare-first order, dealt by shingle; sets of a task once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        packed = 0

        def report() -> pa.RecordBatch:
            node, n, key = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
            owner = np.concatenate([h[2] + at for h, at in zip(held, np.cumsum([0, *(len(h[0]) for h in held)]))])
            tile = (key % np.uint64(tiles)).astype(np.int64)
            order = np.lexsort((owner, tile))
            key, tile, owner = (key >> np.uint64(32)).astype(np.uint32)[order], tile[order], owner[order]
            start = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            out: dict[str, list] = {c: [] for c in ("tile", "nodes", "sizes", "lens", "keys")}
            for s, e in zip(start, np.append(start[1:], len(tile))):
                own, lens = np.unique(owner[s:e], return_counts=True)
                for c, x in zip(out, (int(tile[s]), node[own].tobytes(), n[own].astype(np.int32).tobytes(), lens.astype(np.int32).tobytes(), key[s:e].tobytes())):
                    out[c].append(x)
            return pa.RecordBatch.from_arrays([pa.array(out["tile"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("nodes", "sizes", "lens", "keys"))], names=list(out))

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                hashes, bounds = shingle_sets(data, offsets)
                node, size = set_digests(hashes, bounds), np.diff(bounds)
                fresh = np.asarray([bool(k) and x not in seen and not seen.add(x) for x, k in zip(node.tolist(), size.tolist())], bool)
                order = hashes >> np.uint64(1)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
                    order = np.where(hot[at] == hashes, np.uint64(1 << 63) + rank[at], order)
                row = np.repeat(np.arange(len(size)), size)
                sort = np.lexsort((order, row))
                own = (np.arange(len(row)) - np.repeat(bounds[:-1], size) < (prefix_length(size) + common(size) - 1)[row]) & fresh[row]
                number = np.cumsum(fresh) - 1
                held.append((node[fresh], size[fresh], number[row[own]], mixed(hashes[sort][own])))
                packed += int(fresh.sum())
                if packed >= PACKED:
                    yield report()
                    held, packed = [], 0
                if len(seen) > 500_000:
                    seen.clear()
        if packed:
            yield report()
        freed()

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "tile int, nodes binary, sizes binary, lens binary, keys binary")


_TILE = "tile int, nodes binary, sizes binary, keys binary, who binary, a long, b long, shared long, need long"


def _out(tile: int, kept: Tile, salt: int) -> pd.DataFrame:
    """A row of the tile (if anything is left) and rows of its proposals."""
    blank = {"nodes": None, "sizes": None, "keys": None, "who": None, "a": None, "b": None, "shared": None, "need": None}
    rows = pd.DataFrame([{**blank, **kept.row(tile)}] if len(kept.keys) else [], columns=["tile", *blank])
    found = kept.proposals(salt)
    if len(found):
        found = found.assign(tile=tile, nodes=None, sizes=None, keys=None, who=None)[["tile", *blank]]
        rows = pd.concat([rows, found.astype({c: "Int64" for c in ("a", "b", "shared", "need")})], ignore_index=True) if len(rows) else found
    return rows.astype({c: "Int64" for c in ("a", "b", "shared", "need")})


def first_tiles(docs: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray], tiles: int) -> DataFrame:
    """Scratch table of the tiles with the shingles that several nodes have, and the first proposals."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        node, n, lens, keys = (np.frombuffer(b"".join(frame[c]), kind) for c, kind in (("nodes", np.int64), ("sizes", np.int32), ("lens", np.int32), ("keys", np.uint32)))
        return _out(int(frame["tile"].iloc[0]), Tile.of(node, n.astype(np.int64), np.repeat(np.arange(len(node)), lens), keys).across(), 0)

    return written(_packed(docs, text, frequent, tiles).groupBy("tile").applyInPandas(run, _TILE), "tiles")


def _nodes(tiles: DataFrame) -> DataFrame:
    """(at, node): the nodes of each tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node = np.frombuffer(blob, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), tile, np.int32)), pa.array(node)], names=["at", "node"])

    return tiles.where("nodes IS NOT NULL").select("tile", "nodes").mapInArrow(run, "at int, node long")


def _members(tiles: DataFrame, roots: DataFrame) -> DataFrame:
    """(at, node, comp): the nodes of each tile that have a component."""
    return _nodes(tiles).join(roots, "node").select("at", "node", F.col("root").alias("comp"))


def next_tiles(tiles: DataFrame, roots: DataFrame, salt: int) -> DataFrame:
    """Scratch table of the tiles with the shingles that several components have, and proposals across components."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["tile", "nodes", "sizes", "keys", "who", "a", "b", "shared", "need"])
        tile = Tile.read(left.iloc[0]).with_components(right["node"].to_numpy(np.int64), right["comp"].to_numpy(np.int64))
        return _out(int(left["tile"].iloc[0]), tile.across(), salt)

    held = tiles.where("nodes IS NOT NULL").select("tile", "nodes", "sizes", "keys", "who")
    return written(held.groupBy("tile").cogroup(_members(tiles, roots).groupBy("at")).applyInPandas(run, _TILE), "tiles")


def best_proposals(tiles: DataFrame) -> DataFrame:
    """(a, b): for each node the leader with which it shares most over all tiles, if that is enough."""
    each = tiles.where("a IS NOT NULL").groupBy("b", "a").agg(F.sum("shared").alias("shared"), F.first("need").alias("need")).where("shared >= need")
    best = each.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    return written(best.select("a", "b"), "pairs")


def remaining_pairs(tiles: DataFrame, roots: DataFrame, docs: DataFrame, homes: DataFrame, key: str, text: str) -> DataFrame:
    """Scratch table (a, b): all candidate pairs across components that are left, and whose bitmaps allow a link."""
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"a": [], "b": [], "shared": [], "need": []})
        node = right["node"].to_numpy(np.int64)
        return Tile.read(left.iloc[0]).with_components(node, right["comp"].to_numpy(np.int64)).across().pairs(node, Bitmaps(right["bitmap"].tolist()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0).filter(pa.array(hits(wanted.value, batch.column(1))))):
                hashes, bounds = shingle_sets(data, offsets)
                blobs = [parity_bitmap(hashes[s:e], bitmap_words(int(e - s))).tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(hashes, bounds)), pa.array(blobs, pa.binary())], names=["node", "bitmap"])
        freed()

    used = written(_nodes(tiles).select("node").distinct().join(homes, "node"), "used")
    near = IdFilter(used, "doc_id")
    wanted = near.shared
    texts = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), near.place(F.col(f"`{key}`").cast("long")).alias("place"))
    bitmaps = texts.mapInArrow(sets, "node long, bitmap binary").join(used.select("node"), "node", "left_semi").dropDuplicates(["node"])
    bitmaps = written(bitmaps.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "bitmap"), "bitmaps")
    held = tiles.where("nodes IS NOT NULL").select("tile", "nodes", "sizes", "keys", "who")
    met = held.groupBy("tile").cogroup(_nodes(tiles).join(bitmaps, "node").groupBy("at")).applyInPandas(meet, "a long, b long, shared long, need long")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = met.groupBy(*pair).agg(F.sum("shared").alias("shared"), F.first("need").alias("need")).where("shared >= need")
    out = written(pairs.select("a", "b"), "pairs")
    for table in (used, bitmaps):
        dropped(table)
    return out


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, n, component_id) of every row; see components()."""
    rows, shared = nodes_of(docs, key, text)
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    nodes = written(some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "nodes")
    homes = nodes.select("node", "doc_id")
    total = nodes.agg(F.sum(F.expr(f"n - (n * {PERCENT} + 99) div 100 + 1"))).first()[0] or 0
    tiles = first_tiles(docs.where(F.col(f"`{key}`").isNotNull()), text, frequent_shingles(shared), max(TILES, -(-total // TILE_KEYS)))
    # Between the rounds one step over the stars so far and the new links will do: what is joined too late costs proposals, not links.
    state, tried = None, None
    for salt in range(1, ROUNDS + 1):
        best = best_proposals(tiles)
        asked = best.count()
        new = verified(best, docs, homes, key, text)
        tried = best if tried is None else tried.unionByName(best)
        fresh = _falling(new)
        state, old = stars(fresh if state is None else state.unionByName(fresh)), state
        if old is not None:
            dropped(old)
        roots = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        tiles, old = next_tiles(tiles, roots, salt), tiles
        dropped(old)
        if not asked or new.count() * WORTH < asked:
            break
    rest = remaining_pairs(tiles, roots, docs, homes, key, text)
    dropped(tiles)
    pair = F.struct(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    rest = rest.withColumn("pair", pair).join(tried.select(pair.alias("pair")).distinct(), "pair", "left_anti").select("a", "b")
    roots = connected(state.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(verified(rest, docs, homes, key, text)))
    named = homes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "root").select("node", "component_id")
    return rows.join(labels, "node", "left").select(
        "doc_id", "mark", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set, and the smallest id that links reach.

    Two documents link if they share at least 80 % of the union of their sets. Null and empty texts and texts without words have no
    shingles and link with nothing: their component is their own id. Rows without an id link with nothing and have a null component.
    Equal texts always link; repeated rows each get a row. An empty table gives an empty result. Other columns are not read.
    """
    return labelled(docs, key, text).select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays, once. Columns as given.

    Documents without words stay (repeated rows once; null and empty text differ), and so do all rows without an id. Columns may have
    any names.
    """
    rows = written(labelled(docs, key, text).where("doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(
        F.max("n").alias("n"), F.min("component_id").alias("component_id"), F.count("*").alias("copies")), "labels")
    chosen = rows.where("n > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("first.doc_id", "first.mark")
    stay = written(chosen.unionByName(rows.where("n = 0").select("doc_id", "mark")), "stay")
    # Texts are shuffled only where a row has to go or is repeated, and where the filter takes it for such a row.
    unclear = rows.join(stay, ["doc_id", "mark"], "left_anti").select("doc_id", "mark").unionByName(rows.where("copies > 1").select("doc_id", "mark"))
    near = IdFilter(written(unclear, "unclear"), "doc_id", "mark")
    shared = near.shared
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    marked = whole.withColumn("place", near.place("doc_id", "mark"))

    def part(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = hits(shared.value, batch.column(3)) & ~np.asarray(batch.column(1).is_null())
                yield batch.filter(pa.array(found == hit))

        return marked.mapInArrow(run, marked.schema)

    kept = part(True).join(stay, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    both = part(False).select("row").unionByName(kept.select("row"))
    return both.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
