"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

The ranks file is a parameter. It is read on the driver (through Spark's file system where the path has a scheme), its size is
checked, and it is broadcast: a vocabulary is a fixed table that does not grow with the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from hiremill.llm.shared import appended, schema_with, ship_package

#: Pieces whose ids a generation of a worker's store keeps; results do not depend on it.
CACHED_PIECES = 250_000
#: Pieces of up to so many bytes are merged together, texts of up to so many characters are split together.
TOGETHER_BYTES, TOGETHER_CHARS = 64, 1_000_000
#: Largest vocabulary that is broadcast.
MAX_RANKS = 1_000_000
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from lines of `base64 rank`."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{len(ranks)} ranks; at most {MAX_RANKS} are broadcast")
    return ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. A leaf holds `rank of the pair that begins here * n + position`, so the root is the leftmost lowest pair.

    A merge writes three leaves (the merged token, the consumed one, the left neighbour), each in logarithmic time and only as far
    up as a minimum changes; a piece of n bytes takes O(n log n), however long it is.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    find = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = find(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while tree[1] != _NONE:
        i = tree[1] % n
        j = after[i]
        k = after[i] = after[j]
        own = left = _NONE
        if k < n:
            before[k] = i
            rank = find(piece[i:after[k]])
            if rank is not None:
                own = rank * n + i
        h = before[i]
        changes = [(j, _NONE), (i, own)]
        if h >= 0:
            rank = find(piece[h:k])
            if rank is not None:
                left = rank * n + h
            changes.append((h, left))
        for leaf, value in changes:
            node = size + leaf
            if tree[node] == value:
                continue
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class PairRanks:
    """Rank of the bytes of two adjacent tokens, for arrays of token pairs: sorted keys and a binary search."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.asarray([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 31 | right)
                    values.append(rank)
        order = np.argsort(np.asarray(keys, np.int64))
        self.keys, self.values = np.asarray(keys, np.int64)[order], np.asarray(values, np.int64)[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; _NONE where the bytes are no token or a side is missing (negative)."""
        wanted = left << 31 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.values[at], _NONE)


def merge_pieces(pieces: list[bytes], size: int, pairs: PairRanks) -> list[bytes]:
    """Packed ids of many pieces of 2 to `size` bytes (a power of two): one segment tree per row, all rows merge in step.

    The trees are those of `merge_piece`; a leaf holds `rank * size + position`. In each round every row that still has a pair
    merges its leftmost lowest one and repairs the three paths to its root.
    """
    rows = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, rows)
    grid = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
    token = np.full((rows, size + 1), -1, np.int64)
    token[:, :size] = np.where(np.arange(size) < lengths[:, None], pairs.byte_ids[grid], -1)
    after = np.broadcast_to(np.arange(1, size + 2), (rows, size + 1)).copy()
    before = np.broadcast_to(np.arange(-1, size), (rows, size + 1)).copy()
    tree = np.full((rows, 2 * size), _NONE, np.int64)
    rank = pairs.of(token[:, :-1], token[:, 1:])
    tree[:, size:] = np.where(rank < _NONE, rank * size + np.arange(size), _NONE)
    level = size
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half

    def put(at: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + size
        tree[at, node] = value
        while node[0] > 1:
            value = np.minimum(value, tree[at, node ^ 1])
            node = node >> 1
            tree[at, node] = value

    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        root = tree[live, 1]
        i = root % size
        j = after[live, i]
        k = after[live, j]
        token[live, i], token[live, j] = root // size, -1
        after[live, i] = k
        inner = k <= size
        before[live[inner], k[inner]] = i[inner]
        put(live, j, np.full(len(live), _NONE))
        right = np.where(inner, token[live, np.minimum(k, size)], -1)
        rank = pairs.of(token[live, i], right)
        put(live, i, np.where(rank < _NONE, rank * size + i, _NONE))
        h = before[live, i]
        some = h >= 0
        if some.any():
            at, left = live[some], h[some]
            rank = pairs.of(token[at, left], token[at, i[some]])
            put(at, left, np.where(rank < _NONE, rank * size + left, _NONE))
        live = live[tree[live, 1] < _NONE]
    kept = token[:, :size] >= 0
    ids = token[:, :size][kept].astype("<u4").tobytes()
    ends = (np.cumsum(kept.sum(1)) * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class PieceIds(dict):
    """Piece of text to its packed ids: little-endian unsigned 32-bit integers. Holds two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older, self.pairs = ranks, {}, PairRanks(ranks)

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that are not stored: whole tokens at once, short pieces together, long ones each by itself."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            packed = self.older.get(piece)
            if packed is None:
                data = piece.encode()
                rank = self.ranks.get(data)
                if rank is None and len(data) <= TOGETHER_BYTES:
                    by_size.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
                    continue
                if rank is None:
                    continue
                packed = pack("<I", rank)
            self[piece] = packed
        for size, group in by_size.items():
            self.update(zip([p for p, _ in group], merge_pieces([d for _, d in group], size, self.pairs)))

    def turn(self) -> None:
        """A full generation becomes the older one."""
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode(), self.ranks)
        return pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes and decodes texts by a rank table and a splitting pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = PieceIds(ranks)
        self.split = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text, in order; texts are taken together up to a million characters."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end] or "") <= TOGETHER_CHARS):
                chars += len(texts[end] or "")
                end += 1
            split = [self.split.findall(t) if t else [] for t in texts[start:end]]
            self.pieces.learn(set(chain.from_iterable(split)).difference(self.pieces))
            for pieces in split:
                yield b"".join(map(self.pieces.__getitem__, pieces))
            self.pieces.turn()
            start = end

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODECS: dict[tuple, Codec] = {}


def _codec(key: tuple, shared) -> Codec:
    """One codec per worker and vocabulary, kept between tasks."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds `ids`, the packed little-endian 32-bit ids of each whole text, and on request `decoded`, the bytes of decoding them.

    A null or empty text has no ids (empty binary); rows, repeated or not, and other columns stay as they are. Where the table has
    a column called like a new one, the old one is replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    names = [ids, *([decoded] if decoded else [])]
    source = docs.drop(*[n for n in names if n != text])
    shared = spark.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    key = (ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            packed = list(codec.encode_all(batch.column(text).to_pylist()))
            columns = {ids: pa.array(packed, pa.binary())}
            if decoded:
                columns[decoded] = pa.array([codec.decode(p) for p in packed], pa.binary())
            yield appended(batch, columns)

    return source.mapInArrow(run, schema_with(source, **dict.fromkeys(names, "binary")))


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of packed ids; null ids give an empty text, bytes that are no UTF-8 become replacement characters."""
    spark = df.sparkSession
    ship_package(spark)
    source = df.drop(text)
    shared = spark.sparkContext.broadcast((load_ranks(ranks_path), r"(?s).+"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec((ranks_path, ""), shared)
        for batch in batches:
            yield appended(batch, {text: pa.array([codec.decode(p or b"").decode("utf-8", "replace") for p in batch.column(ids).to_pylist()], pa.string())})

    return source.mapInArrow(run, schema_with(source, **{text: "string"}))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text, in one pass and without keeping ids."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    source = docs.select(key, text)
    shared = spark.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    cache_key = (ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(cache_key, shared)
        for batch in batches:
            counts, hashes, back = [], [], []
            for packed in codec.encode_all(batch.column(1).to_pylist()):
                counts.append(len(packed) // 4)
                hashes.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
