"""Words of Arrow text columns as numpy arrays: positions, hashes, shingles. White space is [\\x20\\x09-\\x0D]."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _byte_values(fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80
_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS["up"] = _powers(int(_BASE), size)
        _POWERS["down"] = _powers(pow(int(_BASE), -1, 2**64), size)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most `limit` bytes (one row at least): (first row, end row, bytes, offsets)."""
    data, bounds = text_buffers(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = min(rows, max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1))
        yield row, end, data[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row]
        row = end


@dataclass
class Words:
    """Words of consecutive rows: byte span, row within the chunk and hash of each; first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes; runs end at row bounds."""
    n = len(inside)
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < n]
    head[begin] = inside[begin]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    stop = offsets[1:][offsets[1:] > 0] - 1
    tail[stop] = inside[stop]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _run_hashes(values: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run. A single row beyond the chunk size is hashed in parts that end between runs."""
    hashes, done = np.empty(len(start), np.uint64), 0
    while done < len(start):
        upto = max(done + 1, int(np.searchsorted(end, start[done] + CHUNK_BYTES, "right")))
        lo, hi = start[done], end[upto - 1]
        up, down = _tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = start[done:upto] - lo, end[done:upto] - lo
        hashes[done:upto] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        done = upto
    return hashes


def words_of(data: np.ndarray, offsets: np.ndarray, fold_case: bool) -> Words:
    """All words of the rows."""
    start, end = _runs(~SPACE[data], offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, row, _run_hashes(_VALUES[fold_case], data, start, end), np.searchsorted(start, offsets)[:len(offsets)])


@dataclass
class Tokens:
    """Runs of token bytes of consecutive rows, A-Z taken as a-z; piece counts the break bytes of the chunk before each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    piece: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, breaks: np.ndarray) -> Tokens:
    """Tokens of the rows. inside and breaks tell of each byte value whether it belongs to a token, and whether it ends a piece."""
    start, end = _runs(inside[data], offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    broken = np.cumsum(breaks[data], dtype=np.int32)
    piece = broken[start] if len(start) else np.zeros(0, np.int32)
    return Tokens(data, start, end, row, _run_hashes(_VALUES[True], data, start, end), piece)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each run of `size` words within one row."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[:n] == words.row[size - 1:])
    total = np.full(len(at), np.uint64(size))
    for k in range(size):
        total = (total ^ words.hash[at + k]) * _SHINGLE
        total ^= total >> np.uint64(29)
    return at, mixed(total)


def lower_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The slices of the bytes as strings, A-Z taken as a-z."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(_LOWER[data[at]]))


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LEAD[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of byte values or flags over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sliced(batch: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded size."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
