"""Packing: optimal length buckets and token-budget batches.

The histogram of all lengths is counted by Spark. Dynamic programming over it chooses the boundaries that waste the least padding, a
document being padded to its bucket's boundary. Inside a bucket, documents are dealt by a hash into slices of bounded size and each
slice is cut into batches of as many documents as the token budget holds at the boundary's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets, padded tokens of a batch, documents of a slice (about).
BUCKETS, BATCH_TOKENS, SLICE_ROWS = 16, 65_536, 2_000
WORD = "[^\\x20\\x09-\\x0D]+"


def word_length(text: str = "text") -> Column:
    """Words of a text; null is 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Buckets:
    """Boundaries in ascending order (the last is the greatest length), rows of each bucket, and the padding of the plan."""

    bounds: list[int]
    rows: list[int]
    padding: int


def plan_buckets(lengths: np.ndarray, counts: np.ndarray, k: int) -> Buckets:
    """Boundaries of at most k buckets with the least total padding. Boundaries are lengths that occur.

    cost(i, j) = the padding of lengths i..j at length j, from prefix sums. best[b][j] is monotone in its last cut, so each layer
    is solved by divide and conquer in O(n log n).
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return Buckets([], [], 0)
    rows, tokens = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(c * x))
    best, cuts = x * rows[1:] - tokens[1:], []
    for _ in range(1, min(k, n)):
        layer, cut = np.zeros(n, np.int64), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            at, low, first, end = 0, best[mid], max(a, 1), min(b, mid) + 1
            if first < end:
                v = best[first - 1:end - 1] + x[mid] * (rows[mid + 1] - rows[first:end]) - (tokens[mid + 1] - tokens[first:end])
                i = int(v.argmin())
                if v[i] <= low:
                    at, low = first + i, v[i]
            layer[mid], cut[mid] = low, at
            todo.append((lo, mid - 1, a, max(at, a)))
            todo.append((mid + 1, hi, at, b))
        best = layer
        cuts.append(cut)
    bounds, j = [], n - 1
    padding = best[-1]
    for cut in reversed(cuts):
        bounds.append(j)
        if cut[j] == 0:
            j = -1
            break
        j = int(cut[j]) - 1
    if j >= 0:
        bounds.append(j)
    bounds = sorted(set(bounds))
    ends = [-1, *bounds]
    return Buckets([int(x[j]) for j in bounds], [int(rows[b + 1] - rows[a + 1]) for a, b in zip(ends, ends[1:])], int(padding))


def length_histogram(docs: DataFrame, length: Column) -> tuple[np.ndarray, np.ndarray]:
    """Every length that occurs, and how many documents have it.

    The driver gets a row for each distinct length; d of them need at least d (d - 1) / 2 tokens, so d grows with the root of the
    corpus at most.
    """
    rows = docs.select(length.alias("n")).groupBy("n").agg(F.count("*").alias("rows")).toPandas()
    return rows["n"].to_numpy(np.int64), rows["rows"].to_numpy(np.int64)


def pack(docs: DataFrame, length: Column, key: str = "doc_id", buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, n_tokens, bucket, bucket_tokens, batch_id, position) of every document.

    A batch holds documents of one bucket, `bucket_tokens` each, at most `batch_tokens` together; a document longer than the budget is
    a batch by itself. Only key and length are shuffled. A slice of a bucket has about `slice_rows` rows however many the bucket has:
    documents are dealt by a hash of the key, and copies of one key in turn. Null lengths count as 0; a null key is a key like others;
    repeated rows each get a place; an empty table gives an empty result.
    """
    # Lengths are counted from the texts once for the histogram and once for the placing; both scans read key and text only.
    n = F.coalesce(length, F.lit(0)).cast("long")
    plan = plan_buckets(*length_histogram(docs, n), buckets)
    bounds = plan.bounds or [0]
    slices = [max(1, round(r / slice_rows)) for r in plan.rows] or [1]
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    of_bucket = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    rows = docs.select(F.col(key).alias("__key"), n.alias("n_tokens")).withColumn("bucket", bucket.cast("int"))
    dealt = rows.withColumns({
        "bucket_tokens": of_bucket(bounds).cast("long"),
        "slice": F.pmod(F.xxhash64(F.col("__key").cast("string"), F.spark_partition_id()), of_bucket(slices).cast("long")).cast("int")})
    place = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("n_tokens", "__key")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("int")
    placed = dealt.withColumns({"place": place, "room": room})
    return placed.select(
        F.col("__key").alias(key), "n_tokens", "bucket", "bucket_tokens",
        F.concat_ws("-", "bucket", "slice", F.floor(F.col("place") / F.col("room")).cast("long")).alias("batch_id"),
        (F.col("place") % F.col("room")).alias("position"))
