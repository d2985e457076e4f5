"""Exact top-k search by inner product with vector-approximation files.

Vectors are dealt into slices. Each slice keeps an approximation file of its vectors, made once: every component lies in one of 2**BITS
cells of equal width between the slice's least and greatest value of that component, one byte each. For a query a table holds the least
and greatest product with each cell, and scanning the cells adds up a lower and an upper bound of every inner product; nothing is decoded.

What can still be among the best k by these bounds is ordered by upper bound. Exact vectors are read for the first of them, which gives
an exact kth score, and then for all others whose bound reaches it, so that the result is certain. No other exact vector is read.

Queries against all rows are a product by definition; it is done in blocks: a block of queries meets the file of a slice in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiremill.llm.shared import ship_package, written

#: Bits of a cell, candidates of a slice and queries of a block (about), first reads for each result asked for.
BITS, SLICE_ROWS, BLOCK_ROWS, FIRST_READS = 6, 4_096, 1_024, 4


class Approximation:
    """Cells of a slice: bounds of inner products by look-up."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray):
        self.low, self.width, self.cells = low, width, cells
        # One flat place for each component's cell, so that a query's table is gathered by one array.
        self.places = cells.T + (np.arange(len(low), dtype=np.int32) << BITS)[:, None]

    @classmethod
    def of(cls, exact: np.ndarray) -> Approximation:
        low, high = exact.min(0).astype(float), exact.max(0).astype(float)
        width = np.maximum((high - low) / (1 << BITS), 1e-9)
        return cls(low, width, np.minimum((exact - low) / width, (1 << BITS) - 1).astype(np.uint8))

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the query's inner product with each vector, with a margin for rounding."""
        edges = query[:, None] * (self.low[:, None] + np.arange((1 << BITS) + 1) * self.width[:, None])
        margin = 1e-9 * np.abs(edges).max(1).sum() + 1
        return tuple(take(edges[:, :-1], edges[:, 1:]).ravel()[self.places].sum(0) + shift for take, shift in ((np.minimum, -margin), (np.maximum, margin)))


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): component x becomes floor(scale * x). Vectors that are null, empty or hold null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)) & (F.size(x) > 0)
    return df.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def files(candidates: DataFrame, slices: int) -> DataFrame:
    """Scratch table of the approximation files: (slice, dim, ids, marks, low, width, cells)."""
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        made = Approximation.of(np.stack(frame["v"].to_numpy()))
        return pd.DataFrame([{"slice": frame["slice"].iloc[0], "dim": frame["dim"].iloc[0], "ids": frame["id"].to_numpy(np.int64).tobytes(), "marks": frame["mark"].to_numpy(np.int64).tobytes(),
                              "low": made.low.tobytes(), "width": made.width.tobytes(), "cells": made.cells.tobytes()}])

    dealt = candidates.withColumn("slice", F.pmod(F.col("mark"), F.lit(slices)).cast("int")).withColumn("dim", F.size("v"))
    return written(dealt.groupBy("slice", "dim").applyInPandas(pack, "slice int, dim int, ids binary, marks binary, low binary, width binary, cells binary"), "cells")


def survivors(queries: DataFrame, packed: DataFrame, k: int, slices: int, blocks: int) -> DataFrame:
    """Scratch table (query_id, query_mark, id, mark, upper): what may be among a query's best k by the bounds of all slices."""
    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            row = held.iloc[0]
            ids, marks = (np.frombuffer(row[c], np.int64) for c in ("ids", "marks"))
            low, width = (np.frombuffer(row[c], float) for c in ("low", "width"))
            file = Approximation(low, width, np.frombuffer(row["cells"], np.uint8).reshape(len(ids), -1))
            for own, mark, v in zip(asked["id"].to_numpy(), asked["mark"].to_numpy(), asked["v"]):
                lower, upper = file.bounds(np.asarray(v, float))
                other = np.flatnonzero(ids != own)
                if len(other) > k:
                    other = other[upper[other] >= np.partition(lower[other], len(other) - k)[len(other) - k]]
                out.append(pd.DataFrame({"query_id": own, "query_mark": mark, "id": ids[other], "mark": marks[other], "lower": lower[other], "upper": upper[other]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "query_mark", "id", "mark", "lower", "upper"])

    dim = F.size("v").alias("dim")
    left = queries.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).cast("int")).select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), dim, "id", "mark", "v")
    right = packed.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "slice", "dim").cogroup(right.groupBy("at", "slice", "dim")).applyInPandas(meet, "query_id long, query_mark long, id long, mark long, lower double, upper double")
    found = written(found, "bounds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    least = found.select("query_id", "lower").withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("lower").alias("least"))
    return written(found.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("query_id", "query_mark", "id", "mark", "upper"), "survivors")


def search(queries: DataFrame, candidates: DataFrame, k: int, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k greatest integer inner products of each query over all candidates but its own id; ties to the smaller id.

    Both sides are (id long, v array<long>). Vectors of another length than the query's are no candidates for it. Repeated ids: equal
    rows count once; of different vectors with one id each counts, the best placed first. Fewer candidates than k give all of them;
    empty sides give an empty result.
    """
    ship_package(candidates.sparkSession)
    n, m = candidates.count(), queries.count()
    slices, blocks = max(1, round(n / slice_rows)), max(1, round(m / block_rows))
    marked = lambda df: df.withColumn("mark", F.xxhash64("id", "v")).dropDuplicates(["id", "mark"]).select("id", "mark", "v")
    asked, held = marked(queries), marked(candidates)
    near = survivors(asked, files(held, slices), k, slices, blocks)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"))))
    first = exact(near.where(F.col("place") <= FIRST_READS * k), asked, held)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    first = written(first, "first")
    kth = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = near.where(F.col("place") > FIRST_READS * k).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    return first.unionByName(exact(rest, asked, held)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact(near: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, id, score) of pairs, from the exact vectors of their candidates only."""
    read = near.select("query_id", "query_mark", "id", "mark").join(held, ["id", "mark"])
    both = read.join(asked.select(F.col("id").alias("query_id"), F.col("mark").alias("query_mark"), F.col("v").alias("q")), ["query_id", "query_mark"])
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda total, x: total + x)
    return both.select("query_id", "id", product.alias("score"))
