"""Ranking, counting and de-duplicating helpers shared by the operators.

`row_number` with a bound on it is planned by Spark as a partial limit before the shuffle
(WindowGroupLimit), so one hot group never travels whole to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str | Column]

#: `spark.sql.optimizer.windowGroupLimitThreshold` of Spark, and the parts of a key for larger samples.
WINDOW_LIMIT, KEY_PARTS = 1000, 64


def top_k(df: DataFrame, keys: Cols, order: Cols, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of every key, for any k. Up to WINDOW_LIMIT Spark cuts each task's rows to k before the shuffle; beyond it a
    first ranking within parts of each key does, so that a hot key is never sorted whole by one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if k > WINDOW_LIMIT:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if "map" not in dict(df.dtypes)[c]]), F.lit(KEY_PARTS))
        first = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_part", "_rn")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, key: str = "id", ord_col: str = "ord") -> DataFrame:
    """Keyed-dictionary semantics: blank keys vanish, the last row of a key stays."""
    kept = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return first_per(kept, [key], [F.col(ord_col).desc()])


def one_per_key(df: DataFrame, key: str = "id") -> DataFrame:
    """A right side for a keyed join: the last row of each key by `ord`, or any one where the table has no order."""
    return last_wins(df, key) if "ord" in df.columns else df.dropDuplicates([key])


def explode_labels(df: DataFrame, keys: Sequence[str], arr: str | Column, ord_col: str = "ord") -> DataFrame:
    """Long form (keys, ord, pos, label); column pruning keeps the wide row out of the shuffle."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return df.select(*keys, F.col(ord_col).alias("ord"), F.posexplode(arr).alias("pos", "label"))


def place(ord_col: str = "ord", pos: str = "pos") -> Column:
    """(ordinal, position) as one number, so that `min` finds the first place in a hash aggregate."""
    return F.col(ord_col).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.col(pos)


def label_counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occurrences per label with the place it was first seen (breaks ties as a counter would)."""
    return long.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first_place"))


def count_order() -> list[Column]:
    return [F.col("n").desc(), F.col("first_place")]


def top_labels(long: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return top_k(label_counts(long, keys), keys, count_order(), k)


def gathered(ranked: DataFrame, keys: Sequence[str], out: str, value: str = "label") -> DataFrame:
    """Ranked rows (already bounded by k) back into one ordered list per key."""
    packed = F.array_sort(F.collect_list(F.struct("rank", value)))
    return ranked.groupBy(*keys).agg(F.transform(packed, lambda x: x[value]).alias(out))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even, 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.bround(part / whole * 100, 0)).otherwise(F.lit(0.0)).cast("bigint")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value",
         cast: str = "double") -> DataFrame:
    """Wide metric row(s) to long (keys, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(v).alias(name), F.col(v).cast(cast).alias(value)) for v in values])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")
