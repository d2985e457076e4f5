"""Snapshots, decision tables and keyed stores: reading, guarding, upserting, pruning, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiremill.functions.rank import first_per
from hiremill.functions.text import null_if_blank

BOM = "﻿"


def tidy_rows(raw: DataFrame, ord_col: str | None = None) -> DataFrame:
    """Trimmed header names, unnamed columns dropped, blank cells NULL, all-blank rows dropped, `ord` fixed."""
    named = [(c, c.replace(BOM, "").strip()) for c in raw.columns if c != ord_col]
    named = [(c, n) for c, n in named if n and not n.startswith("_c")]
    cells = [null_if_blank(F.col(f"`{c}`")).alias(n) for c, n in named]
    order = F.col(ord_col).cast("bigint") if ord_col else F.monotonically_increasing_id()
    out = raw.select(order.alias("ord"), *cells)
    return out.dropna("all", subset=[n for _, n in named])


def file_ordinals(raw: DataFrame, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... in order of file path, block and row, for a table read from any number of files.

    A block lies in one task, so the rows of a block keep their order there; a count per block gives each block its first number. Only
    one row for each block is shuffled, and a recomputed task numbers its rows as before.
    """
    path, block, at, first, before = (f"{name}_{x}" for x in ("path", "block", "at", "first", "before"))
    marked = raw.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(block))
    marked = marked.withColumn(at, F.monotonically_increasing_id())
    blocks = marked.groupBy(path, block).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy(path, block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(path, block, first, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(before))
    numbered = marked.join(blocks, [path, block]).withColumn(name, F.col(before) + F.col(at) - F.col(first))
    return numbered.select(*(F.col(f"`{c}`") for c in raw.columns), name)


def read_snapshot(spark: SparkSession, path: str, fmt: str = "csv", ord_col: str | None = None, multi_line: bool = False) -> DataFrame:
    """A tabular snapshot as string rows with a source ordinal.

    CSV is read in splits; `multi_line` allows line breaks inside cells and makes every file one task. The ordinal is a column of the
    table, or else the place of the row in the order of the files.
    """
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', encoding="UTF-8")
    else:
        raw = spark.read.format(fmt).load(path)
    if ord_col is None and raw.inputFiles():
        ord_col = "source_ordinal"
        while ord_col in raw.columns:
            ord_col += "_"
        raw = file_ordinals(raw, ord_col)
    return tidy_rows(raw, ord_col)


def source_size_guard(new: DataFrame, previous: DataFrame, min_rows: int = 0, shrink_ratio: float = 0.85,
                      allow_shrink: bool = False, strict: bool = False) -> DataFrame:
    """One row: may the new snapshot replace the previous one? Strict mode fails the job instead."""
    n = new.agg(F.count(F.lit(1)).alias("row_count"))
    prev = previous.agg(F.count(F.lit(1)).alias("n"))
    row = n.withColumn("previous_count", prev.scalar())
    floor = F.floor(F.col("previous_count") * F.lit(shrink_ratio)).cast("bigint")
    too_few = (F.lit(min_rows) > 0) & (F.col("row_count") < min_rows)
    shrunk = (F.col("previous_count") > 0) & F.lit(not allow_shrink) & (F.col("row_count") < F.col("minimum_allowed"))
    out = (row.withColumn("minimum_allowed", floor)
           .withColumn("too_few", too_few).withColumn("shrunk", shrunk)
           .withColumn("passed", ~(F.col("too_few") | F.col("shrunk"))))
    if strict:
        out = out.withColumn("passed", F.when(F.col("passed"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("snapshot refused: "), F.col("row_count"), F.lit(" rows"))).cast("boolean")))
    return out


def load_keyed_store(spark: SparkSession, path: str, item_schema: T.StructType, key: str = "id", lines: bool = False) -> DataFrame:
    """A keyed store as one row per key: JSON lines (`lines`), or one `{updatedAt, items: {key: record}}` document.

    A document is a single value that one task reads; it is meant for a one-time import into lines or Parquet.
    """
    if lines:
        own = T.StructType([T.StructField(key, T.StringType()), *[f for f in item_schema.fields if f.name != key]])
        return spark.read.schema(own).json(path).where(F.col(key).isNotNull())
    schema = T.StructType([T.StructField("updatedAt", T.StringType()),
                           T.StructField("items", T.MapType(T.StringType(), item_schema))])
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return unpack_store(docs, item_schema, key)


def unpack_store(docs: DataFrame, item_schema: T.StructType, key: str = "id") -> DataFrame:
    rows = docs.select(F.explode("items").alias(key, "_r"))
    fields = [F.col(f"_r.{f.name}").alias(f.name) for f in item_schema.fields if f.name != key]
    return rows.where(F.col("_r").isNotNull()).select(key, *fields)


def upsert_by_key(store: DataFrame, batch: DataFrame, key: str = "id", ord_col: str = "ord",
                  updated_at: str | None = None) -> DataFrame:
    """The batch's last record of a key replaces the stored record whole."""
    latest = first_per(batch.where(F.col(key) != ""), [key], [F.col(ord_col).desc()])
    if updated_at is not None:
        latest = latest.withColumn("updated_at", F.lit(updated_at))
    latest = latest.select(*store.columns)
    kept = store.join(latest.select(key), key, "left_anti").select(*store.columns)
    return kept.unionByName(latest)


def prune_by_key(store: DataFrame, removed: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Store without the removed keys, and a one-row count of records that went."""
    ids = removed.select(key)
    kept = store.join(ids, key, "left_anti")
    gone = store.join(ids, key, "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return kept, gone


def read_decisions(spark: SparkSession, path: str, ord_col: str | None = None) -> DataFrame:
    """Decision sheet written by people, in any number of files: byte-order mark tolerated, line breaks kept inside cells, cells trimmed."""
    return read_snapshot(spark, path, "csv", ord_col, multi_line=True)


def sheet_rows(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fixed column list of strings; arrays are joined, missing columns are blank."""
    types = dict(df.dtypes)
    cells = []
    for f in fields:
        if f not in types:
            cells.append(F.lit("").alias(f))
        elif types[f].startswith("array<string"):
            cells.append(F.array_join(f, ", ").alias(f))
        else:
            cells.append(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f))
    return df.select(*cells)


def write_sheet(df: DataFrame, fields: Sequence[str], path: str) -> None:
    """A sheet of CSV files that `read_decisions` reads back."""
    sheet_rows(df, fields).write.mode("overwrite").csv(path, header=True, escape='"')


def jsonl_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
