"""Explicit order: order is part of most results here, and DataFrames have none (O-02, O-18, O-52).

Schemas used throughout (longs unless said otherwise):

    assets(asset_pos, path string, is_dir boolean, path_hash, content_hash, size, permissions int)
    asset_chunks(asset_pos, ord, chunk_hash, chunk_size)        ordered list of each asset
    version_chunks(chunk_pos, chunk_hash, chunk_size, chunk_tag) unique, by first appearance
    blocks(block_pos, block_hash, hash_id, tag)
    block_chunks(block_pos, ord, block_hash, chunk_hash, chunk_size)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def positions(df: DataFrame, order: list[Column | str], name: str, partitions: int | None = None) -> DataFrame:
    """df with ``name``, each row's place from 0 in the global order.

    Rows are range-partitioned and sorted; counts of the partitions (one row each) become offsets. No task sees
    more than its range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    return placed.join(F.broadcast(offsets), part == F.col("__p")).withColumn(name, F.col("__o") + inside).drop("__m", "__p", "__o")


def bare_path(path: Column) -> Column:
    """O-02: the sort key of a path is without a directory's slash."""
    return F.regexp_replace(path, "/$", "")


def running_offset(df: DataFrame, group: str, order: str, size: str, name: str) -> DataFrame:
    """O-18, O-52: bytes before each row within its group."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def first_by(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key with the columns of the row that is first in order; combined map-side."""
    kept = [c for c in columns if c not in order]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *kept)).alias("__f"))
    return best.select(key, *[F.col(f"__f.{c}").alias(c) for c in columns])


def last_by(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """As first_by, with the last row."""
    kept = [c for c in columns if c not in order]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *kept)).alias("__f"))
    return best.select(key, *[F.col(f"__f.{c}").alias(c) for c in columns])
