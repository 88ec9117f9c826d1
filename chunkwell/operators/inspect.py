"""Summaries, coverage, usage, listings and eviction (O-23, O-25, O-51, O-54 to O-60, O-62, O-65, O-66)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import details
from .ordering import first_by
from .plan import chunk_locations


def version_summary(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """O-54: one row of counts and sizes; the average is whole, it and the minimum are 0 without chunks."""
    a = assets.agg(F.count("*").alias("asset_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("asset_bytes"))
    c = chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("chunk_bytes"), F.coalesce(F.min("chunk_size"), F.lit(0)).alias("smallest"), F.coalesce(F.max("chunk_size"), F.lit(0)).alias("largest"))
    one = a.withColumn("k", F.lit(0)).join(c.withColumn("k", F.lit(0)), "k").drop("k")
    return one.withColumn("average", F.expr("if(chunk_count = 0, 0L, chunk_bytes div chunk_count)"))


def store_summary(block_chunks: DataFrame) -> DataFrame:
    """O-55, O-56: stored bytes with repeats, unique bytes (first size of each hash), and counts."""
    unique = first_by(block_chunks, "chunk_hash", ["block_pos", "ord"], ["block_pos", "ord", "chunk_size"]).agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("unique_bytes"))
    whole = block_chunks.agg(F.count("*").alias("stored_chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("stored_bytes"))
    return whole.withColumn("k", F.lit(0)).join(unique.withColumn("k", F.lit(0)), "k").drop("k")


def avoided_bytes(old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """O-57: bytes of the new version, per occurrence, and how many of them the old one has."""
    known = old_chunks.select("chunk_hash").distinct().withColumn("known", F.lit(True))
    marked = new_chunks.join(known, "chunk_hash", "left")
    return marked.agg(F.coalesce(F.sum(F.when(F.col("known"), F.col("chunk_size"))), F.lit(0)).alias("avoided"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("total"))


def size_distribution(chunks: DataFrame) -> DataFrame:
    """O-58: count, mean and exact median of the chunk sizes."""
    return chunks.agg(F.count("*").alias("n"), F.avg("chunk_size").alias("mean"), F.median("chunk_size").alias("median"))


def store_covers(assets: DataFrame, asset_chunks: DataFrame, block_chunks: DataFrame) -> DataFrame:
    """O-59: (size_mismatches, missing_chunks, verdict); size mismatches are reported first."""
    sums = asset_chunks.groupBy("asset_pos").agg(F.sum("chunk_size").alias("sum"))
    sizes = assets.where("not is_dir").join(sums, "asset_pos", "left").agg(F.count_if(F.coalesce("sum", F.lit(0)) != F.col("size")).alias("size_mismatches"))
    missing = asset_chunks.select("chunk_hash").distinct().join(block_chunks.select("chunk_hash"), "chunk_hash", "left_anti").agg(F.count("*").alias("missing_chunks"))
    both = sizes.withColumn("k", F.lit(0)).join(missing.withColumn("k", F.lit(0)), "k").drop("k")
    return both.withColumn("verdict", F.when(F.col("size_mismatches") > 0, "size mismatch").when(F.col("missing_chunks") > 0, "missing chunks").otherwise("ok"))


def payload_bytes(block_chunks: DataFrame) -> DataFrame:
    """O-60: bytes of each block once decompressed."""
    return block_chunks.groupBy("block_pos", "block_hash").agg(F.sum("chunk_size").alias("bytes"))


def fragmentation(asset_chunks: DataFrame, block_chunks: DataFrame) -> DataFrame:
    """O-65, O-66: how often an asset's chunks change the block, and the percentages that are reported.

    A leading chunk without a block does not count as a change. Of several blocks with a chunk the last wins.
    asset_fragmentation is 100 * changes / assets with chunks - 100, wrapping as an unsigned 32-bit number, 0 without
    assets; block_usage compares a number with itself and is always 100.
    """
    placed = asset_chunks.join(chunk_locations(block_chunks, "last").select("chunk_hash", "block_pos"), "chunk_hash", "left")
    order = Window.partitionBy("asset_pos").orderBy("ord")
    changes = placed.withColumn("moved", (~F.col("block_pos").eqNullSafe(F.lag("block_pos").over(order))).cast("long"))
    out = changes.groupBy("asset_pos").agg(F.sum("moved").alias("moved")).agg(F.count("*").alias("assets"), F.coalesce(F.sum("moved"), F.lit(0)).alias("changes"))
    wrapped = F.expr("if(assets = 0, 0L, pmod(100 * changes div assets - 100, 4294967296L))")
    return out.withColumn("asset_fragmentation", wrapped).withColumn("block_usage", F.lit(100).cast("long"))


def list_level(assets: DataFrame, prefix: str = "") -> DataFrame:
    """O-23: the entries directly under a prefix, with their line of details."""
    stripped = F.regexp_replace("path", "/+$", "")
    under = prefix + "/" if prefix else ""
    name = F.substring(stripped, len(under) + 1, 1 << 30)
    level = assets.where(stripped.startswith(under) & ~name.contains("/") & (F.length(stripped) > len(under)))
    return level.select("asset_pos", name.alias("name"), details(name, F.col("size"), F.col("permissions"), F.col("is_dir"), 16).alias("line"))


def dump_assets(assets: DataFrame) -> DataFrame:
    """O-62: every asset's line, sizes padded to the widest."""
    width = assets.agg(F.length(F.coalesce(F.max("size"), F.lit(0)).cast("string")).alias("width"), F.lit(0).alias("k"))
    one = assets.withColumn("k", F.lit(0)).join(F.broadcast(width), "k")  # one row
    return one.select("asset_pos", "path", details(F.col("path"), F.col("size"), F.col("permissions"), F.col("is_dir"), F.col("width")).alias("line"))


def find_asset(assets: DataFrame, path: str) -> DataFrame:
    """O-25: the first asset of that path, slashes at its end aside."""
    return assets.where(F.regexp_replace("path", "/+$", "") == path.rstrip("/")).orderBy("asset_pos").limit(1)


def evicted(files: DataFrame, max_bytes: int) -> DataFrame:
    """O-51: cache files (path, size, mtime) that go, oldest first and larger first among equals, until the rest fits.

    Files are dealt into time ranges whose sums are offsets, so no task sorts all of them.
    """
    total = files.agg(F.sum("size").alias("total"), F.min("mtime").alias("low"), F.max("mtime").alias("high"), F.lit(0).alias("k"))
    dealt = files.withColumn("k", F.lit(0)).join(F.broadcast(total), "k")
    dealt = dealt.withColumn("bucket", F.expr("cast(least(255, (mtime - low) * 256 div greatest(1, high - low + 1)) as int)"))
    sums = dealt.groupBy("bucket").agg(F.sum("size").alias("s"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    starts = sums.select("bucket", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("start"))
    order = Window.partitionBy("bucket").orderBy("mtime", F.desc("size"), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0))).join(F.broadcast(starts), "bucket")
    return placed.where(F.expr(f"total - (start + inner) > {max_bytes}")).select("path", "size", "mtime")
