"""Store indexes: ordered dedup, merges, pruning and covering blocks (O-32 to O-45, O-47, O-49, O-64)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import first_by, running_offset


def unique_chunks(asset_chunks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """O-32: the chunks of a version by first appearance, with the size (and tag) seen there: first_pos, first_ord say where."""
    out = first_by(asset_chunks, "chunk_hash", ["asset_pos", "ord"], ["asset_pos", "ord", "chunk_size", *extra])
    return out.withColumnRenamed("asset_pos", "first_pos").withColumnRenamed("ord", "first_ord")


def unique_positions(rows: DataFrame, key: str = "chunk_hash", pos: str = "pos") -> DataFrame:
    """O-33: each key's first position, and its last, whose payload counts."""
    return rows.groupBy(key).agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"))


def merge_stores(blocks: list[DataFrame]) -> DataFrame:
    """O-34, O-44: ordered union of block lists; of equal blocks the one of the earliest list, then position, stays.

    Inputs have (block_hash, block_pos, ...) ; the result adds side, its list's number.
    """
    united = reduce(DataFrame.unionByName, [b.withColumn("side", F.lit(i)) for i, b in enumerate(blocks)])
    return first_by(united, "block_hash", ["side", "block_pos"], ["side", "block_pos", *[c for c in blocks[0].columns if c not in ("block_hash", "block_pos")]])


def merged_hash_id(local_blocks: Column, local_id: Column, remote_blocks: Column, remote_id: Column) -> Column:
    """O-34: the local id if it has blocks, else the remote's, else 0; two different ones are an error."""
    clash = (local_blocks > 0) & (remote_blocks > 0) & (local_id != remote_id)
    return F.when(clash, F.raise_error(F.lit("stores use different hashes"))).when(local_blocks > 0, local_id).when(remote_blocks > 0, remote_id).otherwise(F.lit(0))


def concatenate(blocks: list[DataFrame]) -> DataFrame:
    """O-36: all blocks in the given order, none dropped."""
    return reduce(DataFrame.unionByName, [b.withColumn("side", F.lit(i)) for i, b in enumerate(blocks)])


def block_set_hash_id(blocks: DataFrame) -> DataFrame:
    """O-64: the first id that is not 0, in block order."""
    return blocks.agg(F.coalesce(F.min_by(F.when(F.col("hash_id") != 0, F.col("hash_id")), F.when(F.col("hash_id") != 0, F.col("block_pos"))), F.lit(0)).alias("hash_id"))


def merge_versions(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """O-37: union by path hash; the overlay's record wins whole, the base's position is kept.

    The result adds from_side and union_side, union_pos; assets order by path byte length, then union side and position.
    """
    both = base.withColumn("side", F.lit(0)).unionByName(overlay.withColumn("side", F.lit(1)))
    columns = [c for c in base.columns if c != "path_hash"]
    merged = both.groupBy("path_hash").agg(F.max(F.struct("side", *columns)).alias("r"), F.min(F.struct("side", "asset_pos")).alias("p"))
    return merged.select("path_hash", *[F.col(f"r.{c}").alias(c) for c in columns], F.col("r.side").alias("from_side"), F.col("p.side").alias("union_side"), F.col("p.asset_pos").alias("union_pos"))


def prune_index(blocks: DataFrame, keep: DataFrame) -> DataFrame:
    """O-38: blocks whose hash is kept, in their order; unknown hashes are ignored."""
    return blocks.join(keep.select("block_hash"), "block_hash", "left_semi")


def orphan_blocks(listed: DataFrame, blocks: DataFrame) -> DataFrame:
    """O-45: listed block files that the index does not know."""
    return listed.join(blocks.select("block_hash"), "block_hash", "left_anti")


def block_usage(block_chunks: DataFrame, requested: DataFrame) -> DataFrame:
    """(block_pos, block_hash, used, total, pct): requested bytes of every block that has any; pct is rounded down."""
    asked = requested.select("chunk_hash").distinct().withColumn("__asked", F.lit(1))
    marked = block_chunks.join(asked, "chunk_hash", "left")
    used = marked.groupBy("block_pos", "block_hash").agg(F.sum(F.when(F.col("__asked") == 1, F.col("chunk_size")).otherwise(0)).alias("used"), F.sum("chunk_size").alias("total")).where("used > 0")
    return used.withColumn("pct", F.expr("used * 100 div total"))


def covering_blocks(block_chunks: DataFrame, requested: DataFrame, min_usage: int = 0) -> DataFrame:
    """O-40: the blocks that serve the requested chunks.

    Blocks rank by usage percent, then position; a chunk is claimed by the first block that has it; blocks that
    claim something are the answer: (block_pos, block_hash, pct, claimed).
    """
    usage = block_usage(block_chunks, requested)
    usage = usage.where("false") if min_usage > 100 else usage.where(f"pct >= {min_usage}") if min_usage > 0 else usage
    # the claim is a minimum per chunk, not a sort: it combines map-side, and a chunk in very many blocks is no hot key
    claims = block_chunks.join(usage, ["block_pos", "block_hash"]).join(requested.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
    best = claims.groupBy("chunk_hash").agg(F.min(F.struct((-F.col("pct")).alias("rank"), "block_pos", "block_hash")).alias("b"))
    return best.groupBy(F.col("b.block_pos").alias("block_pos"), F.col("b.block_hash").alias("block_hash"), (-F.col("b.rank")).alias("pct")).agg(F.count("*").alias("claimed"))


def keep_set(covers: list[DataFrame]) -> DataFrame:
    """O-39: block hashes that any kept version needs."""
    return reduce(DataFrame.unionByName, [c.select("block_hash") for c in covers]).distinct()


def kept_payload_sizes(block_chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """O-43, O-60: bytes of the wanted blocks; of blocks listed twice the first counts."""
    sizes = block_chunks.groupBy("block_pos", "block_hash").agg(F.sum("chunk_size").alias("bytes"))
    return first_by(sizes, "block_hash", ["block_pos"], ["block_pos", "bytes"]).join(wanted.select("block_hash").distinct(), "block_hash", "left_semi")


def is_canonical(blocks: DataFrame) -> DataFrame:
    """O-47: whether chunks_offset of blocks (block_pos, chunk_count, chunks_offset) is the running sum of counts."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = blocks.withColumn("bucket", F.expr("block_pos div 4096"))
    starts = dealt.groupBy("bucket").agg(F.sum("chunk_count").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = running_offset(dealt, "bucket", "block_pos", "chunk_count", "inner").join(starts, "bucket")
    return inside.agg(F.coalesce(F.every(F.col("start") + F.col("inner") == F.col("chunks_offset")), F.lit(True)).alias("canonical"))


def block_rows(block_chunks: DataFrame) -> DataFrame:
    """O-49: one row per block with its ordered chunks as an array."""
    packed = block_chunks.groupBy("block_pos", "block_hash").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_hash", "chunk_size"))).alias("chunks"))
    return packed.withColumn("chunk_count", F.size("chunks").cast("long"))


def bounded_blocks(blocks: DataFrame, chunks_in_index: int, on_error: str = "skip") -> DataFrame:
    """O-26: blocks whose chunk range lies outside the index are skipped, or an error, as the operator says."""
    inside = F.col("chunks_offset") + F.col("chunk_count") <= chunks_in_index
    if on_error == "skip":
        return blocks.where(inside)
    return blocks.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("block chunk range outside the index"))))
