"""Write plans, reconstruction and verification (O-41, O-42, O-53, O-94 to O-97)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60
from .ordering import first_by, last_by, running_offset


def chunk_locations(block_chunks: DataFrame, wins: str = "first") -> DataFrame:
    """O-41, O-52: where a chunk lies: (chunk_hash, block_pos, block_hash, block_offset, stored_size).

    The first block in order wins; for usage statistics the last.
    """
    placed = running_offset(block_chunks, "block_pos", "ord", "chunk_size", "block_offset").withColumnRenamed("chunk_size", "stored_size")
    by = first_by if wins == "first" else last_by
    return by(placed, "chunk_hash", ["block_pos", "ord"], ["block_pos", "ord", "block_hash", "block_offset", "stored_size"]).drop("ord")


def write_plan(asset_chunks: DataFrame, block_chunks: DataFrame, strict: bool = True) -> DataFrame:
    """O-42: every chunk of every asset with its offset there and its place in a block.

    A chunk that no block has is an error; with strict=False such rows come back with a null block.
    """
    wanted = running_offset(asset_chunks, "asset_pos", "ord", "chunk_size", "asset_offset")
    plan = wanted.join(chunk_locations(block_chunks), "chunk_hash", "left")
    if strict:
        found = F.when(F.col("block_hash").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no block has chunk "), F.col("chunk_hash").cast("string"))))
        plan = plan.where(found)
    return plan


def coalesced_writes(plan: DataFrame) -> DataFrame:
    """O-53: neighbouring writes that continue both the asset and the block become one: (asset_pos, block_pos, asset_offset, block_offset, bytes, chunks)."""
    order = Window.partitionBy("block_pos", "asset_pos").orderBy("asset_offset")
    follows = (F.lag("asset_offset").over(order) + F.lag("chunk_size").over(order) == F.col("asset_offset")) & (F.lag("block_offset").over(order) + F.lag("chunk_size").over(order) == F.col("block_offset"))
    islands = plan.withColumn("starts", F.when(follows, 0).otherwise(1)).withColumn("island", F.sum("starts").over(order))
    return islands.groupBy("block_pos", "asset_pos", "island").agg(F.min("asset_offset").alias("asset_offset"), F.min("block_offset").alias("block_offset"), F.sum("chunk_size").alias("bytes"), F.count("*").alias("chunks")).drop("island")


def asset_parts(asset_chunks: DataFrame) -> DataFrame:
    """O-94: where in the assets a chunk's bytes are first found: (chunk_hash, asset_pos, ord, asset_offset, chunk_size)."""
    placed = running_offset(asset_chunks, "asset_pos", "ord", "chunk_size", "asset_offset")
    return first_by(placed, "chunk_hash", ["asset_pos", "ord"], ["asset_pos", "ord", "asset_offset", "chunk_size"])


def assemble_payloads(block_chunks: DataFrame, parts: DataFrame, contents: DataFrame) -> DataFrame:
    """O-95: payload of each block from the assets' bytes; contents has (asset_pos, data binary)."""
    cut_out = block_chunks.select("block_pos", "block_hash", "ord", "chunk_hash").join(parts.select("chunk_hash", "asset_pos", "asset_offset", "chunk_size"), "chunk_hash").join(contents, "asset_pos")
    pieces = cut_out.select("block_pos", "block_hash", "ord", F.expr("substring(data, cast(asset_offset + 1 as int), cast(chunk_size as int))").alias("piece"))
    return _joined(pieces, ["block_pos", "block_hash"], "payload")


def _joined(pieces: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Binary pieces of each key, concatenated in the order of ord."""
    listed = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("p"))
    return listed.select(*keys, F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")).alias(name))


def reconstruct(asset_chunks: DataFrame, block_chunks: DataFrame, payloads: DataFrame) -> DataFrame:
    """O-96: (asset_pos, data) rebuilt from block payloads; a block too short for its chunk is an error."""
    plan = write_plan(asset_chunks, block_chunks).join(payloads.select("block_hash", "payload"), "block_hash")
    whole = F.octet_length("payload") >= F.col("block_offset") + F.col("chunk_size")
    plan = plan.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("block is shorter than its index says"))))
    pieces = plan.select("asset_pos", "ord", F.expr("substring(payload, cast(block_offset + 1 as int), cast(chunk_size as int))").alias("piece"))
    return _joined(pieces, ["asset_pos"], "data")


def verify_chunks(chunks: DataFrame, hash_of=h60) -> DataFrame:
    """O-97: chunks (chunk_hash, chunk_size, data) whose bytes do not have their hash or size."""
    return chunks.where((hash_of(F.col("data")) != F.col("chunk_hash")) | (F.octet_length("data") != F.col("chunk_size")))
