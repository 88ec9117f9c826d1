"""Index files and blocks as tables, decoded by the executors (O-03, O-05, O-06, O-50)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .codecs import FormatError, StoredBlock, StoreIndex, VersionIndex

ASSETS = "version_id string, asset_pos long, path string, is_dir boolean, path_hash long, content_hash long, size long, permissions int, chunk_count long"
ASSET_CHUNKS = "version_id string, asset_pos long, ord long, chunk_pos long, chunk_hash long, chunk_size long"
BLOCK_CHUNKS = "store_id string, block_pos long, ord long, block_hash long, hash_id long, tag long, chunk_hash long, chunk_size long"
BLOCKS = "file string, block_hash long, hash_id long, tag long, chunk_count long, plain_bytes long, payload binary"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """One row per asset of all version indexes below path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                v = VersionIndex.decode(data)
                names = [v.path(i) for i in range(len(v.path_hashes))]
                yield pd.DataFrame({"version_id": name, "asset_pos": np.arange(len(names)), "path": names, "is_dir": [n.endswith("/") for n in names], "path_hash": v.path_hashes, "content_hash": v.content_hashes, "size": v.sizes.astype("int64"), "permissions": v.permissions.astype("int32"), "chunk_count": v.chunk_counts.astype("int64")})

    return _files(spark, path, "*.lvi").mapInPandas(run, ASSETS)


def read_asset_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of each asset of all version indexes below path, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                v = VersionIndex.decode(data)
                for i, (start, n) in enumerate(zip(v.chunk_starts.tolist(), v.chunk_counts.tolist(), strict=True)):
                    flat = v.chunk_indexes[start : start + n].astype("int64")
                    yield pd.DataFrame({"version_id": name, "asset_pos": i, "ord": np.arange(n), "chunk_pos": flat, "chunk_hash": v.chunk_hashes[flat], "chunk_size": v.chunk_sizes[flat].astype("int64")})

    return _files(spark, path, "*.lvi").mapInPandas(run, ASSET_CHUNKS)


def read_block_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of each block of all store indexes below path, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                for pos, b in enumerate(StoreIndex.decode(data).blocks()):
                    yield pd.DataFrame({"store_id": name, "block_pos": pos, "ord": np.arange(len(b.chunk_hashes)), "block_hash": b.block_hash, "hash_id": b.hash_id, "tag": b.tag, "chunk_hash": b.chunk_hashes, "chunk_size": b.chunk_sizes.astype("int64")})

    return _files(spark, path, "*.lsi").mapInPandas(run, BLOCK_CHUNKS)


def read_blocks(spark: SparkSession, path: str, plain: bool = False) -> DataFrame:
    """One row per block file below path; files that do not parse are left out. plain: payloads decompressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    block = StoredBlock.decode(data)
                    payload = block.plain() if plain else block.payload
                except FormatError:
                    continue
                i = block.index
                rows.append((name, i.block_hash, i.hash_id, i.tag, len(i.chunk_hashes), i.plain_bytes, payload))
            yield pd.DataFrame(rows, columns=["file", "block_hash", "hash_id", "tag", "chunk_count", "plain_bytes", "payload"])

    return _files(spark, path, "*.lsb").mapInPandas(run, BLOCKS)
