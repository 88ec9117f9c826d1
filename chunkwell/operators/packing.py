"""Packing chunks into blocks (O-31, O-48)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .diff import missing_chunks

MAX_BLOCK_BYTES = 8 * 1024 * 1024
MAX_CHUNKS = 1024


def pack_run(sizes: np.ndarray, limit: int, most: int, open_bytes: int = 0, open_count: int = 0, number: int = 0) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Block number and place in the block of each chunk of (a part of) one run, and the state to go on from.

    A block takes chunks while their count and bytes allow, one at least. Bytes are prefix sums, so each block's
    end is one binary search, not a step per chunk. The state is the open block's bytes, chunks and number.
    """
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    block, ord_, start, n = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), 0, len(sizes)
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit - open_bytes, "right")) - 1
        stop = min(max(stop, start + (open_count == 0)), start + most - open_count, n)
        block[start:stop] = number
        ord_[start:stop] = open_count + np.arange(stop - start)
        if stop == n:
            return block, ord_, (open_bytes + int(ends[n] - ends[start]), open_count + stop - start, number)
        start, open_bytes, open_count, number = stop, 0, 0, number + 1
    return block, ord_, (open_bytes, open_count, number)


def pack(chunks: DataFrame, max_block_bytes: int = MAX_BLOCK_BYTES, max_chunks: int = MAX_CHUNKS, group: str | None = None) -> DataFrame:
    """O-31: chunks (pos, chunk_hash, chunk_size, chunk_tag) with run, block and ord: the packed blocks in order.

    A block holds one tag, at most max_chunks chunks (one at least) and a tenth more bytes than max_block_bytes at
    most, unless its first chunk alone is larger. Where the tag changes a block must start, so runs of equal tags
    are packed apart, in parallel; within a run each block's start depends on the one before. ``group``: another
    column whose values are packed apart.
    """
    limit, most = max_block_bytes + max_block_bytes // 10, max(1, max_chunks)
    keys = [group] if group else []
    order = Window.partitionBy(*keys).orderBy("pos") if keys else Window.orderBy("pos")
    changed = F.coalesce((F.lag("chunk_tag").over(order) != F.col("chunk_tag")).cast("long"), F.lit(0))
    runs = chunks.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order)).drop("changed")

    ids = [*keys, "run"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, (0, 0, 0)
        for frame in frames:
            block, ord_ = np.empty(len(frame), dtype=np.int64), np.empty(len(frame), dtype=np.int64)
            sizes = frame["chunk_size"].to_numpy()
            held = [frame[c].to_numpy() for c in ids]
            moved = np.zeros(max(0, len(frame) - 1), dtype=bool)
            for values in held:
                moved |= values[1:] != values[:-1]
            cuts = [0, *(np.flatnonzero(moved) + 1).tolist(), len(frame)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(values[low] for values in held)
                if own != last:
                    last, state = own, (0, 0, 0)
                block[low:high], ord_[low:high], state = pack_run(sizes[low:high], limit, most, *state)
            yield frame.assign(block=block, ord=ord_)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", block long, ord long"
    return runs.repartition(*ids).sortWithinPartitions(*ids, "pos").mapInPandas(run, schema)


def pack_missing(version_chunks: DataFrame, block_chunks: DataFrame, **limits) -> DataFrame:
    """O-48: the chunks a store lacks, packed in the version's order."""
    return pack(missing_chunks(version_chunks, block_chunks).withColumnRenamed("chunk_pos", "pos"), **limits)
