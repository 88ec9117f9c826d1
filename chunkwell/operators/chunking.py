"""Content-defined chunking and version building (O-85 to O-93).

A boundary is set where a rolling hash of the last 48 bytes meets a condition. That hash does not depend on where
the chunk began, so it is computed for all positions of a range at once by doubling, and the boundaries are then
picked from the sorted candidates by binary search. The byte table of the rolling hash is a parameter: chunks made
with one table match only stores made with the same table. The default table follows from a rule.

Every asset is first cut into ranges of 1024 times the target size and chunked anew in each, which bounds memory
and makes a range, not a file, the unit of parallel work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from .ordering import bare_path, first_by, positions

WINDOW = 48
#: Average sizes from here on have no discriminator.
AVERAGE_CEILING = 9_309_387
RANGE_FACTOR = 1024


def default_table() -> np.ndarray:
    """256 words: the first four bytes of the BLAKE2s digest of each byte value."""
    return np.array([int.from_bytes(hashlib.blake2s(bytes([i])).digest()[:4], "little") for i in range(256)], dtype=np.uint32)


def discriminator(average: int) -> int:
    """O-86: the divisor for an average size; the quotient of doubles is cut to a whole number."""
    a = float(average)
    return int(a / (-1.42888852e-7 * a + 1.33237515))


@dataclass(frozen=True)
class Sizes:
    """O-87: least, average and largest chunk size, checked."""

    least: int
    average: int
    largest: int

    def __post_init__(self):
        if self.least < WINDOW:
            raise ValueError(f"least size {self.least} is under the window of {WINDOW}")
        if not self.least <= self.average <= self.largest:
            raise ValueError("sizes must not fall: least, average, largest")
        if self.average > AVERAGE_CEILING:
            raise ValueError(f"average size {self.average} is over {AVERAGE_CEILING}")

    @classmethod
    def for_target(cls, target: int) -> Sizes:
        return cls(max(WINDOW, target // 8), max(WINDOW, target // 2), max(WINDOW, min(target * 2, 0xFFFFFFFF)))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    by &= 31
    return x if by == 0 else (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def rolling(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the 48 bytes before each position p; entries under 48 are not meaningful."""
    h = np.zeros(len(data) + 1, dtype=np.uint32)
    h[1:] = table[data]
    widths, width = {1: h}, 1
    while width < 32:
        wide = widths[width].copy()
        wide[width:] ^= _rotated(widths[width][:-width], width)
        width *= 2
        widths[width] = wide
    out = widths[32].copy()
    out[32:] ^= widths[16][:-32]  # a rotation by 32 changes nothing
    return out


def spans(data: bytes, sizes: Sizes, table: np.ndarray | None = None, seed: str = "streaming") -> list[tuple[int, int]]:
    """O-85: (offset, size) of each chunk. seed 'buffer' (O-88) starts each chunk's hash from its first 48 bytes."""
    table = default_table() if table is None else table
    n, d = len(data), max(1, discriminator(sizes.average))
    if seed == "buffer":
        return _buffer_spans(data, sizes, table, d)
    marks = np.empty(0, dtype=np.int64)
    if n > sizes.least and sizes.largest > sizes.least:
        marks = np.flatnonzero(rolling(np.frombuffer(data, dtype=np.uint8), table) % np.uint32(d) == d - 1)
    out, at = [], 0
    while at < n:
        left = n - at
        end = n if left <= sizes.least else at + min(left, sizes.largest)
        if left > sizes.least:
            # the first position that is tested lies one byte past the least size
            i = int(np.searchsorted(marks, at + sizes.least + 1))
            if i < len(marks) and marks[i] < end:
                end = int(marks[i])
        out.append((at, end - at))
        at = end
    return out


def _buffer_spans(data: bytes, sizes: Sizes, table: np.ndarray, d: int) -> list[tuple[int, int]]:
    words, out, at = table.tolist(), [], 0
    turn = lambda x, by: ((x << by) | (x >> (32 - by))) & 0xFFFFFFFF if by else x
    while at < len(data):
        scope = data[at : at + sizes.largest]
        pos = len(data) - at
        if pos > sizes.least:
            window, value, pos = list(scope[:WINDOW]), 0, sizes.least
            for i, b in enumerate(window):
                value ^= turn(words[b], (WINDOW - 1 - i) & 31)
            for k, b in enumerate(scope[sizes.least :]):
                gone, window[k % WINDOW] = window[k % WINDOW], b
                value = turn(value, 1) ^ turn(words[gone], WINDOW & 31) ^ words[b]
                pos += 1
                if value % d == d - 1:
                    break
        out.append((at, pos))
        at += pos
    return out


def ranges(assets: DataFrame, target: int) -> DataFrame:
    """O-90: (asset_pos, range_no, range_offset, data) of every asset with bytes; assets have (asset_pos, data)."""
    size = target * RANGE_FACTOR
    parts = F.expr(f"transform(sequence(0, cast((octet_length(data) - 1) div {size} as int)), i -> struct(i as range_no, cast(i as bigint) * {size} as range_offset, substring(data, i * {size} + 1, {size}) as data))")
    return assets.where("octet_length(data) > 0").select("asset_pos", F.explode(parts).alias("r")).select("asset_pos", F.col("r.range_no").cast("long").alias("range_no"), "r.range_offset", "r.data")


def chunk_ranges(rows: DataFrame, target: int, hash_of: Callable[[bytes], int] = hashing.blake2s, table: np.ndarray | None = None, seed: str = "streaming") -> DataFrame:
    """O-91: chunks of ranges in one Arrow pass: (asset_pos, range_no, k, asset_offset, chunk_hash, chunk_size)."""
    sizes, table = Sizes.for_target(target), default_table() if table is None else table

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for pos, no, start, data in zip(frame["asset_pos"], frame["range_no"], frame["range_offset"], frame["data"], strict=True):
                rows += [(pos, no, k, start + at, hash_of(data[at : at + size]), size) for k, (at, size) in enumerate(spans(data, sizes, table, seed))]
            yield pd.DataFrame(rows, columns=["asset_pos", "range_no", "k", "asset_offset", "chunk_hash", "chunk_size"]).astype("int64")

    return rows.mapInPandas(run, "asset_pos long, range_no long, k long, asset_offset long, chunk_hash long, chunk_size long")


def chunk_assets(assets: DataFrame, target: int, **options) -> DataFrame:
    """asset_chunks with asset_offset: the ordered chunks of every asset."""
    chunks = chunk_ranges(ranges(assets, target), target, **options)
    order = Window.partitionBy("asset_pos").orderBy("asset_offset")
    return chunks.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).select("asset_pos", "ord", "asset_offset", "chunk_hash", "chunk_size")


def fixed_chunks(assets: DataFrame, size: int = WINDOW, range_bytes: int | None = None) -> DataFrame:
    """What the chunker does at targets up to 24, where all sizes are 48: plain cuts, in the analytic hash profile.

    range_bytes: cuts start anew in each range of so many bytes, as at target 1 with 1024.
    """
    step = range_bytes or 1 << 40
    starts = f"flatten(transform(sequence(0L, (octet_length(data) - 1) div {step}), r -> transform(sequence(0L, (least({step}, octet_length(data) - r * {step}) - 1) div {size}), i -> named_struct('at', r * {step} + i * {size}, 'n', least({size}, least({step}, octet_length(data) - r * {step}) - i * {size})))))"
    cut = assets.where("octet_length(data) > 0").select("asset_pos", "data", F.posexplode(F.expr(starts)).alias("ord", "c"))
    piece = F.expr("substring(data, cast(c.at + 1 as int), cast(c.n as int))")
    return cut.select("asset_pos", F.col("ord").cast("long").alias("ord"), F.col("c.at").alias("asset_offset"), hashing.h60(piece).alias("chunk_hash"), F.col("c.n").alias("chunk_size"))


def assemble(assets: DataFrame, asset_chunks: DataFrame, tag: int = 0, sequence_hash=None, path_hash=None) -> tuple[DataFrame, DataFrame]:
    """O-92: (assets with hashes and chunk counts, version_chunks). Assets have (asset_pos, path, size, permissions).

    Without chunks the content hash is that of the empty sequence. Hashes default to the analytic profile.
    """
    sequence_hash = sequence_hash or hashing.analytic_sequence_hash
    path_hash = path_hash or hashing.h60
    lists = asset_chunks.groupBy("asset_pos").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_hash"))).alias("c"))
    joined = assets.join(lists, "asset_pos", "left").withColumn("hashes", F.coalesce(F.expr("transform(c, x -> x.chunk_hash)"), F.expr("cast(array() as array<bigint>)")))
    full = joined.select("asset_pos", "path", F.col("path").endswith("/").alias("is_dir"), path_hash(F.col("path")).alias("path_hash"), sequence_hash(F.col("hashes")).alias("content_hash"), "size", "permissions", F.size("hashes").cast("long").alias("chunk_count"))
    firsts = first_by(asset_chunks, "chunk_hash", ["asset_pos", "ord"], ["asset_pos", "ord", "chunk_size"])
    numbered = positions(firsts, ["asset_pos", "ord"], "chunk_pos")
    return full, numbered.select("chunk_pos", "chunk_hash", "chunk_size", F.lit(tag).cast("long").alias("chunk_tag"))


def build_version(files: DataFrame, target: int, tag: int = 0, hash_id: int = hashing.BLAKE2S_ID, table: np.ndarray | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O-93: (assets, asset_chunks, version_chunks) of scanned files (path, data, permissions), in the exact profile."""
    own = hashing.hasher(hash_id)
    placed = positions(files.withColumn("size", F.octet_length(F.coalesce("data", F.lit(b""))).cast("long")), [bare_path(F.col("path"))], "asset_pos")
    chunks = chunk_assets(placed, target, hash_of=own, table=table)
    as_hash = hashing.hash_udf(hash_id)
    assets, unique = assemble(placed, chunks, tag, hashing.sequence_hash_udf(hash_id), lambda p: as_hash(p.cast("binary")))
    return assets, chunks, unique
