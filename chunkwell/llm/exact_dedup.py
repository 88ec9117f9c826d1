"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every text and sets, in a Bloom filter, the cells that were set twice. Pass 2 tests each hash:
rows with a cell that was set at most once have no equal text and pass straight through; only the rest shuffle,
and those are grouped by their full SHA-256. Filters are cut into slices of a fixed size, so what is broadcast
has a proven bound and larger inputs take more slices.

Results for the unusual cases: null text counts as the empty text, and all empty texts are one group; ties in
length go to the smallest doc_id, a null doc_id loses to any other; a repeated row (same doc_id and text) counts
in group_size and carries the same values as its twin (``deduplicate`` keeps one of them); an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Deleted before texts are compared.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BITS_PER_KEY = 16
#: Bits of one broadcast filter slice at most: 32 MB.
MAX_SLICE_BITS = 1 << 28


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _cells(slice_bits: int) -> list[Column]:
    return [F.expr(f"pmod(xxhash64(sha, {i}), {slice_bits}L)") for i in range(2)]


def _repeated(digests: DataFrame, slice_bits: int) -> np.ndarray:
    """Bits of the cells that at least two rows have set."""
    cells = digests.select(F.explode(F.array(*_cells(slice_bits))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    words = twice.groupBy(F.expr("cell div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("b")).toPandas()
    bits = np.zeros(slice_bits // 64, dtype=np.uint64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits


def _tester(held):
    @F.pandas_udf("boolean")
    def again(a: pd.Series, b: pd.Series) -> pd.Series:
        bits, hit = held.value, np.ones(len(a), dtype=bool)
        for cell in (a.to_numpy(), b.to_numpy()):
            hit &= (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(hit)

    return again


def flag_repeats(digests: DataFrame, n: int, max_slice_bits: int = MAX_SLICE_BITS) -> list[tuple[DataFrame, DataFrame]]:
    """For each slice of the hashes: rows that may have an equal, and rows that surely have none."""
    slices = max(1, -(-n * BITS_PER_KEY // max_slice_bits))
    slice_bits = min(max_slice_bits, max(1 << 12, 1 << (n * BITS_PER_KEY // slices).bit_length()))
    out = []
    for s in range(slices):
        part = digests if slices == 1 else digests.where(F.expr(f"pmod(xxhash64(sha, -1), {slices}) = {s}"))
        held = digests.sparkSession.sparkContext.broadcast(_repeated(part, slice_bits))
        flagged = part.withColumn("again", _tester(held)(*_cells(slice_bits)))
        out.append((flagged.where("again").drop("again"), flagged.where("not again").drop("again")))
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slice_bits: int = MAX_SLICE_BITS) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256."""
    digests = common.cut(df.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), F.sha2(normalised(F.col(text_col)), 256).alias("sha")))
    out = None
    for maybe, once in flag_repeats(digests, digests.count(), max_slice_bits):
        groups = maybe.groupBy(F.col("sha").alias("group_sha")).agg(F.count("*").alias("group_size"), F.max(F.struct("n", F.bitwise_not("id").alias("r"), "id")).alias("best"))
        groups = common.cut(groups.select("group_sha", "group_size", F.col("best.id").alias("keep_id")))
        joined = maybe.join(groups, maybe["sha"] == groups["group_sha"]).select("id", "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), "sha")
        alone = once.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        part = joined.unionByName(alone)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    gone = exact_dedup(df, id_col, text_col).where("not kept").select(id_col)
    return common.one_per_text(common.drop_ids(df, gone, id_col), id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
