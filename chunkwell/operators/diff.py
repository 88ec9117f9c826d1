"""Differences between two versions (O-22, O-28 to O-30, O-46, O-67 to O-69)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unsigned_order
from ..functions.formatting import permissions_disagree
from ..functions.paths import is_never_content

_SIDE = ("asset_pos", "path", "content_hash", "permissions")


def version_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """O-28: (change, path_hash, path, source_pos, target_pos), one row per change.

    change is removed, added, content or permissions; an asset may have both of the last two. Path hashes are
    taken to be unique in each version (``expect_unique`` checks it).
    """
    s = source.select("path_hash", *[F.col(c).alias(f"s_{c}") for c in _SIDE])
    t = target.select("path_hash", *[F.col(c).alias(f"t_{c}") for c in _SIDE])
    both = s.join(t, "path_hash", "full_outer")
    only_s, only_t = F.col("t_asset_pos").isNull(), F.col("s_asset_pos").isNull()
    matched = ~only_s & ~only_t
    changes = F.array_compact(
        F.array(
            F.when(only_s, "removed"),
            F.when(only_t, "added"),
            F.when(matched & (F.col("s_content_hash") != F.col("t_content_hash")), "content"),
            F.when(matched & (F.col("s_permissions") != F.col("t_permissions")), "permissions"),
        )
    )
    return both.select(F.explode(changes).alias("change"), "path_hash", F.coalesce("t_path", "s_path").alias("path"), F.col("s_asset_pos").alias("source_pos"), F.col("t_asset_pos").alias("target_pos"))


def expect_unique(assets: DataFrame) -> DataFrame:
    """Path hashes that occur more than once: invalid input for a diff."""
    return assets.groupBy("path_hash").agg(F.count("*").alias("n")).where("n > 1")


def ordered_diff(diff: DataFrame) -> DataFrame:
    """O-67 to O-69: the diff with out_ord, the place of each row within its list.

    Removed: longest path first, later position first among equals. Added: shortest first, earlier position first.
    Modified lists: ascending unsigned path hash.
    """
    length = F.octet_length("path").cast("long")
    first = F.when(F.col("change") == "removed", -length).when(F.col("change") == "added", length).otherwise(unsigned_order(F.col("path_hash")))
    second = F.when(F.col("change") == "removed", -F.col("source_pos")).when(F.col("change") == "added", F.col("target_pos")).otherwise(F.lit(0))
    order = Window.partitionBy("change").orderBy("__1", "__2")
    ranked = diff.withColumn("__1", first).withColumn("__2", second).withColumn("out_ord", (F.row_number().over(order) - 1).cast("long"))
    return ranked.drop("__1", "__2")


def strip_never_content(diff: DataFrame, never: list[str]) -> DataFrame:
    """O-22: index files of the tool itself are never written; removals stay."""
    return diff.where((F.col("change") == "removed") | ~is_never_content(F.regexp_replace("path", "/$", ""), never))


def required_chunks(diff: DataFrame, asset_chunks: DataFrame) -> DataFrame:
    """O-30: (chunk_hash, req_class, out_ord, ord) once per needed chunk: added assets first, then modified, first use wins."""
    rows = ordered_diff(diff).where(F.col("change").isin("added", "content"))
    rows = rows.select(F.when(F.col("change") == "added", 0).otherwise(1).alias("req_class"), "out_ord", F.col("target_pos").alias("asset_pos"))
    used = rows.join(asset_chunks, "asset_pos")
    best = used.groupBy("chunk_hash").agg(F.min(F.struct("req_class", "out_ord", "ord")).alias("f"))
    return best.select("chunk_hash", "f.req_class", "f.out_ord", "f.ord")


def missing_chunks(version_chunks: DataFrame, block_chunks: DataFrame) -> DataFrame:
    """O-29: chunks of a version that a store lacks."""
    return version_chunks.join(block_chunks.select("chunk_hash"), "chunk_hash", "left_anti")


def validate_rescan(found: DataFrame, recorded: DataFrame, retain_permissions: bool = True, windows: bool = False) -> DataFrame:
    """O-46: one row per disagreement of a rescanned tree with its version, and what is wrong first:
    presence, then size, hash and permissions."""
    cols = ("path", "size", "content_hash", "permissions")
    f, r = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in cols]) for d, p in ((found, "f"), (recorded, "r")))
    both = f.join(r, F.col("f_path") == F.col("r_path"), "full_outer")
    problem = (
        F.when(F.col("r_path").isNull(), "unexpected")
        .when(F.col("f_path").isNull(), "missing")
        .when(F.col("f_size") != F.col("r_size"), "size")
        .when(F.col("f_content_hash") != F.col("r_content_hash"), "content")
    )
    if retain_permissions:
        problem = problem.when(permissions_disagree(F.col("f_permissions"), F.col("r_permissions"), windows), "permissions")
    return both.select(F.coalesce("r_path", "f_path").alias("path"), problem.alias("problem")).where("problem is not null")


def first_error(found_count: Column, recorded_count: Column) -> Column:
    """O-46: a differing number of assets is reported before anything else."""
    return F.when(found_count != recorded_count, F.concat(F.lit("asset count "), found_count, F.lit(" != "), recorded_count))
