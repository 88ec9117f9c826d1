"""Get-configs and list files (O-13, O-14, O-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import split_parent, strip_extension

SCHEMA = "`storage-uri` string, `source-path` string, `version-local-store-index-path` string"


def read_configs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(config, storage_uri, source_path, lsi) of config files, in the given order; a missing required key is an error."""
    rows = None
    for i, path in enumerate(paths):
        one = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.lit(i).alias("config"), F.col("storage-uri").alias("storage_uri"), F.col("source-path").alias("source_path"), F.col("version-local-store-index-path").alias("lsi"))
        rows = one if rows is None else rows.unionByName(one)
    for required in ("storage_uri", "source_path"):
        rows = rows.where(F.when(F.col(required).isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit(f"get-config without {required}"))))
    return rows


def agreed(rows: DataFrame, group: str) -> DataFrame:
    """O-13 per group: how many configs and stores; one config without an lsi path drops all lsi paths.

    More than one store is an error for a command; ``stores`` tells.
    """
    return rows.groupBy(group).agg(F.count("*").alias("configs"), F.count_distinct("storage_uri").alias("stores"), F.when(F.every(F.col("lsi").isNotNull()), F.count("lsi")).otherwise(F.lit(0)).cast("long").alias("lsi_paths"))


def put_defaults(config_uri: Column, storage_uri: Column | None = None, source_path: Column | None = None, lsi: Column | None = None) -> list[Column]:
    """O-14: storage_uri, source_path and lsi, derived from the config's own place where not given."""
    parent, file_name = split_parent(config_uri)
    name = strip_extension(file_name)
    derived = {
        "storage_uri": (storage_uri, F.concat(parent, F.lit("/store"))),
        "source_path": (source_path, F.concat(parent, F.lit("/version-data/version-index/"), name, F.lit(".lvi"))),
        "lsi": (lsi, F.concat(parent, F.lit("/version-data/version-store-index/"), name, F.lit(".lsi"))),
    }
    return [(default if given is None else F.coalesce(F.when(given != "", given), default)).alias(k) for k, (given, default) in derived.items()]


def list_entries(lines: DataFrame, column: str) -> DataFrame:
    """O-17: entries of a list file, trimmed, blank lines dropped."""
    return lines.select(F.trim(F.col(column), F.lit(" \t\r")).alias("entry")).where("entry <> ''")
