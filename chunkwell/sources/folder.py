"""Folders as tables (O-01, O-02)."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters

ENTRIES = "path string, is_dir boolean, size long, permissions int"


def scan_folder(spark: SparkSession, root: str, include_filter: str = "", exclude_filter: str = "", never: list[str] | None = None) -> DataFrame:
    """O-01: (path, is_dir, size, permissions) of all files and folders below root, folders with a slash and size 0.

    Links and special files are left out. A folder that the filter drops is still searched. The listing is read by
    the driver: it alone has folders and modes; contents are read by the executors.
    """
    rows = []
    for here, _, _ in os.walk(root):
        with os.scandir(here) as found:
            for entry in found:
                mode = entry.stat(follow_symlinks=False)
                path = os.path.relpath(entry.path, root).replace(os.sep, "/")
                if stat.S_ISDIR(mode.st_mode):
                    rows.append((path, True, 0, stat.S_IMODE(mode.st_mode)))
                elif stat.S_ISREG(mode.st_mode):
                    rows.append((path, False, mode.st_size, stat.S_IMODE(mode.st_mode)))
    listed = spark.createDataFrame(rows, ENTRIES).where(filters.include(F.col("path"), F.col("is_dir"), include_filter, exclude_filter, never))
    return listed.withColumn("path", F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path")))


def read_contents(entries: DataFrame, root: str) -> DataFrame:
    """entries with ``data``; files are read by the executors, folders have none."""

    def run(frames):
        for frame in frames:
            data = []
            for path, folder in zip(frame["path"], frame["is_dir"], strict=True):
                if folder:
                    data.append(b"")
                else:
                    with open(os.path.join(root, path), "rb") as f:
                        data.append(f.read())
            yield frame.assign(data=data)

    return entries.repartition("path").mapInPandas(run, ENTRIES + ", data binary")
