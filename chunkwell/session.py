"""Session helpers: lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        local = spark.sparkContext.master.startswith("local[")
        own = tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint(eager=True)
