"""Incremental ingest of block lists by Structured Streaming: an extension beyond the batch operators.

Every micro-batch of block rows is merged into a table by the ordered-union rule (earlier batches win), so the
streamed result equals the batch merge of all files in arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge_batch(target: str):
    """A foreachBatch function that appends the blocks which earlier batches did not have.

    Each batch goes to a folder of its own number, so a batch that is repeated after a failure replaces itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("block_hash").agg(F.min(F.struct(*[c for c in ("block_pos", *sorted(set(batch.columns) - {"block_hash", "block_pos"}))])).alias("f")).select("block_hash", "f.*")
        try:
            known = spark.read.parquet(target).where(F.col("side") < batch_id).select("block_hash")
            first = first.join(known, "block_hash", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        first.write.mode("overwrite").parquet(f"{target}/side={batch_id}")

    return run


def stream_store_merge(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Start merging the Parquet files of ``source`` into ``target``; ends when all present files are read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(merge_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_new_chunks(spark: SparkSession, source: str, schema: str) -> DataFrame:
    """A stream of the chunks whose hash was not seen before."""
    return spark.readStream.schema(schema).parquet(source).dropDuplicates(["chunk_hash"])
