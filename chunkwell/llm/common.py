"""Shared pieces of the training-data operators: session folders, lineage cuts and hash bitmaps."""

from __future__ import annotations

import gc
import string
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a bitmap that a plan carries as a literal; they are some 80 KB of plan text.
LITERAL_WORDS = 1 << 12
#: Keys (two longs each) that are broadcast at most: under 40 MB as a hash table.
BROADCAST_KEYS = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's setting, else one of our own (local mode only)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        local = context.master.startswith("local[") or context.master == "local"
        found = tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what finished rounds have left: Spark removes shuffle files, broadcasts and checkpoints only once the
    driver's garbage collector finds that nothing refers to them. Called a few times in operators of many rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def bitmap_words(hashes: DataFrame, words: int) -> list[tuple[int, int]]:
    """The non-zero 64-bit words of a bitmap of ``64 * words`` bits with the bits of column ``h`` set.

    At most ``words`` rows reach the driver, whatever the size of ``hashes``; rows are combined map-side.
    """
    bits = hashes.select(F.expr(f"pmod(h, {64 * words}L)").alias("bit"))
    packed = bits.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("b"))
    return [(r.w, r.b) for r in packed.collect()]


def bitmap_literal(found: list[tuple[int, int]], words: int) -> str:
    """SQL text of a bitmap as an array literal; constant folding turns it into one value."""
    values = [0] * words
    for w, b in found:
        values[w] = b
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"


def matched(df: DataFrame, keys: DataFrame, on: Column, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Join df with a checkpointed table of keys: broadcast while the keys' number is within ``most``, beyond
    that shuffled. keys are unique, so neither way repeats rows."""
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df as (key, row): row is the whole row as a struct, so that no column name can clash, and key a number of its own.

    Keys are the ids if these are integers, unique and not null. Else rows are numbered in the order of id (nulls
    first) and text digest and written to the shared folder, so that a row keeps its number.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    own = F.col(f"`{id_col}`")
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        n, known, several = df.agg(F.count("*"), F.count(own), F.count_distinct(own)).first()
        if n == known == several:
            return df.select(own.cast("long").alias("key"), row)
    # equal rows differ in the last number, so that many of them are no single range
    packed = df.select(row, own.alias("own"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("told"), F.monotonically_increasing_id().alias("at"))
    return cut(packed.sort("own", "told", "at").select("row")).select(F.monotonically_increasing_id().alias("key"), "row")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is not in ids (one column of that name, nulls ignored).

    A null key is never dropped. Extra columns of any name pass through.
    """
    gone = cut(ids.select(F.col(key).alias("__gone")).where("__gone is not null").distinct())
    return matched(df, gone, df[f"`{key}`"] == gone["__gone"], "left_anti")


def one_per_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with one row of those that agree in id and text; a null id is never another's, and null text is empty."""
    text = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    known = df.where(F.col(f"`{id_col}`").isNotNull()).withColumn("__text_sha", text).dropDuplicates([id_col, "__text_sha"]).drop("__text_sha")
    return known.union(df.where(F.col(f"`{id_col}`").isNull()))
