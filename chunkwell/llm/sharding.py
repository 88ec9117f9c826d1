"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are put into a seeded random order and ranked; a row's place is its fractional rank
(2 * rank + 1) / (2 * rows of the source). Rows sorted by that fraction interleave the sources in proportion, and
equal cuts of the sorted rows give shards whose counts differ by at most one and whose mixture is the corpus's.

Ranks come without sorting a source or the corpus in one task: rows are dealt into buckets of their random
order, bucket counts are summed into offsets, and only each bucket is ranked. Bucket sizes follow from the seeded
hash, not from the source, so one source with a third of all rows is many buckets.

Results for the unusual cases: a null source is a source of its own; null text has size 8 and CRC 0; rows that
repeat are placed one by one; ties in the random order are broken by doc_id, size and CRC, and rows that agree in
all of these are interchangeable; an empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
SEED = 11
#: Rows of one bucket on average; a bucket is ranked in one task.
BUCKET_ROWS = 20_000


def ranked(df: DataFrame, by: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """df with the rank (from 0) of each row among the rows of equal ``by``, in the order of bucket, then ``order``.

    Null values of ``by`` are a value of their own.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__k{i}") for i, c in enumerate(by)] + [F.col(c).isNull().alias(f"__n{i}") for i, c in enumerate(by)]
    joined = [f"__k{i}" for i in range(len(by))] + [f"__n{i}" for i in range(len(by))]
    keyed = df.select("*", *keys)
    counts = keyed.groupBy(*joined, bucket).agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*joined).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    inside = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*joined, bucket).orderBy(*order)))
    out = inside.join(offsets, [*joined, bucket])
    return out.withColumn(name, F.col("__o") + F.col("__r") - 1).drop("__o", "__r", *joined)


def interleave(df: DataFrame, source: str, order: list[str], draw: str, rows: int) -> DataFrame:
    """df with ``place``, its row's place from 0 in the interleaved order of all sources; ``draw`` is a seeded hex digest."""
    buckets = max(1, rows // BUCKET_ROWS)
    step = f"cast(conv(substr({draw}, 1, 8), 16, 10) as bigint)"
    dealt = df.withColumn("__b", F.expr(f"cast(({step} * {buckets}L) div 4294967296L as int)"))
    dealt = ranked(dealt, [source], "__b", [draw, *order], "__rank").drop("__b")
    sizes = df.groupBy(F.col(source).alias("__s")).agg(F.count("*").alias("__size"))
    dealt = dealt.join(sizes, F.col(source).eqNullSafe(F.col("__s"))).drop("__s")
    dealt = dealt.withColumn("__f", F.expr("(2 * __rank + 1) / cast(2 * __size as double)"))
    dealt = dealt.withColumn("__b", F.expr(f"cast(floor(__f * {buckets}) as int)"))
    dealt = dealt.withColumn("__all", F.lit(0))
    return ranked(dealt, ["__all"], "__b", ["__f", source, draw, *order], "place").drop("__b", "__f", "__rank", "__size", "__all")


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of df with all their columns, and shard and slot (which replace columns of these names)."""
    held = [c for c in df.columns if c not in ("shard", "slot")]
    # rows that repeat an id are told apart by their number in the written table
    packed = common.cut(df.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.monotonically_increasing_id().alias("at")))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = packed.select("at", F.col("row")[id_col].alias("id"), F.col("row")[source_col].alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows = common.cut(rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))))))
    n = rows.count()
    placed = interleave(rows, "source", ["id", "size", "crc"], "draw", n)
    # the first n % shards shards hold one row more
    small, more = n // shards, n % shards
    cut_at = more * (small + 1)
    first, rest = f"place div {small + 1}", f"{more} + (place - {cut_at}) div {max(1, small)}"
    shard_of = f"cast(if(place < {cut_at}, {first}, {rest}) as int)"
    slot = f"cast(if(place < {cut_at}, place % {small + 1}, (place - {cut_at}) % {max(1, small)}) as long)"
    placed = placed.select("at", F.expr(shard_of).alias("shard"), F.expr(slot).alias("slot"))
    return packed.join(placed, "at").select("row.*", "shard", "slot")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A digest of shard_rows: id, source, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = shard_rows(df, id_col, text_col, source_col, shards, seed)
    return rows.select(id_col, source_col, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.read(spark, sf_dir, "documents"))
