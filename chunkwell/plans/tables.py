"""The driver's tables as versions and stores.

``snapshot``: documents as files of a version; version 1 and 2 differ in removed, added, edited and re-permitted
files. ``store`` and ``order_version``: line items as chunks, orders as blocks and as assets, for volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..operators.chunking import assemble, fixed_chunks
from ..operators.ordering import bare_path, positions


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def snapshot_files(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """(path, data, permissions, size): files and their directories."""
    docs = read(spark, sf_dir, "documents").where(f"doc_id % 10 <> {version - 1}")
    text, mode = F.coalesce(F.col("text"), F.lit("")), F.lit(420)
    if version == 2:
        text = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit(" v2"))).otherwise(text)
        mode = F.when(F.col("doc_id") % 13 == 0, 493).otherwise(420)
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(path.alias("path"), text.cast("binary").alias("data"), mode.alias("permissions"))
    folders = docs.select(F.explode(F.array(F.concat("source", F.lit("/")), F.concat_ws("/", "source", "lang", F.lit("")))).alias("path")).distinct()
    both = files.unionByName(folders.select("path", F.lit(b"").alias("data"), F.lit(493).alias("permissions")))
    return both.withColumn("size", F.octet_length("data").cast("long"))


def snapshot(spark: SparkSession, sf_dir: str, version: int, range_bytes: int | None = 1024) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(assets, asset_chunks, version_chunks, files) in the analytic profile, at target 1 (48 bytes, ranges of 1024)."""
    files = positions(snapshot_files(spark, sf_dir, version), [bare_path(F.col("path"))], "asset_pos")
    chunks = fixed_chunks(files.select("asset_pos", "data"), range_bytes=range_bytes)
    assets, unique = assemble(files, chunks)
    return assets, chunks, unique, files


#: The same in DuckDB: f1, a1, c1 and f2, a2, c2 are files, assets and chunks of both versions.
SNAPSHOT_SQL = r"""
f1 AS (
  SELECT path, data, permissions, octet_length(data) AS size, row_number() OVER (ORDER BY encode(regexp_replace(path, '/$', ''))) - 1 AS asset_pos FROM (
    SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, encode(coalesce(text, '')) AS data, 420 AS permissions FROM documents WHERE doc_id % 10 <> 0
    UNION ALL SELECT DISTINCT source || '/', ''::BLOB, 493 FROM documents WHERE doc_id % 10 <> 0
    UNION ALL SELECT DISTINCT source || '/' || lang || '/', ''::BLOB, 493 FROM documents WHERE doc_id % 10 <> 0) x),
f2 AS (
  SELECT path, data, permissions, octet_length(data) AS size, row_number() OVER (ORDER BY encode(regexp_replace(path, '/$', ''))) - 1 AS asset_pos FROM (
    SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, encode(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' v2' ELSE '' END) AS data, CASE WHEN doc_id % 13 = 0 THEN 493 ELSE 420 END AS permissions FROM documents WHERE doc_id % 10 <> 1
    UNION ALL SELECT DISTINCT source || '/', ''::BLOB, 493 FROM documents WHERE doc_id % 10 <> 1
    UNION ALL SELECT DISTINCT source || '/' || lang || '/', ''::BLOB, 493 FROM documents WHERE doc_id % 10 <> 1) x),
r1 AS (SELECT asset_pos, data, size, unnest(generate_series(0, (size - 1) // 1024)) AS r FROM f1 WHERE size > 0),
r2 AS (SELECT asset_pos, data, size, unnest(generate_series(0, (size - 1) // 1024)) AS r FROM f2 WHERE size > 0),
p1 AS (SELECT asset_pos, data, r * 1024 + i * 48 AS o, least(48, least(1024, size - r * 1024) - i * 48) AS n FROM (SELECT *, unnest(generate_series(0, (least(1024, size - r * 1024) - 1) // 48)) AS i FROM r1) x),
p2 AS (SELECT asset_pos, data, r * 1024 + i * 48 AS o, least(48, least(1024, size - r * 1024) - i * 48) AS n FROM (SELECT *, unnest(generate_series(0, (least(1024, size - r * 1024) - 1) // 48)) AS i FROM r2) x),
c1 AS (SELECT asset_pos, CAST(row_number() OVER (PARTITION BY asset_pos ORDER BY o) - 1 AS BIGINT) AS ord, CAST(o AS BIGINT) AS asset_offset, ('0x' || substr(md5(data[o + 1:o + n]), 1, 15))::BIGINT AS chunk_hash, CAST(n AS BIGINT) AS chunk_size FROM p1),
c2 AS (SELECT asset_pos, CAST(row_number() OVER (PARTITION BY asset_pos ORDER BY o) - 1 AS BIGINT) AS ord, CAST(o AS BIGINT) AS asset_offset, ('0x' || substr(md5(data[o + 1:o + n]), 1, 15))::BIGINT AS chunk_hash, CAST(n AS BIGINT) AS chunk_size FROM p2),
l1 AS (SELECT asset_pos, count(*) AS chunk_count, string_agg(CAST(chunk_hash AS VARCHAR), ',' ORDER BY ord) AS l FROM c1 GROUP BY asset_pos),
l2 AS (SELECT asset_pos, count(*) AS chunk_count, string_agg(CAST(chunk_hash AS VARCHAR), ',' ORDER BY ord) AS l FROM c2 GROUP BY asset_pos),
a1 AS (SELECT f1.asset_pos, path, path LIKE '%/' AS is_dir, ('0x' || substr(md5(path), 1, 15))::BIGINT AS path_hash, ('0x' || substr(md5(coalesce(l, '')), 1, 15))::BIGINT AS content_hash, size, permissions, coalesce(chunk_count, 0) AS chunk_count FROM f1 LEFT JOIN l1 USING (asset_pos)),
a2 AS (SELECT f2.asset_pos, path, path LIKE '%/' AS is_dir, ('0x' || substr(md5(path), 1, 15))::BIGINT AS path_hash, ('0x' || substr(md5(coalesce(l, '')), 1, 15))::BIGINT AS content_hash, size, permissions, coalesce(chunk_count, 0) AS chunk_count FROM f2 LEFT JOIN l2 USING (asset_pos))
"""


def store(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """block_chunks: an order is a block, its line items are the chunks; the part is the chunk's hash."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = read(spark, sf_dir, "lineitem").where(where)
    return items.select(F.col("l_orderkey").alias("block_pos"), (F.row_number().over(order) - 1).cast("long").alias("ord"), (F.col("l_orderkey") * 7 + 1).alias("block_hash"), F.col("l_partkey").alias("chunk_hash"), F.col("l_quantity").cast("long").alias("chunk_size"))


STORE_SQL = """s AS (
  SELECT l_orderkey AS block_pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ord,
         l_orderkey * 7 + 1 AS block_hash, l_partkey AS chunk_hash, CAST(l_quantity AS BIGINT) AS chunk_size
  FROM lineitem)"""


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a version asks for: every third part."""
    return read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("chunk_hash"))


REQUESTED_SQL = "q AS (SELECT p_partkey AS chunk_hash FROM part WHERE p_partkey % 3 = 0)"


def order_assets(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Orders as assets; version 2 edits every seventh and re-permits every thirteenth."""
    orders = read(spark, sf_dir, "orders").where(f"o_orderkey % 10 <> {version - 1}")
    path = F.concat_ws("/", "o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string"))
    edited = (F.col("o_orderkey") % 7 == 0).cast("long") if version == 2 else F.lit(0).cast("long")
    mode = F.when(F.col("o_orderkey") % 13 == 0, 493).otherwise(420) if version == 2 else F.lit(420)
    return orders.select(F.col("o_orderkey").alias("asset_pos"), path.alias("path"), F.lit(False).alias("is_dir"), h60(path).alias("path_hash"), (F.col("o_custkey") * 2 + edited).alias("content_hash"), F.floor("o_totalprice").cast("long").alias("size"), mode.alias("permissions"))


ORDERS_SQL = "".join(
    f"""{n} AS (
  SELECT o_orderkey AS asset_pos, o_orderpriority || '/c' || o_custkey || '/' || o_orderkey AS path, FALSE AS is_dir,
         ('0x' || substr(md5(o_orderpriority || '/c' || o_custkey || '/' || o_orderkey), 1, 15))::BIGINT AS path_hash,
         o_custkey * 2 + {edited} AS content_hash, CAST(floor(o_totalprice) AS BIGINT) AS size, {mode} AS permissions
  FROM orders WHERE o_orderkey % 10 <> {v - 1}){comma}"""
    for n, v, edited, mode, comma in (("b1", 1, "0", "420", ", "), ("b2", 2, "CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END", "CASE WHEN o_orderkey % 13 = 0 THEN 493 ELSE 420 END", ""))
)


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_chunks of the orders: their line items."""
    return store(spark, sf_dir).select(F.col("block_pos").alias("asset_pos"), "ord", "chunk_hash", "chunk_size")
