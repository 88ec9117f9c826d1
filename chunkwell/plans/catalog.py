"""The queries of the library's own operators, each with DuckDB SQL where SQL can express it.

A query's key starts with the operator's number in the survey. Queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import filters, formatting, hashing, paths
from ..operators import chunking, diff, inspect, ordering, packing, plan
from ..operators import store as stores
from ..sources import blobs, codecs, configs, folder
from . import tables as t

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _uri(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", "url")


# ---- scans and order


@query("o02_scan_order", f"WITH {t.SNAPSHOT_SQL} SELECT path, CAST(asset_pos AS BIGINT) AS asset_pos, CAST(size AS BIGINT) AS size FROM f1")
def o02(spark, sf):
    files = t.snapshot_files(spark, sf, 1)
    return ordering.positions(files.select("path", "size"), [ordering.bare_path(F.col("path"))], "asset_pos")


@query("o08_codec_dispatch", f"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN {codecs.LZ4_ID} WHEN 2 THEN {codecs.ZSTD_FAMILY + 48} + p_size % 10 WHEN 3 THEN {codecs.BROTLI_FAMILY + 48} + p_size % 100 ELSE p_size END AS tag FROM part)
SELECT p_partkey, CAST(tag AS BIGINT) AS tag, CASE WHEN tag = 0 THEN 'none' WHEN tag = {codecs.LZ4_ID} THEN 'lz4' WHEN tag // 256 = {codecs.ZSTD_FAMILY // 256} THEN 'zstd' WHEN tag // 256 = {codecs.BROTLI_FAMILY // 256} THEN 'brotli' ELSE 'unknown' END AS codec FROM p""")
def o08(spark, sf):
    k = F.col("p_partkey") % 5
    tag = F.when(k == 0, 0).when(k == 1, codecs.LZ4_ID).when(k == 2, 0x7A746430 + F.col("p_size") % 10).when(k == 3, 0x62746C30 + F.col("p_size") % 100).otherwise(F.col("p_size")).cast("long")
    family = F.col("tag").bitwiseAND(codecs.FAMILY_MASK)
    codec = F.when(F.col("tag") == 0, "none").when(F.col("tag") == codecs.LZ4_ID, "lz4").when(family == codecs.ZSTD_FAMILY, "zstd").when(family == codecs.BROTLI_FAMILY, "brotli").otherwise("unknown")
    return t.read(spark, sf, "part").select("p_partkey", tag.alias("tag")).withColumn("codec", codec)


@query("o09_uri_backend", """
WITH u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 's3://b/k' WHEN 1 THEN 'gs://b/k' WHEN 2 THEN 'abfss://b/k' WHEN 3 THEN 'fsblob://x' WHEN 4 THEN 'C:/x' WHEN 5 THEN '/tmp/x' ELSE url END AS uri FROM pages)
SELECT page_id, CASE WHEN uri LIKE 's3://%' THEN 's3' WHEN uri LIKE 'gs://%' OR uri LIKE 'abfss://%' THEN 'unsupported' WHEN uri LIKE 'fsblob://%' OR uri NOT LIKE '%://%' THEN 'fs' ELSE 'unknown' END AS backend FROM u""")
def o09(spark, sf):
    k = F.col("page_id") % 7
    uri = F.when(k == 0, "s3://b/k").when(k == 1, "gs://b/k").when(k == 2, "abfss://b/k").when(k == 3, "fsblob://x").when(k == 4, "C:/x").when(k == 5, "/tmp/x").otherwise(F.col("url"))
    return _uri(spark, sf).select("page_id", paths.backend(uri).alias("backend"))


_CONFIGS = """WITH g AS (SELECT o_custkey AS grp, 'store' || (o_custkey % 3) AS storage_uri, o_orderpriority || '.lvi' AS source_path, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey || '.lsi' END AS lsi FROM orders)"""


@query("o13_get_configs", f"{_CONFIGS} SELECT grp, count(*) AS configs, count(DISTINCT storage_uri) AS stores, CAST(CASE WHEN count(*) = count(lsi) THEN count(lsi) ELSE 0 END AS BIGINT) AS lsi_paths FROM g GROUP BY grp")
def o13(spark, sf):
    rows = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.concat(F.lit("store"), F.col("o_custkey") % 3).alias("storage_uri"), F.concat("o_orderpriority", F.lit(".lvi")).alias("source_path"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".lsi"))).alias("lsi"))
    return configs.agreed(rows, "grp").select("grp", "configs", "stores", "lsi_paths")


@query("o14_put_defaults", r"""
WITH c AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS uri FROM pages),
p AS (SELECT page_id, CASE WHEN uri LIKE '%/%' THEN regexp_extract(uri, '^(.*)/[^/]*$', 1) ELSE '.' END AS parent, regexp_replace(regexp_extract(uri, '([^/]*)$', 1), '\.[^.]*$', '') AS name FROM c)
SELECT page_id, parent || '/store' AS storage_uri, parent || '/version-data/version-index/' || name || '.lvi' AS source_path, parent || '/version-data/version-store-index/' || name || '.lsi' AS lsi FROM p""")
def o14(spark, sf):
    uri = F.regexp_replace("url", "[?#].*$", "")
    return _uri(spark, sf).select("page_id", *configs.put_defaults(uri))


@query("o15_block_sink", f"WITH {t.STORE_SQL}, b AS (SELECT DISTINCT block_hash FROM s) SELECT b.block_hash, CASE WHEN o_orderkey % 4 = 0 THEN 'exists' ELSE 'written' END AS outcome FROM b JOIN orders ON o_orderkey * 7 + 1 = b.block_hash")
def o15(spark, sf):
    blocks = t.store(spark, sf).select("block_hash").distinct()
    orders = t.read(spark, sf, "orders").select((F.col("o_orderkey") * 7 + 1).alias("block_hash"), (F.col("o_orderkey") % 4 == 0).alias("there"))
    existing = orders.where("there").select("block_hash")
    new = blocks.join(orders.select("block_hash"), "block_hash", "left_semi").join(existing, "block_hash", "left_anti").withColumn("outcome", F.lit("written"))
    return new.unionByName(blocks.join(existing, "block_hash", "left_semi").withColumn("outcome", F.lit("exists")))


@query("o16_cache_split", f"WITH {t.STORE_SQL}, b AS (SELECT block_hash, sum(chunk_size) AS bytes FROM s GROUP BY block_hash), e AS (SELECT DISTINCT user_id * 7 + 1 AS block_hash FROM events) SELECT e.block_hash IS NOT NULL AS hit, count(*) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes FROM b LEFT JOIN e ON b.block_hash = e.block_hash GROUP BY 1")
def o16(spark, sf):
    blocks = t.store(spark, sf).groupBy("block_hash").agg(F.sum("chunk_size").alias("bytes"))
    cached = t.read(spark, sf, "events").select((F.col("user_id") * 7 + 1).alias("block_hash")).distinct().withColumn("c", F.lit(True))
    return blocks.join(cached, "block_hash", "left").groupBy(F.col("c").isNotNull().alias("hit")).agg(F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"))


@query("o17_list_files", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT trim(line, ' ' || chr(9) || chr(13)) AS entry, count(*) AS n FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1")
def o17(spark, sf):
    lines = t.read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return configs.list_entries(lines, "line").groupBy("entry").agg(F.count("*").alias("n"))


# ---- projections and filters


@query("o18_asset_offsets", f"WITH {t.SNAPSHOT_SQL} SELECT CAST(asset_pos AS BIGINT) AS asset_pos, ord, chunk_hash, chunk_size, asset_offset FROM c1")
def o18(spark, sf):
    _, chunks, _, _ = t.snapshot(spark, sf, 1)
    return ordering.running_offset(chunks.drop("asset_offset"), "asset_pos", "ord", "chunk_size", "asset_offset")


@query("o19_path_filter", f"WITH {t.ORDERS_SQL} SELECT asset_pos, path FROM b1 WHERE NOT (regexp_matches(path, '/c1') OR regexp_matches(path, '7$')) AND (regexp_matches(path, '^[12]-') OR regexp_matches(path, '99'))")
def o19(spark, sf):
    return t.order_assets(spark, sf, 1).where(filters.include(F.col("path"), F.col("is_dir"), "^[12]-**99", "/c1**7$")).select("asset_pos", "path")


@query("o21_never_content", "SELECT event_id, lower(event_type) IN ('click', 'error') AS never FROM events")
def o21(spark, sf):
    return t.read(spark, sf, "events").select("event_id", paths.is_never_content(F.upper("event_type"), ["Click", "ERROR"]).alias("never"))


_DIFF = f"""WITH {t.ORDERS_SQL},
d AS (
  SELECT unnest(list_filter([CASE WHEN b2.path IS NULL THEN 'removed' END, CASE WHEN b1.path IS NULL THEN 'added' END,
                CASE WHEN b1.content_hash <> b2.content_hash THEN 'content' END, CASE WHEN b1.permissions <> b2.permissions THEN 'permissions' END], lambda x: x IS NOT NULL)) AS change,
         coalesce(b1.path_hash, b2.path_hash) AS path_hash, coalesce(b2.path, b1.path) AS path, b1.asset_pos AS source_pos, b2.asset_pos AS target_pos
  FROM b1 FULL JOIN b2 ON b1.path_hash = b2.path_hash)"""


def _diff(spark, sf):
    return diff.version_diff(t.order_assets(spark, sf, 1), t.order_assets(spark, sf, 2))


@query("o22_strip_never_content", f"{_DIFF} SELECT change, path FROM d WHERE change = 'removed' OR lower(path) NOT IN ('1-urgent/c1/0', '5-low/c899/0')")
def o22(spark, sf):
    return diff.strip_never_content(_diff(spark, sf), ["1-urgent/c1/0", "5-low/C899/0"]).select("change", "path")


@query("o23_list_level", f"""WITH {t.SNAPSHOT_SQL}, n AS (SELECT *, regexp_replace(path, '/$', '') AS p FROM f1)
SELECT CAST(asset_pos AS BIGINT) AS asset_pos, substr(p, 6) AS name,
  CASE WHEN path LIKE '%/' THEN 'd' ELSE '-' END || CASE permissions WHEN 493 THEN 'rwxr-xr-x' ELSE 'rw-r--r--' END || ' ' || lpad(CAST(size AS VARCHAR), 16, ' ') || ' ' || substr(p, 6) AS line
FROM n WHERE p LIKE 'src0/%' AND position('/' IN substr(p, 6)) = 0""")
def o23(spark, sf):
    assets, _, _, _ = t.snapshot(spark, sf, 1)
    return inspect.list_level(assets, "src0")


@query("o24_safe_paths", r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || page_id WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN './.' WHEN 3 THEN 'a/./b' WHEN 4 THEN '' ELSE url END AS p FROM pages)
SELECT page_id, CASE WHEN p LIKE '/%' THEN 'absolute' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent' WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.')) = 0 THEN 'root itself' END AS reason FROM u""")
def o24(spark, sf):
    k, own = F.col("page_id") % 6, F.col("page_id").cast("string")
    p = F.when(k == 0, F.concat(F.lit("/"), own)).when(k == 1, F.concat(F.lit("a/../"), own)).when(k == 2, "./.").when(k == 3, "a/./b").when(k == 4, "").otherwise(F.col("url"))
    return _uri(spark, sf).select("page_id", paths.unsafe_reason(p).alias("reason"))


@query("o25_find_asset", f"WITH {t.SNAPSHOT_SQL} SELECT CAST(asset_pos AS BIGINT) AS asset_pos, path, CAST(size AS BIGINT) AS size FROM f1 WHERE path = 'src1/'")
def o25(spark, sf):
    assets, _, _, _ = t.snapshot(spark, sf, 1)
    return inspect.find_asset(assets, "src1").select("asset_pos", "path", "size")


@query("o26_bounded_blocks", "WITH b AS (SELECT p_partkey AS block_pos, p_partkey * 3 AS chunks_offset, p_size AS chunk_count FROM part), m AS (SELECT count(*) * 3 AS n FROM part) SELECT block_pos FROM b, m WHERE chunks_offset + chunk_count <= n")
def o26(spark, sf):
    part = t.read(spark, sf, "part")
    blocks = part.select(F.col("p_partkey").alias("block_pos"), (F.col("p_partkey") * 3).alias("chunks_offset"), F.col("p_size").alias("chunk_count"))
    return stores.bounded_blocks(blocks, part.count() * 3).select("block_pos")


@query("o27_block_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 65537 END AS block_hash FROM orders")
def o27(spark, sf):
    h = F.col("o_orderkey") * 65537
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(paths.block_path(h), F.lit(".tmp"))).otherwise(paths.block_path(h))
    return t.read(spark, sf, "orders").select("o_orderkey", paths.parse_block_hash(name).alias("block_hash"))


# ---- joins


@query("o28_version_diff", f"""WITH {t.SNAPSHOT_SQL}
SELECT unnest(list_filter([CASE WHEN a2.path IS NULL THEN 'removed' END, CASE WHEN a1.path IS NULL THEN 'added' END,
              CASE WHEN a1.content_hash <> a2.content_hash THEN 'content' END, CASE WHEN a1.permissions <> a2.permissions THEN 'permissions' END], lambda x: x IS NOT NULL)) AS change,
       coalesce(a1.path_hash, a2.path_hash) AS path_hash, coalesce(a2.path, a1.path) AS path, CAST(a1.asset_pos AS BIGINT) AS source_pos, CAST(a2.asset_pos AS BIGINT) AS target_pos
FROM a1 FULL JOIN a2 ON a1.path_hash = a2.path_hash""")
def o28(spark, sf):
    return diff.version_diff(t.snapshot(spark, sf, 1)[0], t.snapshot(spark, sf, 2)[0])


@query("o29_missing_chunks", f"WITH {t.STORE_SQL} SELECT p_partkey AS chunk_pos, p_partkey AS chunk_hash FROM part WHERE p_partkey NOT IN (SELECT chunk_hash FROM s WHERE block_pos % 5 = 0)")
def o29(spark, sf):
    version = t.read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_pos"), F.col("p_partkey").alias("chunk_hash"))
    return diff.missing_chunks(version, t.store(spark, sf).where("block_pos % 5 = 0")).select("chunk_pos", "chunk_hash")


_ORDERED = f"""{_DIFF},
x AS (SELECT *, CASE change WHEN 'removed' THEN -octet_length(encode(path)) WHEN 'added' THEN octet_length(encode(path)) ELSE path_hash END AS k1, CASE change WHEN 'removed' THEN -source_pos WHEN 'added' THEN target_pos ELSE 0 END AS k2 FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY k1, k2) - 1 AS out_ord FROM x)"""


@query("o30_required_chunks", f"""{_ORDERED}, {t.STORE_SQL},
u AS (SELECT s.chunk_hash, CASE o.change WHEN 'added' THEN 0 ELSE 1 END AS req_class, o.out_ord, s.ord FROM o JOIN s ON o.target_pos = s.block_pos WHERE o.change IN ('added', 'content')),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY req_class, out_ord, ord) AS n FROM u)
SELECT chunk_hash, CAST(req_class AS BIGINT) AS req_class, out_ord, ord FROM r WHERE n = 1""")
def o30(spark, sf):
    return diff.required_chunks(_diff(spark, sf), t.order_chunks(spark, sf)).withColumn("req_class", F.col("req_class").cast("long"))


@query("o41_chunk_locations", f"""WITH {t.STORE_SQL}, o AS (SELECT *, sum(chunk_size) OVER (PARTITION BY block_pos ORDER BY ord) - chunk_size AS off, row_number() OVER (PARTITION BY chunk_hash ORDER BY block_pos, ord) AS r FROM s)
SELECT chunk_hash, block_pos, block_hash, CAST(off AS BIGINT) AS block_offset, chunk_size AS stored_size FROM o WHERE r = 1""")
def o41(spark, sf):
    return plan.chunk_locations(t.store(spark, sf)).select("chunk_hash", "block_pos", "block_hash", "block_offset", "stored_size")


_PLAN = f"""WITH {t.STORE_SQL}, st AS (SELECT * FROM s WHERE block_pos % 3 = 0),
lo AS (SELECT *, CAST(sum(chunk_size) OVER (PARTITION BY block_pos ORDER BY ord) - chunk_size AS BIGINT) AS block_offset, row_number() OVER (PARTITION BY chunk_hash ORDER BY block_pos, ord) AS r FROM st),
pl AS (SELECT v.block_pos AS asset_pos, v.ord, v.chunk_hash, v.chunk_size, CAST(sum(v.chunk_size) OVER (PARTITION BY v.block_pos ORDER BY v.ord) - v.chunk_size AS BIGINT) AS asset_offset, lo.block_pos, lo.block_offset
       FROM s v LEFT JOIN lo ON v.chunk_hash = lo.chunk_hash AND lo.r = 1)"""


def _plan(spark, sf):
    return plan.write_plan(t.order_chunks(spark, sf), t.store(spark, sf).where("block_pos % 3 = 0"), strict=False)


@query("o42_write_plan", f"{_PLAN} SELECT asset_pos, ord, chunk_hash, asset_offset, block_pos, block_offset FROM pl")
def o42(spark, sf):
    return _plan(spark, sf).select("asset_pos", "ord", "chunk_hash", "asset_offset", "block_pos", "block_offset")


@query("o43_payload_sizes", f"WITH {t.STORE_SQL} SELECT block_hash, block_pos, CAST(sum(chunk_size) AS BIGINT) AS bytes FROM s WHERE block_pos IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def o43(spark, sf):
    wanted = t.read(spark, sf, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 7 + 1).alias("block_hash"))
    return stores.kept_payload_sizes(t.store(spark, sf), wanted).select("block_hash", "block_pos", "bytes")


@query("o45_orphan_blocks", f"WITH {t.STORE_SQL} SELECT o_orderkey * 7 + 1 AS block_hash FROM orders WHERE o_orderkey * 7 + 1 NOT IN (SELECT block_hash FROM s)")
def o45(spark, sf):
    listed = t.read(spark, sf, "orders").select((F.col("o_orderkey") * 7 + 1).alias("block_hash"))
    return stores.orphan_blocks(listed, t.store(spark, sf))


@query("o46_validate_rescan", f"""WITH {t.ORDERS_SQL} SELECT coalesce(b1.path, b2.path) AS path, CASE WHEN b1.path IS NULL THEN 'unexpected' WHEN b2.path IS NULL THEN 'missing' WHEN b1.size <> b2.size THEN 'size' WHEN b1.content_hash <> b2.content_hash THEN 'content' ELSE 'permissions' END AS problem
FROM b1 FULL JOIN b2 ON b1.path = b2.path WHERE b1.path IS NULL OR b2.path IS NULL OR b1.size <> b2.size OR b1.content_hash <> b2.content_hash OR b1.permissions <> b2.permissions""")
def o46(spark, sf):
    return diff.validate_rescan(t.order_assets(spark, sf, 2), t.order_assets(spark, sf, 1))


# ---- ordered dedup and merges


@query("o32_unique_chunks", f"WITH {t.STORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY block_pos, ord) AS n FROM s) SELECT chunk_hash, block_pos AS first_pos, ord AS first_ord, chunk_size, row_number() OVER (ORDER BY block_pos, ord) - 1 AS chunk_pos FROM r WHERE n = 1")
def o32(spark, sf):
    firsts = stores.unique_chunks(t.order_chunks(spark, sf))
    return ordering.positions(firsts, ["first_pos", "first_ord"], "chunk_pos").select("chunk_hash", "first_pos", "first_ord", "chunk_size", "chunk_pos")


@query("o33_unique_positions", "SELECT l_partkey AS chunk_hash, min(l_orderkey) AS first_pos, max(l_orderkey) AS last_pos FROM lineitem GROUP BY 1")
def o33(spark, sf):
    return stores.unique_positions(t.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("chunk_hash"), F.col("l_orderkey").alias("pos")))


_MERGE = """WITH l AS (SELECT o_orderkey AS block_pos, o_custkey AS block_hash, 0 AS side FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_orderkey % 3 = 2),
m AS (SELECT *, row_number() OVER (PARTITION BY block_hash ORDER BY side, block_pos) AS r FROM l)"""


def _three(spark, sf):
    orders = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("block_pos"), F.col("o_custkey").alias("block_hash"))
    return [orders.where(f"block_pos % 3 = {i}") for i in range(3)]


@query("o34_store_merge", f"{_MERGE} SELECT block_hash, CAST(side AS BIGINT) AS side, block_pos FROM (SELECT *, row_number() OVER (PARTITION BY block_hash ORDER BY side, block_pos) AS r2 FROM l WHERE side < 2) x WHERE r2 = 1")
def o34(spark, sf):
    return stores.merge_stores(_three(spark, sf)[:2]).select("block_hash", F.col("side").cast("long").alias("side"), "block_pos")


@query("o36_concatenate", f"{_MERGE} SELECT side, count(*) AS blocks, CAST(sum(block_pos) AS BIGINT) AS pos_sum FROM (SELECT CAST(side AS BIGINT) AS side, block_pos FROM l) x GROUP BY side")
def o36(spark, sf):
    return stores.concatenate(_three(spark, sf)).groupBy(F.col("side").cast("long").alias("side")).agg(F.count("*").alias("blocks"), F.sum("block_pos").alias("pos_sum"))


@query("o37_version_merge", f"""WITH {t.ORDERS_SQL}, u AS (SELECT *, 0 AS side FROM b1 UNION ALL SELECT *, 1 FROM b2),
r AS (SELECT *, row_number() OVER (PARTITION BY path_hash ORDER BY side DESC) AS last, min(side * 1000000000000 + asset_pos) OVER (PARTITION BY path_hash) AS k FROM u)
SELECT path_hash, path, content_hash, permissions, side AS from_side, row_number() OVER (ORDER BY octet_length(encode(path)), k) - 1 AS merged_pos FROM r WHERE last = 1""")
def o37(spark, sf):
    merged = stores.merge_versions(t.order_assets(spark, sf, 1), t.order_assets(spark, sf, 2))
    placed = ordering.positions(merged.withColumn("length", F.octet_length("path")), ["length", "union_side", "union_pos"], "merged_pos")
    return placed.select("path_hash", "path", "content_hash", "permissions", "from_side", "merged_pos")


@query("o38_prune_index", "SELECT o_orderkey AS block_pos, o_custkey AS block_hash FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def o38(spark, sf):
    blocks = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("block_pos"), F.col("o_custkey").alias("block_hash"))
    keep = t.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("block_hash"))
    return stores.prune_index(blocks, keep).select("block_pos", "block_hash")


_COVER = f"""{t.STORE_SQL}, {t.REQUESTED_SQL},
us AS (SELECT block_pos, block_hash, CAST(sum(CASE WHEN chunk_hash IN (SELECT chunk_hash FROM q) THEN chunk_size ELSE 0 END) AS BIGINT) AS used, CAST(sum(chunk_size) AS BIGINT) AS total FROM s GROUP BY ALL),
pt AS (SELECT block_pos, block_hash, used * 100 // total AS pct FROM us WHERE used > 0)"""


def _claims(least: int) -> str:
    return f"cl{least} AS (SELECT s.chunk_hash, pt.*, row_number() OVER (PARTITION BY s.chunk_hash ORDER BY pct DESC, pt.block_pos, s.ord) AS r FROM s JOIN pt USING (block_pos, block_hash) WHERE s.chunk_hash IN (SELECT chunk_hash FROM q) AND pct >= {least})"


@query("o39_keep_set", f"WITH {_COVER}, {_claims(0)}, {_claims(60)} SELECT block_hash FROM cl0 WHERE r = 1 UNION SELECT block_hash FROM cl60 WHERE r = 1")
def o39(spark, sf):
    s, q = t.store(spark, sf), t.requested(spark, sf)
    return stores.keep_set([stores.covering_blocks(s, q, 0), stores.covering_blocks(s, q, 60)])


@query("o40_covering_blocks", f"WITH {_COVER}, {_claims(30)} SELECT block_pos, block_hash, pct, count(*) AS claimed FROM cl30 WHERE r = 1 GROUP BY ALL")
def o40(spark, sf):
    return stores.covering_blocks(t.store(spark, sf), t.requested(spark, sf), 30)


@query("o44_shard_merge", f"{_MERGE} SELECT block_hash, CAST(side AS BIGINT) AS side, block_pos FROM m WHERE r = 1")
def o44(spark, sf):
    return stores.merge_stores(_three(spark, sf)).select("block_hash", F.col("side").cast("long").alias("side"), "block_pos")


@query("o47_canonical_layout", "SELECT TRUE AS canonical UNION ALL SELECT FALSE")
def o47(spark, sf):
    counts = t.read(spark, sf, "part").select(F.col("p_partkey").alias("block_pos"), F.col("p_size").cast("long").alias("chunk_count"))
    good = ordering.running_offset(counts.withColumn("one", F.lit(0)), "one", "block_pos", "chunk_count", "chunks_offset").drop("one")
    return stores.is_canonical(good).unionByName(stores.is_canonical(good.withColumn("chunks_offset", F.col("chunks_offset") + 1)))


@query("o49_block_rows", f"WITH {t.STORE_SQL} SELECT block_pos, block_hash, count(*) AS chunk_count, md5(string_agg(chunk_hash || ':' || chunk_size, ',' ORDER BY ord)) AS chunks_md5 FROM s GROUP BY ALL")
def o49(spark, sf):
    rows = stores.block_rows(t.store(spark, sf))
    return rows.select("block_pos", "block_hash", "chunk_count", F.md5(F.array_join(F.transform("chunks", lambda x: F.concat_ws(":", x["chunk_hash"], x["chunk_size"])), ",")).alias("chunks_md5"))


@query("o64_hash_id", "SELECT CAST(n_regionkey AS BIGINT) AS hash_id FROM nation WHERE n_regionkey <> 0 ORDER BY n_nationkey LIMIT 1")
def o64(spark, sf):
    blocks = t.read(spark, sf, "nation").select(F.col("n_nationkey").alias("block_pos"), F.col("n_regionkey").cast("long").alias("hash_id"))
    return stores.block_set_hash_id(blocks)


# ---- packing, plans, reconstruction


_PACK = """WITH RECURSIVE c AS (SELECT l_suppkey AS grp, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos, l_partkey AS chunk_hash, CAST(l_quantity AS BIGINT) AS chunk_size, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS tag FROM lineitem),
w AS (
  SELECT grp, pos, chunk_hash, chunk_size, tag, chunk_size AS bytes, 1 AS n, 0 AS block FROM c WHERE pos = 0
  UNION ALL
  SELECT c.grp, c.pos, c.chunk_hash, c.chunk_size, c.tag,
         CASE WHEN c.tag <> w.tag OR w.n = 8 OR w.bytes + c.chunk_size > 220 THEN c.chunk_size ELSE w.bytes + c.chunk_size END,
         CASE WHEN c.tag <> w.tag OR w.n = 8 OR w.bytes + c.chunk_size > 220 THEN 1 ELSE w.n + 1 END,
         CASE WHEN c.tag <> w.tag OR w.n = 8 OR w.bytes + c.chunk_size > 220 THEN w.block + 1 ELSE w.block END
  FROM w JOIN c ON c.grp = w.grp AND c.pos = w.pos + 1)"""


def _packed(items):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    chunks = items.select(F.col("l_suppkey").alias("grp"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("l_partkey").alias("chunk_hash"), F.col("l_quantity").cast("long").alias("chunk_size"), F.expr("case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end").alias("chunk_tag"))
    return packing.pack(chunks, 200, 8, group="grp")


@query("o31_pack_blocks", f"{_PACK} SELECT grp, min(pos) AS first_pos, count(*) AS chunks, CAST(sum(chunk_size) AS BIGINT) AS bytes FROM w GROUP BY grp, block")
def o31(spark, sf):
    packed = _packed(t.read(spark, sf, "lineitem"))
    return packed.groupBy("grp", "run", "block").agg(F.min("pos").alias("first_pos"), F.count("*").alias("chunks"), F.sum("chunk_size").alias("bytes")).drop("run", "block")


@query("o48_pack_missing")
def o48(spark, sf):
    version = t.read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_pos"), F.col("p_partkey").alias("chunk_hash"), (F.col("p_size") * 1000).cast("long").alias("chunk_size"), (F.col("p_partkey") % 2).alias("chunk_tag"))
    return packing.pack_missing(version, t.store(spark, sf).where("block_pos % 9 = 0"), max_block_bytes=100_000, max_chunks=64)


@query("o52_block_offsets", f"WITH {t.STORE_SQL} SELECT block_pos, ord, chunk_hash, CAST(sum(chunk_size) OVER (PARTITION BY block_pos ORDER BY ord) - chunk_size AS BIGINT) AS block_offset FROM s")
def o52(spark, sf):
    return ordering.running_offset(t.store(spark, sf), "block_pos", "ord", "chunk_size", "block_offset").select("block_pos", "ord", "chunk_hash", "block_offset")


@query("o53_coalesced_writes", f"""{_PLAN},
f AS (SELECT *, CASE WHEN lag(asset_offset) OVER w + lag(chunk_size) OVER w = asset_offset AND lag(block_offset) OVER w + lag(chunk_size) OVER w = block_offset THEN 0 ELSE 1 END AS st FROM pl WHERE block_pos IS NOT NULL WINDOW w AS (PARTITION BY block_pos, asset_pos ORDER BY asset_offset)),
i AS (SELECT *, sum(st) OVER (PARTITION BY block_pos, asset_pos ORDER BY asset_offset) AS island FROM f)
SELECT block_pos, asset_pos, min(asset_offset) AS asset_offset, min(block_offset) AS block_offset, CAST(sum(chunk_size) AS BIGINT) AS bytes, count(*) AS chunks FROM i GROUP BY block_pos, asset_pos, island""")
def o53(spark, sf):
    return plan.coalesced_writes(_plan(spark, sf).where("block_pos is not null"))


@query("o94_asset_parts", f"WITH {t.SNAPSHOT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY asset_pos, ord) AS n FROM c1) SELECT chunk_hash, CAST(asset_pos AS BIGINT) AS asset_pos, ord, asset_offset, chunk_size FROM r WHERE n = 1")
def o94(spark, sf):
    return plan.asset_parts(t.snapshot(spark, sf, 1)[1]).select("chunk_hash", "asset_pos", "ord", "asset_offset", "chunk_size")


def _doc_store(spark, sf):
    """Unique chunks of version 1, 64 to a block, with the blocks' payloads."""
    _, chunks, unique, files = t.snapshot(spark, sf, 1)
    blocks = unique.select(F.expr("chunk_pos div 64").alias("block_pos"), F.expr("chunk_pos % 64").alias("ord"), F.expr("chunk_pos div 64 + 1").alias("block_hash"), "chunk_hash", "chunk_size")
    return blocks, chunks, files


@query("o95_block_payloads", f"""WITH {t.SNAPSHOT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY asset_pos, ord) AS n FROM c1),
u AS (SELECT row_number() OVER (ORDER BY r.asset_pos, ord) - 1 AS chunk_pos, chunk_size FROM r WHERE n = 1)
SELECT chunk_pos // 64 AS block_pos, CAST(sum(chunk_size) AS BIGINT) AS bytes FROM u GROUP BY 1""")
def o95(spark, sf):
    blocks, chunks, files = _doc_store(spark, sf)
    payloads = plan.assemble_payloads(blocks, plan.asset_parts(chunks), files.select("asset_pos", "data"))
    return payloads.select("block_pos", F.octet_length("payload").cast("long").alias("bytes"))


@query("o96_reconstruct", f"WITH {t.SNAPSHOT_SQL} SELECT CAST(asset_pos AS BIGINT) AS asset_pos, md5(data) AS md5 FROM f1 WHERE size > 0")
def o96(spark, sf):
    blocks, chunks, files = _doc_store(spark, sf)
    payloads = plan.assemble_payloads(blocks, plan.asset_parts(chunks), files.select("asset_pos", "data"))
    return plan.reconstruct(chunks.drop("asset_offset"), blocks, payloads).select("asset_pos", F.md5("data").alias("md5"))


@query("o97_verify_chunks", f"WITH {t.SNAPSHOT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY asset_pos, ord) AS n FROM c1) SELECT chunk_hash FROM r WHERE n = 1 AND chunk_hash % 5 = 0")
def o97(spark, sf):
    """Every fifth chunk's recorded size is made wrong; those are found."""
    _, chunks, unique, files = t.snapshot(spark, sf, 1)
    cut = plan.asset_parts(chunks).join(files.select("asset_pos", "data"), "asset_pos")
    pieces = cut.select("chunk_hash", F.expr("chunk_size + if(chunk_hash % 5 = 0, 1, 0)").alias("chunk_size"), F.expr("substring(data, cast(asset_offset + 1 as int), cast(chunk_size as int))").alias("data"))
    return plan.verify_chunks(pieces).select("chunk_hash")


# ---- aggregates and windows


@query("o51_evicted", """WITH f AS (SELECT CAST(event_id AS VARCHAR) AS path, user_id * 10 AS size, epoch_us(ts) // 1000000 AS mtime FROM events),
o AS (SELECT *, sum(size) OVER (ORDER BY mtime, size DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone, sum(size) OVER () AS total FROM f)
SELECT path, size, mtime FROM o WHERE total - coalesce(gone, 0) > 1000000""")
def o51(spark, sf):
    files = t.read(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), (F.col("user_id") * 10).alias("size"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("mtime"))
    return inspect.evicted(files, 1_000_000)


@query("o54_version_summary", f"WITH {t.ORDERS_SQL}, {t.STORE_SQL} SELECT (SELECT count(*) FROM b1) AS asset_count, CAST((SELECT sum(size) FROM b1) AS BIGINT) AS asset_bytes, count(*) AS chunk_count, CAST(sum(chunk_size) AS BIGINT) AS chunk_bytes, min(chunk_size) AS smallest, max(chunk_size) AS largest, CAST(sum(chunk_size) // count(*) AS BIGINT) AS average FROM s")
def o54(spark, sf):
    return inspect.version_summary(t.order_assets(spark, sf, 1), t.order_chunks(spark, sf))


@query("o55_store_summary", f"WITH {t.STORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY block_pos, ord) AS n FROM s) SELECT count(*) AS stored_chunks, CAST(sum(chunk_size) AS BIGINT) AS stored_bytes, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_chunks, CAST(sum(CASE WHEN n = 1 THEN chunk_size ELSE 0 END) AS BIGINT) AS unique_bytes FROM r")
def o55(spark, sf):
    return inspect.store_summary(t.store(spark, sf))


@query("o56_self_dedup", f"WITH {t.SNAPSHOT_SQL} SELECT CAST((SELECT sum(x) FROM (SELECT chunk_hash, min(chunk_size) AS x FROM c1 GROUP BY 1) u) AS BIGINT) AS unique_bytes, CAST(sum(chunk_size) AS BIGINT) AS stored_bytes FROM c1")
def o56(spark, sf):
    chunks = t.snapshot(spark, sf, 1)[1].withColumnRenamed("asset_pos", "block_pos")
    return inspect.store_summary(chunks).select("unique_bytes", "stored_bytes")


@query("o57_avoided_bytes", f"WITH {t.SNAPSHOT_SQL} SELECT CAST(sum(CASE WHEN chunk_hash IN (SELECT chunk_hash FROM c1) THEN chunk_size ELSE 0 END) AS BIGINT) AS avoided, CAST(sum(chunk_size) AS BIGINT) AS total FROM c2")
def o57(spark, sf):
    return inspect.avoided_bytes(t.snapshot(spark, sf, 1)[1], t.snapshot(spark, sf, 2)[1])


@query("o58_size_distribution", "SELECT count(*) AS n, avg(CAST(l_quantity AS BIGINT)) AS mean, median(CAST(l_quantity AS DOUBLE)) AS median FROM lineitem")
def o58(spark, sf):
    return inspect.size_distribution(t.store(spark, sf))


@query("o59_store_covers", f"""WITH {t.STORE_SQL}, z AS (SELECT block_pos, sum(chunk_size) AS x FROM s GROUP BY 1),
m AS (SELECT count(*) AS size_mismatches FROM orders LEFT JOIN z ON o_orderkey = block_pos WHERE coalesce(x, 0) <> o_orderkey % 200),
k AS (SELECT count(DISTINCT chunk_hash) AS missing_chunks FROM s WHERE chunk_hash NOT IN (SELECT chunk_hash FROM s WHERE block_pos % 7 = 0))
SELECT size_mismatches, missing_chunks, CASE WHEN size_mismatches > 0 THEN 'size mismatch' WHEN missing_chunks > 0 THEN 'missing chunks' ELSE 'ok' END AS verdict FROM m, k""")
def o59(spark, sf):
    assets = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_pos"), F.lit(False).alias("is_dir"), (F.col("o_orderkey") % 200).alias("size"))
    return inspect.store_covers(assets, t.order_chunks(spark, sf), t.store(spark, sf).where("block_pos % 7 = 0"))


@query("o60_block_bytes", f"WITH {t.STORE_SQL} SELECT block_pos, block_hash, CAST(sum(chunk_size) AS BIGINT) AS bytes FROM s GROUP BY ALL")
def o60(spark, sf):
    return inspect.payload_bytes(t.store(spark, sf))


@query("o61_sequence_hash", f"WITH {t.STORE_SQL} SELECT block_pos, ('0x' || substr(md5(string_agg(CAST(chunk_hash AS VARCHAR), ',' ORDER BY ord)), 1, 15))::BIGINT AS sequence_hash FROM s GROUP BY 1")
def o61(spark, sf):
    rows = stores.block_rows(t.store(spark, sf))
    return rows.select("block_pos", hashing.analytic_sequence_hash(F.transform("chunks", lambda x: x["chunk_hash"])).alias("sequence_hash"))


@query("o61_exact_sequence_hash")
def o61_exact(spark, sf):
    rows = stores.block_rows(t.store(spark, sf))
    return rows.select("block_pos", hashing.sequence_hash_udf()(F.transform("chunks", lambda x: x["chunk_hash"])).alias("sequence_hash"))


@query("o62_dump_assets", f"""WITH {t.ORDERS_SQL}, w AS (SELECT length(CAST(max(size) AS VARCHAR)) AS n FROM b1)
SELECT asset_pos, path, '-rw-r--r-- ' || lpad(CAST(size AS VARCHAR), CAST(n AS INTEGER), ' ') || ' ' || path AS line FROM b1, w""")
def o62(spark, sf):
    return inspect.dump_assets(t.order_assets(spark, sf, 1))


@query("o63_counters", f"WITH {t.STORE_SQL} SELECT count(DISTINCT block_pos) AS get_blocks, count(*) AS get_chunks, CAST(sum(chunk_size) AS BIGINT) AS get_bytes FROM s")
def o63(spark, sf):
    return t.store(spark, sf).agg(F.count_distinct("block_pos").alias("get_blocks"), F.count("*").alias("get_chunks"), F.sum("chunk_size").alias("get_bytes"))


@query("o65_fragmentation", f"""WITH {t.STORE_SQL}, lo AS (SELECT chunk_hash, block_pos FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY block_pos DESC, ord DESC) AS r FROM s WHERE block_pos % 3 = 0) x WHERE r = 1),
p AS (SELECT s.block_pos AS asset_pos, s.ord, lo.block_pos AS b FROM s LEFT JOIN lo USING (chunk_hash)),
f AS (SELECT asset_pos, CASE WHEN b IS DISTINCT FROM lag(b) OVER (PARTITION BY asset_pos ORDER BY ord) THEN 1 ELSE 0 END AS moved FROM p),
g AS (SELECT count(DISTINCT asset_pos) AS assets, CAST(sum(moved) AS BIGINT) AS changes FROM f)
SELECT assets, changes, CASE WHEN assets = 0 THEN 0 ELSE ((100 * changes // assets - 100) % 4294967296 + 4294967296) % 4294967296 END AS asset_fragmentation, CAST(100 AS BIGINT) AS block_usage FROM g""")
def o65(spark, sf):
    return inspect.fragmentation(t.order_chunks(spark, sf), t.store(spark, sf).where("block_pos % 3 = 0"))


@query("o66_block_usage", f"WITH {t.STORE_SQL}, {t.REQUESTED_SQL} SELECT * FROM (SELECT block_pos, block_hash, CAST(sum(CASE WHEN chunk_hash IN (SELECT chunk_hash FROM q) THEN chunk_size ELSE 0 END) AS BIGINT) AS used, CAST(sum(chunk_size) AS BIGINT) AS total, CAST(sum(CASE WHEN chunk_hash IN (SELECT chunk_hash FROM q) THEN chunk_size ELSE 0 END) * 100 // sum(chunk_size) AS BIGINT) AS pct FROM s GROUP BY ALL) x WHERE used > 0")
def o66(spark, sf):
    return stores.block_usage(t.store(spark, sf), t.requested(spark, sf))


@query("o67_ordered_diff", f"{_ORDERED} SELECT change, path, source_pos, target_pos, out_ord FROM o")
def o67(spark, sf):
    return diff.ordered_diff(_diff(spark, sf)).select("change", "path", "source_pos", "target_pos", "out_ord")


# ---- scalars


@query("o70_blake2s")
def o70(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", hashing.hash_udf()(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("blake2s"))


@query("o72_shard_names", "SELECT page_id, 'store_' || sha256(html) || '.lsi' AS name FROM pages")
def o72(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", hashing.shard_name(F.encode("html", "UTF-8")).alias("name"))


@query("o73_block_paths", "SELECT o_orderkey, 'chunks/' || substr(printf('%016x', o_orderkey * 4294967311), 1, 4) || '/0x' || printf('%016x', o_orderkey * 4294967311) || '.lsb' AS path FROM orders")
def o73(spark, sf):
    return t.read(spark, sf, "orders").select("o_orderkey", paths.block_path(F.col("o_orderkey") * 4294967311).alias("path"))


@query("o74_slashes", "SELECT page_id, regexp_replace(url || repeat('/', page_id % 4), '/$', '') AS one, regexp_replace(url || repeat('/', page_id % 4), '/+$', '') AS every FROM pages")
def o74(spark, sf):
    p = F.concat("url", F.repeat(F.lit("/"), (F.col("page_id") % 4).cast("int")))
    return _uri(spark, sf).select("page_id", paths.strip_trailing_slash(p).alias("one"), paths.trim_trailing_slashes(p).alias("every"))


@query("o75_target_path", "SELECT page_id, nullif(string_split(string_split(replace(url, '\\', '/'), '/')[-1], '.')[1], '') AS target FROM pages")
def o75(spark, sf):
    return _uri(spark, sf).select("page_id", paths.derive_target_path(F.col("url")).alias("target"))


@query("o76_parent_and_stem", r"SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM pages")
def o76(spark, sf):
    parent, name = paths.split_parent(F.col("url"))
    return _uri(spark, sf).select("page_id", parent.alias("parent"), name.alias("name"), paths.strip_extension(name).alias("stem"))


@query("o77_details", """SELECT o_orderkey, '-' || array_to_string(list_transform(generate_series(0, 8), lambda i: CASE WHEN (o_orderkey >> (8 - i)) % 2 = 1 THEN substr('rwx', 1 + i % 3, 1) ELSE '-' END), '') || ' ' ||
  CASE WHEN length(CAST(o_orderkey * o_custkey AS VARCHAR)) < 5 THEN lpad(CAST(o_orderkey * o_custkey AS VARCHAR), 5, ' ') ELSE CAST(o_orderkey * o_custkey AS VARCHAR) END || ' ' || o_orderpriority AS line FROM orders""")
def o77(spark, sf):
    return t.read(spark, sf, "orders").select("o_orderkey", formatting.details(F.concat("o_orderpriority", F.lit("//")), F.col("o_orderkey") * F.col("o_custkey"), F.col("o_orderkey").cast("int"), F.lit(False), 5).alias("line"))


@query("o78_byte_counts")
def o78(spark, sf):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 977
    return t.read(spark, sf, "orders").select("o_orderkey", formatting.bytes_decimal(n).alias("decimal"), formatting.bytes_binary(n).alias("binary"))


@query("o79_hash_names", "SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'blake2' WHEN 2 THEN 'blake3' WHEN 3 THEN 'meow' ELSE CAST(n_nationkey AS VARCHAR) END AS name FROM nation")
def o79(spark, sf):
    k = F.col("n_nationkey")
    ids = F.when(k == 1, hashing.BLAKE2S_ID).when(k == 2, hashing.BLAKE3_ID).when(k == 3, hashing.MEOW_ID).otherwise(k)
    return t.read(spark, sf, "nation").select("n_nationkey", hashing.identifier_string(ids).alias("name"))


@query("o81_permissions_disagree", "SELECT o_orderkey, (o_orderkey % 512) <> (o_custkey % 512) AS exact, ((o_orderkey % 512) & 146 <> 0) <> ((o_custkey % 512) & 146 <> 0) AS windows FROM orders")
def o81(spark, sf):
    a, b = (F.col("o_orderkey") % 512).cast("int"), (F.col("o_custkey") % 512).cast("int")
    return t.read(spark, sf, "orders").select("o_orderkey", formatting.permissions_disagree(a, b).alias("exact"), formatting.permissions_disagree(a, b, True).alias("windows"))


@query("o82_windows_mode", "SELECT o_orderkey, CAST(292 + CASE WHEN o_orderkey % 2 = 0 THEN 73 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 146 END AS INTEGER) AS mode FROM orders")
def o82(spark, sf):
    return t.read(spark, sf, "orders").select("o_orderkey", formatting.windows_mode(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0).alias("mode"))


@query("o84_schemes", "SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS scheme FROM pages")
def o84(spark, sf):
    return _uri(spark, sf).select("page_id", paths.scheme_of(F.col("url")).alias("scheme"))


# ---- chunking and versions


@query("o85_content_chunks")
def o85(spark, sf):
    files = ordering.positions(t.snapshot_files(spark, sf, 1), [ordering.bare_path(F.col("path"))], "asset_pos")
    return chunking.chunk_assets(files.select("asset_pos", "data"), 1024)


@query("o90_fixed_chunks", f"WITH {t.SNAPSHOT_SQL} SELECT CAST(asset_pos AS BIGINT) AS asset_pos, ord, asset_offset, chunk_hash, chunk_size FROM c2")
def o90(spark, sf):
    return t.snapshot(spark, sf, 2)[1]


@query("o92_assemble", f"WITH {t.SNAPSHOT_SQL} SELECT CAST(asset_pos AS BIGINT) AS asset_pos, path, is_dir, path_hash, content_hash, CAST(size AS BIGINT) AS size, permissions, chunk_count FROM a2")
def o92(spark, sf):
    return t.snapshot(spark, sf, 2)[0]


@query("o93_build_version")
def o93(spark, sf):
    return chunking.build_version(t.snapshot_files(spark, sf, 1), 1024)[0]


# ---- codecs, files and chunker variants


@query("o01_scan_folder")
def o01(spark, sf):
    return folder.scan_folder(spark, sf, include_filter=r"\.parquet")


@query("o10_blob_list")
def o10(spark, sf):
    return spark.createDataFrame(blobs.Blobs(sf).list(), "name string, size long")


@query("o03_version_index_codec", f"WITH {t.ORDERS_SQL} SELECT asset_pos, path, path_hash, content_hash, size, permissions FROM b2")
def o03(spark, sf):
    """Assets written as version indexes of a sixteenth each, and read back (O-03, O-04, O-83)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("asset_pos", kind="stable")
        names = [p.encode() + b"\0" for p in frame["path"]]
        n, nothing = len(frame), np.zeros(len(frame), "<u4")
        index = codecs.VersionIndex(
            hashing.BLAKE2S_ID,
            1,
            frame["path_hash"].to_numpy("<i8"),
            frame["content_hash"].to_numpy("<i8"),
            frame["size"].to_numpy("<u8"),
            nothing,
            nothing,
            name_offsets=np.concatenate([[0], np.cumsum([len(x) for x in names])[:-1]]).astype("<u4"),
            permissions=frame["permissions"].to_numpy("<u2"),
            names=b"".join(names),
        )
        v = codecs.VersionIndex.decode(index.encode())
        return pd.DataFrame({"asset_pos": frame["asset_pos"].to_numpy(), "path": [v.path(i) for i in range(n)], "path_hash": v.path_hashes, "content_hash": v.content_hashes, "size": v.sizes.astype("int64"), "permissions": v.permissions.astype("int32")})

    assets = t.order_assets(spark, sf, 2)
    return assets.groupBy(F.col("asset_pos") % 16).applyInPandas(run, "asset_pos long, path string, path_hash long, content_hash long, size long, permissions int")


@query("o05_store_index_codec", f"WITH {t.STORE_SQL} SELECT block_pos, ord, block_hash, chunk_hash, chunk_size FROM s")
def o05(spark, sf):
    """Blocks written as store indexes of a sixteenth each, and read back (O-05, O-36, O-49)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block_pos", "ord"], kind="stable")
        blocks = [codecs.BlockIndex(int(g["block_hash"].iloc[0]), 3, 0, g["chunk_hash"].to_numpy("<i8"), g["chunk_size"].to_numpy("<u4")) for _, g in frame.groupby("block_pos")]
        found = codecs.StoreIndex.decode(codecs.StoreIndex.of_blocks(blocks).encode()).blocks()
        rows = [((b.block_hash - 1) // 7, i, b.block_hash, int(h), int(n)) for b in found for i, (h, n) in enumerate(zip(b.chunk_hashes, b.chunk_sizes, strict=True))]
        return pd.DataFrame(rows, columns=["block_pos", "ord", "block_hash", "chunk_hash", "chunk_size"])

    return t.store(spark, sf).groupBy(F.col("block_pos") % 16).applyInPandas(run, "block_pos long, ord long, block_hash long, chunk_hash long, chunk_size long")


@query("o06_block_codec", "SELECT page_id, md5(html) AS md5 FROM pages")
def o06(spark, sf):
    """Each page's html as a stored block, compressed, written and read back (O-06, O-07)."""

    @F.pandas_udf("binary")
    def through(data: pd.Series) -> pd.Series:
        def one(raw: bytes) -> bytes:
            index = codecs.BlockIndex(1, 3, codecs.TAG_BY_NAME["zstd"], np.array([hashing.blake2s(raw)], "<i8"), np.array([len(raw)], "<u4"))
            stored = codecs.StoredBlock(index, codecs.encode_payload(index.tag, raw))
            return codecs.StoredBlock.decode(stored.encode()).plain()

        return data.map(one)

    return t.read(spark, sf, "pages").select("page_id", F.md5(through(F.encode("html", "UTF-8"))).alias("md5"))


@query("o88_buffer_chunks")
def o88(spark, sf):
    pages = t.read(spark, sf, "pages").select(F.col("page_id").alias("asset_pos"), F.encode("html", "UTF-8").alias("data"))
    return chunking.chunk_assets(pages, 1024, seed="buffer")


@query("o50_index_from_blocks", "SELECT o_orderkey * 4294967311 AS block_hash FROM orders WHERE o_orderkey % 5 <> 0")
def o50(spark, sf):
    """Block files whose name is not their hash's are left out; the rest in unsigned order."""
    h = F.col("o_orderkey") * 4294967311
    listed = t.read(spark, sf, "orders").select(h.alias("block_hash"), F.when(F.col("o_orderkey") % 5 == 0, paths.block_path(h + 1)).otherwise(paths.block_path(h)).alias("name"))
    return listed.where(F.col("name") == paths.block_path(F.col("block_hash"))).orderBy(hashing.unsigned_order(F.col("block_hash"))).select("block_hash")
