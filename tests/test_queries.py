"""Every query of the catalogue against its DuckDB SQL on the smallest tables, and properties of the operators."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chunkwell.operators import diff, plan, store
from chunkwell.plans import catalog, tables
from chunkwell.streaming import ingest

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def text(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    if name in SQL:
        found = duck.execute(SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(tuple(text(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in found.fetchall())
        assert sorted(tuple(text(r[c]) for c in sorted(columns)) for r in rows) == want
    else:
        assert rows


def test_all_blocks_are_packed_as_by_a_plain_loop(spark):
    items = sorted((r.l_suppkey, r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_quantity, r.l_extendedprice, r.l_returnflag) for r in tables.read(spark, SF, "lineitem").collect())
    blocks, last, pos = [], None, 0
    for item in items:
        grp, size, tag = item[0], int(item[4]), item[6]
        pos = pos + 1 if blocks and blocks[-1][0] == grp else 0
        if last != (grp, tag) or blocks[-1][2] == 8 or blocks[-1][3] + size > 220:
            blocks.append([grp, pos, 0, 0])
        blocks[-1][2] += 1
        blocks[-1][3] += size
        last = (grp, tag)
    out = catalog.queries()["o31_pack_blocks"](spark, SF).collect()
    assert sum(r.chunks for r in out) == len(items)
    assert sorted([r.grp, r.first_pos, r.chunks, r.bytes] for r in out) == sorted(blocks)


def test_diff_with_itself_is_empty(spark):
    assets = tables.order_assets(spark, SF, 1)
    assert diff.version_diff(assets, assets).isEmpty()
    assert diff.expect_unique(assets).isEmpty()


def test_merge_is_idempotent_and_cover_is_complete(spark):
    s, q = tables.store(spark, SF), tables.requested(spark, SF)
    blocks = s.select("block_hash", "block_pos").distinct()
    assert store.merge_stores([blocks, blocks]).count() == blocks.count()
    cover = store.covering_blocks(s, q)
    served = s.join(cover.select("block_hash"), "block_hash", "left_semi").select("chunk_hash").distinct()
    asked = q.join(s.select("chunk_hash"), "chunk_hash", "left_semi")
    assert asked.join(served, "chunk_hash", "left_anti").isEmpty()
    assert store.covering_blocks(s, q, 101).isEmpty()


def test_errors_are_raised(spark):
    s = tables.store(spark, SF)
    with pytest.raises(Exception, match="no block has chunk"):
        plan.write_plan(tables.order_chunks(spark, SF), s.where("block_pos = 1")).collect()
    with pytest.raises(Exception, match="different hashes"):
        spark.range(1).select(store.merged_hash_id(F.lit(1), F.lit(2), F.lit(1), F.lit(3))).collect()
    with pytest.raises(Exception, match="outside the index"):
        store.bounded_blocks(spark.sql("select 5 as chunks_offset, 6 as chunk_count"), 10, "error").collect()


def test_streamed_merge_equals_batch(spark, tmp_path):
    orders = tables.read(spark, SF, "orders").select(F.col("o_orderkey").alias("block_pos"), F.col("o_custkey").alias("block_hash"))
    source, parts = str(tmp_path / "in"), [orders.where(f"block_pos % 3 = {i}") for i in range(3)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    ingest.stream_store_merge(spark, source, "block_pos long, block_hash long", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("block_hash").distinct().count() == orders.select("block_hash").distinct().count()
    assert out.select("side").distinct().count() >= 2
