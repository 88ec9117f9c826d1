"""The commands end to end, over a chain of three small versions."""

import os

import pytest

from chunkwell.plans import commands as c
from chunkwell.sources import blobs
from chunkwell.sources.codecs import StoreIndex, VersionIndex

V1 = {"empty": b"", "text.txt": b"one small text", "folder/inner.txt": b"in a folder" * 40, "script.sh": b"#!/bin/sh\n", "old-name.bin": bytes(range(256)) * 30, "gone.txt": b"to be deleted", "move.txt": b"to be moved"}
V2 = {k: v for k, v in V1.items() if k not in ("gone.txt", "old-name.bin")} | {"text.txt": b"another, longer text", "new-name.bin": V1["old-name.bin"], "folder2/more.txt": b"more" * 100}
V3 = {k: v for k, v in V2.items() if k != "move.txt"} | {"folder/move.txt": V2["move.txt"], "last.txt": b"the last one"}


def lay(root, files, executable=()):
    for path, data in files.items():
        where = root / path
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(data)
        where.chmod(0o755 if path in executable else 0o644)
    return str(root)


def tree(root):
    out = {}
    for here, _, names in os.walk(root):
        for n in names:
            if n != c.CACHE_NAME:
                p = os.path.join(here, n)
                out[os.path.relpath(p, root)] = (open(p, "rb").read(), os.stat(p).st_mode & 0o777)
    return out


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("chain")
    store = str(top / "store")
    for i, (files, run) in enumerate(((V1, ()), (V2, ("script.sh",)), (V3, ("script.sh",))), 1):
        lay(top / f"v{i}", files, run)
        report = c.upsync(spark, str(top / f"v{i}"), store, str(top / f"v{i}.lvi"), target_chunk_size=256, max_block_bytes=2000, store_index_path=str(top / f"v{i}.lsi"))
        assert report.written_blocks > 0
    return top


def test_chain_of_syncs_gives_each_version(spark, chain):
    target = chain / "target"
    for i in (1, 2, 3, 1):
        c.downsync(spark, [str(chain / f"v{i}.lvi")], str(chain / "store"), str(target), validate=True, verify_chunks=True)
        assert tree(target) == tree(chain / f"v{i}")


def test_same_version_again_writes_nothing(spark, chain):
    again = c.upsync(spark, str(chain / "v3"), str(chain / "store"), str(chain / "again.lvi"), target_chunk_size=256, max_block_bytes=2000, min_usage=0)
    assert again.written_blocks == 0
    assert VersionIndex.decode((chain / "again.lvi").read_bytes()).encode() == (chain / "again.lvi").read_bytes()


def test_overlay_of_two_versions(spark, chain):
    target = chain / "both"
    c.downsync(spark, [str(chain / "v1.lvi"), str(chain / "v3.lvi")], str(chain / "store"), str(target))
    assert {k: v[0] for k, v in tree(target).items()} == V1 | V3


def test_inspection(spark, chain):
    store, index = str(chain / "store"), str(chain / "v2.lvi")
    assert c.validate_version(spark, store, index) == "ok"
    one = c.print_version(spark, index).head()
    assert one.asset_count == len(V2) + 2 and one["hash"] == "blake2"
    assert [r.name for r in c.ls(spark, index, "folder").collect()] == ["inner.txt"]
    assert len(c.dump_version_assets(spark, index).collect()) == one.asset_count
    assert c.print_version_usage(spark, store, index).head().block_usage == 100
    assert c.print_store(spark, store).head().unique_chunks > 0
    assert c.create_version_store_index(spark, store, index, str(chain / "own.lsi")) == len(StoreIndex.decode((chain / "own.lsi").read_bytes()).block_hashes)
    assert c.cp(spark, store, index, "text.txt", str(chain / "copied")) == len(V2["text.txt"])
    assert (chain / "copied").read_bytes() == V2["text.txt"]
    with pytest.raises(c.CommandError):
        c.cp(spark, store, index, "no such", str(chain / "x"))


def test_put_and_get(spark, chain, tmp_path):
    c.put(spark, str(chain / "v1"), str(tmp_path / "config.json"), target_chunk_size=256)
    c.get(spark, [str(tmp_path / "config.json")], str(tmp_path / "out"))
    assert tree(tmp_path / "out") == tree(chain / "v1")
    with pytest.raises(c.CommandError):
        c.put(spark, str(chain / "v1"), str(tmp_path / "c.json"), store_index_path="x", no_store_index=True)


def test_clone_rebuild_and_prune(spark, chain, tmp_path):
    store = str(tmp_path / "clone")
    indexes = [str(chain / f"v{i}.lvi") for i in (1, 2)]
    targets = [str(tmp_path / f"v{i}.lvi") for i in (1, 2)]
    assert c.clone_store(spark, str(chain / "store"), store, indexes, targets, str(tmp_path / "work")) >= 1
    assert c.validate_version(spark, store, targets[1]) == "ok"
    before = blobs.read_store_index(blobs.Blobs(store))[0]
    for name in blobs.shard_names(blobs.Blobs(store)):
        blobs.Blobs(store).delete(name)
    assert c.init_remote_store(spark, store) == len(before.block_hashes)
    with pytest.raises(c.CommandError):
        c.prune_store(spark, store, [])
    report = c.prune_store(spark, store, [targets[1]])
    assert report.deleted == report.dropped
    assert c.validate_version(spark, store, targets[1]) == "ok"


def test_hostile_paths_are_refused(spark, chain, tmp_path):
    index = VersionIndex.decode((chain / "v1.lvi").read_bytes())
    index.names = index.names.replace(b"gone.txt", b"../a.txt")
    (tmp_path / "bad.lvi").write_bytes(index.encode())
    with pytest.raises(c.CommandError):
        c.downsync(spark, [str(tmp_path / "bad.lvi")], str(chain / "store"), str(tmp_path / "t"))


def test_index_files_as_tables(spark, chain):
    from pyspark.sql import functions as F

    from chunkwell.sources import index_files

    assets = index_files.read_assets(spark, str(chain / "v1.lvi"))
    assert {r.path for r in assets.collect()} == set(V1) | {"folder/"}
    chunks = index_files.read_asset_chunks(spark, str(chain / "v1.lvi"))
    sums = chunks.groupBy("asset_pos").agg(F.sum("chunk_size").alias("n")).join(assets, "asset_pos")
    assert sums.where("n <> size").isEmpty() and sums.count() == sum(bool(x) for x in V1.values())
    blocks = index_files.read_blocks(spark, str(chain / "store"), plain=True)
    stored = index_files.read_block_chunks(spark, str(chain / "store")).select("block_hash").distinct()
    assert blocks.count() == stored.count() == blocks.join(stored, "block_hash", "left_semi").count()
    assert blocks.where("octet_length(payload) <> plain_bytes").isEmpty()
