"""The end-user commands (O-98 to O-110) as compositions of the operators.

Index files are read and written whole by the driver, as their formats ask; chunking, hashing, packing payloads and
writing blocks and files run on the executors. Store and target folders must be reachable from every executor.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import chunking, diff, inspect, ordering, packing
from ..operators import plan as plans
from ..operators import store as stores
from ..session import cut
from ..sources import blobs, codecs, folder
from ..sources.codecs import BlockIndex, StoredBlock, StoreIndex, VersionIndex

#: A cached index of the target folder; never content.
CACHE_NAME = ".chunkwell.index.cache.lvi"


class CommandError(ValueError):
    pass


# ---- index files as tables


def version_tables(spark: SparkSession, index: VersionIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, asset_chunks, version_chunks) of an index."""
    n = len(index.path_hashes)
    names = [index.path(i) for i in range(n)]
    assets = pd.DataFrame({"asset_pos": np.arange(n), "path": names, "is_dir": [p.endswith("/") for p in names], "path_hash": index.path_hashes, "content_hash": index.content_hashes, "size": index.sizes.astype("int64"), "permissions": index.permissions.astype("int32"), "chunk_count": index.chunk_counts.astype("int64")})
    counts = index.chunk_counts.astype(np.int64)
    owner = np.repeat(np.arange(n), counts)
    order = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]) if n else np.empty(0, np.int64), counts)
    flat = index.chunk_indexes[np.repeat(index.chunk_starts.astype(np.int64), counts) + order] if len(owner) else np.empty(0, np.int64)
    chunks = pd.DataFrame({"asset_pos": owner, "ord": order, "chunk_hash": index.chunk_hashes[flat], "chunk_size": index.chunk_sizes[flat].astype("int64")})
    unique = pd.DataFrame({"chunk_pos": np.arange(len(index.chunk_hashes)), "chunk_hash": index.chunk_hashes, "chunk_size": index.chunk_sizes.astype("int64"), "chunk_tag": index.chunk_tags.astype("int64")})
    return (
        spark.createDataFrame(assets, "asset_pos long, path string, is_dir boolean, path_hash long, content_hash long, size long, permissions int, chunk_count long"),
        spark.createDataFrame(chunks, "asset_pos long, ord long, chunk_hash long, chunk_size long"),
        spark.createDataFrame(unique, "chunk_pos long, chunk_hash long, chunk_size long, chunk_tag long"),
    )


def version_index(assets: DataFrame, asset_chunks: DataFrame, unique: DataFrame, hash_id: int, target: int) -> VersionIndex:
    """O-04: the index of a version's tables."""
    a = assets.toPandas().sort_values("asset_pos", kind="stable")
    u = unique.toPandas().sort_values("chunk_pos", kind="stable")
    place = dict(zip(u["chunk_hash"], range(len(u)), strict=True))
    m = asset_chunks.select("asset_pos", "ord", "chunk_hash").toPandas().sort_values(["asset_pos", "ord"], kind="stable")
    counts = m.groupby("asset_pos").size().reindex(a["asset_pos"], fill_value=0).to_numpy()
    names = [p.encode() + b"\0" for p in a["path"]]
    starts = lambda lengths: np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("<u4") if len(lengths) else np.empty(0, "<u4")
    return VersionIndex(
        hash_id,
        target,
        a["path_hash"].to_numpy("<i8"),
        a["content_hash"].to_numpy("<i8"),
        a["size"].to_numpy("<u8"),
        counts.astype("<u4"),
        starts(counts),
        np.array([place[h] for h in m["chunk_hash"]], dtype="<u4"),
        u["chunk_hash"].to_numpy("<i8"),
        u["chunk_size"].to_numpy("<u4"),
        u["chunk_tag"].to_numpy("<u4"),
        starts([len(x) for x in names]),
        a["permissions"].to_numpy("<u2"),
        b"".join(names),
    )


def store_tables(spark: SparkSession, index: StoreIndex) -> DataFrame:
    """block_chunks of a store index, with the block's tag."""
    rows = [(b, i, block.block_hash, int(h), int(s), block.tag) for b, block in enumerate(index.blocks()) for i, (h, s) in enumerate(zip(block.chunk_hashes, block.chunk_sizes, strict=True))]
    return spark.createDataFrame(rows, "block_pos long, ord long, block_hash long, chunk_hash long, chunk_size long, tag long")


def _subset(index: StoreIndex, hashes: list[int]) -> StoreIndex:
    """The blocks of those hashes, in that order."""
    first: dict[int, BlockIndex] = {}
    for block in index.blocks():
        first.setdefault(block.block_hash, block)
    return StoreIndex.of_blocks([first[h] for h in hashes if h in first])


def covering(spark: SparkSession, index: StoreIndex, chunks: DataFrame, min_usage: int = 0) -> StoreIndex:
    """O-40 on index files."""
    found = stores.covering_blocks(store_tables(spark, index), chunks, min_usage).toPandas().sort_values(["pct", "block_pos"], ascending=[False, True])
    return _subset(index, found["block_hash"].tolist())


def scan_version(spark: SparkSession, root: str, target: int, tag: int, hash_id: int, include_filter: str = "", exclude_filter: str = "") -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
    """O-93: the tables of a folder's version, and its files with their bytes."""
    entries = folder.scan_folder(spark, root, include_filter, exclude_filter, [CACHE_NAME])
    files = folder.read_contents(entries, root)
    tables = tuple(cut(d) for d in chunking.build_version(files.select("path", "data", "permissions"), target, tag, hash_id))
    return tables, files


# ---- upsync and put


@dataclass
class UpReport:
    written_blocks: int
    written_chunks: int
    assets: int


def upsync(spark: SparkSession, source: str, storage_uri: str, target_index: str, *, store_index_path: str | None = None, source_index: str | None = None, target_chunk_size: int = 32768, max_block_bytes: int = packing.MAX_BLOCK_BYTES, max_chunks: int = packing.MAX_CHUNKS, min_usage: int = 80, compression: str = "zstd", hash_name: str = "blake2", include_filter: str = "", exclude_filter: str = "") -> UpReport:
    """O-98: store a folder as a version: only blocks with chunks that the store lacks are written."""
    if compression not in codecs.TAG_BY_NAME:
        raise CommandError(f"unknown compression {compression!r}")
    tag, hash_id = codecs.TAG_BY_NAME[compression], hashing.identifier_for_name(hash_name)
    tables, files = scan_version(spark, source, target_chunk_size, tag, hash_id, include_filter, exclude_filter)
    if source_index:
        tables = version_tables(spark, VersionIndex.decode(blobs.read_uri(source_index)))
    assets, chunks, unique = tables
    store = blobs.Blobs(storage_uri)
    known, _ = blobs.read_store_index(store)
    existing = covering(spark, known, unique, min_usage)
    new = _write_missing(spark, store, assets, chunks, unique, store_tables(spark, existing), files, hash_id, max_block_bytes, max_chunks)
    if new:
        blobs.add_to_store_index(store, new)
    blobs.write_uri(target_index, version_index(assets, chunks, unique, hash_id, target_chunk_size).encode())
    if store_index_path:
        blobs.write_uri(store_index_path, blobs.merged([existing, StoreIndex.of_blocks(new)]).encode())
    return UpReport(len(new), sum(len(b.chunk_hashes) for b in new), assets.count())


def _write_missing(spark, store, assets, chunks, unique, stored, files, hash_id, max_block_bytes, max_chunks) -> list[BlockIndex]:
    """O-48, O-95, O-15: pack the missing chunks, and write their blocks from the files' bytes."""
    packed = cut(packing.pack_missing(unique, stored, max_block_bytes=max_block_bytes, max_chunks=max_chunks))
    if packed.isEmpty():
        return []
    blocks = packed.withColumn("block_pos", F.struct("run", "block"))
    contents = assets.select("asset_pos", "path").join(files.select("path", "data"), "path").drop("path")
    parts = plans.asset_parts(chunks).select("chunk_hash", "asset_pos", "asset_offset")
    pieces = blocks.join(parts, "chunk_hash").join(contents, "asset_pos")
    pieces = pieces.select("run", "block", "ord", "chunk_hash", "chunk_size", "chunk_tag", F.expr("substring(data, cast(asset_offset + 1 as int), cast(chunk_size as int))").alias("piece"))
    own = hashing.hasher(hash_id)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", kind="stable")
        hashes, tag = frame["chunk_hash"].tolist(), int(frame["chunk_tag"].iloc[0])
        index = BlockIndex(own(hashing.sequence_bytes(hashes)), hash_id, tag, frame["chunk_hash"].to_numpy("<i8"), frame["chunk_size"].to_numpy("<u4"))
        blobs.put_block(store, StoredBlock(index, codecs.encode_payload(tag, b"".join(frame["piece"]))))
        return pd.DataFrame({"run": [frame["run"].iloc[0]], "block": [frame["block"].iloc[0]], "index": [index.encode()]})

    written = pieces.groupBy("run", "block").applyInPandas(write, "run long, block long, index binary").toPandas()
    return [BlockIndex.decode_prefix(bytes(x))[0] for x in written.sort_values(["run", "block"])["index"]]


def put(spark: SparkSession, source: str, config_uri: str, *, storage_uri: str = "", target_index: str = "", store_index_path: str = "", no_store_index: bool = False, **options) -> UpReport:
    """O-99: upsync with places derived from the config's, then write the config."""
    if no_store_index and store_index_path:
        raise CommandError("a store index path is given together with no_store_index")
    parent, _, name = config_uri.replace("\\", "/").rpartition("/")
    parent, stem = parent or ".", name.rpartition(".")[0] or name
    storage_uri = storage_uri or f"{parent}/store"
    target_index = target_index or f"{parent}/version-data/version-index/{stem}.lvi"
    lsi = None if no_store_index else store_index_path or f"{parent}/version-data/version-store-index/{stem}.lsi"
    report = upsync(spark, source, storage_uri, target_index, store_index_path=lsi, **options)
    config = {"storage-uri": storage_uri, "source-path": target_index} | ({"version-local-store-index-path": lsi} if lsi else {})
    blobs.write_uri(config_uri, json.dumps(config, indent=2).encode())
    return report


# ---- downsync, get and cp


@dataclass
class DownReport:
    removed: int
    added: int
    modified: int
    permissions: int
    blocks: int
    bytes_written: int


def merged_version(spark: SparkSession, indexes: list[VersionIndex]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O-37 over any number of versions, later ones over earlier ones."""
    if len({(i.hash_id, i.target) for i in indexes}) > 1:
        raise CommandError("versions differ in hash or target chunk size")
    assets, chunks, unique = version_tables(spark, indexes[0])
    for index in indexes[1:]:
        more, more_chunks, _ = version_tables(spark, index)
        merged = stores.merge_versions(assets, more).withColumn("length", F.octet_length("path"))
        placed = cut(ordering.positions(merged.withColumnRenamed("asset_pos", "own_pos"), ["length", "union_side", "union_pos"], "asset_pos"))
        both = chunks.withColumn("from_side", F.lit(0)).unionByName(more_chunks.withColumn("from_side", F.lit(1))).withColumnRenamed("asset_pos", "own_pos")
        chunks = cut(both.join(placed.select("own_pos", "from_side", "asset_pos"), ["own_pos", "from_side"]).select("asset_pos", "ord", "chunk_hash", "chunk_size"))
        assets = placed.select("asset_pos", "path", "is_dir", "path_hash", "content_hash", "size", "permissions", "chunk_count")
    if len(indexes) > 1:
        firsts = stores.unique_chunks(chunks)
        unique = ordering.positions(firsts, ["first_pos", "first_ord"], "chunk_pos").select("chunk_pos", "chunk_hash", "chunk_size", F.lit(0).cast("long").alias("chunk_tag"))
    return assets, chunks, unique


def _check_paths(assets: DataFrame) -> None:
    from ..functions.paths import unsafe_reason

    bad = assets.select("path", unsafe_reason(F.col("path")).alias("reason")).where("reason is not null").head()
    if bad:
        raise CommandError(f"unsafe path {bad.path!r}: {bad.reason}")


def _rebuilt(spark, store: blobs.Blobs, wanted: DataFrame, index: StoreIndex, verify: int | None) -> DataFrame:
    """(asset_pos, ord, piece) of the wanted asset chunks, from the store's blocks."""
    blocks = store_tables(spark, index)
    plan = plans.write_plan(wanted, blocks)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = hashing.hasher(verify) if verify else None
        for frame in frames:
            for block_hash, rows in frame.groupby("block_hash", sort=False):
                block = StoredBlock.decode(store.read(blobs.block_name(int(block_hash))))
                data = block.plain()
                cuts = [data[o : o + n] for o, n in zip(rows["block_offset"], rows["chunk_size"], strict=True)]
                for piece, n, h in zip(cuts, rows["chunk_size"], rows["chunk_hash"], strict=True):
                    if len(piece) != n:
                        raise codecs.FormatError(f"block {block_hash} is shorter than its index says")
                    if own and own(piece) != h:
                        raise codecs.FormatError(f"chunk {h} of block {block_hash} does not have its hash")
                yield rows[["asset_pos", "ord"]].assign(piece=cuts)

    # one task reads a block once: rows are dealt and sorted by block
    dealt = plan.repartition("block_hash").sortWithinPartitions("block_hash").select("asset_pos", "ord", "block_hash", "block_offset", "chunk_size", "chunk_hash")
    return dealt.mapInPandas(load, "asset_pos long, ord long, piece binary")


def _writer(root: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for path, pieces in zip(frame["path"], frame["pieces"], strict=True):
                where = os.path.join(root, path)
                os.makedirs(os.path.dirname(where), exist_ok=True)
                own = f"{where}.part"
                with open(own, "wb") as f:
                    n = sum(f.write(p["piece"]) for p in pieces)
                os.replace(own, where)
                done.append(n)
            yield pd.DataFrame({"bytes": done})

    return write


def downsync(spark: SparkSession, source_indexes: list[str], storage_uri: str, target: str = "", *, target_index: str | None = None, store_index_paths: list[str] | None = None, retain_permissions: bool = True, delete_removed: bool = True, validate: bool = False, verify_chunks: bool = False, include_filter: str = "", exclude_filter: str = "") -> DownReport:
    """O-100: make a folder equal to a version, fetching only the blocks with content that changes."""
    indexes = [VersionIndex.decode(blobs.read_uri(u)) for u in source_indexes]
    if not target:
        stem = source_indexes[0].replace("\\", "/").rpartition("/")[2].partition(".")[0]
        if not stem:
            raise CommandError(f"no target folder follows from {source_indexes[0]!r}")
        target = stem
    hash_id, size = indexes[0].hash_id, indexes[0].target
    assets, chunks, _ = merged_version(spark, indexes)
    _check_paths(assets)
    os.makedirs(target, exist_ok=True)
    cache = os.path.join(target, CACHE_NAME)
    if target_index:
        current = version_tables(spark, VersionIndex.decode(blobs.read_uri(target_index)))[0]
    else:
        current = scan_version(spark, target, size, 0, hash_id, include_filter, exclude_filter)[0][0]
    changes = cut(diff.ordered_diff(diff.strip_never_content(diff.version_diff(current, assets), [CACHE_NAME])))
    store = blobs.Blobs(storage_uri)
    known = blobs.merged([StoreIndex.decode(blobs.read_uri(u)) for u in store_index_paths]) if store_index_paths else blobs.read_store_index(store)[0]
    needed = covering(spark, known, diff.required_chunks(changes, chunks))
    if os.path.exists(cache):
        os.remove(cache)  # it no longer tells what is there
    rows = changes.orderBy("change", "out_ord").collect()
    by = {c: [r for r in rows if r.change == c] for c in ("removed", "added", "content", "permissions")}
    removed = _remove(target, [r.path for r in by["removed"]]) if delete_removed else 0
    for r in by["added"]:
        if r.path.endswith("/"):
            os.makedirs(os.path.join(target, r.path), exist_ok=True)
    write = assets.join(changes.where("change in ('added', 'content')").select(F.col("target_pos").alias("asset_pos")), "asset_pos", "left_semi").where("not is_dir")
    for r in write.where("size = 0").collect():
        os.makedirs(os.path.dirname(os.path.join(target, r.path)), exist_ok=True)
        open(os.path.join(target, r.path), "wb").close()
    wanted = chunks.join(write.select("asset_pos"), "asset_pos", "left_semi")
    pieces = _rebuilt(spark, store, wanted, needed, hash_id if verify_chunks else None)
    whole = pieces.groupBy("asset_pos").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("pieces")).join(assets.select("asset_pos", "path"), "asset_pos")
    done = whole.select("path", "pieces").mapInPandas(_writer(target), "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).head().n
    if retain_permissions:
        again = assets.join(changes.where("change <> 'removed'").select(F.col("target_pos").alias("asset_pos")).distinct(), "asset_pos", "left_semi")
        fresh = {r.path for r in by["added"] if r.path.endswith("/")}
        for r in again.select("path", "permissions").collect():
            if r.path not in fresh:
                os.chmod(os.path.join(target, r.path), r.permissions & 0o777)
    if validate:
        found = scan_version(spark, target, size, 0, hash_id, include_filter, exclude_filter)[0][0]
        bad = diff.validate_rescan(found, assets, retain_permissions).where("problem <> 'permissions' or not path like '%/'").head()
        if bad:
            raise CommandError(f"after the sync {bad.path!r} is wrong: {bad.problem}")
    if len(indexes) == 1:
        blobs.write_uri(cache, indexes[0].encode())
    return DownReport(removed, len(by["added"]), len(by["content"]), len(by["permissions"]), len(needed.block_hashes), done)


def _remove(root: str, paths: list[str]) -> int:
    """Longest first, so files go before their folders; folders that still hold something wait for another round."""
    left, count = paths, 0
    for _ in range(10):
        again = []
        for path in left:
            where = os.path.join(root, path)
            try:
                os.rmdir(where) if path.endswith("/") else os.remove(where)
                count += 1
            except FileNotFoundError:
                count += 1
            except OSError:
                again.append(path)
        left = again
        if not left:
            break
    return count


def get(spark: SparkSession, config_uris: list[str], target: str = "", **options) -> DownReport:
    """O-101: downsync by config files; all must name one store, and one without a store index drops them all."""
    found = [json.loads(blobs.read_uri(u)) for u in config_uris]
    for c in found:
        for key in ("storage-uri", "source-path"):
            if key not in c:
                raise CommandError(f"get-config without {key}")
    if len({c["storage-uri"] for c in found}) != 1:
        raise CommandError("get-configs name different stores")
    lsi = [c.get("version-local-store-index-path") for c in found]
    return downsync(spark, [c["source-path"] for c in found], found[0]["storage-uri"], target, store_index_paths=lsi if all(lsi) else None, **options)


def cp(spark: SparkSession, storage_uri: str, index_uri: str, source_path: str, target_path: str) -> int:
    """O-110: one asset of a version, written to a file."""
    assets, chunks, _ = version_tables(spark, VersionIndex.decode(blobs.read_uri(index_uri)))
    found = inspect.find_asset(assets, source_path).head()
    if found is None:
        raise CommandError(f"no asset {source_path!r}")
    store = blobs.Blobs(storage_uri)
    rows = _rebuilt(spark, store, chunks.where(F.col("asset_pos") == found.asset_pos), blobs.read_store_index(store)[0], None)
    data = b"".join(bytes(r.piece) for r in rows.orderBy("ord").collect())
    blobs.write_uri(target_path, data)
    return len(data)


# ---- inspection


def print_version(spark: SparkSession, index_uri: str) -> DataFrame:
    """O-102: a version's counts and sizes."""
    index = VersionIndex.decode(blobs.read_uri(index_uri))
    assets, _, unique = version_tables(spark, index)
    return inspect.version_summary(assets, unique).withColumn("hash", hashing.identifier_string(F.lit(index.hash_id))).withColumn("target", F.lit(index.target))


def print_store(spark: SparkSession, storage_uri: str) -> DataFrame:
    """O-102: a store's counts and sizes."""
    return inspect.store_summary(store_tables(spark, blobs.read_store_index(blobs.Blobs(storage_uri))[0]))


def ls(spark: SparkSession, index_uri: str, prefix: str = "") -> DataFrame:
    return inspect.list_level(version_tables(spark, VersionIndex.decode(blobs.read_uri(index_uri)))[0], prefix).orderBy("asset_pos")


def dump_version_assets(spark: SparkSession, index_uri: str) -> DataFrame:
    return inspect.dump_assets(version_tables(spark, VersionIndex.decode(blobs.read_uri(index_uri)))[0]).orderBy("asset_pos")


def validate_version(spark: SparkSession, storage_uri: str, index_uri: str) -> str:
    """O-103: 'ok', or what the store lacks for the version."""
    assets, chunks, unique = version_tables(spark, VersionIndex.decode(blobs.read_uri(index_uri)))
    cover = covering(spark, blobs.read_store_index(blobs.Blobs(storage_uri))[0], unique)
    return inspect.store_covers(assets, chunks, store_tables(spark, cover)).head().verdict


def print_version_usage(spark: SparkSession, storage_uri: str, index_uri: str) -> DataFrame:
    """O-104."""
    _, chunks, unique = version_tables(spark, VersionIndex.decode(blobs.read_uri(index_uri)))
    return inspect.fragmentation(chunks, store_tables(spark, covering(spark, blobs.read_store_index(blobs.Blobs(storage_uri))[0], unique)))


def create_version_store_index(spark: SparkSession, storage_uri: str, index_uri: str, target: str) -> int:
    """O-105: write the part of the store index that a version needs; returns its number of blocks."""
    _, _, unique = version_tables(spark, VersionIndex.decode(blobs.read_uri(index_uri)))
    cover = covering(spark, blobs.read_store_index(blobs.Blobs(storage_uri))[0], unique)
    blobs.write_uri(target, cover.encode())
    return len(cover.block_hashes)


# ---- store maintenance


def init_remote_store(spark: SparkSession, storage_uri: str) -> int:
    """O-106, O-50: rebuild the store index from the block files; files that are not what their name says are left out."""
    store = blobs.Blobs(storage_uri)
    names = [n for n, _ in store.list("chunks/") if n.endswith(".lsb")]
    if not names:
        return 0

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name in frame["name"]:
                try:
                    index = StoredBlock.decode(store.read(name)).index
                except codecs.FormatError:
                    continue
                if blobs.block_name(index.block_hash) == name:
                    out.append(index.encode())
            yield pd.DataFrame({"index": out})

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition("name")
    found = [BlockIndex.decode_prefix(bytes(r[0]))[0] for r in listed.mapInPandas(load, "index binary").collect()]
    found.sort(key=lambda b: b.block_hash & 0xFFFFFFFFFFFFFFFF)
    index, shards = blobs.read_store_index(store)
    blobs.write_store_index(store, blobs.merged([StoreIndex.of_blocks(found), index]), shards)
    return len(found)


@dataclass
class PruneReport:
    kept: int
    dropped: int
    deleted: int


def prune_store(spark: SparkSession, storage_uri: str, index_uris: list[str], *, store_index_paths: list[str] | None = None, dry_run: bool = False, allow_empty: bool = False, validate: bool = True, skip_invalid: bool = False) -> PruneReport:
    """O-107: keep the blocks that the given versions need. The index is written before blocks are deleted, so a
    crash leaves blocks that no index names, never the reverse."""
    store = blobs.Blobs(storage_uri)
    index, shards = blobs.read_store_index(store)
    if store_index_paths and len(store_index_paths) != len(index_uris):
        raise CommandError("one store index per version is needed")
    keep: set[int] = set()
    for i, uri in enumerate(index_uris):
        assets, chunks, unique = version_tables(spark, VersionIndex.decode(blobs.read_uri(uri)))
        cover = StoreIndex.decode(blobs.read_uri(store_index_paths[i])) if store_index_paths else covering(spark, index, unique)
        verdict = inspect.store_covers(assets, chunks, store_tables(spark, cover)).head().verdict if validate or store_index_paths else "ok"
        if verdict != "ok":
            if store_index_paths or not skip_invalid:
                raise CommandError(f"{uri}: {verdict}")
            continue
        keep |= {int(h) for h in cover.block_hashes}
    if not keep and not allow_empty and len(index.block_hashes):
        raise CommandError("nothing would be kept; this must be allowed explicitly")
    kept = StoreIndex.of_blocks([b for b in index.blocks() if b.block_hash in keep])
    kept.hash_id = index.hash_id
    report = PruneReport(len(kept.block_hashes), len(index.block_hashes) - len(kept.block_hashes), 0)
    if dry_run:
        return report
    blobs.write_store_index(store, kept, shards)
    report.deleted = prune_store_blocks(spark, storage_uri)
    return report


def prune_store_index(index_uri: str, keep: set[int], target: str) -> int:
    """O-38 on an index file."""
    index = StoreIndex.decode(blobs.read_uri(index_uri))
    kept = StoreIndex.of_blocks([b for b in index.blocks() if b.block_hash in keep])
    kept.hash_id = index.hash_id
    blobs.write_uri(target, kept.encode())
    return len(kept.block_hashes)


def prune_store_blocks(spark: SparkSession, storage_uri: str, dry_run: bool = False) -> int:
    """O-45: delete block files that the store index does not name."""
    store = blobs.Blobs(storage_uri)
    known = {blobs.block_name(int(h)) for h in blobs.read_store_index(store)[0].block_hashes}
    orphans = [n for n, _ in store.list("chunks/") if n.endswith(".lsb") and n not in known]
    if not dry_run:
        for name in orphans:
            store.delete(name)
    return len(orphans)


def clone_store(spark: SparkSession, source_uri: str, target_uri: str, index_uris: list[str], target_index_uris: list[str], work_folder: str, **options) -> int:
    """O-108: bring versions to another store through a work folder; versions that are covered there are skipped."""
    copied = 0
    for source, target in zip(index_uris, target_index_uris, strict=True):
        index = VersionIndex.decode(blobs.read_uri(source))
        if validate_version(spark, target_uri, source) != "ok":
            downsync(spark, [source], source_uri, work_folder)
            name = {v: k for k, v in hashing.NAMES.items()}[index.hash_id]
            upsync(spark, work_folder, target_uri, target, target_chunk_size=index.target, hash_name=name, **options)
            copied += 1
        blobs.write_uri(target, index.encode())
    return copied
