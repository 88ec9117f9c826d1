"""Hashes, paths, formatting, filters and codecs against known answers and plain Python."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwell.functions import filters, formatting, hashing, paths
from chunkwell.operators import chunking, packing
from chunkwell.sources import codecs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_blake3_known_answers():
    # published test vectors: input bytes count up modulo 251
    data = lambda n: bytes(i % 251 for i in range(n))
    assert hashing.blake3_digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3_digest(data(1)).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert hashing.blake3_digest(data(1024)).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert hashing.blake3_digest(data(1025)).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


def test_blake2s_and_registry():
    assert hashing.blake2s(b"abc") == int.from_bytes(hashlib.blake2s(b"abc", digest_size=8).digest(), "little", signed=True)
    with pytest.raises(NotImplementedError):
        hashing.hasher(hashing.MEOW_ID)
    with pytest.raises(ValueError):
        hashing.hasher(1)
    with pytest.raises(ValueError):
        hashing.identifier_for_name("md5")


def test_unsigned_order(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 5, -1, -(1 << 63), (1 << 63) - 1)], "h long")
    assert [r.h for r in rows.orderBy(hashing.unsigned_order(F.col("h"))).collect()] == [0, 5, (1 << 63) - 1, -(1 << 63), -1]


def test_paths(spark):
    assert one(spark, paths.block_path(F.lit(-1))) == "chunks/ffff/0xffffffffffffffff.lsb"
    assert one(spark, paths.parse_block_hash(F.lit("chunks/ffff/0xffffffffffffffff.lsb"))) == -1
    assert one(spark, paths.parse_block_hash(F.lit("chunks/ffff/0xff.lrb"))) is None
    assert [one(spark, paths.derive_target_path(F.lit(p))) for p in ("a/b.c.lvi", "x", ".lvi", "a\\b.lvi")] == ["b", "x", None, "b"]
    assert [one(spark, c) for c in paths.split_parent(F.lit("name"))] == [".", "name"]
    assert [one(spark, c) for c in paths.split_parent(F.lit("a\\b/c"))] == ["a\\b", "c"]
    assert one(spark, paths.unsafe_reason(F.lit("a/NUL.txt"), windows=True)) == "reserved name"
    assert one(spark, paths.unsafe_reason(F.lit("a/NUL.txt"))) is None
    assert [paths.parse_size(s) for s in ("17", "2GiB", "500MB", "1.5k")] == [17, 2 << 30, 500_000_000, 1500]
    with pytest.raises(ValueError):
        paths.parse_size("many")


def test_formatting(spark):
    assert one(spark, formatting.details(F.lit("d/"), F.lit(123456), F.lit(0o751), F.lit(True), 4)) == "drwxr-x--x 123456 d"
    assert [one(spark, formatting.bytes_decimal(F.lit(n).cast("long"))) for n in (999, 1000, 1_500_000)] == ["999", "1.0 k", "1.5 M"]
    assert [one(spark, formatting.bytes_binary(F.lit(n).cast("long"))) for n in (1023, 1024, 3 << 30)] == ["1023 B", "1.0 KB", "3.0 GB"]
    assert one(spark, formatting.windows_mode(F.lit(True), F.lit(False))) == 0o777


def test_pattern_splitting():
    assert filters.split_patterns("a**b") == ["a", "b"]
    assert filters.split_patterns(r"a\**b") == [r"a\**b"]
    assert filters.split_patterns("a*b**") == ["a*b"]
    assert filters.split_patterns(r"\**x**y") == [r"\**x", "y"]
    with pytest.raises(Exception):
        filters.split_patterns("(")


def test_filters(spark):
    rows = spark.createDataFrame([("a", True), ("a/b.txt", False), ("c.TXT", False), ("idx", False)], "path string, is_dir boolean")
    keep = lambda **k: [r.path for r in rows.where(filters.include(F.col("path"), F.col("is_dir"), **k)).collect()]
    assert keep() == ["a", "a/b.txt", "c.TXT", "idx"]
    assert keep(include_filter="^a/") == ["a", "a/b.txt"]
    assert keep(include_filter="^a", exclude_filter="b") == ["a"]
    assert keep(never=["IDX"]) == ["a", "a/b.txt", "c.TXT"]


# ---- codecs


def random_version(r):
    a, c = r.randint(0, 6), r.randint(0, 8)
    counts = [r.randint(0, 4) if c else 0 for _ in range(a)]
    while sum(counts) < c and a:
        counts[0] += 1
    if not a:
        c = 0
    names = [f"dir{i}/é{i}" + "/" * (i % 2) for i in range(a)]
    blob = [n.encode() + b"\0" for n in names]
    big = lambda n, k="<i8": np.array([r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(n)], dtype=k)
    return codecs.VersionIndex(7, 9, big(a), big(a), np.arange(a).astype("<u8"), np.array(counts, "<u4"), np.array([sum(counts[:i]) for i in range(a)], "<u4"), np.array([r.randrange(c) for _ in range(sum(counts))], "<u4"), big(c), np.arange(c).astype("<u4"), np.arange(c).astype("<u4"), np.array([sum(map(len, blob[:i])) for i in range(a)], "<u4"), np.arange(a).astype("<u2"), b"".join(blob)), names


def test_version_index_round_trip_and_truncation():
    r = random.Random(1)
    for _ in range(60):
        index, names = random_version(r)
        data = index.encode()
        again = codecs.VersionIndex.decode(data)
        assert again.encode() == data and [again.path(i) for i in range(len(names))] == names
        assert [again.is_dir(i) for i in range(len(names))] == [n.endswith("/") for n in names]
        for n in range(0, len(data) - len(index.names), 7):
            with pytest.raises(codecs.FormatError):
                codecs.VersionIndex.decode(data[:n])
    with pytest.raises(codecs.FormatError):
        codecs.VersionIndex.decode(b"\3\0\0\0" + data[4:])


def block(r, tag=0):
    sizes = [r.randint(1, 50) for _ in range(r.randint(1, 5))]
    raw = bytes(r.randrange(4) for _ in range(sum(sizes)))
    index = codecs.BlockIndex(r.randint(-(1 << 63), (1 << 63) - 1), 3, tag, np.arange(len(sizes)).astype("<i8"), np.array(sizes, "<u4"))
    return codecs.StoredBlock(index, codecs.encode_payload(tag, raw)), raw


def test_blocks_and_stores_round_trip():
    r = random.Random(2)
    blocks = []
    for tag in (0, *codecs.ZSTD_LEVELS):
        stored, raw = block(r, tag)
        again = codecs.StoredBlock.decode(stored.encode())
        assert again.plain()[: len(raw)] == raw and again.encode() == stored.encode()
        blocks.append(stored.index)
    store = codecs.StoreIndex.of_blocks(blocks)
    data = store.encode()
    assert codecs.StoreIndex.decode(data).encode() == data
    assert [b.block_hash for b in codecs.StoreIndex.decode(data).blocks()] == [b.block_hash for b in blocks]
    for bad in (data + b"\0", data[:-1], b"\0" * 16):
        with pytest.raises(codecs.FormatError):
            codecs.StoreIndex.decode(bad)


def test_payload_errors():
    framed = codecs.encode_payload(0x7A746432, b"x" * 100)
    with pytest.raises(codecs.FormatError):
        codecs.decode_payload(0x7A746432, framed, 99)
    with pytest.raises(codecs.FormatError):
        codecs.decode_payload(0x7A746432, framed + b"!", 100)
    with pytest.raises(codecs.FormatError):
        codecs.decode_payload(0x7A746432, framed[:5], 100)
    with pytest.raises(codecs.FormatError):
        codecs.decode_payload(0x7A746432, framed[:8] + b"\0" * (len(framed) - 8), 100)
    with pytest.raises(codecs.FormatError):
        codecs.codec_of(0x12345678)
    with pytest.raises(NotImplementedError):
        codecs.encode_payload(codecs.LZ4_ID, b"x")


# ---- chunking and packing


def stepwise(data, sizes, table, d):
    """The chunker a byte at a time."""
    turn = lambda x, k: ((x << k) | (x >> (32 - k))) & 0xFFFFFFFF if k else x
    out, at = [], 0
    while at < len(data):
        left = len(data) - at
        size = left
        if left > sizes.least:
            size = min(left, sizes.largest)
            for p in range(sizes.least + 1, size + 1):
                h = 0
                for k in range(chunking.WINDOW):
                    h ^= turn(int(table[data[at + p - 1 - k]]), k % 32)
                if h % d == d - 1:
                    size = p
                    break
        out.append((at, size))
        at += size
    return out


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1200), st.sampled_from([1, 24, 96, 128, 200]))
def test_chunker_is_the_rolling_hash(data, target):
    sizes, table = chunking.Sizes.for_target(target), chunking.default_table()
    found = chunking.spans(data, sizes, table)
    assert found == stepwise(data, sizes, table, chunking.discriminator(sizes.average))
    assert b"".join(data[a : a + n] for a, n in found) == data
    buffered = chunking.spans(data, sizes, table, "buffer")
    assert [a for a, _ in buffered] == [sum(n for _, n in buffered[:i]) for i in range(len(buffered))] and sum(n for _, n in buffered) == len(data)


def test_discriminators_and_sizes():
    assert [chunking.discriminator(max(48, t // 2)) for t in (1024, 32768, 131072, 1048576)] == [384, 12318, 49535, 416942]
    for bad in ((47, 48, 49), (48, 47, 49), (48, 48, 47), (48, chunking.AVERAGE_CEILING + 1, chunking.AVERAGE_CEILING + 1)):
        with pytest.raises(ValueError):
            chunking.Sizes(*bad)


def greedy(sizes, tags, limit, most):
    out, b, n, used = [], -1, 0, 0
    for i, (s, t) in enumerate(zip(sizes, tags, strict=True)):
        if i == 0 or t != tags[i - 1] or n == most or used + s > limit:
            b, n, used = b + 1, 0, 0
        out.append(b)
        n, used = n + 1, used + s
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 7), st.lists(st.integers(0, 60), max_size=6))
def test_packing_in_parts_is_greedy(sizes, most, cuts):
    out, state = [], (0, 0, 0)
    edges = sorted({0, len(sizes), *(min(c, len(sizes)) for c in cuts)})
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        blocks, _, state = packing.pack_run(np.array(sizes[low:high]), 110, most, *state)
        out += blocks.tolist()
    assert out == greedy(sizes, [0] * len(sizes), 110, most)


def test_pack_over_tags(spark):
    r = random.Random(3)
    rows = [(i, i, r.randint(1, 50), r.choice([1, 1, 1, 2])) for i in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, "pos long, chunk_hash long, chunk_size long, chunk_tag long"), 100, 5).orderBy("pos").collect()
    names = {}
    got = [names.setdefault((x.run, x.block), len(names)) for x in packed]
    assert got == greedy([x[2] for x in rows], [x[3] for x in rows], 110, 5)
