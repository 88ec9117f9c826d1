"""Binary index files and blocks (O-03 to O-08, O-83): little-endian, packed, arrays one after the other."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import zstandard

# Fixed values of the file formats.
VERSION_INDEX = 0x00000002
STORE_INDEX = 0x01000000
NO_COMPRESSION = 0
ZSTD_FAMILY, BROTLI_FAMILY, LZ4_ID = 0x7A746400, 0x62746C00, 0x6C7A3432
FAMILY_MASK = 0xFFFFFF00
ZSTD_LEVELS = {0x7A746431: 0, 0x7A746432: 3, 0x7A746433: 22, 0x7A746434: 8, 0x7A746435: 22}
TAG_BY_NAME = {
    "none": 0,
    "lz4": LZ4_ID,
    "zstd": 0x7A746432,
    "zstd_min": 0x7A746431,
    "zstd_max": 0x7A746433,
    "zstd_high": 0x7A746433,
    "zstd_low": 0x7A746433,
    "brotli": 0x62746C31,
    "brotli_min": 0x62746C30,
    "brotli_max": 0x62746C32,
    "brotli_text": 0x62746C62,
    "brotli_text_min": 0x62746C61,
    "brotli_text_max": 0x62746C63,
}


class FormatError(ValueError):
    """Bytes that are not what their header says."""


def _array(kind: str, n: int):
    return field(default_factory=lambda: np.zeros(n, dtype=kind))


class _Layout:
    """Reads and writes a run of fixed arrays; the lengths come from the header."""

    @staticmethod
    def read(data: bytes, at: int, parts: list[tuple[str, str, int]]) -> tuple[dict, int]:
        out = {}
        for name, kind, n in parts:
            end = at + n * np.dtype(kind).itemsize
            if end > len(data):
                raise FormatError(f"{name} needs {end} bytes of {len(data)}")
            out[name] = np.frombuffer(data, dtype=kind, count=n, offset=at).copy()
            at = end
        return out, at

    @staticmethod
    def write(value, parts: list[tuple[str, str, int]]) -> bytes:
        return b"".join(np.ascontiguousarray(getattr(value, name), dtype=kind).tobytes() for name, kind, _ in parts)


def _header(data: bytes, n: int) -> tuple[int, ...]:
    if len(data) < 4 * n:
        raise FormatError("header is cut short")
    return struct.unpack_from(f"<{n}I", data)


@dataclass
class VersionIndex:
    hash_id: int = 0
    target: int = 0
    path_hashes: np.ndarray = _array("<i8", 0)
    content_hashes: np.ndarray = _array("<i8", 0)
    sizes: np.ndarray = _array("<u8", 0)
    chunk_counts: np.ndarray = _array("<u4", 0)
    chunk_starts: np.ndarray = _array("<u4", 0)
    chunk_indexes: np.ndarray = _array("<u4", 0)
    chunk_hashes: np.ndarray = _array("<i8", 0)
    chunk_sizes: np.ndarray = _array("<u4", 0)
    chunk_tags: np.ndarray = _array("<u4", 0)
    name_offsets: np.ndarray = _array("<u4", 0)
    permissions: np.ndarray = _array("<u2", 0)
    names: bytes = b""

    @staticmethod
    def _parts(a: int, c: int, m: int) -> list[tuple[str, str, int]]:
        return [
            ("path_hashes", "<i8", a),
            ("content_hashes", "<i8", a),
            ("sizes", "<u8", a),
            ("chunk_counts", "<u4", a),
            ("chunk_starts", "<u4", a),
            ("chunk_indexes", "<u4", m),
            ("chunk_hashes", "<i8", c),
            ("chunk_sizes", "<u4", c),
            ("chunk_tags", "<u4", c),
            ("name_offsets", "<u4", a),
            ("permissions", "<u2", a),
        ]

    @classmethod
    def decode(cls, data: bytes) -> VersionIndex:
        version, hash_id, target, a, c, m = _header(data, 6)
        if version != VERSION_INDEX:
            raise FormatError(f"version index of format {version:#x}")
        if m < c:
            raise FormatError("fewer chunk references than chunks")
        arrays, at = _Layout.read(data, 24, cls._parts(a, c, m))
        out = cls(hash_id, target, **arrays, names=data[at:])
        ends = out.chunk_starts.astype(np.int64) + out.chunk_counts
        if len(ends) and int(ends.max()) > m:
            raise FormatError("an asset's chunks lie outside the map")
        if m and int(out.chunk_indexes.max()) >= c:
            raise FormatError("a chunk reference is outside the chunks")
        return out

    def encode(self) -> bytes:
        a, c, m = len(self.path_hashes), len(self.chunk_hashes), len(self.chunk_indexes)
        return struct.pack("<6I", VERSION_INDEX, self.hash_id, self.target, a, c, m) + _Layout.write(self, self._parts(a, c, m)) + self.names

    def path_bytes(self, i: int) -> bytes:
        if not 0 <= i < len(self.name_offsets):
            raise FormatError(f"no asset {i}")
        at = int(self.name_offsets[i])
        if at >= len(self.names):
            raise FormatError(f"name of asset {i} is outside the names")
        end = self.names.find(b"\0", at)
        if end < 0:
            raise FormatError(f"name of asset {i} does not end")
        return self.names[at:end]

    def path(self, i: int) -> str:
        try:
            return self.path_bytes(i).decode()
        except UnicodeDecodeError as e:
            raise FormatError(f"name of asset {i} is not UTF-8") from e

    def is_dir(self, i: int) -> bool:
        return self.path_bytes(i).endswith(b"/")


@dataclass
class BlockIndex:
    block_hash: int
    hash_id: int
    tag: int
    chunk_hashes: np.ndarray
    chunk_sizes: np.ndarray

    @classmethod
    def decode_prefix(cls, data: bytes) -> tuple[BlockIndex, int]:
        if len(data) < 20:
            raise FormatError("block header is cut short")
        block_hash, hash_id, n, tag = struct.unpack_from("<q3I", data)
        arrays, at = _Layout.read(data, 20, [("chunk_hashes", "<i8", n), ("chunk_sizes", "<u4", n)])
        return cls(block_hash, hash_id, tag, **arrays), at

    def encode(self) -> bytes:
        n = len(self.chunk_hashes)
        return struct.pack("<q3I", self.block_hash, self.hash_id, n, self.tag) + _Layout.write(self, [("chunk_hashes", "<i8", n), ("chunk_sizes", "<u4", n)])

    @property
    def plain_bytes(self) -> int:
        return int(self.chunk_sizes.astype(np.int64).sum())


@dataclass
class StoredBlock:
    index: BlockIndex
    payload: bytes

    @classmethod
    def decode(cls, data: bytes) -> StoredBlock:
        index, at = BlockIndex.decode_prefix(data)
        if index.tag == 0 and len(data) - at < index.plain_bytes:
            raise FormatError("raw payload is shorter than its chunks")
        return cls(index, data[at:])

    def encode(self) -> bytes:
        return self.index.encode() + self.payload

    def plain(self) -> bytes:
        return decode_payload(self.index.tag, self.payload, self.index.plain_bytes)


@dataclass
class StoreIndex:
    hash_id: int = 0
    block_hashes: np.ndarray = _array("<i8", 0)
    chunk_hashes: np.ndarray = _array("<i8", 0)
    chunk_offsets: np.ndarray = _array("<u4", 0)
    chunk_counts: np.ndarray = _array("<u4", 0)
    block_tags: np.ndarray = _array("<u4", 0)
    chunk_sizes: np.ndarray = _array("<u4", 0)

    @staticmethod
    def _parts(b: int, c: int) -> list[tuple[str, str, int]]:
        return [("block_hashes", "<i8", b), ("chunk_hashes", "<i8", c), ("chunk_offsets", "<u4", b), ("chunk_counts", "<u4", b), ("block_tags", "<u4", b), ("chunk_sizes", "<u4", c)]

    @classmethod
    def decode(cls, data: bytes) -> StoreIndex:
        version, hash_id, b, c = _header(data, 4)
        if version != STORE_INDEX:
            raise FormatError(f"store index of format {version:#x}")
        arrays, at = _Layout.read(data, 16, cls._parts(b, c))
        if at != len(data):
            raise FormatError(f"{len(data) - at} bytes after the store index")
        return cls(hash_id, **arrays)

    def encode(self) -> bytes:
        b, c = len(self.block_hashes), len(self.chunk_hashes)
        return struct.pack("<4I", STORE_INDEX, self.hash_id, b, c) + _Layout.write(self, self._parts(b, c))

    def blocks(self) -> list[BlockIndex]:
        """O-49: blocks whose range lies inside the index; others are skipped."""
        out = []
        for i, h in enumerate(self.block_hashes):
            low = int(self.chunk_offsets[i])
            high = low + int(self.chunk_counts[i])
            if high <= min(len(self.chunk_hashes), len(self.chunk_sizes)):
                out.append(BlockIndex(int(h), self.hash_id, int(self.block_tags[i]), self.chunk_hashes[low:high], self.chunk_sizes[low:high]))
        return out

    @classmethod
    def of_blocks(cls, blocks: list[BlockIndex]) -> StoreIndex:
        if not blocks:
            return cls()
        counts = np.array([len(b.chunk_hashes) for b in blocks], dtype="<u4")
        offsets = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        return cls(
            next((b.hash_id for b in blocks if b.hash_id), 0),
            np.array([b.block_hash for b in blocks], dtype="<i8"),
            np.concatenate([b.chunk_hashes for b in blocks]),
            offsets,
            counts,
            np.array([b.tag for b in blocks], dtype="<u4"),
            np.concatenate([b.chunk_sizes for b in blocks]),
        )


def codec_of(tag: int) -> str:
    """O-08: lz4 by its exact id, zstd and brotli by family."""
    if tag == LZ4_ID:
        return "lz4"
    family = {ZSTD_FAMILY: "zstd", BROTLI_FAMILY: "brotli"}.get(tag & FAMILY_MASK)
    if family is None:
        raise FormatError(f"unknown compression {tag:#x}")
    return family


def _only_zstd(tag: int) -> None:
    if codec_of(tag) != "zstd":
        raise NotImplementedError(f"no {codec_of(tag)} codec is installed")


def encode_payload(tag: int, raw: bytes) -> bytes:
    """O-07: raw for tag 0, else plain size, packed size and the packed bytes."""
    if tag == NO_COMPRESSION:
        return raw
    _only_zstd(tag)
    packed = zstandard.ZstdCompressor(level=ZSTD_LEVELS.get(tag, 0)).compress(raw)
    return struct.pack("<2I", len(raw), len(packed)) + packed


def decode_payload(tag: int, payload: bytes, most: int) -> bytes:
    """O-07: the plain bytes; sizes are checked before and after unpacking."""
    if tag == NO_COMPRESSION:
        return payload
    _only_zstd(tag)
    if len(payload) < 8:
        raise FormatError("payload header is cut short")
    plain, packed = struct.unpack_from("<2I", payload)
    if plain > most:
        raise FormatError(f"payload declares {plain} bytes, its chunks have {most}")
    if packed != len(payload) - 8:
        raise FormatError(f"payload declares {packed} packed bytes, it has {len(payload) - 8}")
    try:
        out = zstandard.ZstdDecompressor().decompress(payload[8:], max_output_size=plain)
    except zstandard.ZstdError as e:
        raise FormatError("payload does not unpack") from e
    if len(out) != plain:
        raise FormatError(f"payload unpacks to {len(out)} bytes, not {plain}")
    return out
