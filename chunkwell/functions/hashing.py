"""Hash functions and their registry (O-61, O-70 to O-72, O-79).

Two profiles. *Exact*: 64-bit BLAKE2s (digest length 8 in the parameter block) and BLAKE3 (first 8 bytes), digests
read little-endian into signed longs. *Analytic*: the first 15 hex digits of MD5 as a positive long, available in
every SQL engine; it is a stand-in for tests and analytics, not a hash that stores use.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers of hash algorithms in index files.
BLAKE2S_ID = 0x626C6B32
BLAKE3_ID = 0x626C6B33
MEOW_ID = 0x6D656F77
NAMES = {"blake2": BLAKE2S_ID, "blake3": BLAKE3_ID, "meow": MEOW_ID}

# Fixed values of the BLAKE3 specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_M = 0xFFFFFFFF


def h60(x: Column) -> Column:
    """Analytic profile: 60-bit hash of a string or binary column."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def signed(u: int) -> int:
    """The signed long of the same bit pattern."""
    return u - (1 << 64) if u >= 1 << 63 else u


def blake2s(data: bytes) -> int:
    return struct.unpack("<q", hashlib.blake2s(data, digest_size=8).digest())[0]


def _compress(cv, block: bytes, counter: int, length: int, flags: int):
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *_IV[:4], counter & _M, counter >> 32, length, flags]

    def g(a, b, c, d, x, y):
        for r1, r2, z in ((16, 12, x), (8, 7, y)):
            v[a] = (v[a] + v[b] + z) & _M
            t = v[d] ^ v[a]
            v[d] = (t >> r1 | t << (32 - r1)) & _M
            v[c] = (v[c] + v[d]) & _M
            t = v[b] ^ v[c]
            v[b] = (t >> r2 | t << (32 - r2)) & _M

    for _ in range(7):
        for i in range(4):
            g(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            g(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[i] for i in _PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3_digest(data: bytes) -> bytes:
    """Unkeyed BLAKE3, 32 bytes; plain Python, meant for tests and small inputs."""
    chunks = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]

    def leaf(i: int, root: int):
        cv, blocks = _IV, [chunks[i][j : j + 64] for j in range(0, len(chunks[i]), 64)] or [b""]
        for k, block in enumerate(blocks):
            flags = (_CHUNK_START if k == 0 else 0) | (_CHUNK_END | root if k == len(blocks) - 1 else 0)
            cv = _compress(cv, block, i, len(block), flags)
        return cv

    def tree(low: int, high: int, root: int):
        if high - low == 1:
            return leaf(low, root)
        left = 1 << ((high - low - 1).bit_length() - 1)
        both = struct.pack("<16I", *tree(low, low + left, 0), *tree(low + left, high, 0))
        return _compress(_IV, both, 0, 64, _PARENT | root)

    return struct.pack("<8I", *tree(0, len(chunks), _ROOT))


def blake3(data: bytes) -> int:
    return struct.unpack("<q", blake3_digest(data)[:8])[0]


HASHERS = {BLAKE2S_ID: blake2s, BLAKE3_ID: blake3}


def hasher(identifier: int):
    """The hash function of an identifier; known but unsupported and unknown ones are errors of their own."""
    if identifier in HASHERS:
        return HASHERS[identifier]
    if identifier == MEOW_ID:
        raise NotImplementedError("hash 'meow' is recognised but not supported")
    raise ValueError(f"unknown hash identifier {identifier:#x}")


def identifier_for_name(name: str) -> int:
    if name not in NAMES:
        raise ValueError(f"unknown hash {name!r}")
    return NAMES[name]


def identifier_string(identifier: Column) -> Column:
    """O-79: the name of a known identifier, else its decimal text."""
    out = identifier.cast("string")
    for name, number in NAMES.items():
        out = F.when(identifier == number, F.lit(name)).otherwise(out)
    return out


def hash_udf(identifier: int = BLAKE2S_ID):
    """Vectorised hash of a binary column."""
    own = hasher(identifier)

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        return data.map(own).astype("int64")

    return run


def sequence_bytes(hashes: list[int]) -> bytes:
    """Little-endian longs one after the other: what content and block hashes are taken over."""
    return struct.pack(f"<{len(hashes)}q", *hashes)


def sequence_hash_udf(identifier: int = BLAKE2S_ID):
    """O-61: hash of an ordered array of 64-bit hashes."""
    own = hasher(identifier)

    @F.pandas_udf("long")
    def run(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: own(sequence_bytes([] if h is None else list(h)))).astype("int64")

    return run


def analytic_sequence_hash(hashes: Column) -> Column:
    """O-61 in the analytic profile: over the decimal texts, comma-joined."""
    return h60(F.array_join(F.transform(hashes, lambda x: x.cast("string")), ","))


def unsigned_order(h: Column) -> Column:
    """A long that sorts as the unsigned 64-bit value of h."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def shard_name(serialized: Column) -> Column:
    """O-72: the name of a store-index shard, from its bytes."""
    return F.concat(F.lit("store_"), F.sha2(serialized, 256), F.lit(".lsi"))
