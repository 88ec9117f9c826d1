"""Blob folders by URI, and the store layout on them (O-10 to O-12, O-15, O-44, O-50)."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

from .codecs import BlockIndex, FormatError, StoredBlock, StoreIndex

LOCK_SUFFIX = "._lck"


@dataclass(frozen=True)
class Blobs:
    """Objects under a root. Picklable; each process opens its own file system. Writes appear whole or not at all."""

    uri: str

    def _open(self):
        from pyarrow import fs

        scheme = self.uri.partition("://")[0] if "://" in self.uri else ""
        if scheme in ("gs", "abfs", "abfss"):
            raise NotImplementedError(f"{scheme}:// stores are not supported")
        if scheme in ("", "file", "fsblob") or len(scheme) == 1:
            path = self.uri.removeprefix("file://").removeprefix("fsblob://")
            return fs.LocalFileSystem(), os.path.abspath(path)
        return fs.FileSystem.from_uri(self.uri)

    def list(self, prefix: str = "") -> list[tuple[str, int]]:
        """(name, bytes) of the objects whose name starts with prefix; lock files are hidden, no root is no objects."""
        from pyarrow import fs

        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = ((i.path[len(root) :].lstrip("/"), i.size) for i in found if i.type == fs.FileType.File)
        return sorted((n, s) for n, s in names if n.startswith(prefix) and not n.endswith(LOCK_SUFFIX))

    def exists(self, name: str) -> bool:
        from pyarrow import fs

        system, root = self._open()
        return system.get_file_info(f"{root}/{name}").type == fs.FileType.File

    def read(self, name: str) -> bytes:
        system, root = self._open()
        with system.open_input_stream(f"{root}/{name}", compression=None) as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        system, root = self._open()
        system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        own = f"{root}/{name}.{uuid.uuid4().hex[:16]}"
        with system.open_output_stream(own, compression=None) as f:
            f.write(data)
        system.move(own, f"{root}/{name}")

    def delete(self, name: str) -> None:
        system, root = self._open()
        system.delete_file(f"{root}/{name}")


def split_uri(uri: str) -> tuple[Blobs, str]:
    parent, _, name = uri.replace("\\", "/").rpartition("/")
    return Blobs(parent or "."), name


def read_uri(uri: str) -> bytes:
    blobs, name = split_uri(uri)
    return blobs.read(name)


def write_uri(uri: str, data: bytes) -> None:
    blobs, name = split_uri(uri)
    blobs.write(name, data)


def block_name(block_hash: int) -> str:
    digits = f"{block_hash & 0xFFFFFFFFFFFFFFFF:016x}"
    return f"chunks/{digits[:4]}/0x{digits}.lsb"


def put_block(store: Blobs, block: StoredBlock) -> bool:
    """O-15: write a block unless it is there; tells whether it was written."""
    name = block_name(block.index.block_hash)
    if store.exists(name):
        return False
    store.write(name, block.encode())
    return True


def shard_names(store: Blobs) -> list[str]:
    return [n for n, size in store.list("store") if n.endswith(".lsi") and size > 0 and "/" not in n]


def merged(indexes: list[StoreIndex]) -> StoreIndex:
    """O-34 on index files: earlier files win whole blocks; two different hash ids are an error."""
    ids = {i.hash_id for i in indexes if len(i.block_hashes)}
    if len(ids) > 1:
        raise FormatError("stores use different hashes")
    seen: dict[int, BlockIndex] = {}
    for index in indexes:
        for block in index.blocks():
            seen.setdefault(block.block_hash, block)
    return StoreIndex.of_blocks(list(seen.values()))


def read_store_index(store: Blobs) -> tuple[StoreIndex, list[str]]:
    """O-44: all shards, merged in the order of their names, and those names; a shard that vanishes starts it over."""
    while True:
        names = shard_names(store)
        try:
            return merged([StoreIndex.decode(store.read(n)) for n in names]), names
        except FileNotFoundError:
            continue


def add_to_store_index(store: Blobs, blocks: list[BlockIndex]) -> None:
    """Publish blocks: one new shard holds all that was read and the new ones; the shards that were read go."""
    index, names = read_store_index(store)
    write_store_index(store, merged([index, StoreIndex.of_blocks(blocks)]), names)


def write_store_index(store: Blobs, index: StoreIndex, replaces: list[str]) -> None:
    data = index.encode()
    name = f"store_{hashlib.sha256(data).hexdigest()}.lsi"
    store.write(name, data)
    for old in replaces:
        if old != name:
            store.delete(old)
