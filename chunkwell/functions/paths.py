"""Scalar functions on paths, URIs and names (O-21, O-24, O-27, O-73 to O-76, O-80, O-84)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that Windows reserves.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
_SIZES = {"": 1, "B": 1} | {p + s: b**e for e, p in enumerate("KMGTPE", 1) for s, b in (("", 1000), ("B", 1000), ("IB", 1024))}


def hex16(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def block_path(h: Column, base: str = "chunks", extension: str = "lsb") -> Column:
    """O-73: where a block lies; caches use extension 'lrb'."""
    return F.concat(F.lit(base + "/"), F.substring(hex16(h), 1, 4), F.lit("/0x"), hex16(h), F.lit("." + extension))


def parse_block_hash(name: Column, extension: str = "lsb") -> Column:
    """O-27: the hash in a block file's name (after its last ``0x``), null for other names."""
    digits = F.regexp_extract(name, rf"^(?s).*0x([0-9a-fA-F]{{1,16}})\.{re.escape(extension)}$", 1)
    value = F.conv(digits, 16, -10)
    return F.when(digits != "", value.cast("long"))


def strip_trailing_slash(p: Column) -> Column:
    """O-74: one slash at most."""
    return F.regexp_replace(p, "/$", "")


def trim_trailing_slashes(p: Column) -> Column:
    """O-74: all of them."""
    return F.regexp_replace(p, "/+$", "")


def derive_target_path(source: Column) -> Column:
    """O-75: last segment up to its first dot; null where that is empty (an error for commands)."""
    stem = F.substring_index(F.substring_index(F.replace(source, F.lit("\\"), F.lit("/")), "/", -1), ".", 1)
    return F.when(stem != "", stem)


def split_parent(uri: Column) -> tuple[Column, Column]:
    """O-76: cut at the last slash or backslash; the parent of a bare name is '.'."""
    has = uri.rlike(r"[/\\]")
    parent = F.when(has, F.regexp_extract(uri, r"(?s)^(.*)[/\\][^/\\]*$", 1)).otherwise(F.lit("."))
    return parent, F.regexp_extract(uri, r"(?s)([^/\\]*)$", 1)


def strip_extension(name: Column) -> Column:
    """O-76: drop from the last dot on."""
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def scheme_of(uri: Column) -> Column:
    """O-84: the scheme, null if there is none."""
    found = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.when(found != "", found)


def normalized(path: Column) -> Column:
    """O-84: backslashes as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def backend(uri: Column) -> Column:
    """O-09: fs, s3, unsupported or an error text; a one-letter scheme is a drive."""
    scheme = F.lower(scheme_of(uri))
    return (
        F.when(scheme.isNull() | scheme.isin("file", "fsblob") | (F.length(scheme) == 1), "fs")
        .when(scheme == "s3", "s3")
        .when(scheme.isin("gs", "abfs", "abfss"), "unsupported")
        .otherwise("unknown")
    )


def is_never_content(path: Column, never: list[str]) -> Column:
    """O-21: equality without regard to ASCII case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = {n.translate(str.maketrans(upper, lower)) for n in never}
    return F.translate(path, upper, lower).isin(*sorted(folded)) if folded else F.lit(False)


def unsafe_reason(path: Column, windows: bool = False) -> Column:
    """O-24: why a path must not be joined to a root; null if it may."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    out = F.when(path.startswith("/"), "absolute").when(F.exists(parts, lambda x: x == ".."), "parent").when(F.size(parts) == 0, "root itself")
    if windows:
        stem = lambda x: F.upper(F.substring_index(x, ".", 1))
        bad = lambda x: x.contains(":") | x.rlike(r"[. ]$") | stem(x).isin(*RESERVED)
        out = out.when(path.rlike(r"^([A-Za-z]:|\\)"), "drive or UNC").when(F.exists(parts, bad), "reserved name")
    return out


def parse_size(text: str) -> int:
    """O-80: '2GiB', '500MB', '1.5k' or a bare count, in bytes."""
    found = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*", text)
    if not found or found[2].upper() not in _SIZES:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * _SIZES[found[2].upper()]) if "." in found[1] else int(found[1]) * _SIZES[found[2].upper()]
