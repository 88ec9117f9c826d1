"""Display functions (O-77, O-78, O-81, O-82)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def permission_string(permissions: Column, is_dir: Column) -> Column:
    bits = [F.when(permissions.bitwiseAND(1 << (8 - i)) != 0, F.lit("rwx"[i % 3])).otherwise(F.lit("-")) for i in range(9)]
    return F.concat(F.when(is_dir, F.lit("d")).otherwise(F.lit("-")), *bits)


def padded(value: Column, width) -> Column:
    """Right-aligned; longer texts stay whole."""
    text = value.cast("string")
    width = width if isinstance(width, Column) else F.lit(width)
    return F.when(F.length(text) < width, F.lpad(text, width, F.lit(" "))).otherwise(text)


def details(name: Column, size: Column, permissions: Column, is_dir: Column, width) -> Column:
    """O-77: one line of a listing."""
    return F.concat_ws(" ", permission_string(permissions, is_dir), padded(size, width), F.regexp_replace(name, "/+$", ""))


def _scaled(n: Column, unit: int, suffixes: list[str], plain: Column) -> Column:
    out = plain
    for i, suffix in enumerate(suffixes, 1):
        out = F.when(n >= unit**i, F.concat(F.format_string("%.1f ", n.cast("double") / float(unit**i)), F.lit(suffix))).otherwise(out)
    return out


def bytes_decimal(n: Column) -> Column:
    return _scaled(n, 1000, ["k", "M", "G", "T", "P", "E"], n.cast("string"))


def bytes_binary(n: Column) -> Column:
    return _scaled(n, 1024, ["KB", "MB", "GB", "TB", "PB", "EB"], F.concat(n.cast("string"), F.lit(" B")))


def permissions_disagree(found: Column, recorded: Column, windows: bool = False) -> Column:
    """O-81: Windows keeps only whether anyone may write."""
    if windows:
        return (found.bitwiseAND(0o222) != 0) != (recorded.bitwiseAND(0o222) != 0)
    return found != recorded


def windows_mode(is_dir: Column, read_only: Column) -> Column:
    """O-82: the mode that stands for a Windows file's attributes."""
    return (F.lit(0o444) + F.when(is_dir, 0o111).otherwise(0) + F.when(read_only, 0).otherwise(0o222)).cast("int")
