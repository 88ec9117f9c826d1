"""Path filters (O-19, O-20)."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import is_never_content


def split_patterns(text: str) -> list[str]:
    """O-20: patterns between ``**``; a backslash keeps the star after it from counting."""
    cuts = [m.span() for m in re.finditer(r"(?s)\\+.?|\*\*", text) if m[0] == "**"]
    edges = [0, *(x for span in cuts for x in span), len(text)]
    out = [text[low:high] for low, high in zip(edges[::2], edges[1::2], strict=True)]
    if not out[-1]:
        out.pop()
    for pattern in out:
        re.compile(pattern)
    return out


def include(path: Column, is_dir: Column, include_filter: str = "", exclude_filter: str = "", never: list[str] | None = None) -> Column:
    """O-19: unanchored matches, exclusion wins, no include patterns include all; directories are also tried with a slash."""
    hit = lambda p: path.rlike(p) | (is_dir & F.concat(path, F.lit("/")).rlike(p))
    any_of = lambda patterns, empty: reduce(or_, map(hit, patterns)) if patterns else F.lit(empty)
    wanted = any_of(split_patterns(include_filter), True) & ~any_of(split_patterns(exclude_filter), False)
    return wanted & ~is_never_content(path, never or [])
