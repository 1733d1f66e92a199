"""Byte-bounded text, evidence samples and visible escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(part: Column) -> Column:
    return F.try_validate_utf8(part.cast("string"))


def head_bytes(text: Column, size: Column | int) -> Column:
    """The longest prefix of at most ``size`` bytes that ends on a character boundary."""
    raw, size = text.cast("binary"), F.lit(size) if isinstance(size, int) else size
    cut = lambda k: _whole(F.substring(raw, F.lit(1), F.greatest(size - k, F.lit(0)).cast("int")))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*(cut(k) for k in range(4)), F.lit("")))


def tail_bytes(text: Column, size: int) -> Column:
    """The longest suffix of at most ``size`` bytes that begins on a character boundary."""
    raw, n = text.cast("binary"), F.octet_length(text)
    cut = lambda k: _whole(F.substring(raw, (n - F.lit(size - k) + 1).cast("int"), F.lit(max(size - k, 0))))
    return F.when(n <= size, text).otherwise(F.coalesce(*(cut(k) for k in range(4) if size - k > 0), F.lit("")))


def line_count(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def capture(text: Column, size: int) -> Column:
    """struct(text, original_bytes, original_lines, truncated): both ends of a long text, the larger half first."""
    tail = size // 2
    ends = F.concat(head_bytes(text, size - tail), tail_bytes(text, tail)) if tail else head_bytes(text, size)
    n = F.octet_length(text)
    return F.struct(F.when(n <= size, text).otherwise(ends).alias("text"), n.cast("long").alias("original_bytes"), line_count(text).alias("original_lines"), (n > size).alias("truncated"))


def escape_visible(text: Column) -> Column:
    """Backslash, tab and return as escapes, other control characters but the newline as hex escapes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for code in [*range(0x20), *range(0x7F, 0xA0)]:
        if code != 0x0A:
            out = F.replace(out, F.lit(chr(code)), F.lit({9: "\\t", 13: "\\r"}.get(code, f"\\x{code:02x}")))
    return out
