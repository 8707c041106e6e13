"""Number, date, colour and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(c: Column, bounds: list[tuple[float, str]], other: str, missing: str) -> Column:
    """The label of the first bound that is not exceeded."""
    out = F.when(c.isNull(), missing)
    for limit, label in bounds:
        out = out.when(c <= limit, label)
    return out.otherwise(other)


def real_date(c: Column | str) -> Column:
    """Whether a string is an ISO date of the calendar."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == c, F.lit(False))


def luminance(hexcode: Column) -> Column:
    """Relative luminance of ``rrggbb``."""
    def part(i: int) -> Column:
        v = F.conv(F.substring(hexcode, i, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(1) + 0.7152 * part(3) + 0.0722 * part(5)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def span_hash(text: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the bytes ``[start, end)`` of the UTF-8 text."""
    return F.sha2(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), 256)


def content_key(*columns: Column) -> Column:
    """A key by content: nulls count, order of columns counts."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16)


def canonical(*columns: Column | str) -> Column:
    """Fields in one order, parted by bars, nulls written as a tilde."""
    return F.concat_ws("|", *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("~")) for c in columns))
