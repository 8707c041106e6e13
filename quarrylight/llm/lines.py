"""Lines of a text as rows, and their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, text: str = "text", *keep: Column | str) -> DataFrame:
    """One row per line of ``text`` with ``line_no`` (from 1) and ``line``.

    A null text has no lines; an empty one has one empty line.
    """
    parts = F.split(F.col(text), "\n", -1)
    return df.select(*keep, F.posexplode(parts).alias("_pos", "line")).withColumn("line_no", F.col("_pos") + 1).drop("_pos")


def letters(line: Column | str) -> Column:
    """The letters of a line in lower case, everything else dropped."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))
