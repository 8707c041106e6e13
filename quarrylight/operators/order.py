"""Operators that depend on order: keep-first, budgets, intervals, chains, as-of.

Each names its order and breaks all ties, and partitions by a key that the
data has, so that no window runs over a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def capped(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, most_rows: int, most_size: int) -> DataFrame:
    """Rows before the first that would exceed the rows or the total size; what follows it is left out even if small.

    Only a key's first ``most_rows`` can matter, and a rank below a limit is
    found before the shuffle, so a key may hold any number of rows.
    """
    few = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most_rows)
    w = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    # Sizes are not negative: once over, the running total stays over.
    return few.withColumn("_total", F.sum(size).over(w)).where(F.col("_total") <= most_size).drop("_n", "_total")


def merged(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Overlapping intervals, or such at most ``gap`` apart, as one: gaps and islands, one sort."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    marked = df.withColumn("_b", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_new", F.when(F.col("_b").isNull() | (F.col(start) > F.col("_b") + gap), 1).otherwise(0))
    numbered = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_i")


def islands(df: DataFrame, keys: list[str], start: str, end: str, reach: int, width: int = 4096) -> DataFrame:
    """Rows with ``cluster``: 1, 2, ... for groups of intervals that touch within ``reach``.

    A key may hold most rows: it is cut into ranges of ``start``, and what the
    ranges before reach to, and how many clusters they began, is carried over
    by a table with a row for each range.
    """
    parted = df.withColumn("_r", F.floor(F.col(start) / width))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    reached = parted.groupBy(*keys, "_r").agg(F.max(end).alias("_e")).withColumn("_far", F.max("_e").over(before)).drop("_e")
    inner = Window.partitionBy(*keys, "_r").orderBy(start, end)
    marked = parted.join(reached, [*keys, "_r"]).withColumn("_b", F.greatest("_far", F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1))))
    marked = marked.withColumn("_new", F.when(F.col("_b").isNull() | (F.col(start) - reach > F.col("_b")), 1).otherwise(0))
    begun = marked.groupBy(*keys, "_r").agg(F.sum("_new").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    own = F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).join(begun, [*keys, "_r"]).withColumn("cluster", F.col("_own") + F.col("_o")).drop("_r", "_far", "_b", "_new", "_own", "_o")


def latest(df: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """The values of the last row of each key, by partial aggregation, without a sort."""
    return df.groupBy(*keys).agg(*(F.max_by(v, order).alias(v) for v in values))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the nearest right row not after it.

    Both sides are merged by one sort for each key instead of a join on a
    range; a left row without an earlier right row has nulls.
    """
    names = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"))
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("_l"), F.struct(*values).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*keys, "_l.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def chain_breaks(df: DataFrame, keys: list[str], order: list[Column], own: str, previous: str) -> DataFrame:
    """Rows whose stored hash of the row before is not that row's hash."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_p", F.lag(own).over(w)).where(~F.col(previous).eqNullSafe(F.col("_p"))).drop("_p")


def numbered(df: DataFrame, keys: list[str], column: str, width: int, name: str = "n") -> DataFrame:
    """Rows with their place 1, 2, ... by an integer column within each key.

    A key may hold most rows: it is parted by ranges of the column, numbered
    within each, and offset by the rows of the ranges before, a small table.
    Rows with equal values must not occur.
    """
    parted = df.withColumn("_r", F.floor(F.col(column) / width))
    local = parted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(column)))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy(*keys, "_r").agg(F.count("*").alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return local.join(offsets, [*keys, "_r"]).withColumn(name, F.col("_n") + F.col("_o")).drop("_r", "_n", "_o")
