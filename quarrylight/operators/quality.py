"""Constraint queries: bad data as rows, and comparisons of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: Column, *rules: tuple[str, Column]) -> DataFrame:
    """``(key, rule)`` for every rule that a row breaks, in one pass; a condition that is null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))
    return df.select(key.alias("key"), F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference leads nowhere; a null reference is no reference."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys at which two tables differ, with both values; a full outer join with null-safe comparison."""
    l, r = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")), b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = l.join(r, keys, "full_outer")
    kind = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")) | F.col("_l").isNull() | F.col("_r").isNull()).select(*keys, "left_value", "right_value", kind.alias("kind"))


def covers(planned: DataFrame, *parts: tuple[str, DataFrame]) -> DataFrame:
    """Items that the parts miss, hold twice, or hold without a plan."""
    held = reduce(DataFrame.unionByName, [df.select("item").withColumn("part", F.lit(name)) for name, df in parts])
    held = held.groupBy("item").agg(F.count("*").alias("times"))
    both = planned.select("item").distinct().withColumn("_p", F.lit(True)).join(held, "item", "full_outer")
    problem = F.when(F.col("_p").isNull(), "unplanned").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "twice")
    return both.select("item", problem.alias("problem")).where("problem is not null")
