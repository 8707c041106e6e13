"""Aggregates: scores with runners-up, two-level rollups, rates without denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """Null, not zero, where there is nothing to divide by."""
    return F.try_divide(part, whole)


def winner(scores: DataFrame, keys: list[str], label: str, score: str, least: float, margin: float) -> DataFrame:
    """The best label of each key if it has the least score and so many times the runner-up's; otherwise null, an abstention."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), label)
    top = scores.withColumn("_n", F.row_number().over(w)).where("_n <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("_n") == 1, F.col(label))).alias(label), F.max(F.when(F.col("_n") == 1, F.col(score))).alias(score), F.max(F.when(F.col("_n") == 2, F.col(score))).alias("rival"))
    sure = (F.col(score) >= least) & (F.col("rival").isNull() | (F.col(score) >= margin * F.col("rival")))
    return top.withColumn(label, F.when(sure, F.col(label)))


def worst(df: DataFrame, keys: list[str], state: str, ranks: list[str]) -> DataFrame:
    """The last-listed state that occurs."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(state))
    return df.groupBy(*keys).agg(F.max(rank).alias("_r")).withColumn("worst", F.element_at(F.array(*map(F.lit, ranks)), F.col("_r").cast("int"))).drop("_r")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows by a total order, overall or for each key; overall it is one take-ordered step."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
