"""Ordered gates, three-valued flags, votes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(*gates: tuple[Column, str]) -> Column:
    """The code of the first gate that fails; null if all pass.  A gate that is null fails."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in gates))


def all_false(tags: Column, facts: Column) -> Column:
    """Fail open: whether every tag is known to be false; an empty list is not."""
    return (F.size(tags) > 0) & F.forall(tags, lambda t: F.coalesce(F.element_at(facts, t) == F.lit(False), F.lit(False)))


def all_true(tags: Column, facts: Column) -> Column:
    """Fail closed: whether every tag is known to be true; an empty list is."""
    return F.forall(tags, lambda t: F.coalesce(F.element_at(facts, t), F.lit(False)))


def quorum(votes: DataFrame, keys: list[str], family: str, anchor: str, vote: str, yes: str, least: int) -> DataFrame:
    """``agreed``: enough distinct families voted, one of them the anchor, and none against."""
    return votes.groupBy(*keys).agg(
        F.count_distinct(family).alias("families"),
        ((F.count_distinct(family) >= least) & F.bool_or(anchor) & F.bool_and(F.col(vote) == yes)).alias("agreed"),
    )


def proved_absent(asked: DataFrame, rows: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked for, has no row, and has a note that nothing was found: a missing row alone proves nothing."""
    return asked.join(rows.select(*keys).distinct(), keys, "left_anti").join(notes.select(*keys).distinct(), keys, "left_semi")


def closure(edges: DataFrame, child: str, parent: str, most_rounds: int = 16) -> DataFrame:
    """``(child, ancestor, depth)`` of a vocabulary's edges, which must have no cycle; paths double in each round.

    For tables of terms, which are small; a graph of rows needs ``components``.
    """
    paths = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    for _ in range(most_rounds):
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.child")).select("a.child", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        more = paths.unionByName(longer).distinct()
        if more.count() == paths.count():
            return paths
        paths = edges.sparkSession.createDataFrame(more.collect(), "child string, ancestor string, depth int")
    raise ValueError("the edges have a cycle")


def verdict(label: Column, evidence: Column, disproof: Column, least: int) -> Column:
    """``violation``, ``pass`` or ``needs_review``: a pass needs a disproof of some length that stands in the evidence word for word, case aside."""
    proved = (F.length(F.trim(disproof)) >= least) & F.contains(F.lower(evidence), F.lower(F.trim(disproof)))
    return F.when(label == "breach", "violation").when((label == "no_breach") & proved, "pass").otherwise("needs_review")
