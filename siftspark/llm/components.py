"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node next to it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.join(least, "u").filter("v > u").selectExpr("v AS u", "least AS v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").filter("v <> least").selectExpr("v AS u", "least AS v")
    return moved.union(least.selectExpr("u", "least AS v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge, itself included.

    ``edges`` has the columns ``a`` and ``b`` of one ordered type without nulls. Each round is written to
    the shared folder; the rounds end when every edge leads to the smallest node of its component, after
    a number of rounds that grows with the logarithm of the component size. Only two sums per round reach
    the driver. Minima are pre-aggregated in the tasks, and joins on a node are left to be split if skewed.
    """
    current = written(
        edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct(), "edges")
    state = None
    while True:
        following = written(_small_star(_large_star(current)), "edges")
        new = following.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            roots = following.select("v").distinct().selectExpr("v AS node", "v AS component")
            return following.selectExpr("u AS node", "v AS component").union(roots)
        current, state = following, tuple(new)
