"""Connected components of an edge table, as joins on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import stored
from tastewright.operators.lookup import lookup


def _state(edges: DataFrame) -> tuple:
    """Number of edges, and whole sums of two 64-bit hashes of them."""
    sums = (F.sum(F.xxhash64(*pair).cast("decimal(20,0)")) for pair in (("a", "b"), ("b", "a")))
    return tuple(edges.agg(F.count("*"), *sums).first())


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours tied to the smallest of them and itself.

    The minimum is pre-aggregated and unique by node; the join with it goes by
    ``lookup``, so that the links of a node with very many are split over tasks.
    """
    # a > b in every stored edge
    if larger_only:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = lookup(sides.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        met = lookup(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return met.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable, for every node of ``edges`` (columns a, b).

    Large-star and small-star steps in turn, until nothing changes; the number
    of rounds grows with the logarithm of the longest path. Self links and
    repeated links change nothing; no edges give no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _state(now)
    while before[0]:
        now = stored(_stars(_stars(now, larger_only=True), larger_only=False))
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
