"""Counts and means over ratings and catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_summary(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """One row: how many ratings, how many catalogue rows."""
    n_items = items.agg(F.count("*")).scalar()
    return ratings.agg(F.count("*").alias("n_ratings")).select(
        "n_ratings", n_items.alias("n_items")
    )


def item_stats(ratings: DataFrame) -> DataFrame:
    """Number and mean of the ratings of each rated item.

    Map-side partial aggregation reduces a hot item to one row per input
    partition before the shuffle.
    """
    return ratings.groupBy("item_id").agg(
        F.count("*").alias("n_ratings"),
        F.avg("rating").alias("avg_rating"),
    )


def rating_counts(ratings: DataFrame) -> DataFrame:
    """Only the counts; the optimizer then drops the unused mean."""
    return item_stats(ratings).select("item_id", "n_ratings")
