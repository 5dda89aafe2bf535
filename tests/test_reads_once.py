"""The ratings, often a join of two tables, are made once for the fit and the step after it."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver

N = 2_000


def counted_ratings(spark):
    """Ratings whose rows count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def passing(item_id):
        made.add(1)
        return item_id

    ratings = spark.range(N, numPartitions=4).select(
        (F.col("id") % 50).cast("int").alias("user_id"),
        passing((F.col("id") % 40).cast("int")).alias("item_id"),
        (F.col("id") % 5 + 1).cast("double").alias("rating"),
    )
    return ratings, made


@pytest.mark.parametrize("solver", ["blocks", "joins"])
def test_invariant_makes_the_ratings_once(spark, monkeypatch, solver):
    ratings, made = counted_ratings(spark)
    monkeypatch.setattr(driver, "ratings_table", lambda spark, folder: ratings)
    rows = driver._invariant(spark, "unused", solver).collect()
    assert len(rows) == 50 and made.value == N


def test_score_coverage_makes_the_ratings_once(spark, monkeypatch):
    ratings, made = counted_ratings(spark)
    monkeypatch.setattr(driver, "ratings_table", lambda spark, folder: ratings)
    rows = driver.score_coverage_query(spark, "unused").collect()
    assert len(rows) == N + len(driver.SESSION) and made.value == N

