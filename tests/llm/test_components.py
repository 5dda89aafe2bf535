"""Connected components: a node with very many links is split over tasks."""

import pytest
from pyspark.sql import functions as F

from tastewright.llm import components as module
from tastewright.llm.components import components

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_thresholds(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_star_is_split(spark, small_thresholds):
    n = 200_000
    star = spark.range(n, numPartitions=8).select(
        (F.col("id") + 10).alias("a"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") + 9).cast("long").alias("b"))
    edges = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    step = module._stars(edges, larger_only=True)
    step.collect()
    assert "skew=true" in step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    found = components(star).agg(F.count("*"), F.min("root"), F.max("root")).first()
    assert tuple(found) == (n + 1, 5, 5)


def test_changes_are_seen(spark):
    """Two edge tables of one size differ in their sums of whole hashes."""
    one = spark.createDataFrame([(2, 1), (4, 3)], "a long, b long")
    two = spark.createDataFrame([(2, 1), (4, 2)], "a long, b long")
    assert module._state(one) != module._state(two) and module._state(one) == module._state(one.orderBy("b"))
    assert module._state(one.where("false")) == (0, None, None)
