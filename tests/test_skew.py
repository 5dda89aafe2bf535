"""A third of all rows on one key: the work must be spread, the rows whole."""

import pytest
from pyspark.sql import functions as F

from tastewright.operators import FactorModel, capture_ratings, fit_residuals, lookup, title_map
from tastewright.plans import recommend_many

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
N = 300_000


@pytest.fixture(autouse=True)
def small_thresholds(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def collected(df):
    """Rows and the plan they were computed with."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def vectors(spark, n):
    component = "transform(sequence(1, 8), k -> float(pmod(xxhash64(id, k), 100)) / 100)"
    return spark.range(n).select(F.col("id").cast("int").alias("id"), F.expr(component).alias("features"))


def test_popular_title(spark):
    hot = F.col("id") % 3 == 0
    submissions = spark.range(N, numPartitions=8).select(
        F.col("id").cast("int").alias("user_id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 1000)).alias("title"),
        F.lit("3").alias("rating_text"),
    )
    items = spark.range(1001).select(
        F.col("id").cast("int").alias("item_id"),
        F.when(F.col("id") == 1000, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("title"),
    )
    rows, plan = collected(capture_ratings(submissions, title_map(items)))
    assert "skew=true" in plan
    assert len(rows) == N and sum(r.item_id == 1000 for r in rows) == N // 3


def test_popular_item_and_busy_user(spark):
    third = F.col("id") % 3
    ratings = spark.range(N, numPartitions=8).select(
        F.when(third == 0, 7).otherwise(F.col("id") % 2000).cast("int").alias("user_id"),
        F.when(third == 1, 9).otherwise(F.col("id") % 1000).cast("int").alias("item_id"),
        (F.col("id") % 5 + 1).cast("double").alias("rating"),
    )
    model = FactorModel(vectors(spark, 2000), vectors(spark, 1000), 8, 0.0, "given")
    rows, plan = collected(fit_residuals(model, ratings))
    assert plan.count("skew=true") == 2
    assert len(rows) == ratings.select("user_id").distinct().count()


def test_one_item_in_every_list(spark):
    items = vectors(spark, 1000).withColumn(
        "features", F.when(F.col("id") == 9, F.expr("array_repeat(float(9), 8)")).otherwise(F.col("features"))
    )
    model = FactorModel(vectors(spark, 20000), items, 8, 0.0, "given")
    ids = spark.range(1000).select(F.col("id").cast("int").alias("item_id"))
    catalogue = ids.withColumn("title", F.concat(F.lit("t"), "item_id"))
    new = spark.range(20000).select(
        F.col("id").cast("int").alias("user_id"), F.lit(3).alias("item_id"), F.lit(1.0).alias("rating")
    )
    stats = ids.withColumn("n_ratings", F.lit(30).cast("long"))
    rows, plan = collected(recommend_many(model, stats, catalogue, new, 25, 2))
    assert "skew=true" in plan
    assert len(rows) == 40000
    assert sum(r.item_id == 9 and r["rank"] == 1 for r in rows) == 20000


def test_lookup_is_a_join(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(5).groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n"))
    assert sorted(lookup(rows, table, "k").collect()) == sorted(rows.join(table, "k").collect())


def test_lookup_merges_no_tasks(spark):
    """A table of more partitions than a shuffle has is read by as many tasks."""
    table = spark.range(100, numPartitions=40).select(F.col("id").alias("k"), F.spark_partition_id().alias("part"))
    rows = spark.range(100).select(F.col("id").alias("k"))
    assert lookup(rows, table, "k").select("part").distinct().count() == 40
    assert lookup(rows, table.withColumn("task", F.spark_partition_id()), "k").count() == 100
