import random

import pytest
from pyspark.sql import functions as F

from tastewright.operators import list_titles, search_many, search_titles, store_titles
from tastewright.schemas import ITEM


def listed(df):
    return [tuple(r) for r in df.orderBy("position").collect()]


def expected(items):
    ordered = sorted(items, key=lambda r: (r[1].lower().encode(), r[0], r[1].encode()))
    return [(i + 1, title, item) for i, (item, title) in enumerate(ordered)]


def test_order_ignores_case(spark):
    items = [(1, "beta"), (2, "Alpha"), (3, "alpha"), (4, "Gamma"), (5, "ALPHA")]
    assert listed(list_titles(spark.createDataFrame(items, ITEM))) == expected(items)


def test_many_partitions_and_one_hot_title(spark):
    random.seed(1)
    items = [(i, f"{random.choice('abcXYZ')}{random.randrange(300)}") for i in range(3000)]
    items += [(7, "same")] * 1500
    random.shuffle(items)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = list_titles(spark.createDataFrame(items, ITEM).repartition(6))
        sizes = [len(p) for p in result.rdd.glom().collect()]
        assert listed(result) == expected(items)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 1500  # the hot title is spread


@pytest.mark.parametrize("prefix", ["RED", "", "äb", "none", "100%"])
def test_search(spark, prefix):
    items = [(1, "red ring"), (2, "Redwood"), (3, "blue"), (4, "ÄB one"), (5, "aRED"), (6, "100% x")]
    hits = [r for r in items if r[1].lower().startswith(prefix.lower())]
    catalogue = spark.createDataFrame(items, ITEM)
    assert listed(search_titles(catalogue, prefix, positions=True)) == expected(hits)
    assert [tuple(r) for r in search_titles(catalogue, prefix).collect()] == [r[1:] for r in expected(hits)]


def test_a_search_runs_no_job_when_built(spark):
    catalogue = spark.createDataFrame([(i, f"red {i}") for i in range(100)], ITEM)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("search", "")
    try:
        found = search_titles(catalogue, "r")
        assert tracker.getJobIdsForGroup("search") == []
        assert found.first().title == "red 0" and tracker.getJobIdsForGroup("search")
        assert "TakeOrderedAndProject" in found.limit(1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_empty_catalogue(spark):
    assert listed(list_titles(spark.createDataFrame([], ITEM))) == []


def test_search_many(spark):
    items = [(1, "red ring"), (2, "Redwood"), (3, "blue"), (4, "ÄB one"), (5, "aRED"), (6, "r"), (2, "")]
    texts = ["red", "RED", "", "äb", "none", "r", "red ring and more", "red", "Red"]
    result = search_many(
        spark.createDataFrame(items, ITEM), spark.createDataFrame([(t,) for t in texts], "prefix string")
    )
    for text in texts:
        hits = [r for r in items if r[1].lower().startswith(text.lower())]
        found = [tuple(r)[1:] for r in result.where(result.prefix == text).orderBy("position").collect()]
        assert found == expected(hits)


def test_search_many_broadcasts_no_titles(spark):
    """The titles cut to each length look small by the files' size, but are many."""
    items = [(i, f"{'abc'[i % 3]}{i % 97} title {i}") for i in range(2000)]
    texts = ["a1", "B2", "c", "none"]
    result = search_many(
        spark.createDataFrame(items, ITEM), spark.createDataFrame([(t,) for t in texts], "prefix string")
    )
    rows = result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [start" not in plan
    for text in texts:
        hits = [r for r in items if r[1].lower().startswith(text.lower())]
        found = sorted(tuple(r)[1:] for r in rows if r.prefix == text)
        assert found == expected(hits)


WORDS = ["red ring", "Redwood", "blue", "ÄB one", "aRED", "100% x", "r", "", "red", "RED\U0010ffff", "red\U0010ffff\U0010ffffx", "re", "rf"]


@pytest.mark.parametrize("prefix", ["RED", "", "äb", "none", "100%", "red\U0010ffff", "r"])
def test_search_of_a_stored_catalogue(spark, tmp_path, prefix):
    items = [*enumerate(WORDS), *enumerate(WORDS)]
    stored = store_titles(spark.createDataFrame(items, ITEM).repartition(4), f"{tmp_path}/titles")
    hits = [r for r in items if r[1].lower().startswith(prefix.lower())]
    assert listed(search_titles(stored, prefix, positions=True)) == expected(hits)
    assert [tuple(r) for r in search_titles(stored, prefix).collect()] == [r[1:] for r in expected(hits)]


def test_a_stored_catalogue_is_read_by_range(spark, tmp_path):
    titles = spark.range(40_000, numPartitions=4).select(
        F.col("id").cast("int").alias("item_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    stored = store_titles(titles, f"{tmp_path}/titles", **{"parquet.block.size": "65536"})
    found = search_titles(stored, "ABC")
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PushedFilters"):].splitlines()[0]
    assert "GreaterThanOrEqual(start,abc)" in filters and "StringStartsWith(start,abc)" in filters
    assert found.count() == titles.where("title LIKE 'abc%'").count() > 0
    # Rows that a task is handed are those of row groups the range touches.
    seen = stored.where((F.col("start") >= "abc") & F.col("start").startswith("abc"))
    seen.collect()
    scan = seen._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().get("numOutputRows").get().value() < 20_000


def test_search_many_of_a_stored_catalogue(spark, tmp_path):
    items = spark.createDataFrame([*enumerate(WORDS), *enumerate(WORDS)], ITEM)
    typed = spark.createDataFrame([(t,) for t in ["red", "RED", "", "äb", "none", "r", None]], "prefix string")
    plain = search_many(items, typed).collect()
    stored = store_titles(items, f"{tmp_path}/titles")
    assert sorted(map(tuple, search_many(stored, typed).collect())) == sorted(map(tuple, plain))


def test_store_an_empty_catalogue(spark, tmp_path):
    stored = store_titles(spark.createDataFrame([], ITEM), f"{tmp_path}/titles")
    assert search_titles(stored, "a", positions=True).count() == 0
