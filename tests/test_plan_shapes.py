"""What the optimizer makes of the operators, with broadcasts by size off."""

import pytest

from tastewright.operators import (
    candidates,
    capture_ratings,
    dataset_summary,
    item_stats,
    rating_counts,
    score,
    title_map,
    top_scored,
    train,
)
from tastewright.plans import recommend, recommend_many
from tastewright.schemas import ITEM, RATING, SUBMISSION
from tastewright.sources import new_ratings

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    from tastewright.sources import catalogue_table, ratings_table

    folder = tmp_path_factory.mktemp("tables")
    ratings_table(spark, FOLDER).write.parquet(f"{folder}/ratings")
    catalogue_table(spark, FOLDER).write.parquet(f"{folder}/items")
    return (
        spark.read.schema(RATING).parquet(f"{folder}/ratings"),
        spark.read.schema(ITEM).parquet(f"{folder}/items"),
    )


@pytest.fixture
def no_size_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_distributed(text):
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_counts_read_one_column_and_no_mean(tables):
    text = plan(rating_counts(tables[0]).where("n_ratings >= 25"))
    assert "ReadSchema: struct<item_id:int>" in text
    assert "avg(" not in text and "partial_count" in text
    assert text.count("Exchange") == 1


def test_stats_aggregate_before_the_shuffle(tables):
    text = plan(item_stats(tables[0]))
    assert "partial_avg" in text and text.count("Exchange") == 1


def test_summary_reads_no_columns(tables):
    text = plan(dataset_summary(*tables))
    assert "ReadSchema: struct<>" in text
    assert_distributed(text)


def test_recommend(spark, tables, no_size_broadcast):
    ratings, items = tables
    model = train(ratings, iterations=1)
    new = new_ratings(spark, [(0, 3, 5.0)])
    text = plan(recommend(model, item_stats(ratings), items, new, 25))
    assert_distributed(text)
    assert text.count("TakeOrderedAndProject") == 2
    assert "ArrowEvalPython" not in text
    many = plan(recommend_many(model, item_stats(ratings), items, new, 25))
    assert_distributed(many)
    assert "WindowGroupLimit" in many and "BroadcastHashJoin" not in many


def test_relational_operators(spark, tables, no_size_broadcast):
    ratings, items = tables
    new = new_ratings(spark, [(0, 3, 5.0)])
    raw = spark.createDataFrame([(0, "x", "3")], SUBMISSION)
    model = train(ratings, iterations=1)
    scored = score(model, ratings.select("user_id", "item_id"))
    for df in (
        candidates(items, new),
        capture_ratings(raw, title_map(items)),
        scored,
        top_scored(scored, items, item_stats(ratings), 25, 5),
    ):
        text = plan(df)
        assert_distributed(text)
        assert "BroadcastHashJoin" not in text
        assert "Python" not in text
