"""The check of lists finds what is wrong with a list."""

import pytest
from pyspark.sql import functions as F

from tastewright.operators import FactorModel, item_stats
from tastewright.plans import check_lists, plain_lists, recommend_many
from tastewright.schemas import ITEM, RATING


@pytest.fixture(scope="module")
def world(spark):
    def factors(n, shift):
        value = lambda k: ((F.col("id") * (37 + 11 * k) + shift) % 101 / 50 - 1).cast("float")
        return spark.range(n).select(F.col("id").cast("int").alias("id"), F.array(*[value(k) for k in range(3)]).alias("features"))

    model = FactorModel(factors(30, 5), factors(60, 9), 3, 0.0, "given")
    ratings = spark.createDataFrame([(100 + u, i, 3.0) for i in range(60) for u in range(i % 9)], RATING)
    items = spark.createDataFrame([(i, f"t{i}") for i in range(70)] + [(4, "t4"), (8, "other eight")], ITEM)
    new = spark.createDataFrame([(u, (u * 7) % 60, 4.0) for u in range(25)] * 2 + [(999, 3, 1.0)], RATING)
    return model, item_stats(ratings).checkpoint(), items, new


def judged(listed, expected):
    return {r.user_id: (r.n_listed, r.ok) for r in check_lists(listed, expected).collect()}


def test_right_lists(spark, world):
    model, stats, items, new = world
    listed = recommend_many(model, stats, items, new, 3, 6)
    for blocks in (1, 5):
        found = judged(listed, plain_lists(model, stats, items, new, new, 3, 6, blocks))
        assert found == {u: (6, True) for u in range(25)}
    few = plain_lists(model, stats, items, new, new.where("user_id < 5"), 3, 6)
    assert judged(listed.where("user_id < 5"), few) == {u: (6, True) for u in range(5)}
    assert judged(listed.where("false"), few.where("false")) == {}


@pytest.mark.parametrize("wrong", [
    lambda rows: rows.where("rank < 6"),
    lambda rows: rows.union(rows.where("rank = 6").withColumn("rank", F.lit(7).cast("long"))),
    lambda rows: rows.withColumn("title", F.when(F.col("rank") == 2, "x").otherwise(F.col("title"))),
    lambda rows: rows.withColumn("title", F.when(F.col("rank") != 2, F.col("title"))),
    lambda rows: rows.withColumn("prediction", (F.col("prediction") + 0.001).cast("float")),
    lambda rows: rows.withColumn("prediction", F.when(F.col("rank") < 3, F.col("prediction"))),
    lambda rows: rows.withColumn("n_ratings", F.col("n_ratings") + 1),
    lambda rows: rows.withColumn("rank", 7 - F.col("rank")),
])
def test_wrong_lists(spark, world, wrong):
    model, stats, items, new = world
    expected = plain_lists(model, stats, items, new, new, 3, 6)
    assert {ok for _, ok in judged(wrong(expected), expected).values()} == {False}


def test_missing_lists(spark, world):
    model, stats, items, new = world
    expected = plain_lists(model, stats, items, new, new, 3, 6)
    found = judged(expected.where("user_id <> 4"), expected.where("user_id <> 5"))
    assert found[4] == (0, False) and found[5] == (6, False) and found[6] == (6, True)


def test_plain_lists_in_groups(spark, world, monkeypatch):
    """Pairs are scored inside groups of users and items, never shuffled as rows,
    and the lists are those of scoring every pair and ranking them all."""
    import numpy as np

    from tastewright.plans import checking

    model, stats, items, new = world
    monkeypatch.setattr(checking, "USERS_PER_BLOCK", 4)
    monkeypatch.setattr(checking, "ITEMS_PER_BLOCK", 7)
    found = plain_lists(model, stats, items, new, new, 3, 6, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan

    w = {r.id: r.features for r in model.user_factors.collect()}
    v = {r.id: r.features for r in model.item_factors.collect()}
    n = {r.item_id: r.n_ratings for r in stats.collect()}
    rows = [(r.item_id, r.title) for r in items.collect()]
    rated = {(r.user_id, r.item_id) for r in new.collect()}
    expected = set()
    for u in {r.user_id for r in new.collect()} & w.keys():
        pool = []
        for i, _ in rows:
            if i in v and (u, i) not in rated and n.get(i, 0) >= 3:
                p = float(np.float32(sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(w[u], v[i]))))
                pool += [(-p, i, t) for j, t in rows if j == i]
        for rank, (p, i, t) in enumerate(sorted(pool)[:6], 1):
            expected.add((u, rank, i, t, n[i], -p))
    got = {(r.user_id, r.rank, r.item_id, r.title, r.n_ratings, float(r.prediction)) for r in found.collect()}
    assert got == expected


def test_plain_lists_shuffle_statistics_once(spark, world):
    """The items are counted and then scored from one stored copy, not computed twice."""
    model, _, items, new = world
    ratings = spark.createDataFrame([(100 + u, i, 3.0) for i in range(60) for u in range(i % 9)], RATING)
    expected = plain_lists(model, item_stats(ratings), items, new, new, 3, 6)
    assert "InMemoryRelation" in expected._jdf.queryExecution().optimizedPlan().toString()
    listed = recommend_many(model, item_stats(ratings), items, new, 3, 6)
    assert judged(listed, expected) == {u: (6, True) for u in range(25)}
