import math

import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from tastewright.operators import (
    fit_residuals,
    item_stats,
    score,
    train,
    training_set,
)
from tastewright.operators.join_training import train_by_joins
from tastewright.schemas import RATING
from tastewright.sources import new_ratings, ratings_table

FOLDER = "/root/testdata/sf0.001"
SESSION = [(0, 3, 5.0), (0, 7, 1.0), (0, 11, 4.0)]


@pytest.fixture(scope="module")
def everything(spark):
    return training_set(ratings_table(spark, FOLDER), new_ratings(spark, SESSION)).persist()


@pytest.fixture(scope="module")
def model(everything):
    return train(everything)


def factors(df):
    return {r.id: list(r.features) for r in df.collect()}


def distance(a, b):
    assert a.keys() == b.keys()
    return max(abs(x - y) for k in a for x, y in zip(a[k], b[k]))


def library(ratings, **params):
    return ALS(
        userCol="user_id", itemCol="item_id", ratingCol="rating", rank=8, regParam=0.1, seed=5,
        numUserBlocks=10, numItemBlocks=10, coldStartStrategy="drop", **params,
    ).fit(ratings)


def test_training_set_keeps_repeats(spark):
    base = spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0)], RATING)
    assert training_set(base, base).count() == 4


def test_seconds_and_solver(model):
    assert model.solver == "blocks"
    assert model.seconds > 0 and round(model.seconds, 3) == model.seconds


def test_predictions_equal_the_library(everything, model):
    pairs = everything.select("user_id", "item_id").distinct()
    theirs = library(everything, maxIter=10).transform(pairs)
    both = score(model, pairs).join(theirs.withColumnRenamed("prediction", "p"), ["user_id", "item_id"])
    worst = both.agg(F.max(F.abs(F.col("prediction") - F.col("p"))), F.count("*")).first()
    assert worst[0] < 1e-5 and worst[1] == pairs.count()


def test_scoring_keeps_repeated_and_drops_unknown_pairs(spark, model):
    pairs = spark.createDataFrame([(0, 5), (0, 5), (0, 10**6), (10**6, 5)], "user_id int, item_id int")
    scored = score(model, pairs)
    assert scored.dtypes == [("user_id", "int"), ("item_id", "int"), ("prediction", "float")]
    assert [(r.user_id, r.item_id) for r in scored.collect()] == [(0, 5), (0, 5)]


def test_users_solve_their_normal_equations(everything, model):
    worst = fit_residuals(model, everything).agg(F.max("residual"), F.count("*")).first()
    assert worst[0] < 1e-3
    assert worst[1] == everything.select("user_id").distinct().count()
    # Control: the same check must notice that repeated ratings were dropped.
    assert fit_residuals(model, everything.distinct()).agg(F.max("residual")).first()[0] > 0.1


def test_input_partitions_do_not_matter(everything, model):
    again = train(everything.repartition(17))
    assert distance(factors(model.user_factors), factors(again.user_factors)) < 1e-3


@pytest.mark.parametrize("pairs_per_salt", [10**9, 15])
def test_joins_equal_the_library_from_the_same_start(everything, pairs_per_salt):
    """With and without salted ids, from the library's own first factors."""
    start = library(everything, maxIter=0).userFactors
    users, items = train_by_joins(
        everything, 8, 3, 0.1, 5, start=start, pairs_per_salt=pairs_per_salt
    )
    theirs = library(everything, maxIter=3)
    assert distance(factors(users), factors(theirs.userFactors)) < 1e-4
    assert distance(factors(items), factors(theirs.itemFactors)) < 1e-4
    assert distance(factors(users), factors(start)) > 0.1


def test_joins_with_one_item_in_a_third_of_all_ratings(spark):
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(1, 61) for i in range(1, 5)]
    rows += [(u, 0, float(u % 5 + 1)) for u in range(1, 61) for _ in range(2)]
    ratings = spark.createDataFrame(rows, RATING)
    start = library(ratings, maxIter=0).userFactors
    users, items = train_by_joins(ratings, 8, 2, 0.1, 5, start=start, pairs_per_salt=20)
    theirs = library(ratings, maxIter=2)
    assert distance(factors(users), factors(theirs.userFactors)) < 1e-3
    assert distance(factors(items), factors(theirs.itemFactors)) < 1e-3


def test_joins_fit_alone(everything):
    model = train(everything, solver="joins", iterations=4)
    assert model.solver == "joins"
    assert fit_residuals(model, everything).agg(F.max("residual")).first()[0] < 1e-3


@pytest.mark.parametrize("solver", ["blocks", "joins"])
def test_nan_is_rejected(spark, solver):
    ratings = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 1.0)], RATING)
    with pytest.raises(Exception, match="(?i)must not be null or nan"):
        train(ratings, solver=solver)


def test_unknown_solver(everything):
    with pytest.raises(ValueError):
        train(everything, solver="guess")


def test_settings_do_not_follow_the_data(spark):
    """Frames that differ in their number of rows are fitted from equal settings."""
    few = spark.createDataFrame([(u, i, 3.0) for u in range(1, 6) for i in range(1, 6)], RATING)
    many = few.union(few).union(few)
    models = [train(rows, iterations=1) for rows in (few, many)]
    assert [m.solver for m in models] == ["blocks", "blocks"]
    start = train(few, iterations=1, blocks=10)
    assert distance(factors(models[0].user_factors), factors(start.user_factors)) == 0
    assert train(few, iterations=1, solver="joins").solver == "joins"



@pytest.mark.parametrize("solver", ["blocks", "joins"])
def test_recovers_held_out_ratings(spark, solver):
    """Ratings from a rank-two rule; every seventh is held out."""
    def rating(u, i):
        return 3 + 1.5 * math.sin(u) * math.cos(2 * i) + math.cos(3 * u) * math.sin(i)

    cells = [(u, i, rating(u, i)) for u in range(1, 61) for i in range(1, 41)]
    held = spark.createDataFrame([c for n, c in enumerate(cells) if n % 7 == 0], RATING)
    known = spark.createDataFrame([c for n, c in enumerate(cells) if n % 7], RATING)
    model = train(known, regularization=0.01, iterations=6, solver=solver)
    scored = score(model, held).join(held, ["user_id", "item_id"])
    mean = known.agg(F.avg("rating")).first()[0]
    error = scored.agg(
        F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2)).alias("ours"),
        F.sqrt(F.avg((F.lit(mean) - F.col("rating")) ** 2)).alias("mean"),
    ).first()
    assert error.ours < error.mean / 2


def test_item_stats(spark):
    ratings = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (2, 1, 3.0), (1, 2, 5.0)], RATING)
    assert sorted(tuple(r) for r in item_stats(ratings).collect()) == [(1, 3, 8 / 3), (2, 1, 5.0)]
