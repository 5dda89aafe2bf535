"""What keeps a fit and the steps after it within memory and disk, on few rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastewright.operators import fit_residuals, join_training, score, scoring, train, training
from tastewright.schemas import RATING


def rows_of(spark, users=60, items=40):
    cells = [(u, i, float((u * i) % 5 + 1)) for u in range(1, users + 1) for i in range(1, items + 1) if (u + i) % 3]
    return spark.createDataFrame(cells + [(1, 0, 2.0)] * 3, RATING)


def factors(df):
    return {r.id: np.array(r.features) for r in df.collect()}


def distance(a, b):
    assert a.keys() == b.keys()
    return max(abs(a[k] - b[k]).max() for k in a)


def test_no_block_too_large_is_given_to_the_library(spark, monkeypatch):
    ratings = rows_of(spark)
    library = train(ratings, iterations=3)
    fitted = []
    fit = training.ALS.fit
    monkeypatch.setattr(training, "RATINGS_PER_BLOCK", 10)
    monkeypatch.setattr(training.ALS, "fit", lambda self, rows: fitted.append(rows.count()) or fit(self, rows))
    model = train(ratings, iterations=3)
    assert model.solver == "blocks" and fitted == [60]  # one row a user, for the start
    assert model.user_factors.dtypes == library.user_factors.dtypes == [("id", "int"), ("features", "array<float>")]
    assert distance(factors(model.user_factors), factors(library.user_factors)) < 1e-5
    assert distance(factors(model.item_factors), factors(library.item_factors)) < 1e-5
    assert distance(factors(model.item_factors), factors(train(ratings, iterations=3, seed=6, solver="joins").item_factors)) > 1e-3


@pytest.mark.parametrize("row", [(None, 2, 1.0), (2, None, 1.0), (2, 2, None), (2, 2, float("nan"))])
def test_rows_the_library_rejects(spark, monkeypatch, row):
    monkeypatch.setattr(training, "RATINGS_PER_BLOCK", 10)
    with pytest.raises(Exception, match="(?i)must not be null"):
        train(rows_of(spark).union(spark.createDataFrame([row], RATING)), iterations=1)


def test_null_ids_are_in_no_pair(spark):
    odd = spark.createDataFrame([(None, 2, 1.0), (2, None, 5.0), (None, None, 5.0), (77, None, 1.0)], RATING)
    plain = train(rows_of(spark), iterations=2, solver="joins")
    model = train(rows_of(spark).union(odd), iterations=2, solver="joins")
    assert distance(factors(model.user_factors), factors(plain.user_factors)) < 1e-5
    assert distance(factors(model.item_factors), factors(plain.item_factors)) < 1e-5


def test_a_task_is_sent_each_vector_once(spark, monkeypatch):
    """What travels in a half-step are vectors of (task, id); before, it was one for each pair."""
    monkeypatch.setattr(join_training, "PAIRS_AT_LEAST", 500)
    pairs = join_training._pairs(rows_of(spark))
    none = {key: spark.createDataFrame([], f"{key} int, salts int") for key in join_training.SIDES}
    layout = join_training._layout(pairs, "item_id", "user_id", none, {"item_id": 0}, 4).collect()
    packs, routes = [r for r in layout if r.block is None], [r for r in layout if r.block is not None]
    assert sum(len(r.codes) // 4 for r in packs) == pairs.count() == 1601
    sent = sum(len(r.ids) // 4 for r in routes)
    assert sent <= 60 * len(packs) == 240
    assert len({(r.task, r.block) for r in routes}) == len(routes)


def test_a_fit_leaves_its_factors_alone(spark):
    """Packed pairs and the factors of earlier steps go with the step that needs them last."""
    train(rows_of(spark), iterations=1, solver="joins")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    model = train(rows_of(spark), iterations=3, solver="joins")
    tables = {name for name in set(os.listdir(folder)) - before if name.startswith("table-")}
    assert len(tables) == 2 and model.user_factors.count() == 60 and model.item_factors.count() == 41


def test_residuals_in_passes(spark, monkeypatch):
    ratings = rows_of(spark).union(spark.createDataFrame([(None, 3, 1.0), (500, 3, 1.0)], RATING)).persist()
    model = train(rows_of(spark), iterations=2)
    whole = {r.user_id: r.residual for r in fit_residuals(model, ratings).collect()}
    monkeypatch.setattr(training, "RATINGS_PER_PASS", 300)
    found = fit_residuals(model, ratings)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    parts = found.collect()
    assert {r.user_id: r.residual for r in parts} == pytest.approx(whole, abs=1e-9) and len(parts) == len(whole) == 60


def test_scores_in_passes(spark, monkeypatch):
    model = train(rows_of(spark), iterations=2)
    pairs = rows_of(spark).select("user_id", "item_id").union(
        spark.createDataFrame([(1, 999), (999, 1), (None, 1), (1, None)], "user_id int, item_id int"))
    whole = score(model, pairs).collect()
    monkeypatch.setattr(scoring, "PAIRS_PER_PASS", 300)
    found = score(model, pairs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == sorted(whole) and len(whole) == 1603
