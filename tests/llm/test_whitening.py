"""Whitening against numpy, the qd solver against numpy's."""

import numpy as np
import pytest

from tastewright.llm import queries, whitening
from tastewright.llm.qd import bidiagonal, right_vectors

FOLDER = "/root/testdata/sf0.01"


def matrices():
    rng = np.random.default_rng(0)
    x, y = (np.linalg.qr(rng.normal(size=(48, 48)))[0] for _ in range(2))
    for n in (1, 2, 3, 8, 64, 130):
        yield f"normal {n}", rng.normal(size=(n, n))
    yield "unit", np.eye(30)
    yield "zero", np.zeros((5, 5))
    yield "two values", x @ np.diag(np.r_[np.ones(24), 2 * np.ones(24)]) @ y
    yield "rank 10", x @ np.diag(np.r_[np.ones(10), np.zeros(38)]) @ y
    yield "close", x @ np.diag(1 + 1e-9 * np.arange(48)) @ y
    yield "graded", x @ np.diag(10.0 ** -np.arange(48).clip(0, 12)) @ y
    yield "wilkinson", np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1)
    for _ in range(40):
        n = int(rng.integers(2, 40))
        yield "zeros", np.diag(rng.integers(-2, 3, n).astype(float)) + np.diag(rng.integers(-1, 2, n - 1).astype(float), 1)


@pytest.mark.parametrize("name, r", list(matrices()))
def test_right_vectors(name, r):
    squares, vectors = right_vectors(r)
    expected = np.linalg.svd(r, compute_uv=False) ** 2
    size = max(expected[0], 1e-300)
    assert (np.diff(squares) <= 0).all() and np.abs(squares - expected).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(r))).max() < 1e-11
    assert np.abs(r.T @ r @ vectors - vectors * squares).max() <= 1e-12 * size
    a, b, v = bidiagonal(r)
    banded = np.diag(a) + np.diag(b, 1)
    assert np.allclose(v @ banded.T @ banded @ v.T, r.T @ r, atol=1e-12 * size)


def test_small_values_keep_their_digits():
    # relative accuracy, which a solver working on r^T r loses
    a, b = 10.0 ** -np.arange(8), 0.5 * 10.0 ** -np.arange(1, 8)
    from tastewright.llm.qd import squares
    values = squares(a, b)
    product = np.prod(a) ** 2
    assert abs(np.prod(values) / product - 1) < 1e-12


def brute(vectors):
    """x, n, sums, eigenvalues (falling) and eigenvectors of the vectors that stay."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, centred, values[::-1], columns[:, ::-1]


def held_against(rows, vectors, ids, k=8):
    x, n, sums, centred, values, columns = brute(vectors)
    k = min(k, x.shape[1])
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == n * k and set(found) == set(ids)
    ours = np.array([[found[i][c].whitened for c in range(1, k + 1)] for i in ids])
    theirs = centred @ columns[:, :k] / np.sqrt(values[:k])
    sign = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours * sign - theirs).max() < 1e-8
    for row, i in enumerate(ids):
        exact = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[row], sums))
        assert all(r.deviation == exact and r.n == n for r in found[i].values())
        assert abs(found[i][1].spread / max(exact / n**2, 1e-300) - 1) < 1e-9
    for c in range(k):
        assert abs(found[ids[0]][c + 1].explained / (values[c] / values.sum()) - 1) < 1e-9
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query_against_numpy(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    held_against(queries.op11_whitening(spark, FOLDER).collect(), [r.embedding for r in table], [r.vec_id for r in table])


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(50, 5)).astype(np.float32).tolist()
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]),
           (104, [float("inf")] * 5), (105, [1.0, 2.0]), (106, [1.0] * 9)]
    rows = [(i, v, "n", 1.0) for i, v in [*enumerate(good), *odd]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `dotted.name` string, whitened double").repartition(7)
    held_against(whitening.whiten(frame).collect(), good, list(range(50)))
    as_double = frame.withColumn("embedding", frame.embedding.cast("array<double>"))
    held_against(whitening.whiten(as_double, components=3).collect(), good, list(range(50)), 3)
    assert whitening.whiten(frame.where("vec_id >= 100 AND vec_id < 105")).count() == 0
    assert whitening.whiten(frame.where("false")).columns == whitening.whiten(frame).columns
    # equal rows and rows without an id all count
    twice = spark.createDataFrame([(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [0.0, 3.0])], "vec_id long, embedding array<float>")
    found = whitening.whiten(twice).collect()
    assert len(found) == 6 and {r.n for r in found} == {3}
    assert {r.whitened is None for r in found if r.component == 2} == {True}
    first = sorted(round(r.whitened, 9) for r in found if r.component == 1)
    assert first == [-0.707106781, -0.707106781, 1.414213562] and found[0].identity_error < 1e-12
    one = whitening.whiten(twice.where("vec_id = 1")).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in one] == [(None, 0, 0.0, 0.0)] * 2


def test_deviation_beyond_a_long(spark):
    frame = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [3e38, 0.0])], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in whitening.whiten(frame).where("component = 1").collect()}
    assert found[3].deviation is None and found[3].spread > 1e36
    near = spark.createDataFrame([(1, [1e5]), (2, [-1e5])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(near).collect()} == {(2 * 102400000) ** 2}
    edge = whitening.Centre(2, [0])
    x = np.array([[1518500249], [1518500250]])  # squares of twice these are 4 * about 2**61.01
    spread = (x.astype(float) ** 2).sum(axis=1)
    told = edge.deviations(x, spread)
    assert told.mask.tolist() == [(2 * int(v)) ** 2 >= 1 << 63 for v in x.ravel()]


def test_rounds_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 200)
    rng = np.random.default_rng(9)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 5).tolist()
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(9)
    held_against(whitening.whiten(frame).collect(), vectors, list(range(300)))
