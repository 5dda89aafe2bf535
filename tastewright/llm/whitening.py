"""Embedding whitening: rows centred, rotated to principal components, scaled to unit variance.

An entry c, as double, becomes the long x = floor(1024 c) + 100000, and all sums
are of whole numbers. Each partition reduces its centred rows to an upper
triangle by blockwise QR; the triangles are reduced in rounds of ``FAN`` until
one is left, of which ``qd`` gives singular values and right vectors. The driver
holds that triangle and the sums: both as wide as a vector, whatever the rows.

Defined results: rows without a vector, or with a null or non-finite entry, are
dropped, as are vectors without entries. Vectors differ in length: those of the
most frequent length stay (of equal ones the longest). ``|x|`` ends at 2**62. A
component without variance (one row, constant or dependent entries) has
``whitened`` null and is left out of ``identity_error``. Of equal variances any
orthonormal vectors are given; a component's largest entry is positive. Rows of
equal or no id are separate rows, all counted. ``deviation`` is null where it is
no long, which n from some millions on makes it; ``spread`` is the same over n
squared. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastewright.llm.common import quoted, ranges, stored, sums_by_row
from tastewright.llm.qd import EPS, right_vectors

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Triangles that a task of the next round reduces to one.
FAN = 32
#: Entries of a block that is worked on at once.
BLOCK_ENTRIES = 1 << 21
MOST = 1 << 62
LOW_BITS = 31


def _entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat entries, and for each row where it starts, its length and whether all of it is finite."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
    finite = sums_by_row(~np.isfinite(flat), lengths, np.int64) == 0
    return flat, np.cumsum(lengths) - lengths, lengths, finite & (lengths > 0)


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """The longs x of some entries."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * entries)
    return np.clip(scaled, -MOST, MOST).astype(np.int64) + OFFSET


def _blocks(batches, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``(batch, rows, x)``: blocks of the rows whose vector stays, with their x."""
    step = max(1, BLOCK_ENTRIES // size)
    for batch in batches:
        flat, starts, lengths, finite = _entries(batch.column("vector"))
        rows = np.flatnonzero(finite & (lengths == size))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            x = flat[ranges(starts[some], lengths[some])].reshape(-1, size)
            yield batch, some, whole_numbers(x)


def _sums(batches):
    """Sums of x by vector length and dimension, in two parts that cannot overflow."""
    for batch in batches:
        flat, starts, lengths, finite = _entries(batch.column("vector"))
        for size in np.unique(lengths[finite]).tolist():
            rows = np.flatnonzero(finite & (lengths == size))
            x = whole_numbers(flat[ranges(starts[rows], lengths[rows])].reshape(-1, size))
            high, low = x >> LOW_BITS, x & ((1 << LOW_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                 pa.array(np.full(size, len(rows), np.int64)), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0))],
                names=["size", "dim", "n", "high", "low"])


class Centre:
    """Number of vectors and their sums; takes the mean off rows with one rounding."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.size, self.sums = n, len(sums), sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Sums of ``(n x - S) ** 2`` as longs and where they are none, as a masked array.

        Longs wrap around, which leaves a sum right that is a long itself.
        """
        wrapped = np.array([s & (1 << 64) - 1 for s in self.sums], np.uint64).view(np.int64)
        n = np.uint64(self.n & (1 << 64) - 1).astype(np.int64)
        with np.errstate(over="ignore"):
            d = x * n - wrapped
            total = (d * d).sum(axis=1)
        size = spread * float(self.n) ** 2
        over = size >= 2.0**63
        for row in np.flatnonzero(abs(size / 2.0**63 - 1) < 1e-6).tolist():  # too near for a double to tell
            over[row] = sum((self.n * v - s) ** 2 for v, s in zip(x[row].tolist(), self.sums)) >= 1 << 63
        return np.ma.array(total, mask=over)


def _centre(vectors: DataFrame) -> Centre | None:
    parts = vectors.mapInArrow(_sums, "size int, dim int, n long, high long, low long")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = stored(parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), big("high"), big("low")))
    top = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return None
    rows = sums.where(F.col("size") == top["size"]).orderBy("dim").collect()  # as many as a vector has entries
    return Centre(top.n, [(int(r.high) << LOW_BITS) + int(r.low) for r in rows])


def _triangle(blocks, size: int) -> np.ndarray:
    """The triangle R of the QR decomposition of all rows, taken block by block."""
    r, held = np.zeros((0, size)), []
    for block in blocks:
        held.append(block)
        if sum(map(len, held)) >= 2 * size:
            r, held = np.linalg.qr(np.concatenate([r, *held]), mode="r"), []
    r = np.linalg.qr(np.concatenate([r, *held]), mode="r")
    return np.concatenate([r, np.zeros((size - len(r), size))])


def _reduced(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """The triangle of all centred rows."""
    size = centre.size

    def told(r):
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def first(batches):
        blocks = (centre.rows(x) for _, _, x in _blocks(batches, size))
        some = next(blocks, None)
        if some is not None:
            yield told(_triangle(chain([some], blocks), size))

    def next_round(batches):
        blocks = (np.frombuffer(r.as_buffer(), np.float64).reshape(size, size) for batch in batches for r in batch.column("r"))
        some = next(blocks, None)
        if some is not None:
            yield told(_triangle(chain([some], blocks), size))

    triangles = stored(vectors.mapInArrow(first, "part int, r binary"))
    left = triangles.count()
    while left > 1:
        groups = -(-left // FAN)
        dealt = triangles.repartition(groups, F.pmod(F.col("part"), F.lit(groups)))
        triangles = stored(dealt.mapInArrow(next_round, "part int, r binary"))
        left = triangles.count()
    return np.frombuffer(triangles.first().r, np.float64).reshape(size, size)


class Whitening:
    """Components of a fit list: directions, variances and scaled directions."""

    def __init__(self, centre: Centre, triangle: np.ndarray, components: int):
        squares, vectors = right_vectors(triangle, components)
        self.centre = centre
        total = float((triangle**2).sum())
        self.variances = squares / centre.n
        self.explained = squares / total if total else np.zeros(len(squares))
        largest = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.where(vectors[largest, np.arange(len(squares))] < 0, -1.0, 1.0)
        # rounding leaves this much of a direction without variance
        self.varies = squares > (centre.size * EPS) ** 2 * total if total else np.zeros(len(squares), bool)
        scale = np.where(self.varies, np.sqrt(np.where(self.varies, self.variances, 1.0)), np.inf)
        self.scaled = self.vectors / scale

    def rows(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.scaled


def _identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    size, k = fitted.centre.size, len(fitted.variances)
    i, j = (x.ravel() for x in np.indices((k, k + 1)))

    def products(batches):
        total = np.zeros((k, k + 1))
        for _, _, x in _blocks(batches, size):
            w = fitted.rows(fitted.centre.rows(x))
            total += w.T @ np.column_stack([w, np.ones(len(w))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "total"])

    found = np.zeros((k, k + 1))
    for r in vectors.mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        found[r.i, r.j] = r.total / fitted.centre.n
    error = found[:, :k] - np.outer(found[:, k], found[:, k]) - np.eye(k)
    seen = error[np.ix_(fitted.varies, fitted.varies)]
    return float(np.abs(seen).max()) if seen.size else 0.0


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = rows[quoted(vector_col)]
    if rows.schema[vector_col].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        vector = vector.cast("array<double>")
    return rows.select(rows[quoted(id_col)].alias("vec_id"), vector.alias("vector"))


def fit(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all vectors that stay; None without any."""
    vectors = _vectors(rows, id_col, vector_col).select("vector")
    centre = _centre(vectors)
    return centre and Whitening(centre, _reduced(vectors, centre), components)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that stays and each of the first ``components`` components.

    ``(vec_id, component, n, deviation, whitened, explained, identity_error, spread)``.
    """
    named = _vectors(rows, id_col, vector_col)
    schema = T.StructType([
        T.StructField("vec_id", named.schema["vec_id"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
        T.StructField("spread", T.DoubleType())])
    fitted = fit(rows, components, id_col, vector_col)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, k = _identity_error(named, fitted), len(fitted.variances)

    def whitened(batches):
        for batch, kept, x in _blocks(batches, fitted.centre.size):
            centred = fitted.centre.rows(x)
            spread = (centred**2).sum(axis=1)
            deviation = fitted.centre.deviations(x, spread)
            n = len(kept)
            values = fitted.rows(centred).ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(kept, k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fitted.centre.n)),
                 pa.array(np.repeat(deviation.data, k), mask=np.repeat(np.ma.getmaskarray(deviation), k)),
                 pa.array(values, mask=np.tile(~fitted.varies, n)), pa.array(np.tile(fitted.explained, n)),
                 pa.array(np.full(n * k, error)), pa.array(np.repeat(spread, k))], names=schema.fieldNames())

    return named.mapInArrow(whitened, schema)
