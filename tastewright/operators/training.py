"""Training set and explicit-feedback alternating least squares."""

from __future__ import annotations

from dataclasses import dataclass
from time import perf_counter

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.functions import dot
from tastewright.operators.join_training import train_by_joins
from tastewright.operators.lookup import lookup
from tastewright.operators.passes import in_passes
from tastewright.schemas import BLOCKS, ITERATIONS, RANK, REGULARIZATION, SEED, SOLVER
from tastewright.session import use_checkpoint_folder


# Ratings of a block, on average, up to which the library's block solver is used:
# a task of it holds several copies of a block.
RATINGS_PER_BLOCK = 5_000_000
# Ratings whose joins with factors and sums by user are on disk at once.
RATINGS_PER_PASS = 50_000_000


@dataclass(frozen=True)
class FactorModel:
    """Fitted factors, (id INT, features ARRAY<FLOAT>), ids unique."""

    user_factors: DataFrame
    item_factors: DataFrame
    rank: int
    seconds: float
    solver: str


def training_set(ratings: DataFrame, new: DataFrame) -> DataFrame:
    """Base ratings and new ones; repeated ratings are all kept."""
    return ratings.unionByName(new)


def train(
    ratings: DataFrame,
    rank: int = RANK,
    iterations: int = ITERATIONS,
    regularization: float = REGULARIZATION,
    seed: int = SEED,
    solver: str = SOLVER,
    blocks: int = BLOCKS,
) -> FactorModel:
    """Fit ``rating ~ user . item``, the penalty weighted by rating counts.

    ``solver`` ("blocks" or "joins") and ``blocks`` set the start point, so they
    are part of the model like ``seed``; neither follows from the data or the
    cluster. ``seconds`` is the wall time of the fit.
    """
    use_checkpoint_folder(ratings.sparkSession)
    started = perf_counter()
    if solver == "joins":
        users, items = train_by_joins(ratings, rank, iterations, regularization, seed)
    elif solver == "blocks":
        users, items = _train_by_blocks(ratings, rank, iterations, regularization, seed, blocks)
    else:
        raise ValueError(f"solver must be 'blocks' or 'joins', not {solver!r}")
    return FactorModel(users, items, rank, round(perf_counter() - started, 3), solver)


def _train_by_blocks(
    ratings: DataFrame, rank: int, iterations: int, regularization: float, seed: int, blocks: int
) -> tuple[DataFrame, DataFrame]:
    """The factors of the library's block solver.

    It holds all ratings of a block in one task. Where these are too many, the
    library draws its first user factors, which follow from the user ids, the
    seed and ``blocks`` alone, and the same steps from there are done in tasks of
    bounded size: the factors differ by rounding alone.
    """
    als = ALS(
        userCol="user_id",
        itemCol="item_id",
        ratingCol="rating",
        rank=rank,
        maxIter=iterations,
        regParam=regularization,
        seed=seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        coldStartStrategy="drop",
    )
    if iterations == 0 or ratings.count() <= blocks * RATINGS_PER_BLOCK:
        model = als.fit(ratings)
        return model.userFactors, model.itemFactors
    known = [
        F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"{key} must not be NULL"))).alias(key)
        for key in ("user_id", "item_id")
    ]
    checked = ratings.select(*known, F.col("rating").cast("float").alias("rating"))
    users = ratings.select("user_id").distinct()
    start = als.copy({als.maxIter: 0}).fit(
        users.select("user_id", F.lit(0).alias("item_id"), F.lit(1.0).alias("rating"))
    )
    return train_by_joins(checked, rank, iterations, regularization, seed, start.userFactors)


def fit_residuals(
    model: FactorModel, ratings: DataFrame, regularization: float = REGULARIZATION
) -> DataFrame:
    """How far each user's factors are from solving their normal equations.

    For user factors w and item factors v the largest component of
    ``| sum v (v.w - r) + regularization n w |``. The users are solved for
    last, so a finished fit leaves about nothing.
    """
    users = model.user_factors.select(F.col("id").alias("user_id"), F.col("features").alias("w"))
    items = model.item_factors.select(F.col("id").alias("item_id"), F.col("features").alias("v"))
    error = (dot("v", "w", model.rank).cast("double") - F.col("rating")).alias("error")

    def residuals(some: DataFrame) -> DataFrame:
        # The join just before the sums is on the other id, so that adaptive
        # execution may split a hot id in either join.
        sums = (
            lookup(lookup(some, users, "user_id"), items, "item_id")
            .select("user_id", "v", error)
            .groupBy("user_id")
            .agg(
                F.count("*").alias("n"),
                *[F.sum(F.col("v")[i] * F.col("error")).alias(f"g{i}") for i in range(model.rank)],
            )
        )
        parts = [
            F.abs(F.col(f"g{i}") + regularization * F.col("n") * F.col("w")[i])
            for i in range(model.rank)
        ]
        return sums.join(users, "user_id").select("user_id", F.greatest(*parts).alias("residual"))

    return in_passes(ratings, ["user_id"], RATINGS_PER_PASS, residuals)
