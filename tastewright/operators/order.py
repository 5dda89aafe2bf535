"""Global order by distributed sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastewright.session import use_checkpoint_folder


def sorted_rows(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` in the given order, by a distributed sort.

    The last sort key differs for every row, so that even many equal rows
    spread over partitions.
    """
    return rows.withColumn("row", F.monotonically_increasing_id()).orderBy(*order, "row").drop("row")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with their place, from 1, in the given order.

    Each range partition of the sorted rows numbers its own, and adds the rows
    of all partitions before it. The sorted rows are checkpointed, because both
    parts must see the same ranges.
    """
    use_checkpoint_folder(rows.sparkSession)
    ordered = (
        sorted_rows(rows, *order)
        .select(
            *rows.columns,
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("in_part"),
        )
        .checkpoint()
    )
    # One row per sort partition: bounded by spark.sql.shuffle.partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("part").agg(F.count("*").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
    )
    return ordered.join(F.broadcast(offsets), "part").select(
        (F.col("before") + F.col("in_part") + 1).alias("position"), *rows.columns
    )
