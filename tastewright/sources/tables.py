"""Ratings, catalogue and submissions derived from order tables.

Every order line is a rating of the ordered part by the ordering customer.
User ids are shifted by one, since id 0 belongs to the person asking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ratings_table(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities 1..50 become ratings 1..5."""
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("o_custkey") + 1).cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
    )


def catalogue_table(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("item_id"),
        F.col("p_name").alias("title"),
    )


def submissions_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a typed-in rating: its type and value give the text.

    Most texts are numbers in and out of bounds; some are no numbers, and the
    titles of error events are unknown or empty.
    """
    events = _table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    parts = _table(spark, folder, "part").select("p_partkey", "p_name")
    n_parts = parts.agg(F.count("*")).scalar()
    events = events.withColumn("part", F.pmod("event_id", n_parts))
    value = F.col("value")
    tenth = (F.floor(value) / 10).cast("string")
    kind = F.col("event_type")
    return events.join(parts, F.col("part") == F.col("p_partkey")).select(
        (F.col("user_id") + 1).cast("int").alias("user_id"),
        F.when((kind == "error") & (value < 10), "")
        .when(kind == "error", F.concat("p_name", F.lit(" (unknown)")))
        .otherwise(F.col("p_name")).alias("title"),
        F.when(kind == "view", F.concat(F.lit(" "), tenth, F.lit(" ")))
        .when((kind == "click") & (value < 50), F.concat(tenth, F.lit("d")))
        .when((kind == "click") & (value < 100), "nan")
        .when((kind == "signup") & (value < 50), "")
        .when((kind == "signup") & (value < 100), "five")
        .otherwise(tenth).alias("rating_text"),
    )
