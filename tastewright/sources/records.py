"""Ratings and catalogue sources.

Text inputs carry no header. Fields after the ones used are ignored, and a
short, blank or malformed line fails any job that reads it, also one that only
counts. So does a row of a columnar input with a NULL or an id out of range.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastewright.functions import csv_fields, csv_struct, naive_fields, required, to_int, to_number
from tastewright.schemas import ITEM, RATING

# "csv" honours double quotes, "naive_split" cuts at every comma.
DIALECTS = ("csv", "naive_split")

ARROW_TYPES = {"integer": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _fields(lines: DataFrame, count: int, dialect: str) -> tuple[DataFrame, list[Column]]:
    """The lines with their fields, and the first ``count`` fields."""
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {sorted(DIALECTS)}, not {dialect!r}")
    line = F.col("value")
    if dialect == "csv":
        lines = lines.withColumn("parsed", csv_struct(line, count))
        cut = lines.withColumn("fields", csv_fields(line, F.col("parsed"), count))
    else:
        cut = lines.withColumn("fields", naive_fields(line, count))
    return cut, [F.get("fields", F.lit(i)) for i in range(count)]


def _checked(rows: DataFrame, names: list[str], fields: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """``fields`` of each row, all computed even where a query uses none.

    As the output of a generator they are not pruned, so their checks hold for
    counts as well.
    """
    named = [field.alias(name) for name, field in zip(names, fields)]
    return rows.select(F.inline(F.array(F.struct(*named))), *keep).select(*names, *keep)


def parse_ratings(lines: DataFrame, dialect: str = "csv") -> DataFrame:
    """Lines in column ``value`` to (user_id, item_id, rating)."""
    cut, (user, item, rating) = _fields(lines, 3, dialect)
    line = F.col("value")
    return _checked(cut, RATING.names, [
        required(to_int(user), "user id", line),
        required(to_int(item), "item id", line),
        required(to_number(rating), "rating", line),
    ])


def parse_items(lines: DataFrame, dialect: str = "csv", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines in column ``value`` to (item_id, title) and the columns in ``keep``."""
    cut, (item, title) = _fields(lines, 2, dialect)
    line = F.col("value")
    # The CSV parser gives NULL for an empty field; a missing one has no comma before it.
    title = F.when(F.contains(line, F.lit(",")), F.coalesce(title, F.lit("")))
    return _checked(cut, ITEM.names, [
        required(to_int(item), "item id", line),
        required(title, "title", line),
    ], keep)


def _columns(spark: SparkSession, path, file_format: str, schema) -> DataFrame:
    table = spark.read.format(file_format).load(path)
    row = F.to_json(F.struct(*[F.col(f.name) for f in schema]))
    return _checked(table, schema.names, [
        required(F.col(f.name).try_cast(f.dataType), f.name, row) for f in schema
    ])


def read_ratings(spark: SparkSession, path, file_format: str = "text", dialect: str = "csv") -> DataFrame:
    """Ratings from text lines, or from a columnar table with the RATING columns."""
    if file_format == "text":
        return parse_ratings(spark.read.text(path), dialect)
    return _columns(spark, path, file_format, RATING)


def read_items(
    spark: SparkSession,
    path,
    file_format: str = "text",
    dialect: str = "csv",
    with_order: bool = False,
) -> DataFrame:
    """Catalogue from text lines, or from a columnar table with the ITEM columns.

    ``with_order`` adds ``line_order``, which sorts lines as they stand in the
    files, for operators where a later line wins.
    """
    if file_format != "text":
        if with_order:
            raise ValueError("only text files have a line order")
        return _columns(spark, path, file_format, ITEM)
    lines = spark.read.text(path)
    if not with_order:
        return parse_items(lines, dialect)
    lines = lines.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_order"),
    )
    return parse_items(lines, dialect, keep=("line_order",))


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows held by the driver; handed over as Arrow, they have a known size."""
    columns = zip(*rows) if rows else [()] * len(schema)
    arrays = [pa.array(c, ARROW_TYPES[f.dataType.typeName()]) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, schema.names), schema)


def new_ratings(spark: SparkSession, rows: Iterable[tuple[int, int, float]] = ()) -> DataFrame:
    """Ratings typed in by one person, held in memory; may be empty."""
    return local_table(spark, [(int(u), int(i), float(r)) for u, i, r in rows], RATING)
