"""Column functions on text; all of them stay built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastewright.schemas import LIST_HEADING, LIST_SEPARATOR

# What counts as a written number. Spark's own cast also takes a type suffix,
# as in "4d" or "4f", which is no number here, and takes no sign before "nan".
NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
NOT_A_NUMBER = r"(?i)^\s*[+-]?nan\s*$"


def to_number(text: Column) -> Column:
    """Text as DOUBLE, NULL where it is not written as one."""
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(
        text.rlike(NOT_A_NUMBER), F.lit(float("nan"))
    )


def to_int(text: Column) -> Column:
    """Text as INT, NULL where it is no 32-bit whole number."""
    return text.try_cast("int")


def required(value: Column, what: str, line: Column) -> Column:
    """``value``, failing the job where it is NULL, in either ANSI mode."""
    message = F.concat(F.lit(f"{what} missing or malformed in line: "), F.coalesce(line, F.lit("")))
    return F.coalesce(value, F.raise_error(message))


def naive_fields(line: Column, count: int) -> Column:
    """A line cut at every comma, quotes not honoured."""
    return F.split(line, ",", -1)


def csv_fields(line: Column, parsed: Column, count: int) -> Column:
    """At least the first ``count`` fields of a CSV line with double quotes.

    ``parsed`` is the line's ``csv_struct``, a column of its own so that a line
    is parsed once. A line without a quote is the same either way, and cutting
    it is cheaper.
    """
    has_quote = F.contains(line, F.lit('"'))
    quoted = F.array(*[parsed[f"f{i}"] for i in range(count)])
    return F.when(has_quote, quoted).otherwise(naive_fields(line, count))


def csv_struct(line: Column, count: int) -> Column:
    """The first ``count`` fields of a line with quotes, as a struct; NULL for a line without."""
    schema = ", ".join(f"f{i} string" for i in range(count))
    options = {"mode": "PERMISSIVE", "escape": '"'}
    return F.from_csv(F.when(F.contains(line, F.lit('"')), line), schema, options)


def has_prefix(text: Column, prefix: Column) -> Column:
    """Starts-with, ignoring case; the empty prefix matches everything."""
    return F.startswith(F.lower(text), F.lower(prefix))


def bullet_list(titles: Column) -> Column:
    """An array of titles as the displayed list."""
    return F.concat(F.lit(LIST_HEADING), F.array_join(titles, LIST_SEPARATOR))
