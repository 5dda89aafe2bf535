"""Joins with a side that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame

ANY_NUMBER = (1 << 31) - 1


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join where only ``rows`` may be skewed on ``key``.

    Adaptive execution splits the rows of a hot key over tasks, but only where
    both sides come straight out of a shuffle made for the join. A grouped
    ``table`` would be joined in place, as it is already placed by the key;
    ``coalesce`` has that placement forgotten, at the price of shuffling the
    smaller side once more. Its limit is above any number of partitions, so no
    task is merged away. It stays open to a broadcast by size.
    """
    return rows.join(table.coalesce(ANY_NUMBER), key, how)
