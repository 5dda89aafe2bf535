from tastewright.sources.records import (
    local_table,
    new_ratings,
    parse_items,
    parse_ratings,
    read_items,
    read_ratings,
)
from tastewright.sources.tables import catalogue_table, ratings_table, submissions_table

__all__ = [
    "catalogue_table",
    "local_table",
    "new_ratings",
    "parse_items",
    "parse_ratings",
    "ratings_table",
    "read_items",
    "read_ratings",
    "submissions_table",
]
