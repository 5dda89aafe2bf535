"""Record shapes and the fixed values of the recommender."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RATING = T.StructType([
    T.StructField("user_id", T.IntegerType()),
    T.StructField("item_id", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
])

ITEM = T.StructType([
    T.StructField("item_id", T.IntegerType()),
    T.StructField("title", T.StringType()),
])

SUBMISSION = T.StructType([
    T.StructField("user_id", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("rating_text", T.StringType()),
])

SCORED = T.StructType([
    T.StructField("user_id", T.IntegerType()),
    T.StructField("item_id", T.IntegerType()),
    T.StructField("prediction", T.FloatType()),
])

# Id of the person asking, length of the list, open bounds of a
# valid new rating, training parameters, text of the displayed list.
SESSION_USER = 0
LIST_LENGTH = 5
RATING_ABOVE = 0.0
RATING_BELOW = 6.0
RANK = 8
ITERATIONS = 10
REGULARIZATION = 0.1
SEED = 5
# Also parts of the start point.
SOLVER = "blocks"
BLOCKS = 10
LIST_HEADING = "Recommended For You :\n\n* "
LIST_SEPARATOR = "\n* "


@dataclass(frozen=True)
class Preset:
    """What differs between the supported catalogues."""

    app_name: str
    min_ratings: int


# Smallest number of base ratings an item needs to be listed.
PRESETS = {
    "electronics": Preset("Electronics recommendations", 1),
    "movies": Preset("Movie recommendations", 25),
}
