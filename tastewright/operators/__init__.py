from tastewright.operators.candidates import candidates, supported_items, unrated
from tastewright.operators.capture import capture_ratings
from tastewright.operators.catalogue import list_titles, search_many, search_titles, store_titles, title_map
from tastewright.operators.lookup import lookup
from tastewright.operators.ranking import (
    add_titles,
    count_titles,
    format_list,
    number_rows,
    preview,
    rank_titles,
    top_scored,
)
from tastewright.operators.scoring import score, score_items, top_items
from tastewright.operators.statistics import dataset_summary, item_stats, rating_counts
from tastewright.operators.training import (
    FactorModel,
    fit_residuals,
    train,
    training_set,
)

__all__ = [
    "FactorModel",
    "add_titles",
    "candidates",
    "capture_ratings",
    "count_titles",
    "dataset_summary",
    "fit_residuals",
    "format_list",
    "item_stats",
    "list_titles",
    "lookup",
    "number_rows",
    "preview",
    "rank_titles",
    "rating_counts",
    "score",
    "score_items",
    "search_many",
    "search_titles",
    "store_titles",
    "supported_items",
    "title_map",
    "top_items",
    "top_scored",
    "train",
    "training_set",
    "unrated",
]
