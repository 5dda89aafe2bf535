from tastewright.plans.checking import check_lists, plain_lists
from tastewright.plans.recommendation import (
    RatingSession,
    recommend,
    recommend_for_session,
    recommend_for_sessions,
    recommend_many,
)

__all__ = [
    "RatingSession",
    "check_lists",
    "plain_lists",
    "recommend",
    "recommend_for_session",
    "recommend_for_sessions",
    "recommend_many",
]
