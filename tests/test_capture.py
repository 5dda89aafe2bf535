import pytest

from tastewright.operators import capture_ratings, title_map
from tastewright.plans import RatingSession
from tastewright.schemas import ITEM, SUBMISSION

ITEMS = [(3, "Three"), (12, "Dup"), (13, "Dup"), (99, "")]


@pytest.fixture
def titles(spark):
    return title_map(spark.createDataFrame(ITEMS, ITEM))


def captured(spark, titles, *submissions):
    return sorted(tuple(r) for r in capture_ratings(
        spark.createDataFrame([(0, *s) for s in submissions], SUBMISSION), titles
    ).collect())


@pytest.mark.parametrize("text,value", [
    ("0.1", 0.1), ("5.9", 5.9), (" 3 ", 3.0), ("+4", 4.0), ("1e0", 1.0), ("5.", 5.0), (".5", 0.5),
])
def test_accepted(spark, titles, text, value):
    assert captured(spark, titles, ("Three", text)) == [(0, 3, value)]


@pytest.mark.parametrize(
    "text", ["0", "6", "-1", "abc", "4d", "4f", "nan", "inf", "-inf", "", "4 5", "0x4", None]
)
def test_rejected_text(spark, titles, text):
    assert captured(spark, titles, ("Three", text)) == []


def test_titles(spark, titles):
    assert captured(spark, titles, ("", "4"), ("three", "4"), (None, "4"), ("Dup", "4")) == [(0, 13, 4.0)]


def test_repeated_submissions_all_count(spark, titles):
    assert captured(spark, titles, ("Three", "5"), ("Three", "1")) == [(0, 3, 1.0), (0, 3, 5.0)]


def test_session_accumulates(spark, titles):
    session = RatingSession()
    assert session.ratings(spark, titles).count() == 0
    session.submit("Three", "5")
    session.submit("Nobody", "5")
    assert session.ratings(spark, titles).count() == 1
    session.submit("Dup", "2")
    assert sorted(tuple(r) for r in session.ratings(spark, titles).collect()) == [(0, 3, 5.0), (0, 13, 2.0)]
