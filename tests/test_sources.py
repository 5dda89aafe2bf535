import pytest
from pyspark.sql import functions as F

from tastewright.operators import title_map
from tastewright.schemas import ITEM, RATING
from tastewright.sources import new_ratings, parse_items, parse_ratings, read_items, read_ratings

DIALECTS = ["csv", "naive_split"]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("dialect", DIALECTS)
def test_rating_lines(spark, dialect):
    parsed = parse_ratings(lines(spark, "1,10,4.5,111", " 2, 11 ,3,222", "3,12,1e0", "4,13,.5,"), dialect)
    assert [(f.name, f.dataType) for f in parsed.schema] == [(f.name, f.dataType) for f in RATING]
    assert rows(parsed) == [(1, 10, 4.5), (2, 11, 3.0), (3, 12, 1.0), (4, 13, 0.5)]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("dialect", DIALECTS)
@pytest.mark.parametrize("line", [
    "user,item,rating",
    "1,2",
    "",
    "3000000000,1,1",
    "1.0,1,1",
    "1L,1,1",
    "1,1,4d",
    "1,1,4f",
    "1,1,",
    "1,1,abc",
])
def test_malformed_rating_line_fails(spark, dialect, line, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="missing or malformed"):
            parse_ratings(lines(spark, "1,2,3", line), dialect).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_nan_and_infinity_are_numbers(spark):
    parsed = parse_ratings(lines(spark, "1,1,nan", "1,2,inf", "1,3,-Infinity"))
    assert [str(r.rating) for r in parsed.orderBy("item_id").collect()] == ["nan", "inf", "-inf"]


def test_quoted_title(spark):
    quoted = lines(spark, '11,"American President, The (1995)",Comedy')
    assert rows(parse_items(quoted)) == [(11, "American President, The (1995)")]
    assert rows(parse_items(quoted, "naive_split")) == [(11, '"American President')]


def test_item_lines(spark):
    parsed = parse_items(lines(spark, "1,Plain,x,y", '2,"Say ""hi""",z', "3,", "4, spaced "))
    assert [(f.name, f.dataType) for f in parsed.schema] == [(f.name, f.dataType) for f in ITEM]
    assert rows(parsed) == [(1, "Plain"), (2, 'Say "hi"'), (3, ""), (4, " spaced ")]


@pytest.mark.parametrize("dialect", DIALECTS)
@pytest.mark.parametrize("line", ["5", "", "x,Title"])
def test_malformed_item_line_fails(spark, dialect, line):
    with pytest.raises(Exception, match="missing or malformed"):
        parse_items(lines(spark, line), dialect).collect()


def test_unknown_dialect(spark):
    with pytest.raises(ValueError):
        parse_items(lines(spark, "1,a"), "tsv")


def test_text_files(spark, tmp_path):
    (tmp_path / "ratings.csv").write_bytes(b"1,2,3\r\n1,3,4.5\r\n")
    assert rows(read_ratings(spark, str(tmp_path / "ratings.csv"))) == [(1, 2, 3.0), (1, 3, 4.5)]


def test_columnar_files(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3.0)], "user_id long, item_id long, rating float").write.orc(
        str(tmp_path / "ratings")
    )
    ratings = read_ratings(spark, str(tmp_path / "ratings"), "orc")
    assert ratings.dtypes == [("user_id", "int"), ("item_id", "int"), ("rating", "double")]
    assert rows(ratings) == [(1, 2, 3.0)]
    spark.createDataFrame([(1, "a", 0)], "item_id int, title string, more int").write.parquet(
        str(tmp_path / "items")
    )
    assert rows(read_items(spark, str(tmp_path / "items"), "parquet")) == [(1, "a")]
    with pytest.raises(ValueError):
        read_items(spark, str(tmp_path / "items"), "parquet", with_order=True)


def test_last_line_wins_over_many_splits(spark, tmp_path):
    """Ids fall along the file, so that the largest id is not the last."""
    path = tmp_path / "items.csv"
    n = 4000
    path.write_text("".join(f"{n - i},title {i % 100}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        items = read_items(spark, str(path), with_order=True)
        assert items.rdd.getNumPartitions() > 5
        found = dict(rows(title_map(items)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = {f"title {i % 100}": n - i for i in range(n)}
    assert found == expected


def test_last_file_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("9,Dup\n" + "8,filler\n" * 50)
    (tmp_path / "b.csv").write_text("3,Dup\n")
    items = read_items(spark, str(tmp_path), with_order=True)
    assert dict(rows(title_map(items)))["Dup"] == 3


def test_title_map_without_order(spark):
    items = spark.createDataFrame([(12, "Dup"), (13, "Dup"), (1, "One")], ITEM)
    assert dict(rows(title_map(items))) == {"Dup": 13, "One": 1}


def test_new_ratings(spark):
    assert rows(new_ratings(spark, [(0, 3, 5.0), (0, 3, 1)])) == [(0, 3, 1.0), (0, 3, 5.0)]
    empty = new_ratings(spark)
    assert empty.count() == 0
    assert empty.dtypes == [("user_id", "int"), ("item_id", "int"), ("rating", "double")]


@pytest.mark.parametrize("dialect", ["csv", "naive_split"])
@pytest.mark.parametrize("bad", ["userId,movieId,rating", "", "1,2", "1,2,abc", "3000000000,1,2"])
def test_counts_fail_on_malformed_lines(spark, tmp_path, dialect, bad):
    (tmp_path / "ratings.csv").write_text(f"1,10,4.0\n{bad}\n")
    rows = read_ratings(spark, str(tmp_path), dialect=dialect)
    for asked in (rows, rows.groupBy("item_id").count()):
        with pytest.raises(Exception, match="malformed"):
            asked.agg(F.count("*")).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_columnar_rows_are_checked(spark, tmp_path, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for k, row in enumerate([(3000000000, 1, 2.0), (None, 1, 2.0), (1, 1, None)]):
            path = f"{tmp_path}/{k}"
            spark.createDataFrame([row], "user_id long, item_id long, rating double").write.parquet(path)
            with pytest.raises(Exception, match="malformed"):
                read_ratings(spark, path, "parquet").agg(F.count("*")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_a_quoted_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "items.csv").write_text('1,"a, b"\n2,b\n')
    rows = read_items(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv") == 1
    assert {r.title for r in rows.collect()} == {"a, b", "b"}
