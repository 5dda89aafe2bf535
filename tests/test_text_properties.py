"""Random text against Python's own number and CSV parsers, one job each."""

import csv
import io
import math
import random

from pyspark.sql import functions as F

from tastewright.functions import to_int, to_number
from tastewright.sources import parse_items


def python_value(parse, text):
    try:
        return parse(text)
    except ValueError:
        return None


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == b or (math.isnan(a) and math.isnan(b))


def test_numbers(spark):
    random.seed(11)
    texts = ["".join(random.choices("0123456789+-.eEdDfF xL", k=random.randint(0, 6))) for _ in range(20000)]
    texts += ["nan", "NaN", "+nan", "inf", "-Inf", "infinity", "Infinit", "nand", "1e999", "1e-999",
              "\t7\t", "2147483647", "2147483648", "-2147483648", "-2147483649", "007", "+0"]
    table = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    for row in table.select("t", to_number(F.col("t")).alias("x"), to_int(F.col("t")).alias("n")).collect():
        assert same(row.x, python_value(float, row.t)), row
        whole = python_value(int, row.t)
        if whole is not None and not -(2**31) <= whole < 2**31:
            whole = None
        assert row.n == whole, row


def test_csv_titles(spark):
    random.seed(12)
    titles = ["".join(random.choices('ab",\\\' ;#\té', k=random.randint(0, 8))) for _ in range(5000)]
    lines = []
    for n, title in enumerate(titles):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([n, title, "more,x" if n % 2 else "plain"])
        lines.append((out.getvalue(),))
    parsed = parse_items(spark.createDataFrame(lines, "value string").repartition(8))
    found = {r.item_id: r.title for r in parsed.collect()}
    assert found == dict(enumerate(titles))
