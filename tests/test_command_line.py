import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tastewright.sources import catalogue_table, ratings_table

ROOT = Path(__file__).parents[1]


def test_files_in_text_out(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    ratings, items = ratings_table(spark, folder), catalogue_table(spark, folder)
    ratings.select(F.concat_ws(",", "user_id", "item_id", "rating")).write.text(f"{tmp_path}/ratings")
    items.select(F.concat_ws(",", "item_id", "title")).write.text(f"{tmp_path}/items")
    done = subprocess.run(
        [sys.executable, "-m", "tastewright", "--preset", "movies",
         "--ratings", f"{tmp_path}/ratings", "--items", f"{tmp_path}/items",
         "--rate", "red ring=5", "--rate", "blue bolt=1", "--rate", "nothing=x", "--unique-items",
         "--out", f"{tmp_path}/list"],
        cwd=ROOT, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr
    assert "6000 ratings of 200 items" in done.stdout
    taken = next(x for x in done.stdout.splitlines() if x.startswith("New ratings taken: "))
    assert taken.count("item ") == 2 and "= 5.0" in taken and "= 1.0" in taken
    assert done.stdout.count("\n* ") == 5
    assert spark.read.parquet(f"{tmp_path}/list").select("item_id").distinct().count() == 5
