"""Recommend from files: ``spark-submit`` or ``python -m tastewright --help``."""

from __future__ import annotations

import argparse

from tastewright.operators import dataset_summary, format_list, preview, title_map
from tastewright.plans import RatingSession, recommend_for_session
from tastewright.schemas import BLOCKS, LIST_LENGTH, PRESETS, SESSION_USER, SOLVER
from tastewright.session import spark_session
from tastewright.sources import local_table, read_items, read_ratings
from tastewright.sources.records import DIALECTS


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tastewright", description=__doc__)
    parser.add_argument("--preset", choices=sorted(PRESETS), default="movies")
    parser.add_argument("--ratings", required=True, help="ratings: user,item,rating")
    parser.add_argument("--items", required=True, help="catalogue: item,title")
    parser.add_argument("--format", default="text", help="text, parquet, orc, ...")
    parser.add_argument("--dialect", choices=sorted(DIALECTS), default="csv")
    parser.add_argument(
        "--rate", action="append", default=[], metavar="TITLE=RATING", help="a new rating; repeatable"
    )
    parser.add_argument("--unique-items", action="store_true", help="list an item once, whatever its rows")
    parser.add_argument("--solver", choices=["blocks", "joins"], default=SOLVER)
    parser.add_argument("--blocks", type=int, default=BLOCKS, help="blocks of the block solver")
    parser.add_argument("--length", type=int, default=LIST_LENGTH)
    parser.add_argument("--out", help="also write the list as parquet to this path")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    options = arguments(argv)
    preset = PRESETS[options.preset]
    spark = spark_session(preset.app_name)
    ratings = read_ratings(spark, options.ratings, options.format, options.dialect)
    text = options.format == "text"
    items = read_items(spark, options.items, options.format, options.dialect, with_order=text)

    session = RatingSession()
    for entry in options.rate:
        title, _, rating = entry.rpartition("=")
        session.submit(title, rating)
    new = session.ratings(spark, title_map(items))

    print("New ratings taken: " + "; ".join(f"item {r.item_id} = {r.rating}" for r in preview(new).collect()))
    summary = dataset_summary(ratings, items).first()
    print(f"{summary.n_ratings} ratings of {summary.n_items} items")
    ranked, model = recommend_for_session(
        ratings, items, new, preset.min_ratings, options.length,
        unique_items=options.unique_items, solver=options.solver, blocks=options.blocks,
    )
    print(f"Model trained in {model.seconds} seconds")
    if options.out:
        ranked.write.mode("overwrite").parquet(options.out)
    person = local_table(spark, [(SESSION_USER,)], ranked.select("user_id").schema)
    print(format_list(ranked, person).first().text)


if __name__ == "__main__":
    main()
