
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastewright.functions import to_number
from tastewright.operators import (
    FactorModel,
    candidates,
    capture_ratings,
    dataset_summary,
    fit_residuals,
    format_list,
    item_stats,
    list_titles,
    lookup,
    preview,
    rating_counts,
    score,
    search_many,
    search_titles,
    store_titles,
    title_map,
    top_items,
    top_scored,
    train,
    training_set,
)
from tastewright.plans import (
    check_lists,
    plain_lists,
    recommend,
    recommend_for_session,
    recommend_for_sessions,
    recommend_many,
)
from tastewright.schemas import PRESETS
from tastewright.session import shared_path
from tastewright.sources import (
    catalogue_table,
    new_ratings,
    parse_items,
    parse_ratings,
    ratings_table,
    read_items,
    read_ratings,
    submissions_table,
)

# Queries on training text come with a subpackage that may be absent, as may its codecs.
try:
    from tastewright.llm import queries as text_queries
except ImportError:
    text_queries = None

# What the person asking rated in this session.
SESSION = [(0, 3, 5.0), (0, 7, 1.0), (0, 11, 4.0)]
MOVIES = PRESETS["movies"].min_ratings
ELECTRONICS = PRESETS["electronics"].min_ratings


def _captured(spark: SparkSession, folder: str) -> DataFrame:
    """Session ratings of many users, from all submissions."""
    titles = title_map(catalogue_table(spark, folder))
    return capture_ratings(submissions_table(spark, folder), titles)


def _rating_lines(spark: SparkSession, folder: str) -> DataFrame:
    r = ratings_table(spark, folder)
    return r.select(F.concat_ws(",", "user_id", "item_id", "rating", F.lit("1112486027")).alias("value"))


def _item_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue lines with a quoted title holding a comma, and a third field."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    title = F.concat(F.lit('"'), "p_name", F.lit(", The ("), "p_brand", F.lit(')"'))
    return part.select(F.concat_ws(",", "p_partkey", title, "p_type").alias("value"))


def _average_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every item the session user did not rate, scored by its mean rating."""
    stats = item_stats(ratings_table(spark, folder))
    pool = candidates(catalogue_table(spark, folder), new_ratings(spark, SESSION))
    means = stats.select("item_id", F.col("avg_rating").alias("prediction"))
    return lookup(pool, means, "item_id"), stats


def _vector_model(spark: SparkSession, folder: str) -> FactorModel:
    """The embedding table as the factors of users and items alike."""
    users, items = (
        spark.read.parquet(f"{folder}/embeddings.parquet").select(
            F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("features")
        )
        for _ in range(2)
    )
    return FactorModel(users, items, rank=64, seconds=0.0, solver="given")


def _event_pairs(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.col("user_id").cast("int").alias("user_id"), F.col("event_id").cast("int").alias("item_id")
    )


def parse_ratings_query(spark, folder):
    return parse_ratings(_rating_lines(spark, folder))


def parse_ratings_naive_query(spark, folder):
    return parse_ratings(_rating_lines(spark, folder), dialect="naive_split")


def parse_items_query(spark, folder):
    return parse_items(_item_lines(spark, folder))


def parse_items_naive_query(spark, folder):
    return parse_items(_item_lines(spark, folder), dialect="naive_split")


def _as_text(lines: DataFrame) -> str:
    """Lines written as text files, for the readers of files."""
    path = shared_path(lines.sparkSession)
    lines.select("value").write.text(path)
    return path


def read_ratings_query(spark, folder):
    return read_ratings(spark, _as_text(_rating_lines(spark, folder)))


def read_items_query(spark, folder):
    return read_items(spark, _as_text(_item_lines(spark, folder)))


def title_map_files_query(spark, folder):
    """The last line of a title wins: files hold the catalogue by falling id."""
    items = catalogue_table(spark, folder).orderBy(F.desc("item_id"))
    path = _as_text(items.select(F.concat_ws(",", "item_id", "title").alias("value")))
    return title_map(read_items(spark, path, with_order=True))


def numeric_text_query(spark, folder):
    return submissions_table(spark, folder).groupBy(
        to_number(F.col("rating_text")).alias("number")
    ).agg(F.count("*").alias("n"))


def dataset_summary_query(spark, folder):
    return dataset_summary(ratings_table(spark, folder), catalogue_table(spark, folder))


def item_stats_query(spark, folder):
    return item_stats(ratings_table(spark, folder))


def rating_counts_query(spark, folder):
    return rating_counts(ratings_table(spark, folder))


def training_set_query(spark, folder):
    """Users with the size and sum of their part of the training set."""
    everything = training_set(ratings_table(spark, folder), new_ratings(spark, SESSION))
    return everything.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("rating").alias("total")
    )


def title_map_query(spark, folder):
    return title_map(catalogue_table(spark, folder))


def list_titles_query(spark, folder):
    return list_titles(catalogue_table(spark, folder))


def search_titles_query(spark, folder):
    return search_titles(catalogue_table(spark, folder), "RED", positions=True)


def search_hits_query(spark, folder):
    return search_titles(catalogue_table(spark, folder), "RED")


def search_many_query(spark, folder):
    """Search for the first word of every title, and for every brand."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    typed = part.select(F.upper(F.split("p_name", " ")[0]).alias("prefix"))
    return search_many(catalogue_table(spark, folder), typed.union(part.select("p_brand")))


def _stored_titles(spark, folder):
    return store_titles(catalogue_table(spark, folder), shared_path(spark))


def search_stored_query(spark, folder):
    return search_titles(_stored_titles(spark, folder), "RED", positions=True)


def search_many_stored_query(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    typed = part.select(F.upper(F.split("p_name", " ")[0]).alias("prefix"))
    return search_many(_stored_titles(spark, folder), typed.union(part.select("p_brand")))


def capture_ratings_query(spark, folder):
    return _captured(spark, folder)


def candidates_query(spark, folder):
    return candidates(catalogue_table(spark, folder), new_ratings(spark, SESSION))


def support_topk_query(spark, folder):
    scored, stats = _average_scores(spark, folder)
    return top_scored(scored, catalogue_table(spark, folder), stats, MOVIES, 5)


def support_topk_bag_query(spark, folder):
    """A catalogue with many rows per item: every copy and title counts."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    items = lines.select(F.col("l_partkey").cast("int").alias("item_id"), F.col("l_returnflag").alias("title"))
    stats = item_stats(ratings_table(spark, folder))
    means = stats.select("item_id", F.col("avg_rating").alias("prediction"))
    scored = lookup(candidates(items, new_ratings(spark, SESSION)), means, "item_id")
    return top_scored(scored, items, stats, MOVIES, 2000)


def score_coverage_query(spark, folder):
    """Pairs the model can score, of the ones that occur and some that cannot."""
    r = ratings_table(spark, folder).persist()  # read by the fit and by the pairs
    new = new_ratings(spark, SESSION)
    model = train(training_set(r, new))
    pairs = r.selectExpr(
        """inline(array(struct(user_id, item_id),
                        named_struct('user_id', -user_id - 1, 'item_id', item_id),
                        named_struct('user_id', user_id, 'item_id', -item_id - 1)))"""
    )
    asked = pairs.union(new.select("user_id", "item_id"))
    return score(model, asked).select("user_id", "item_id")


def score_vectors_query(spark, folder):
    return score(_vector_model(spark, folder), _event_pairs(spark, folder))


def top_items_vectors_query(spark, folder):
    """Five best vectors for each user, except those in the user's events."""
    model = _vector_model(spark, folder)
    pairs = _event_pairs(spark, folder)
    items = model.item_factors.select(F.col("id").alias("item_id"))
    return top_items(model, pairs, items, pairs, 5)


def _invariant(spark, folder, solver):
    # A join of two tables, read by the fit and by the residuals: made once.
    everything = training_set(ratings_table(spark, folder), new_ratings(spark, SESSION)).persist()
    model = train(everything, solver=solver)
    return fit_residuals(model, everything).select(
        "user_id", (F.col("residual") < 1e-3).alias("ok")
    )


def als_invariant_query(spark, folder):
    return _invariant(spark, folder, "blocks")


def als_invariant_joins_query(spark, folder):
    return _invariant(spark, folder, "joins")


def _flagship(spark, folder, min_ratings):
    ranked, _ = recommend_for_session(
        ratings_table(spark, folder),
        catalogue_table(spark, folder),
        new_ratings(spark, SESSION),
        min_ratings,
    )
    return ranked


def recommend_top5_query(spark, folder):
    return _flagship(spark, folder, MOVIES)


def recommend_top5_electronics_query(spark, folder):
    return _flagship(spark, folder, ELECTRONICS)


def recommend_many_query(spark, folder):
    ranked, _ = recommend_for_sessions(
        ratings_table(spark, folder),
        catalogue_table(spark, folder),
        _captured(spark, folder),
        MOVIES,
    )
    return ranked


def training_time_query(spark, folder):
    """The time a fit tells: positive, of three places."""
    everything = training_set(ratings_table(spark, folder), new_ratings(spark, SESSION))
    seconds = train(everything, iterations=1).seconds
    return everything.agg(
        F.count("*").alias("n_ratings"),
        F.any_value(F.lit(seconds > 0 and seconds == round(seconds, 3))).alias("ok"),
    )


def _flagship_checked(spark, folder, min_ratings):
    """The list of the person asking, against every item scored and filtered late."""
    ratings, items, new = ratings_table(spark, folder), catalogue_table(spark, folder), new_ratings(spark, SESSION)
    listed, model = recommend_for_session(ratings, items, new, min_ratings)
    return check_lists(listed, plain_lists(model, item_stats(ratings), items, new, new, min_ratings))


def recommend_top5_checked_query(spark, folder):
    return _flagship_checked(spark, folder, MOVIES)


def recommend_top5_electronics_checked_query(spark, folder):
    return _flagship_checked(spark, folder, ELECTRONICS)


def recommend_many_checked_query(spark, folder):
    """All lists are made; those of users whose id is divisible by 20 are checked."""
    ratings, items, new = ratings_table(spark, folder), catalogue_table(spark, folder), _captured(spark, folder)
    listed, model = recommend_for_sessions(ratings, items, new, MOVIES)
    asked = F.col("user_id") % 20 == 0
    expected = plain_lists(model, item_stats(ratings), items, new, new.where(asked), MOVIES)
    return check_lists(listed.where(asked), expected)


def format_list_query(spark, folder):
    return format_list(support_topk_query(spark, folder))


def format_list_users_query(spark, folder):
    """Lists by user, with the users who have none."""
    ranked = support_topk_query(spark, folder)
    users = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").cast("int").alias("user_id"))
    return format_list(ranked, users)


def title_map_ordered_query(spark, folder):
    """Brands to items, where the row with the highest price is the last."""
    part = spark.read.parquet(f"{folder}/part.parquet").select(
        F.col("p_partkey").cast("int").alias("item_id"), F.col("p_brand").alias("title"),
        F.struct("p_retailprice", "p_partkey").alias("line_order"))
    return title_map(part)


def search_empty_query(spark, folder):
    return search_titles(catalogue_table(spark, folder), "", positions=True)


def _given(spark, folder):
    ratings = ratings_table(spark, folder)
    return _vector_model(spark, folder), item_stats(ratings), catalogue_table(spark, folder)


def recommend_given_query(spark, folder):
    """The whole list from a given model."""
    return recommend(*_given(spark, folder), new_ratings(spark, SESSION), MOVIES)


def recommend_given_unique_query(spark, folder):
    """The same where the catalogue has every item twice, listed once."""
    model, stats, items = _given(spark, folder)
    return recommend(model, stats, items.union(items), new_ratings(spark, SESSION), MOVIES, unique_items=True)


def recommend_given_many_query(spark, folder):
    return recommend_many(*_given(spark, folder), _captured(spark, folder), MOVIES)


def preview_query(spark, folder):
    return preview(_captured(spark, folder).orderBy("user_id", "item_id", "rating"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: train with three new ratings and list the five best movies."""
    return recommend_top5_query(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "parse_ratings": parse_ratings_query,
        "parse_ratings_naive": parse_ratings_naive_query,
        "parse_items": parse_items_query,
        "parse_items_naive": parse_items_naive_query,
        "read_ratings": read_ratings_query,
        "read_items": read_items_query,
        "title_map_files": title_map_files_query,
        "numeric_text": numeric_text_query,
        "dataset_summary": dataset_summary_query,
        "item_stats": item_stats_query,
        "rating_counts": rating_counts_query,
        "training_set": training_set_query,
        "title_map": title_map_query,
        "list_titles": list_titles_query,
        "search_titles": search_titles_query,
        "search_hits": search_hits_query,
        "search_many": search_many_query,
        "search_stored": search_stored_query,
        "search_many_stored": search_many_stored_query,
        "capture_ratings": capture_ratings_query,
        "candidates": candidates_query,
        "support_topk": support_topk_query,
        "support_topk_bag": support_topk_bag_query,
        "score_coverage": score_coverage_query,
        "score_vectors": score_vectors_query,
        "top_items_vectors": top_items_vectors_query,
        "als_invariant": als_invariant_query,
        "als_invariant_joins": als_invariant_joins_query,
        "recommend_top5": recommend_top5_query,
        "recommend_top5_electronics": recommend_top5_electronics_query,
        "recommend_many": recommend_many_query,
        "training_time": training_time_query,
        "recommend_top5_checked": recommend_top5_checked_query,
        "recommend_top5_electronics_checked": recommend_top5_electronics_checked_query,
        "recommend_many_checked": recommend_many_checked_query,
        "format_list": format_list_query,
        "format_list_users": format_list_users_query,
        "title_map_ordered": title_map_ordered_query,
        "search_empty": search_empty_query,
        "recommend_given": recommend_given_query,
        "recommend_given_unique": recommend_given_unique_query,
        "recommend_given_many": recommend_given_many_query,
        "preview": preview_query,
        **(text_queries.queries() if text_queries else {}),
    }


# Common table expressions of the SQL side.
R = """r AS (
  SELECT CAST(o_custkey + 1 AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,
         CAST(floor((l_quantity - 1) / 10) + 1 AS DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
I = "i AS (SELECT CAST(p_partkey AS INT) AS item_id, p_name AS title FROM part)"
N = """n AS (SELECT CAST(u AS INT) AS user_id, CAST(i AS INT) AS item_id, CAST(x AS DOUBLE) AS rating
  FROM (VALUES (0, 3, 5.0), (0, 7, 1.0), (0, 11, 4.0)) AS v(u, i, x))"""
ST = "st AS (SELECT item_id, count(*) AS n_ratings, avg(rating) AS avg_rating FROM r GROUP BY item_id)"
SUB = """sub AS (
  SELECT CAST(user_id + 1 AS INT) AS user_id,
         CASE WHEN event_type = 'error' AND value < 10 THEN ''
              WHEN event_type = 'error' THEN p_name || ' (unknown)' ELSE p_name END AS title,
         CASE WHEN event_type = 'view' THEN ' ' || tenth || ' '
              WHEN event_type = 'click' AND value < 50 THEN tenth || 'd'
              WHEN event_type = 'click' AND value < 100 THEN 'nan'
              WHEN event_type = 'signup' AND value < 50 THEN ''
              WHEN event_type = 'signup' AND value < 100 THEN 'five'
              ELSE tenth END AS rating_text
  FROM (SELECT *, CAST(CAST(floor(value) / 10 AS DOUBLE) AS VARCHAR) AS tenth,
               event_id % (SELECT count(*) FROM part) AS pk FROM events) e
  JOIN part ON pk = p_partkey)"""
TM = "tm AS (SELECT title, max(item_id) AS item_id FROM i GROUP BY title)"
TOPK = """scored AS (
  SELECT CAST(0 AS INT) AS user_id, i.item_id, title, avg_rating AS prediction, n_ratings
  FROM i JOIN st ON i.item_id = st.item_id
  WHERE n_ratings >= 25 AND i.item_id NOT IN (SELECT item_id FROM n)),
topk AS (
  SELECT user_id, rank, item_id, title, prediction, n_ratings FROM (
    SELECT *, row_number() OVER (ORDER BY prediction DESC, item_id) AS rank FROM scored)
  WHERE rank <= 5)"""
EV = "ev AS (SELECT CAST(user_id AS INT) AS user_id, CAST(event_id AS INT) AS item_id FROM events)"
DOT = "CAST(list_inner_product(CAST(w.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS FLOAT)"


def oracle_sql() -> dict[str, str]:
    numbers = "numbers AS (SELECT user_id, title, TRY_CAST(trim(rating_text) AS DOUBLE) AS number FROM sub)"
    captured = """cap AS (SELECT user_id, item_id, number AS rating FROM numbers JOIN tm ON numbers.title = tm.title
            WHERE numbers.title <> '' AND number > 0 AND number < 6)"""
    # Every unrated item scored, supported ones listed late.
    listed = """SELECT user_id, rank, item_id, title, prediction, n_ratings FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rank FROM all_scored
              WHERE n_ratings >= 25) WHERE rank <= 5"""
    given = f"""WITH {R}, {I}, {N}, {ST}, all_scored AS (
              SELECT CAST(0 AS INT) AS user_id, i.item_id, title, {DOT} AS prediction, n_ratings
              FROM i JOIN st ON i.item_id = st.item_id JOIN embeddings v ON v.vec_id = i.item_id
              JOIN embeddings w ON w.vec_id = 0 WHERE i.item_id NOT IN (SELECT item_id FROM n)) {listed}"""
    session_checked = f"""WITH {R}, {I}, {N}, {ST}
        SELECT CAST(0 AS INT) AS user_id, least(5, count(*)) AS n_listed, TRUE AS ok
        FROM i JOIN st ON i.item_id = st.item_id WHERE n_ratings >= MIN AND i.item_id NOT IN (SELECT item_id FROM n)
        HAVING count(*) > 0"""
    words = """typed AS (SELECT upper(split_part(p_name, ' ', 1)) AS prefix FROM part
                      UNION SELECT p_brand FROM part)"""
    search_red = f"""WITH {I}
            SELECT row_number() OVER (ORDER BY lower(title), item_id) AS position, title, item_id
            FROM i WHERE starts_with(lower(title), 'red')"""
    search_words = f"""WITH {I}, {words}
            SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY lower(title), item_id) AS position,
                   title, item_id
            FROM typed JOIN i ON starts_with(lower(title), lower(prefix))"""
    return {
        "parse_ratings": f"WITH {R} SELECT * FROM r",
        "read_ratings": f"WITH {R} SELECT * FROM r",
        "read_items": """SELECT CAST(p_partkey AS INT) AS item_id,
            p_name || ', The (' || p_brand || ')' AS title FROM part""",
        "title_map_files": f"WITH {I} SELECT title, min(item_id) AS item_id FROM i GROUP BY title",
        "search_stored": search_red,
        "search_many_stored": search_words,
        "training_time": f"""WITH {R}, {N}
            SELECT count(*) AS n_ratings, TRUE AS ok FROM (SELECT * FROM r UNION ALL SELECT * FROM n)""",
        "recommend_top5_checked": session_checked.replace("MIN", str(MOVIES)),
        "recommend_top5_electronics_checked": session_checked.replace("MIN", str(ELECTRONICS)),
        "recommend_many_checked": f"""WITH {R}, {I}, {TM}, {SUB}, {ST}, {numbers}, {captured},
            able AS (SELECT item_id FROM st WHERE n_ratings >= {MOVIES}),
            gone AS (SELECT user_id, count(DISTINCT cap.item_id) FILTER (WHERE able.item_id IS NOT NULL) AS n
                     FROM cap LEFT JOIN able ON able.item_id = cap.item_id WHERE user_id % 20 = 0 GROUP BY user_id)
            SELECT user_id, least(5, (SELECT count(*) FROM able) - n) AS n_listed, TRUE AS ok FROM gone
            WHERE (SELECT count(*) FROM able) > n""",
        "parse_ratings_naive": f"WITH {R} SELECT * FROM r",
        "parse_items": """SELECT CAST(p_partkey AS INT) AS item_id,
            p_name || ', The (' || p_brand || ')' AS title FROM part""",
        "parse_items_naive": """SELECT CAST(p_partkey AS INT) AS item_id, '"' || p_name AS title FROM part""",
        "numeric_text": f"WITH {SUB}, {numbers} SELECT number, count(*) AS n FROM numbers GROUP BY number",
        "dataset_summary": f"""WITH {R}, {I}
            SELECT (SELECT count(*) FROM r) AS n_ratings, (SELECT count(*) FROM i) AS n_items""",
        "item_stats": f"WITH {R}, {ST} SELECT * FROM st",
        "rating_counts": f"WITH {R} SELECT item_id, count(*) AS n_ratings FROM r GROUP BY item_id",
        "training_set": f"""WITH {R}, {N}
            SELECT user_id, count(*) AS n, sum(rating) AS total
            FROM (SELECT * FROM r UNION ALL SELECT * FROM n) GROUP BY user_id""",
        "title_map": f"WITH {I}, {TM} SELECT * FROM tm",
        "list_titles": f"""WITH {I}
            SELECT row_number() OVER (ORDER BY lower(title), item_id) AS position, title, item_id FROM i""",
        "search_titles": search_red,
        "search_hits": f"WITH {I} SELECT title, item_id FROM i WHERE starts_with(lower(title), 'red')",
        "search_many": search_words,
        "capture_ratings": f"""WITH {I}, {TM}, {SUB}, {numbers}
            SELECT user_id, item_id, number AS rating FROM numbers JOIN tm ON numbers.title = tm.title
            WHERE numbers.title <> '' AND number > 0 AND number < 6""",
        "candidates": f"""WITH {I}, {N}
            SELECT CAST(0 AS INT) AS user_id, item_id FROM i WHERE item_id NOT IN (SELECT item_id FROM n)""",
        "support_topk": f"WITH {R}, {I}, {N}, {ST}, {TOPK} SELECT * FROM topk",
        "support_topk_bag": f"""WITH {R}, {N}, {ST},
            li AS (SELECT CAST(l_partkey AS INT) AS item_id, l_returnflag AS title FROM lineitem),
            cand AS (SELECT item_id FROM li WHERE item_id NOT IN (SELECT item_id FROM n)),
            bag AS (SELECT CAST(0 AS INT) AS user_id, cand.item_id, li.title, avg_rating AS prediction, n_ratings
                    FROM cand JOIN li ON cand.item_id = li.item_id JOIN st ON cand.item_id = st.item_id
                    WHERE n_ratings >= 25)
            SELECT user_id, rank, item_id, title, prediction, n_ratings FROM (
              SELECT *, row_number() OVER (ORDER BY prediction DESC, item_id, title) AS rank FROM bag)
            WHERE rank <= 2000""",
        "score_coverage": f"""WITH {R}, {N}
            SELECT user_id, item_id FROM r UNION ALL SELECT user_id, item_id FROM n""",
        "score_vectors": f"""WITH {EV}
            SELECT user_id, item_id, {DOT} AS prediction FROM ev
            JOIN embeddings w ON w.vec_id = user_id JOIN embeddings v ON v.vec_id = item_id""",
        "top_items_vectors": f"""WITH {EV},
            pairs AS (SELECT u.user_id, CAST(v.vec_id AS INT) AS item_id, {DOT} AS prediction
                      FROM (SELECT DISTINCT user_id FROM ev) u
                      JOIN embeddings w ON w.vec_id = u.user_id CROSS JOIN embeddings v),
            unrated AS (SELECT * FROM pairs WHERE NOT EXISTS (
                SELECT 1 FROM ev WHERE ev.user_id = pairs.user_id AND ev.item_id = pairs.item_id))
            SELECT user_id, item_id, prediction FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS k
              FROM unrated) WHERE k <= 5""",
        "als_invariant": f"""WITH {R}, {N}
            SELECT DISTINCT user_id, TRUE AS ok FROM (SELECT user_id FROM r UNION ALL SELECT user_id FROM n)""",
        "als_invariant_joins": f"""WITH {R}, {N}
            SELECT DISTINCT user_id, TRUE AS ok FROM (SELECT user_id FROM r UNION ALL SELECT user_id FROM n)""",
        "format_list": f"""WITH {R}, {I}, {N}, {ST}, {TOPK}
            SELECT user_id, 'Recommended For You :' || chr(10) || chr(10) || '* '
                   || string_agg(title, chr(10) || '* ' ORDER BY rank) AS text
            FROM topk GROUP BY user_id""",
        "format_list_users": f"""WITH {R}, {I}, {N}, {ST}, {TOPK},
            l AS (SELECT user_id, chr(10) || '* ' AS s, string_agg(title, chr(10) || '* ' ORDER BY rank) AS t
                  FROM topk GROUP BY user_id)
            SELECT CAST(c_custkey AS INT) AS user_id,
                   'Recommended For You :' || chr(10) || chr(10) || '* ' || coalesce(t, '') AS text
            FROM customer LEFT JOIN l ON c_custkey = user_id""",
        "title_map_ordered": """SELECT p_brand AS title,
            CAST(arg_max(p_partkey, (p_retailprice, p_partkey)) AS INT) AS item_id FROM part GROUP BY p_brand""",
        "search_empty": f"""WITH {I}
            SELECT row_number() OVER (ORDER BY lower(title), item_id) AS position, title, item_id FROM i""",
        "recommend_given": given,
        "recommend_given_unique": given,
        "recommend_given_many": f"""WITH {R}, {I}, {TM}, {SUB}, {ST}, {numbers}, {captured}, all_scored AS (
              SELECT u.user_id, i.item_id, title, {DOT} AS prediction, n_ratings
              FROM (SELECT DISTINCT user_id FROM cap) u JOIN embeddings w ON w.vec_id = u.user_id
              CROSS JOIN i JOIN st ON i.item_id = st.item_id JOIN embeddings v ON v.vec_id = i.item_id
              WHERE NOT EXISTS (SELECT 1 FROM cap WHERE cap.user_id = u.user_id AND cap.item_id = i.item_id)) {listed}""",
        "preview": f"""WITH {I}, {TM}, {SUB}, {numbers}, {captured}
            SELECT * FROM cap ORDER BY user_id, item_id, rating LIMIT 10""",
        **(text_queries.oracle_sql() if text_queries else {}),
    }
