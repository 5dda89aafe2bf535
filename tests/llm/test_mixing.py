"""Mixing against a plain version: targets, quotas, shards, draws and the rows themselves."""

import inspect
import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from tastewright.llm import mixing, queries

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at the bound, share what is over again; names by code point, null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over or len(over) == len(free) and left == 0:
            return {**share, **fixed}
        for s in over:
            fixed[s] = float(most * sizes[s])
            left -= fixed[s]


def size(text):
    return len(WORD.findall(text or ""))


def odd_rows():
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(k % 13)), f"s{k % 4}") for k in range(300)]
    rows += [(k, "one two three\n four" * 30, "big") for k in range(300, 360)]
    rows += [(400, "a b", None), (None, "a b c", None), (None, "a b c", None), (401, None, "s1"), (402, "", "blank"), (403, " \t\n", "blank"),
             (404, "x " * 4000, "S"), (405, "tiny", "é"), (405, "tiny", "é"), (405, "other here", "é"), (406, "", ""), (407, "y", "")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "x", 7) for i, t, s in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `size.of` string, draws int").repartition(5)


def held_against(mix, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    expected = targets(sizes)
    found = mix.documents().collect()
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == sorted((i, size(t)) for i, t, _ in rows if i is not None)
    assert len(found) == len(rows)
    by_size = Counter((r.source_size, round(r.target, 6)) for r in found)
    assert by_size == Counter((sizes[s], round(expected[s], 6)) for _, _, s in rows)
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws)
        assert all(0 < d.words <= r.size for d in r.draws) and len({d.draw for d in r.draws}) == len(r.draws)
        taken[r.source_size, round(r.target, 6)] += r.taken
    for key, n in by_size.items():
        same = [s for s in sizes if (sizes[s], round(expected[s], 6)) == key]
        alike = sum(c - 1 for c in Counter((i, t) for i, t, s in rows if s in same).values())
        total = sum(int(expected[s] + 1e-9) for s in same)
        assert total - alike - len(same) <= taken[key] <= total
    return found


@pytest.mark.parametrize("block_words, shard_words", [(40, 900), (11, 350)])
def test_against_brute_force(spark, odd, block_words, shard_words):
    mix = mixing.Mix(odd, block_words=block_words, shard_words=shard_words)
    found = held_against(mix, odd_rows())
    if block_words == 40:  # partitioned otherwise, the mix is the same
        again = mixing.Mix(odd.repartition(3), block_words=block_words, shard_words=shard_words).documents().collect()
        assert sorted(map(str, found)) == sorted(map(str, again))
    draws = mix.tree.collect()
    per_shard = Counter()
    for r in draws:
        per_shard[r.shard] += r.n
    total = sum(per_shard.values())
    assert all(per_shard[s] == (s + 1) * total // mix.shards - s * total // mix.shards for s in range(mix.shards))
    starts = defaultdict(list)
    for r in draws:
        starts[r.id] += range(r.first, r.first + r.n)
    assert all(sorted(x) == list(range(len(x))) for x in starts.values())


def test_real_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    found = held_against(mixing.Mix(docs), rows)
    assert sorted(map(str, found)) == sorted(map(str, queries.op13_mixing(spark, FOLDER).collect()))


def test_rows_of_the_mix(spark, odd):
    mix = mixing.Mix(odd, block_words=40, shard_words=900)
    told = Counter()
    for r in mix.documents().collect():
        for d in r.draws:
            told[r.doc_id, d.shard, d.draw, d.words] += 1
    rows = mix.rows().withColumn("part", F.spark_partition_id()).collect()
    assert Counter((r.row.doc_id, r.shard, r.draw, r.words) for r in rows) == told
    assert set(rows[0].row.asDict()) == set(odd.columns)
    texts = {(i, t) for i, t, _ in odd_rows()}
    for r in rows:
        assert size(r.row.text) == r.words and any(i == r.row.doc_id and (t or "").startswith(r.row.text) for i, t in texts)
    # a shard is in one partition, and its sources are mixed
    assert len({(r.shard, r.part) for r in rows}) == len({r.shard for r in rows})
    order = [r.row.source for r in rows if r.shard == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) > 2 * len(set(order))


def test_empty_tables(spark, odd):
    none = mixing.Mix(odd.where("false"))
    assert none.documents().count() == 0 and none.rows().count() == 0
    blank = mixing.Mix(odd.where("text IS NULL OR trim(text) = ''"))
    assert {(r.size, r.taken, r.target) for r in blank.documents().collect()} == {(0, 0, 0.0)}


@pytest.mark.parametrize("total, marked, drawn", [(10, 3, 4), (10, 10, 4), (10, 4, 10), (7, 0, 3), (60, 30, 30), (1000, 20, 500), (5000, 2500, 1200)])
def test_hypergeometric(spark, total, marked, drawn):
    n = 4000
    long = lambda x: F.lit(x).cast("long")
    uniform = (F.col("id") + 0.5) / n
    rows = spark.range(n).select(mixing.hypergeometric(long(total), long(marked), long(drawn), uniform).alias("x")).groupBy("x").count().collect()
    found = {r.x: r["count"] / n for r in rows}
    expected = {x: comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn)
                for x in range(max(0, drawn - total + marked), min(marked, drawn) + 1)}
    assert set(found) <= set(expected)
    assert all(abs(found.get(x, 0) - p) <= 1.01 / n for x, p in expected.items())


def test_tree_is_multivariate_hypergeometric(spark):
    """Over many strata the first shard's share has the right mean and spread; strata leave every sum exact."""
    n = 200
    quotas = spark.createDataFrame([(mixing.STRATUM * k + i, q) for k in range(n) for i, q in enumerate((12, 6, 2))], "id long, n long")
    found = {r.id: r.n for r in mixing.splitting_tree(quotas, 4).where("shard = 0").collect()}
    firsts = [found.get(mixing.STRATUM * k, 0) for k in range(n)]
    mean, spread = 5 * 12 / 20, 5 * 0.6 * 0.4 * 15 / 19
    assert abs(sum(firsts) / n - mean) < 4 * (spread / n) ** 0.5
    assert 0.65 < sum((x - mean) ** 2 for x in firsts) / n / spread < 1.4
    many = spark.range(1300).select("id", (F.col("id") % 4).alias("n"))
    dealt = mixing.splitting_tree(many, 20).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert len(dealt) == 20 and max(r.n for r in dealt) - min(r.n for r in dealt) <= 3
    back = mixing.splitting_tree(many, 20).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {r.id: r.n for r in back} == {k: k % 4 for k in range(1300) if k % 4}


def test_no_python_on_the_main_path(spark, odd):
    mix = mixing.Mix(odd, block_words=40, shard_words=900)
    plan = mix.rows()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert not re.search(r"pandas|mapInArrow|\.rdd|udf", inspect.getsource(mixing))
