"""Every stage of the pipeline on its own input against a plain version: what goes, and that clean documents stay."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tastewright.llm import language
from tastewright.session import written_table

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `meta.url` string, sig int, row string"


def rows_of(frame):
    return sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), f"u{i}", 7, "r") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_language_keeps_clean_documents(spark, real):
    docs, rows = real
    kept = {r.doc_id for r in stage("language")(spark, docs, FOLDER).collect()}
    assert {i for i, t in rows if not any(c.isalpha() for c in t or "")}.isdisjoint(kept)
    prose = [i for i, t in rows if len(WORD.findall(t or "")) > 60 and sum(c.isalpha() or c in " \n" for c in t) > 0.9 * len(t)]
    assert len(prose) > 300 and len(kept.intersection(prose)) >= 0.99 * len(prose)
    model = language.train(docs)
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(900)) for _ in range(20)]
    bad = table(spark, [(k, t) for k, t in enumerate([*noise, None, "", "12 34 !?", "½ ² ① Ⅷ"])])
    assert language.accepted(bad, model).count() == 0
    found = {r.doc_id: r for r in language.identify(bad, model).collect()}
    assert [(found[k].lang_pred, found[k].score) for k in range(20, 24)] == [("und", 0.0)] * 4


def test_false_rejections_are_few(spark, real):
    docs, _ = real
    model = language.train(docs)
    held = language.identify(docs, model).where("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id")
    right = held.where("lang_pred = lang").agg(F.count("*").alias("n"), F.count_if("rejected").alias("gone")).first()
    assert right.n > 100 and right.gone <= 0.02 * right.n


def plain_lines(rows):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    has = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                has.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        own = [x for x in (t or "").split("\n") if i is None or len(has.get(key(x), ())) < 5 or max(has[key(x)]) == i]
        out.append((i, None if t is None else "\n".join(own)))
    return out


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Group number of each row: fingerprints within two bits, reachable."""
    prints = [fingerprint(t) for _, t in rows]
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(parent)
    for a in every:
        for b in every:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return [root(p) for p in prints]


def test_line_stage(spark, real):
    docs, rows = real
    kept = stage("line_dedup")(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted(plain_lines(rows))
    assert kept.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()


def test_near_stage(spark, real):
    docs, rows = real
    rows = rows[:400]
    kept = rows_of(stage("near_dedup")(spark, docs.where(F.col("doc_id").isin([i for i, _ in rows])), FOLDER))
    first = {}
    for (i, t), g in sorted(zip(rows, plain_groups(rows)), key=lambda x: x[0][0]):
        first.setdefault(g, (i, t))
    assert kept == sorted(first.values())


BASE = " ".join(f"word{k} of{k % 13}" for k in range(300))
OTHER = " ".join(f"quite different{k}" for k in range(200))


def test_near_stage_judges_rows_not_ids(spark):
    rows = [(1, BASE), (3, BASE + " more"), (3, OTHER), (None, BASE), (None, "only without an id here now"), (4, OTHER + " x"),
            (8, None), (9, ""), (5, "y z"), (5, "y z")]
    kept = stage("near_dedup")(spark, table(spark, rows), FOLDER)
    assert set(kept.columns) == set(table(spark, []).columns)
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, BASE), (3, OTHER), (None, "only without an id here now"), (8, None), (5, "y z"), (5, "y z")], key=str)


def sellers(item, text):
    """Least edits of the item anywhere in the text."""
    row = list(range(len(item) + 1))
    low = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(item):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row = new
        low = min(low, row[-1])
    return low


def test_benchmark_stage(spark, tmp_path):
    rng = random.Random(1)
    items = ["the old river bends near a mill of grey stone and slow water", "seven small lamps burn in a narrow hall", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda t: " ".join(WORD.findall((t or "").translate(LOWER)))
    rows = [(None, "nothing here"), (900, None), (901, ""), (902, items[0].upper().replace(" ", "\n "))]
    for k in range(120):
        text = list(f"some words before {items[k % 2]} and some words after it")
        for _ in range(k % 7):
            at = rng.randrange(18, len(text) - 28)
            text[at] = rng.choice("abcxyz ")
        rows.append((k, "".join(text)))
    expected = [(i, t) for i, t in rows if not any(sellers(plain(x), plain(t)) <= int(0.06 * len(plain(x))) for x in items if x)]
    assert 10 < len(expected) < 110
    kept = stage("decontamination")(spark, table(spark, rows), str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_encoding_stage(spark):
    rows = [(1, BASE), (2, None), (None, "é 漢"), (2, " \n")]
    found = stage("encoding")(spark, table(spark, rows), FOLDER).collect()
    assert len(found) == 4 and all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_and_odd_tables(spark, name):
    none = table(spark, [(1, "a b")]).where("false")
    assert stage(name)(spark, none, FOLDER).count() == 0
    odd = table(spark, [(None, None), (1, ""), (1, "x " * 300_000), (1, "x " * 300_000), (2, BASE), (2, OTHER)])
    kept = stage(name)(spark, odd, FOLDER)
    if name != "encoding":
        assert kept.columns == odd.columns
        assert {r["meta.url"] for r in kept.collect()} <= {"uNone", "u1", "u2"}
    kept.collect()
    assert hashlib.sha256(str(sorted(map(str, kept.collect()))).encode()).hexdigest() == hashlib.sha256(
        str(sorted(map(str, stage(name)(spark, odd.repartition(2), FOLDER).collect()))).encode()).hexdigest()


def test_run_counts_and_leaves_one_table(spark, monkeypatch):
    left = []
    monkeypatch.setattr(corpus_pipeline, "written_table", lambda rows: left.append(written_table(rows)[1]) or (spark.read.parquet(left[-1]), left[-1]))
    counts = []
    encoded = corpus_pipeline.run(spark, "/root/testdata/sf0.001", counts)
    n = encoded.count()
    assert [c[0] for c in counts] == [name for name, _ in corpus_pipeline.STAGES[:-1]]
    assert all(a[2] == b[1] for a, b in zip(counts, counts[1:])) and counts[-1][2] == n < counts[0][1]
    for path in left[:-1]:
        with pytest.raises(Exception):
            spark.read.parquet(path)
    assert spark.read.parquet(left[-1]).count() == n
