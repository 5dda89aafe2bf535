"""What models learn from: bounded rows, right verdicts, plain counterparts."""

import random
import string
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastewright.llm import decontaminate, language, quality, secrets, toxicity

FOLDER = "/root/testdata/sf0.1"


def repeated(spark, schema, text):
    """One labelled id in very many rows."""
    return spark.range(10_000, numPartitions=4).select(
        F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit(text), (F.col("id") % 50).cast("string")).alias("text"))


def test_a_repeated_id_is_learnt_once(spark, monkeypatch):
    docs = repeated(spark, None, "some awful words of a text ")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality.BoostedTrees, "fit", lambda self, x, y: seen.append((x.shape, y.tolist())) or self)
    quality.train(docs, labels)
    assert seen == [((1, len(quality.FEATURES)), [1.0])]
    monkeypatch.setattr(toxicity.ToxicModel, "fit", lambda *a: seen.append([len(x) for x in a[1:3]]))
    toxicity.train(docs, labels)
    assert seen[1] == [1, 1]


def test_trained_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.col("doc_id"), F.lit(4)) == 0
    trees = quality.train(docs, labels.where(~held))
    rows = quality.judge(docs.where(held), trees).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 200 and len(bad) > 50
    assert np.mean([r.kept for r in good]) > 0.9 and np.mean([r.kept for r in bad]) < 0.05
    assert np.mean([not r.base_failed for r in bad]) > 0.2  # of which the trees find the rest


def kneser_ney(words, order, size):
    """Interpolated probabilities, plainly: p(c | context) by order."""
    counts = defaultdict(Counter)
    for word, n in words.items():
        text = "^" * (order - 1) + word + "$"
        for k in range(order - 1, len(text)):
            counts[order][text[k - order + 1 : k + 1]] += n
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1

    def p(gram):
        if not gram:
            return 1 / size
        n = len(gram)
        ones, twos = (sum(v == x for v in counts[n].values()) for x in (1, 2))
        discount = ones / (ones + 2 * twos) if ones else 0.5
        same = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        weight = max(discount * len(same) / sum(same.values()), 1e-9)
        return max(counts[n][gram] - discount, 0) / sum(same.values()) * (n and 1) + weight * p(gram[1:])

    return p


def test_language_model_against_plain_kneser_ney():
    words = Counter({"abba": 3, "baba": 1, "cab": 2, "bac": 1, "acca": 4, "b": 1})
    model = language.LanguageModel({"x": words})
    p = kneser_ney(words, language.ORDER, len("abc") + 2)
    for word in ["abba", "cab", "cc", "b", "abc", "baccab", "acc"]:
        text = "^" * (language.ORDER - 1) + word + "$"
        grams = [text[k - language.ORDER + 1 : k + 1] for k in range(language.ORDER - 1, len(text))]
        expected = sum(log(p(g)) for g in grams)
        found, sizes = model.word_scores([word])
        assert sizes[0] == len(word) + 1 and abs(found[0, 0] - expected) < 1e-4, word


ALPHABETS = {
    "hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits,
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
NAMES = ["getUserAccountNumber", "MAX_RETRY_COUNT_value", "updateRequestTimeout", "databaseConnectionPool", "read_session_Config_file"]


@pytest.mark.parametrize("kind", ALPHABETS)
@pytest.mark.parametrize("size", [20, 32, 64, 128, 500, 2000])
def test_secrets_of_all_alphabets_and_lengths(kind, size):
    rng = random.Random(size)
    scanner = secrets.Scanner(b" user account number max retry count value update request timeout ")
    found = 0
    for _ in range(60):
        key = "".join(rng.choice(ALPHABETS[kind]) for _ in range(size))
        text = f"é the bearer value {key} stands here"
        found += f"novel:19:{19 + size}" in scanner.scan(text.encode())[2]
    assert found >= 0.9 * 60


def test_names_of_the_corpus_are_no_secrets(spark):
    lines = [f"x = {a}(y); token = {b}: call {a}{b[0].upper()}{b[1:]} now" for a in NAMES for b in NAMES]
    docs = spark.createDataFrame(list(enumerate(lines * 3 + [None, ""])), "doc_id long, text string")
    names = secrets.identifiers(docs)
    assert all(n.encode() in names for n in NAMES) and b"get user account number" in names
    few = secrets.identifiers(docs, most=1)
    assert len(few) < 60 and secrets.identifiers(docs.where("false")) == b" "
    scanner = secrets.Scanner(names)
    flagged = [n for a in NAMES for b in NAMES if a != b for n in [f"{a}_{b}1"] if "novel" in scanner.scan(f"the secret of {n} it is".encode())[2]]
    assert len(flagged) <= 2, flagged
    assert secrets.secret_spans(docs.where("false")).count() == 0


def test_blocks_of_a_large_benchmark_are_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(decontaminate, "stored", lambda rows: stored.append(1) or rows.checkpoint())
    items = spark.createDataFrame([(k, f"item number {k} of the whole benchmark here") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"text with item number {k} of the whole benchmark here inside") for k in range(0, 80, 3)], "doc_id long, text string")
    whole, small = (decontaminate.leaks(docs, items, block_bytes=b).distinct().collect() for b in (1 << 20, 300))
    assert sorted(whole) == sorted(small) and len(stored) >= 3
    clean = [sorted(r.doc_id for r in decontaminate.clean_documents(docs, items, block_bytes=b).collect()) for b in (1 << 20, 300)]
    assert clean[0] == clean[1]
