"""Periodic runs against brute force."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tastewright.llm import periods, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_length=6, min_exponent=4):
    """Every run, by all lags; a stretch's period is the smallest lag that fits it."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((i, j - i, q) for (i, j), q in found.items())


def library(*texts, **limits):
    names = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    codes = np.array([names[w] for t in texts for w in t], np.int64)
    rows = periods.runs_of(codes, [len(t) for t in texts], **limits).tolist()
    return [[tuple(r[1:]) for r in rows if r[0] == k] for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 7), st.integers(0, 20)), max_size=4),
       st.lists(st.integers(0, 2), max_size=60))
def test_repeated_blocks(blocks, rest):
    text = [w for block, times, more in blocks for w in (block * times + block[: more])] + rest
    assert library(text, rest, text[::-1]) == [brute(text), brute(rest), brute(text[::-1])]


@pytest.mark.parametrize("q", [*range(1, 40), 64, 97, 150, 333])
@pytest.mark.parametrize("more", [-1, 0, 1])
def test_every_period(q, more):
    rng = np.random.default_rng(q)
    block = rng.integers(0, 3 if q % 2 else 1000, q).tolist()
    text = rng.integers(2000, 3000, 17).tolist() + (block * 5)[: 4 * q + more] + rng.integers(2000, 3000, 9).tolist()
    assert library(text) == [brute(text)]


def test_known_shapes():
    fibonacci = ["a", "b"]
    for _ in range(12):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = "0"
    for _ in range(9):
        thue += thue.translate(str.maketrans("01", "10"))
    shapes = [list(fibonacci[-1]), list(thue), list(thue * 5), ["x"] * 700, list("ab" * 90 + "abc" * 80), [], ["x"] * 5, ["x"] * 6]
    assert library(*shapes) == [brute(s) for s in shapes]
    assert library(list("abcab" * 7), min_length=10, min_exponent=6) == [[(0, 35, 5)]]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)), len(words))


def test_query_on_odd_and_real_rows(spark, tmp_path):
    real = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    real = [(r.doc_id, r.text) for r in real if len((r.text or "").split()) < 900]
    ids = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    odd = [(None, "a b " * 9), (None, None), (5, ""), (5, " \n\x0b"), (5, "a b c " * 8), (5, "a b c " * 8), (7, "x " * 3000),
           (8, "é é " * 6 + "  ende"), *[(i, " ".join(f"w{k % 11}" for k in range(j))) for j, i in enumerate(ids)]]
    rows = [(i, t, "odd", 1) for i, t in [*odd, *real]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `runs.x` string, runs int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted([expected(i, t) for i, t in [*odd, *real]], key=str)
    assert sum(r[1] for r in found) > 40
    assert periods.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, min_exponent=3)
