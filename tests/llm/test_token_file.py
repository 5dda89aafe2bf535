"""Token files: encoding against the library, partition bounds, random access."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tastewright.llm import token_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return token_file.Encoder(open(PATH, encoding="utf-8").read())


def ids_of(text):
    return WHOLE.encode(text, add_special_tokens=False).ids + [0]


ODD = st.text(st.sampled_from("aB z.,'\n\t-é¿ñ ²9½İ漢  <|>endoftextđŁ̈\x1f\x85"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=30), st.sampled_from(["", " ", "<|endoftext|>", "it's we'll", "x.\ny", "a  b"])), max_size=5))
def test_same_ids_as_the_library(encoder, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    ids, counts = encoder.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert counts.tolist() == [len(ids_of(t)) for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_file.Encoder('{"pre_tokenizer": {"type": "Whitespace"}}')


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], list(range(200, 400)) * 9])
def test_levels(values):
    file = token_file.TokenFile(token_file.pack(np.array(values, np.uint32)))
    assert file.all().tolist() == values and [file.token(k) for k in range(len(values))] == values
    with pytest.raises(IndexError):
        file.token(len(values))


def test_parts_keep_the_order_and_split_hot_keys():
    rng = np.random.default_rng(2)
    bounds = sorted([(5, 3), (5, 3), (5, 3), (9, 0), (9, 7), (20, 1)])
    doc_id, sig = rng.integers(0, 30, 4000), rng.integers(0, 10, 4000)
    hot = np.arange(4000) % 3 == 0
    doc_id[hot], sig[hot] = 5, 3
    part = token_file.parts_of(doc_id, sig, bounds)
    keys = list(zip(doc_id.tolist(), sig.tolist()))
    for p in range(len(bounds)):
        assert max(k for k, q in zip(keys, part) if q <= p) <= min([k for k, q in zip(keys, part) if q > p], default=(99, 0))
    share = np.bincount(part[hot], minlength=7)
    assert share[:4].min() > 300 and share[4:].sum() == 0


@pytest.fixture(scope="module")
def written(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "no id"), (7, "again seven"), (10**6, None), (10**6 + 1, "漢字 " * 3000)], docs.schema)
    every = docs.union(extra)
    rows = [(r.doc_id, r.text or "") for r in every.collect()]
    return token_file.write_token_files(every, PATH, file_ids=3000), rows


def test_tokens_by_position(spark, written):
    files, rows = written
    told = sorted(token_file.read_token_files(files).collect(), key=lambda r: r.start)
    assert len(told) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(ids_of(t))
    stream = []
    for r in told:
        same = [x for x in texts[r.doc_id] if len(x) == r.n_tokens]
        stream += same[0] if len(same) == 1 or len(texts[r.doc_id]) == 1 else same[0]
    rng = np.random.default_rng(1)
    asked = [0, len(stream) - 1, *rng.integers(0, len(stream), 500).tolist()]
    positions = spark.createDataFrame([(p,) for p in [*asked, len(stream), -1, None, 0]], "position long")
    found = {r.position: r.id for r in token_file.read_tokens(files, positions).collect()}
    assert found == {p: stream[p] for p in asked}


def test_documents_by_id(spark, written):
    files, rows = written
    asked = [1, 5, 7, 10**6, 10**6 + 1, 12345678]
    found = token_file.read_documents(files, spark.createDataFrame([(i,) for i in [*asked, None, 5]], "doc_id long")).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((i, ids_of(t)) for i, t in rows if i in asked)
    starts = {r.start for r in token_file.read_token_files(files).collect()}
    assert {r.start for r in found} <= starts


def _scan(frame):
    """Plan text and rows that the scan of a collected frame handed on."""
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return frame._jdf.queryExecution().executedPlan().toString(), plan.metrics().get("numOutputRows").get().value()


def test_a_lookup_reads_one_level_of_few_groups(spark, written):
    docs = spark.range(3000, numPartitions=3).select(F.col("id").alias("doc_id"), F.repeat(F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("the")), 9).alias("text"))
    files = token_file.write_token_files(docs, PATH, file_ids=2000)
    some = files.orderBy("part", "seq").first()
    asked = spark.createDataFrame([(some.part, some.seq)], "part int, seq int")
    read = token_file._only(files, asked).select("part", "seq", "c0", "b0", "r0")
    assert len(read.collect()) == 1
    plan, handed = _scan(read)
    assert "c1" not in plan and "doc_ids" not in plan and "PushedFilters: [EqualTo(part" in plan.replace("IsNotNull(part), IsNotNull(seq), ", "")
    assert handed < files.count() / 3


def test_hot_ids_are_spread(spark):
    docs = spark.range(4000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("a few words of text " * 20).alias("text"))
    files = token_file.write_token_files(docs, PATH)
    per_part = [r.n for r in files.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(per_part) == 4000 and max(per_part) < 1200
    read = token_file.read_token_files(files)
    assert [r.doc_id is None for r in read.orderBy("start").collect()] == sorted([k < 1334 for k in range(4000)], reverse=True)
