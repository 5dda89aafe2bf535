"""Queries of the operators: each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tastewright.llm import (
    decontaminate, language, lines, mixing, periods, quality, secrets, sentencepiece, simhash, suffixes, token_file, toxicity,
    whitening)


def _table(spark, folder, name="documents"):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language(spark, folder):
    documents = _table(spark, folder)
    return language.identify(documents, language.train(documents))


def op2_quality(spark, folder):
    documents = _table(spark, folder)
    return quality.judge(documents, quality.train(documents, _table(spark, folder, "labels")))


def op3_simhash(spark, folder):
    return simhash.near_groups(_table(spark, folder))


def op4_decontaminate(spark, folder):
    return decontaminate.leaks(_table(spark, folder), _table(spark, folder, "benchmark"))


def op5_sentencepiece(spark, folder):
    return sentencepiece.encode_documents(_table(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_file(spark, folder):
    files = token_file.write_token_files(_table(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_token_files(files)


def op7_line_dedup(spark, folder):
    kept = lines.dedup_lines(_table(spark, folder))
    return kept.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_toxicity(spark, folder):
    documents = _table(spark, folder)
    return toxicity.score_documents(documents, toxicity.train(documents, _table(spark, folder, "labels")))


def op9_secrets(spark, folder):
    return secrets.secret_spans(_table(spark, folder))


def op10_suffix_dedup(spark, folder):
    return suffixes.remove_repeats(_table(spark, folder))


def op11_whitening(spark, folder):
    return whitening.whiten(_table(spark, folder, "embeddings"))


def _with_planted_runs(documents):
    """Documents, in one of ten of which the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    # The list of words is bound once, as an array of one.
    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    text = F.transform(words, lambda w: F.when(F.size(w) > 0, planted(w)))[0]
    return documents.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, folder):
    found = periods.periodic_runs(_with_planted_runs(_table(spark, folder)))
    told = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = found.select("*", periods.strongest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(told, lambda t: F.concat(t, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op13_mixing(spark, folder):
    return mixing.mixed_documents(_table(spark, folder))


def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)

# Every row is numbered, since rows of equal id keep their own lines.
LINE_DEDUP_SQL = """WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
l AS (SELECT r, doc_id, unnest(own) AS line, generate_subscripts(own, 1) AS n FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
s AS (
  SELECT k.*, c.key IS NULL OR doc_id IS NULL OR doc_id = c.last AS stays
  FROM k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE stays), '')) AS kept_sha256
FROM s GROUP BY r, doc_id"""

# A repeated 50-byte string covers its bytes; strings less than a string apart make one removed run.
SUFFIX_DEDUP_SQL = """WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS data FROM documents),
p AS (
  SELECT r, doc_id, data, unnest(range(octet_length(data) - 49)) AS pos FROM d
  WHERE doc_id IS NOT NULL AND octet_length(data) >= 50),
w AS (SELECT r, doc_id, pos, array_slice(data, pos + 1, pos + 50) AS s FROM p),
g AS (SELECT r, pos, doc_id, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM w),
m AS (
  SELECT r, pos, coalesce(pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) > 50, TRUE) AS fresh
  FROM g WHERE first_doc < doc_id),
n AS (SELECT r, pos, sum(fresh::INT) OVER (PARTITION BY r ORDER BY pos) AS span FROM m),
spans AS (SELECT r, min(pos) AS low, max(pos) + 50 AS high FROM n GROUP BY r, span),
stays AS (
  SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL
  SELECT d.r, coalesce(max(s.high), 0), max(octet_length(d.data)) FROM d LEFT JOIN spans s ON d.r = s.r GROUP BY d.r),
kept AS (
  SELECT d.r, string_agg(CASE WHEN s.low < s.high THEN hex(array_slice(d.data, s.low + 1, s.high)) ELSE '' END, ''
    ORDER BY s.low, s.high) AS bytes FROM d JOIN stays s ON d.r = s.r GROUP BY d.r),
gone AS (SELECT r, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, octet_length(data) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(bytes)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)"""


# Equal words of a document at each distance, as islands of neighbours; of runs over
# one stretch the smallest distance is the period. crc32 is written out bit by bit.
PERIODIC_RUNS_SQL = r"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own FROM documents),
c AS (
  SELECT r, doc_id, own, len(own) AS n, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS h FROM d),
g AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM c),
h AS MATERIALIZED (SELECT r, doc_id, own, n, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
base AS MATERIALIZED (SELECT r, unnest(own) AS word, generate_subscripts(own, 1) - 1 AS i FROM h),
w AS MATERIALIZED (
  SELECT o.r, o.i, n, src.word FROM base o JOIN h ON o.r = h.r
  JOIN base src ON src.r = o.r AND src.i = CASE WHEN o.i >= a THEN a + (o.i - a) % p ELSE o.i END),
m AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
t AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
u AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM t GROUP BY r, start, length),
best AS (
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM u GROUP BY r),
gone AS (SELECT DISTINCT w.r, i FROM w JOIN u ON w.r = u.r AND i >= start + period AND i < start + length),
kept AS (
  SELECT w.r, string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE gone.i IS NULL) AS words
  FROM w LEFT JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256, n AS n_words
FROM h LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


def queries():
    return {
        "op1_language": op1_language,
        "op2_quality": op2_quality,
        "op3_simhash": op3_simhash,
        "op4_decontaminate": op4_decontaminate,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_token_file": op6_token_file,
        "op7_line_dedup": op7_line_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_secrets": op9_secrets,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_whitening": op11_whitening,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_mixing": op13_mixing,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op7_line_dedup": LINE_DEDUP_SQL, "op10_suffix_dedup": SUFFIX_DEDUP_SQL,
            "op12_periodic_runs": PERIODIC_RUNS_SQL}
