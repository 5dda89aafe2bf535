"""From raw documents to token ids, in five stages.

Each stage is ``function(spark, docs, sf_dir)`` and works on all its predecessor
kept. All but the last return the columns of ``documents``. Null and empty texts
are rejected by the first stage, as they have no letter. Rows of equal id are
judged each for itself; those of equal id and text are one document. Rows without
an id keep their lines; as copies they come after those with one. Very long texts
are taken whole. Extra columns pass through under any name, an empty table goes
through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastewright.llm import decontaminate, language, lines, sentencepiece, simhash
from tastewright.session import drop_written_table, written_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no language's model accepts."""
    return language.accepted(docs, language.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; ``n_chars`` follows the text."""
    kept = lines.dedup_lines(docs)

    def column(name):
        if name == "text":
            return F.col("text")
        own = F.col("row").getField(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            own = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(own)
        return own.alias(name)

    return kept.select(*[column(name) for name in docs.columns])


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of fingerprints: three-word shingles, two differing bits or fewer."""
    return simhash.one_of_each(docs, size=3, radius=2)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)`` of what is left."""
    return sentencepiece.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("decontamination", remove_benchmark),
    ("encoding", encode),
]

#: Language models and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, counts: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    A stage's table goes once the next one is written, the last one when Python
    ends. ``counts`` collects ``(stage, rows in, rows kept)`` of each stage.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept, path = written_table(stage(spark, docs, sf_dir))
        if counts is not None:
            counts.append((name, docs.count(), kept.count()))
        if before:
            drop_written_table(spark, before)
        docs, before = kept, path
    return STAGES[-1][1](spark, docs, sf_dir)
