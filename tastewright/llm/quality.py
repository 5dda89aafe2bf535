"""Quality rules: document statistics judged by monotone boosted trees.

Words are runs without ASCII white space. Trees learn from a bounded sample of
the quality labels; more symbols, repeated lines, repeated words or shouting can
only lower a score.

Defined results: null and empty texts have no word, so they fail the base rule.
Without usable labels the trees are a constant and the base rule decides.
Repeated rows give equal rows; labels of one id that disagree count as good. A
score at the limit is kept. Very long texts are taken whole, one at a time. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import WORD_BITS, WordMemo, id_and_text, slices, texts_of
from tastewright.llm.trees import BoostedTrees

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
SMALL = bytes(range(97, 123))
DIGITS = b"0123456789"
PUNCTUATION = b"!?.,;:"
LEAST_WORDS = 50
#: Labelled documents the trees learn from, on average; a hash of the id draws them.
SAMPLE = 6000
#: Least probability of good quality of a kept document.
KEEP_AT = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {  # name: direction in which quality may change
    "symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1, "marks": -1,
    "word_length": 0, "words": 0, "digits": 0, "distinct": 0,
}


def repeated_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if codes.max() >= 1 << WORD_BITS:
        codes = np.unique(codes, return_inverse=True)[1]
    if len(codes) >= 1 << WORD_BITS and codes.max() >= 1 << WORD_BITS:  # a text of over two million distinct words
        pair = np.unique((codes[:-1].astype(np.int64) << 31) | codes[1:], return_inverse=True)[1]
        windows = (pair[:-1].astype(np.int64) << 31) | codes[2:]
    else:
        windows = (codes[:-2] << 2 * WORD_BITS) | (codes[1:-1] << WORD_BITS) | codes[2:]
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not again.size:
        return 0
    at = np.searchsorted(again, windows)
    at[at == len(again)] = 0
    inside = again[at] == windows
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + n] |= inside
    return int(covered.sum())


def statistics(texts: list[bytes], memo: WordMemo) -> tuple[np.ndarray, np.ndarray]:
    """Base counts and features of each text."""
    words, counts = [], []
    for text in texts:
        own = text.split()
        words += own
        counts.append(len(own))
    codes = memo.codes(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(np.r_[0, counts], dtype=np.int64)
    total = np.r_[0, np.cumsum(sizes)]
    base, features = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(FEATURES)))
    without = lambda text, chars: len(text) - len(text.translate(None, chars))
    for k, (text, n) in enumerate(zip(texts, counts)):
        if not n:
            continue
        own = codes[ends[k] : ends[k + 1]]
        word_bytes = int(total[ends[k + 1]] - total[ends[k]])
        points = len(text) if text.isascii() else len(text.decode())
        lines = [x for x in text.split(b"\n") if x.strip()]
        chars = points - (len(text) - word_bytes)
        symbols = without(text, SYMBOLS)
        repeats = len(lines) - len(set(lines))
        repeated = repeated_words(own)
        base[k] = n, chars, symbols, repeats, repeated
        capitals, small = without(text, CAPITALS), without(text, SMALL)
        features[k] = (
            symbols / chars, repeats / max(1, len(lines)), repeated / n, capitals / max(1, capitals + small),
            without(text, PUNCTUATION) / n, chars / n, np.log1p(n), without(text, DIGITS) / chars,
            len(np.unique(own)) / n)
    return base, features


def _features(batches):
    memo = WordMemo()
    for batch in batches:
        for part in slices(batch):
            _, features = statistics(texts_of(part), memo)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality"), pa.array(list(features), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> BoostedTrees:
    """Trees from at most some ``sample`` labelled documents; only their features come to the driver.

    Of rows with one id a single text is learnt from, the one with the greatest hash.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("quality"))
    total = known.count()
    share = int((1 << 30) * min(1.0, sample / max(1, total)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # The chosen ids number some ``sample`` whatever the table's size.
    texts = id_and_text(docs, id_col, text_col)
    own = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(
        F.max_by("text", F.xxhash64("text")).alias("text"))
    rows = own.mapInArrow(_features, "doc_id long, quality int, features array<double>").collect()
    rows.sort(key=lambda r: r.doc_id)
    trees = BoostedTrees(FEATURES.values())
    x = np.array([r.features for r in rows]).reshape(-1, len(FEATURES))
    return trees.fit(x, np.array([r.quality for r in rows], np.float64))


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, score double")


def judge(docs: DataFrame, trees: BoostedTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the base rule, the trees' score and the verdict of every row."""

    def rows(batches):
        memo = WordMemo()
        for batch in batches:
            for part in slices(batch):
                base, features = statistics(texts_of(part), memo)
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])
                score = trees.probability(features)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c.copy()) for c in base.T), pa.array(failed),
                     pa.array(~failed & (score >= KEEP_AT)), pa.array(score)],
                    names=["doc_id", *BASE, "base_failed", "kept", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, SCHEMA)
