"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and their beginnings learns from confirmed toxic texts and from
unlabelled ones, among which toxic texts hide at the rate of the class prior.
Its risk is the prior times the positives' loss, plus the part of the unlabelled
loss that the prior does not explain; where that part falls below zero, its
gradient is turned round (non-negative estimator).

Defined results: null and empty texts are scored by the bias alone. Without a
confirmed toxic text every score is 0. Repeated rows give equal rows; repeated
labels of an id count once, toxic if any is. Features that tie go by name, a score
of one half is predicted toxic. Very long texts are taken whole, one at a time. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import MEMO_WORDS, Rows, WordMemo, id_and_text, is_held_out, ranges, slices, stored, texts_of

#: Texts learnt from, on average: confirmed toxic ones, and unlabelled ones.
POSITIVES, UNLABELLED = 2000, 5000
#: Features kept: those with the largest score of a two-sample test.
FEATURES, LEAST_Z, LEAST_TEXTS = 512, 4.0, 3
STEPS, STEP, RIDGE, SLACK = 600, 0.05, 2e-4, 0.0
MARKS = b".,;:!?\"'()[]{}*#$%&|<>"


def features_of(word: bytes) -> list[str]:
    """The word, and its beginnings of 4 to 8 letters, which inflected forms share."""
    plain = word.lower().strip(MARKS).decode(errors="ignore")
    if not plain:
        return []
    return ["=" + plain, *("^" + plain[:n] for n in range(4, min(8, len(plain)) + 1))]


def features_in(text: bytes) -> set[str]:
    return {f for w in set(text.split()) for f in features_of(w)}


def prior_corrected_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float):
    """Weights and bias by the non-negative risk, with logistic loss and Adam steps."""
    p, u = positive.astype(np.float64), unlabelled.astype(np.float64)
    w, b = np.zeros(p.shape[1]), -2.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # loss of calling z negative: log(1 + e^z); of calling it positive: log(1 + e^-z)
        negative_part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_positive = prior * np.r_[p.T @ (sp - 1), (sp - 1).sum()] / len(p)
        as_negative = np.r_[u.T @ su, su.sum()] / len(u) - prior * np.r_[p.T @ sp, sp.sum()] / len(p)
        gradient = as_positive + as_negative if negative_part >= -SLACK else -as_negative
        gradient[:-1] += RIDGE * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


class ToxicModel:
    """Weights of words and beginnings; others weigh nothing."""

    def __init__(self, weights: dict[str, float], bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    @classmethod
    def fit(cls, words: list[str], positive: list[list[int]], unlabelled: list[list[int]], prior: float) -> "ToxicModel":
        """From the places in ``words`` of what each text has of them."""
        if not positive or not unlabelled or not 0 < prior < 1:
            return cls({}, -np.inf, prior)

        def table(texts):
            out = np.zeros((len(texts), len(words)), np.float32)
            for row, text in enumerate(texts):
                out[row, text] = 1
            return out

        weights, bias = prior_corrected_fit(table(positive), table(unlabelled), prior)
        return cls(dict(zip(words, weights.tolist())), float(bias), prior)


class Scorer:
    """Scores of texts: each feature of the model counts once a text."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.place = {w: k for k, w in enumerate(model.weights)}
        self.weight = np.array([*model.weights.values(), 0.0])
        self.ids, self.starts, self.lengths = Rows(dtype=np.int64), Rows(dtype=np.int64), Rows(dtype=np.int64)
        self.memo = WordMemo(self._compute, self._reset, MEMO_WORDS)

    def _reset(self):
        for rows in (self.ids, self.starts, self.lengths):
            rows.clear()

    def _compute(self, words):
        own = [[self.place[f] for f in features_of(w) if f in self.place] for w in words]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        self.starts.extend(self.ids.used + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.ids.extend(np.fromiter((i for ids in own for i in ids), np.int64, int(lengths.sum())))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        words, counts = [], []
        for text in texts:
            own = text.split()
            words += own
            counts.append(len(own))
        codes = self.memo.codes(words)
        at = np.flatnonzero(self.lengths.data[codes])
        lengths = self.lengths.data[codes[at]]
        found = self.ids.data[ranges(self.starts.data[codes[at]], lengths)]
        row = np.repeat(np.repeat(np.arange(len(texts)), counts)[at], lengths)
        once = np.unique(row * len(self.weight) + found)
        sums = np.bincount(once // len(self.weight), self.weight[once % len(self.weight)], len(texts))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(sums + self.model.bias)))


def _sample_features(batches):
    for batch in batches:
        for part in slices(batch):
            features = [sorted(features_in(text)) for text in texts_of(part)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("p"), part.column("u"), pa.array(features, pa.list_(pa.string()))],
                names=["doc_id", "p", "u", "features"])


def telling_features(texts: DataFrame, n_p: int, n_u: int, most: int = FEATURES) -> DataFrame:
    """``feature`` with the ``z`` of a two-sample test, the ``most`` telling of toxic texts first."""
    counts = texts.select("p", "u", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum(F.col("p").cast("long")).alias("in_p"), F.sum(F.col("u").cast("long")).alias("in_u"))
    both = (F.col("in_p") + F.col("in_u")) / F.lit(n_p + n_u)
    spread = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * F.lit(1 / n_p + 1 / n_u))
    z = (F.col("in_p") / F.lit(n_p) - F.col("in_u") / F.lit(n_u)) / spread
    telling = counts.where(F.col("in_p") >= LEAST_TEXTS).select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z)
    return telling.orderBy(F.desc("z"), F.desc("feature")).limit(most)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          id_col: str = "doc_id", text_col: str = "text", features: int = FEATURES) -> ToxicModel:
    """Learn from rows with an id that are not held out: bounded samples, drawn by a hash of the id.

    Of rows with one id a single text is learnt from, the one with the greatest
    hash. ``features`` bounds the model.

    The class prior is the share of toxic ones among the labelled rows. Texts are
    cut into features and counted on the executors; the driver gets the kept
    features and, for each text, which of them it has.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    texts = id_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    total = docs.count()

    def drawn(wanted, of, salt):
        share = int((1 << 30) * min(1.0, wanted / max(1, of)))
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < share

    # Some ``positives`` ids, whatever the table's size.
    toxic = known.where((F.col("toxic") == 1) & drawn(positives, sizes.toxic, 1)).select("doc_id", F.lit(True).alias("p"))
    marked = texts.join(F.broadcast(toxic), "doc_id", "left").select(
        "doc_id", "text", F.col("p").isNotNull().alias("p"), drawn(unlabelled, total, 2).alias("u")).where("p OR u")
    single = marked.groupBy("doc_id", "p", "u").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    sample = stored(single.mapInArrow(_sample_features, "doc_id long, p boolean, u boolean, features array<string>"))
    n = sample.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in "pu"]).first()
    if not n.p or not n.u:
        return ToxicModel.fit([], [], [], 0.0)
    words = [r.feature for r in telling_features(sample, n.p, n.u, features).collect()]
    place = {w: k for k, w in enumerate(words)}

    def places(batches):
        for batch in batches:
            own = [[place[w] for w in text if w in place] for text in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("p"), batch.column("u"), pa.array(own, pa.list_(pa.int32()))],
                names=["doc_id", "p", "u", "own"])

    rows = sample.mapInArrow(places, "doc_id long, p boolean, u boolean, own array<int>").collect()
    rows.sort(key=lambda r: r.doc_id)
    return ToxicModel.fit(
        words, [r.own for r in rows if r.p], [r.own for r in rows if r.u], sizes.toxic / max(1, sizes.n))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""

    def rows(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                score = scorer.scores(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", is_held_out(F.col("doc_id")))
    return texts.mapInArrow(rows, SCHEMA)
