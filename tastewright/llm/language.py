"""Language identification by interpolated Kneser-Ney character models.

One model of order 5 per language over words of letters with their ends marked.
Every language and every letter of the sample is learnt; n-grams are 64-bit
hashes, so the alphabet has no limit. Probabilities of a block of languages stand
side by side in sorted hash arrays, one for each order, already interpolated; an
n-gram no language of the block has falls back to the next order by the weight of
its context. The lowest cross-entropy per character
wins. A document is rejected when even that is far above what texts of the
language have that were set apart from training: above a place towards the entropy
of words of its letters in random order, and above the entropy that all but
``FALSE_REJECTION`` of the set-apart texts keep below.

Defined results: null text or no letter (by Unicode class) gives ``und``, score 0,
rejected. Very long texts are taken whole, one at a time.
Training rows with null text, language or id are left out; if nothing is left
to learn from, every prediction is ``und``. Equal entropies go to the language that
sorts first. Repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import (
    MEMO_WORDS, SLICE_BYTES, Rows, WordMemo, id_and_text, is_held_out, slices, stored, sums_by_row, texts_of,
    whole_rows)

ORDER = 5
#: Texts a language is learnt from, on average; which ones, a hash of the id says.
SAMPLE_PER_LANGUAGE = 400
#: Texts of all languages together, which share it evenly if there are many, and the least for each of them.
SAMPLE_TOTAL, LEAST_TEXTS = 25_600, 20
#: Languages side by side in one table.
BLOCK = 16
#: Languages up to which memos and slices have their full size.
FULL_SIZE = 64
#: One in so many sampled texts is set apart for the limits, and the share of them that may be rejected.
APART, FALSE_REJECTION = 5, 0.005
#: Where between a language's mean entropy and that of its shuffled letters the limit stands.
REJECT_AT = 0.7
#: Letters from which on an entropy is judged.
LEAST_LETTERS = 20
EDGE = 1  # the number that marks both ends of a word
LETTERS = re.compile(r"[^\W\d_]+")
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def letter_runs(word: bytes) -> list[str]:
    """Runs of letters, in lower case; numbers such as fractions or circled ones are none."""
    runs = LETTERS.findall(word.decode().lower())
    if all(map(str.isalpha, runs)):
        return runs
    return "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()


def _longer(grams: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with one more symbol before them."""
    mixed = grams * MIX + before
    return (mixed ^ (mixed >> np.uint64(29))) * STIR


def _grams(runs: list[str], number: np.ndarray, known: np.ndarray):
    """N-grams of all runs, each ended by a mark, by order; their contexts by order; the symbols of each run."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
    ends = np.cumsum(sizes) - 1
    text = np.frombuffer(("\0".join(runs) + "\0").encode("utf-32-le"), np.uint32)
    place = np.searchsorted(known, text)
    place[place == len(known)] = 0
    codes = np.where(known[place] == text, number[place], 0).astype(np.uint64)
    codes[ends] = EDGE
    since = np.arange(len(text)) - np.repeat(ends - sizes + 1, sizes)
    grams, edges = [np.zeros(len(text), np.uint64), codes], [np.zeros(1, np.uint64), np.full(1, EDGE, np.uint64)]
    for back in range(1, ORDER):
        before = np.full(len(text), EDGE, np.uint64)
        inside = since >= back
        before[inside] = codes[np.flatnonzero(inside) - back]
        grams.append(_longer(grams[-1], before))
        edges.append(_longer(edges[-1], np.full(1, EDGE, np.uint64)))
    contexts = [None] + [np.where(since > 0, np.roll(grams[k], 1), edges[k]) for k in range(ORDER)]
    return grams, contexts, sizes


class Table:
    """Rows by n-gram, in a sorted array of hashes."""

    def __init__(self, grams: np.ndarray, rows: np.ndarray):
        hashes = grams * MIX  # odd: one hash for each n-gram
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order].astype(np.float32)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The row of each n-gram, or -1."""
        if not len(self.hashes):
            return np.full(len(grams), -1, np.int64)
        hashes = grams * MIX
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, -1)


class Block:
    """Kneser-Ney models of some languages, from their counts by order."""

    def __init__(self, tables: list[dict], uniform: float):
        n = len(tables)
        lower_grams, lower = np.zeros(1, np.uint64), np.full((1, n), uniform)
        self.n, self.floor = n, np.log(uniform)
        self.grams, self.weights = [None], [None]
        for order in range(1, ORDER + 1):
            every, _, suffixes, before = (np.concatenate(x) for x in zip(*(t[order] for t in tables)))
            union, at = np.unique(every, return_index=True)
            suffixes, before = suffixes[at], before[at]
            contexts = np.unique(before)
            below = lower[np.searchsorted(lower_grams, suffixes)]
            value, weight = np.empty((len(union), n)), np.ones((len(contexts), n))
            for k, table in enumerate(tables):
                grams, count, _, context = table[order]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                own, inverse = np.unique(context, return_inverse=True)
                total, kinds = np.bincount(inverse, count, len(own)), np.bincount(inverse, minlength=len(own))
                at = np.searchsorted(contexts, own)
                weight[at, k] = np.maximum(discount * kinds / total, 1e-9)
                value[:, k] = 0
                value[np.searchsorted(union, grams), k] = np.maximum(count - discount, 0) / total[inverse]
            value += weight[np.searchsorted(contexts, before)] * below
            self.grams.append(Table(union, np.log(value)))
            self.weights.append(Table(contexts, np.log(weight)))
            lower_grams, lower = union, value

    def scores(self, grams, contexts, sizes) -> np.ndarray:
        """Log-probability of each run in each language."""
        value = np.zeros((len(grams[1]), self.n), np.float32)
        left = np.arange(len(value))
        for order in range(ORDER, 0, -1):
            at = self.grams[order].find(grams[order][left])
            hit = at >= 0
            value[left[hit]] += self.grams[order].rows[at[hit]]
            left = left[~hit]
            if not left.size:
                break
            at = self.weights[order].find(contexts[order][left])
            met = at >= 0
            value[left[met]] += self.weights[order].rows[at[met]]
        value[left] += self.floor
        return sums_by_row(value, sizes)


class LanguageModel:
    """Kneser-Ney models of several languages over one alphabet."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        alphabet = sorted({c for words in counts.values() for word in words for c in word})
        self.known = np.array([ord(c) for c in alphabet] or [0], np.uint32)
        self.number = np.arange(2, len(self.known) + 2, dtype=np.uint64)
        self.limits = np.full(len(self.languages), np.inf)
        uniform = 1.0 / (len(alphabet) + 2)
        self.blocks = [
            Block([self._counts(counts[name]) for name in self.languages[at : at + BLOCK]], uniform)
            for at in range(0, len(self.languages), BLOCK)]

    @property
    def grams(self) -> list:
        """N-grams by order, of the first block."""
        return self.blocks[0].grams

    def share(self, size: int) -> int:
        """A size for what grows with the number of languages."""
        return max(1, size * FULL_SIZE // max(FULL_SIZE, len(self.languages)))

    def _counts(self, words: Counter):
        """By order: n-grams, counts (of occurrences at the top, of left extensions below), suffixes, contexts."""
        runs = list(words)
        grams, contexts, sizes = _grams(runs, self.number, self.known)
        times = np.repeat(np.fromiter(words.values(), np.int64, len(runs)), sizes)
        kinds, first, inverse = np.unique(grams[ORDER], return_index=True, return_inverse=True)
        tables = {ORDER: (kinds, np.bincount(inverse, times), grams[ORDER - 1][first], contexts[ORDER][first])}
        for order in range(ORDER - 1, 0, -1):
            kinds, at, count = np.unique(grams[order][first], return_index=True, return_counts=True)
            first = first[at]
            tables[order] = (kinds, count, grams[order - 1][first], contexts[order][first])
        return tables

    def word_scores(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each run in each language, and its symbols."""
        grams, contexts, sizes = _grams(runs, self.number, self.known)
        return np.concatenate([b.scores(grams, contexts, sizes) for b in self.blocks], axis=1), sizes

    def noise_entropy(self, language: str, words: Counter) -> float:
        """Mean entropy, in its language, of the words' letters in random order."""
        runs = sorted(words)
        letters = np.array(list("".join(runs)))
        np.random.default_rng(7).shuffle(letters)
        cuts = np.cumsum([0, *map(len, runs)]).tolist()
        mixed = "".join(letters.tolist())
        at = self.languages.index(language)
        grams, contexts, sizes = _grams([mixed[a:b] for a, b in zip(cuts, cuts[1:])], self.number, self.known)
        sums = self.blocks[at // BLOCK].scores(grams, contexts, sizes)
        return float(-sums[:, at % BLOCK].sum() / max(1, sizes.sum()))


class Scorer:
    """Cross-entropies of texts, with a memo of distinct words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.sums, self.symbols = Rows(len(model.languages)), Rows(dtype=np.int64)
        self.memo = WordMemo(self._compute, self._reset, model.share(MEMO_WORDS))

    def _reset(self):
        self.sums.clear()
        self.symbols.clear()

    def _compute(self, words):
        runs = [letter_runs(w) for w in words]
        counts = np.fromiter(map(len, runs), np.int64, len(runs))
        sums, sizes = np.zeros((len(words), len(self.model.languages))), np.zeros(len(words), np.int64)
        if counts.any():
            values, lengths = self.model.word_scores([r for own in runs for r in own])
            sums, sizes = sums_by_row(values, counts), sums_by_row(lengths, counts).astype(np.int64)
        self.sums.extend(sums)
        self.symbols.extend(sizes)

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text in each language, and its symbols."""
        words, counts = [], []
        for text in texts:
            own = text.split()
            words += own
            counts.append(len(own))
        counts = np.array(counts, np.int64)
        codes = self.memo.codes(words)
        symbols = sums_by_row(self.symbols.data[codes], counts).astype(np.int64)
        sums = sums_by_row(self.sums.data[codes], counts)
        return -sums / np.maximum(symbols, 1)[:, None], symbols

    def predict(self, texts: list[bytes]):
        """``(language or und, score, entropy, rejected)`` of each text, as arrays."""
        names = np.array([*self.model.languages, "und"], object)
        if not self.model.languages:
            none = np.zeros(len(texts))
            return np.full(len(texts), "und", object), none, none, np.ones(len(texts), bool)
        entropy, symbols = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        # Share of the winner if a text of at most 50 symbols had to be told apart.
        odds = np.exp(-(entropy - lowest[:, None]) * np.minimum(symbols, 50)[:, None])
        score = 1 / odds.sum(axis=1)
        none = symbols == 0
        rejected = none | ((symbols >= LEAST_LETTERS) & (lowest > self.model.limits[best]))
        return names[np.where(none, len(names) - 1, best)], np.where(none, 0.0, score), np.where(none, 0.0, lowest), rejected


def _count_words(batches):
    for batch in batches:
        counts: dict[str, Counter] = {}
        for part in slices(batch):
            for name, text in zip(part.column("lang").to_pylist(), texts_of(part)):
                counts.setdefault(name, Counter()).update(r for w in text.split() for r in letter_runs(w))
        for name, words in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(words), pa.string()), pa.array(list(words), pa.string()),
                 pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", total: int = SAMPLE_TOTAL) -> LanguageModel:
    """Models from a bounded sample of the rows that are not held out.

    ``sample`` texts of each language on average, or an equal share of ``total``
    if there are many languages, but not fewer than ``LEAST_TEXTS``; drawn by a
    hash of the id at a rate set by the language's count. One in ``APART`` of the
    drawn texts is not learnt from: limits come from these. Word counts are summed
    on the executors and only those of the sample come to the driver.
    """
    known = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        docs[lang_col].cast("string").alias("lang"))
    known = known.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return LanguageModel({})
    sample = min(sample, max(LEAST_TEXTS, total // len(sizes))) * APART / (APART - 1)
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int((1 << 30) * min(1.0, sample / r.n)))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(rates[F.col("lang")], F.lit(0))
    chosen = stored(known.where(drawn).withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(APART)) == 0))
    counts = {r.lang: Counter() for r in sizes}
    for r in chosen.where("NOT apart").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counts[r.lang][r.word] += r.n
    model = LanguageModel({k: v for k, v in counts.items() if v})

    def own_entropy(batches):
        scorer, place = Scorer(model), {k: i for i, k in enumerate(model.languages)}
        for batch in batches:
            for part in slices(batch, size=model.share(SLICE_BYTES)):
                entropy, symbols = scorer.entropies(texts_of(part))
                at = np.array([place.get(k, 0) for k in part.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array(entropy[np.arange(len(at)), at]), pa.array(symbols)],
                    names=["lang", "entropy", "symbols"])

    judged = chosen.where("apart").mapInArrow(own_entropy, "lang string, entropy double, symbols long").where(
        F.col("symbols") >= LEAST_LETTERS).groupBy("lang").agg(
        F.avg("entropy").alias("mean"), F.percentile("entropy", 1 - FALSE_REJECTION).alias("most"))
    for r in judged.collect():
        if r.lang in model.languages:
            noise = model.noise_entropy(r.lang, counts[r.lang])
            model.limits[model.languages.index(r.lang)] = max(r.most, r.mean + REJECT_AT * max(0.0, noise - r.mean))
    return model


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, entropy, rejected)`` of every row."""
    def predict(batches):
        scorer = Scorer(model)  # bounded by the sample
        for batch in batches:
            for part in slices(batch, size=model.share(SLICE_BYTES)):
                name, score, entropy, rejected = scorer.predict(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(name, pa.string()), pa.array(score),
                     pa.array(entropy), pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"])

    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", is_held_out(F.col("doc_id")))
    return texts.mapInArrow(predict, SCHEMA)


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged."""
    def keeper(text):
        def keep(batches):
            scorer = Scorer(model)
            for batch in batches:
                for part in slices(batch, text, model.share(SLICE_BYTES)):
                    yield part.filter(pa.array(~scorer.predict(texts_of(part, text))[3], pa.bool_()))

        return keep

    return whole_rows(docs, text_col, keeper)
