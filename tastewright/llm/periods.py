"""Periodic runs of words, found from multi-scale minimizers.

A run is a longest stretch of consecutive words with smallest period q that is
at least ``min_exponent`` periods and ``min_length`` words long. Words are runs
of anything but ASCII white space.

Short periods are found by direct lag scans. A scale of width w covers the
periods from 2w/3 to w: every place is hashed with the w words that begin there,
and the least hash of each window of w places is a minimizer. In a run of such a
period two minimizers of equal hash stand one period apart and nothing equal
between them, since w words or more with two periods would have a smaller one.
A run of four periods is long enough for such a pair at its scale. Neighbouring
equal minimizers are the seeds; comparing words extends them to whole runs.

Defined results: null, empty and blank texts have no word and no run. A row is
judged for itself, so rows of equal or no id are separate rows. Runs that
overlap, or start together with other periods, are all given. Very long texts
are taken whole, some 100 bytes of memory a word. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import WordMemo, id_and_text, ranges, slices, texts_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Periods found by comparing each word with the one so many places on.
DIRECT = 10
RUNS = "array<struct<start: long, length: long, period: long>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


# --- one batch of texts -------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _after(x: np.ndarray, shift: int, fill) -> np.ndarray:
    """``x[i + shift]``, and ``fill`` past the end."""
    out = np.full_like(x, fill)
    if shift < len(x):
        out[: len(x) - shift] = x[shift:]
    return out


def _pair(x: np.ndarray, shift: int) -> np.ndarray:
    """A hash of ``x[i]`` and ``x[i + shift]``."""
    return _mixed(x * np.uint64(3) + _mixed(_after(x, shift, 0) + np.uint64(0x9E3779B97F4A7C15)))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of ``x[i : i + width]`` for each whole window."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of a window of ``width`` places."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.int64)
    least = _sliding(hashes, width, np.minimum)
    # a window begins up to width - 1 places before the place
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, width, np.maximum) == hashes)


def _matches(c: np.ndarray, at: int, lag: int, step: int) -> int:
    """Number of places from ``at`` on, in direction ``step``, whose word equals the one ``lag`` on."""
    found, size = 0, 64
    while True:
        if step > 0:
            low, high = at + found, min(at + found + size, len(c) - lag)
        else:
            low, high = max(0, at - found - size + 1), at - found + 1
        if low >= high:
            return found
        differ = np.flatnonzero(c[low:high] != c[low + lag : high + lag])
        if differ.size:
            return found + int(differ[0] if step > 0 else high - low - 1 - differ[-1])
        found += high - low
        size = min(2 * size, 1 << 16)


def _prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def _least_length(q: int, min_length: int, min_exponent: int) -> int:
    return max(min_length, min_exponent * q)


def direct_runs(c: np.ndarray, last: int, min_length: int, min_exponent: int):
    """``(start, length, period)`` arrays of all runs with periods up to ``last``."""
    equal = {}
    for q in range(1, last + 1):
        if q >= len(c):
            return
        same = c[:-q] == c[q:]
        equal[q] = np.concatenate([[0], np.cumsum(same)])
        ends = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
        found = np.flatnonzero(np.diff(ends) - 1 >= _least_length(q, min_length, min_exponent) - q)
        start, length = ends[found] + 1, ends[found + 1] - ends[found] - 1 + q
        smallest = np.ones(len(start), bool)
        for p in _prime_factors(q):
            sums = equal[q // p]
            smallest &= sums[start + q] - sums[start] < q
        yield start[smallest], length[smallest], np.full(int(smallest.sum()), q)


def seeded_runs(c: np.ndarray, place: np.ndarray, period: np.ndarray, min_length: int, min_exponent: int, known: set):
    """Runs that seeds (words at ``place`` and ``period`` on) extend to, each once, as rows."""
    rows, covered = [], (0, 0)
    order = np.lexsort((place, period))
    for m, q in zip(place[order].tolist(), period[order].tolist()):
        if covered[0] == q and m < covered[1]:
            continue
        right = _matches(c, m, q, 1)
        start = m - _matches(c, m - 1, q, -1)
        covered = (q, m + max(right, 1))
        length = m + right - start + q
        if right and length >= _least_length(q, min_length, min_exponent) and (start, q) not in known and not any(
                np.array_equal(c[start : start + q], c[start + q // p : start + q + q // p]) for p in _prime_factors(q)):
            known.add((start, q))
            rows.append((start, length, q))
    return rows


def runs_of(codes: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """``(text, start, length, period)`` rows of all runs of some texts, in order.

    ``codes`` are the word numbers, from 0, of all texts one after another, of which
    each has ``counts``.
    """
    counts = np.asarray(counts, np.int64)
    # Every text ends with a word of its own, which no run can hold.
    starts = np.cumsum(counts + 1) - (counts + 1)
    c = np.empty(int(counts.sum()) + len(counts), np.int64)
    c[starts + counts] = -1 - np.arange(len(counts))
    c[ranges(starts, counts)] = codes
    found = [np.stack([s, n, q], axis=1) for s, n, q in direct_runs(c, DIRECT, min_length, min_exponent)]
    tables = [(np.concatenate(found) if found else np.empty((0, 3), np.int64), starts, np.arange(len(counts)))]
    live, at, hashes, power, width = np.arange(len(counts)), starts, _mixed(c.view(np.uint64)), 1, DIRECT
    known: set = set()
    while True:
        width = 3 * (width + 1) // 2
        low = -(-2 * width // 3)
        long = counts[live] >= _least_length(low, min_length, min_exponent)
        if not long.any():
            break
        if not long.all():
            rows = ranges(at[long], counts[live][long] + 1)
            c, hashes, live, known = c[rows], hashes[rows], live[long], set()
            at = np.cumsum(counts[live] + 1) - (counts[live] + 1)
        while 2 * power <= width:
            hashes, power = _pair(hashes, power), 2 * power
        grams = _pair(hashes, width - power) if width > power else hashes
        place = minimizers(grams, width)
        by_hash = place[np.argsort(grams[place], kind="stable")]
        near = np.diff(by_hash)
        fits = (near >= low) & (near <= width) & (grams[by_hash[1:]] == grams[by_hash[:-1]])
        seeds = np.flatnonzero(fits)
        rows = seeded_runs(c, by_hash[seeds], near[seeds], min_length, min_exponent, known)
        tables.append((np.array(rows, np.int64).reshape(-1, 3), at, live))
    every = []
    for rows, begin, names in tables:
        own = np.searchsorted(begin, rows[:, 0], side="right") - 1
        every.append(np.column_stack([names[own], rows[:, 0] - begin[own], rows[:, 1:]]) if len(rows) else np.empty((0, 4), np.int64))
    # of two runs with one start that of the smaller period is the shorter
    return np.unique(np.concatenate(every), axis=0)


def collapsed_words(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep).tolist())


# --- Spark --------------------------------------------------------------------

def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row.

    ``runs`` are in order of start, then period; ``collapsed`` has the words that
    stay, joined by spaces, where a run keeps its first period only. The exponent
    is 4 at least, as the scales need it.
    """
    if min_exponent < 4:
        raise ValueError("min_exponent is 4 or more")

    def find(batches):
        memo = WordMemo()
        for batch in batches:
            for part in slices(batch):
                texts = [text.split() for text in texts_of(part)]
                counts = np.array([len(words) for words in texts], np.int64)
                codes = memo.codes([word for words in texts for word in words])
                rows = runs_of(codes, counts, min_length, min_exponent)
                ends = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
                collapsed = [
                    collapsed_words(words, rows[low:high, 1:]) if low < high else b" ".join(words)
                    for words, low, high in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]
                fields = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields), pa.array(collapsed, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(find, SCHEMA)


def strongest(runs):
    """The run with the greatest exact exponent: the first of them; null without any."""
    none = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("period"))
    best = F.aggregate(runs, none, lambda best, run: F.when(run.length * best.period > best.length * run.period, run).otherwise(best))
    return F.when(F.size(runs) > 0, best)
