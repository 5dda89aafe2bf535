"""Helpers the operators share: text columns, slices of batches, word memos."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.session import use_checkpoint_folder

#: Bytes of text a task works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Distinct words a memo holds before it starts anew.
MEMO_WORDS = 400_000
#: 3-word windows pack three word numbers of this many bits.
WORD_BITS = 21


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of any table; other columns are left behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def whole_rows(docs: DataFrame, column: str, make: Callable[[str], Callable]) -> DataFrame:
    """``docs`` through ``mapInArrow`` by ``make(name)``, where ``name`` is what ``column`` is called inside.

    Columns have plain names on the way, as that call takes no other.
    """
    plain = [f"c{k}" for k in range(len(docs.columns))]
    inner = docs.toDF(*plain)
    return inner.mapInArrow(make(plain[docs.columns.index(column)]), inner.schema).toDF(*docs.columns)


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the shared checkpoint folder.

    The files go when the frame is no longer referenced, with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    use_checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


def stored_by(rows: DataFrame, count: int, column: str) -> DataFrame:
    """``rows`` stored hashed by ``column``; later joins on it leave them where they are.

    A stored frame keeps its partitioning only if adaptive execution did not
    make it, so that is off while the rows are written.
    """
    conf = rows.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return stored(rows.repartition(count, column))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes in ``column``, in order."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null reads as empty."""
    values = batch.column(column).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


class WordMemo:
    """Numbers distinct words and keeps what ``compute`` made of them.

    ``compute(words)`` is called for words not met before and appends one row
    per word to its own store. ``reset`` is called when the memo starts anew.
    """

    def __init__(self, compute: Callable[[list[bytes]], None] | None = None,
                 reset: Callable[[], None] | None = None, limit: int = MEMO_WORDS):
        self.compute, self.reset, self.limit, self.index = compute, reset, limit, {}

    def codes(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; numbers hold until the next call."""
        index = self.index
        if len(index) > self.limit:
            index.clear()
            if self.reset:
                self.reset()
        found = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if missing.size:
            asked = [words[i] for i in missing.tolist()]
            fresh = list(dict.fromkeys(asked))
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            if self.compute:
                self.compute(fresh)
            found[missing] = np.fromiter(map(index.__getitem__, asked), np.int64, len(asked))
        return found


class Rows:
    """A growing array."""

    def __init__(self, width: int | None = None, dtype=np.float32):
        self.shape = () if width is None else (width,)
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.used, self.data = 0, np.empty((1024, *self.shape), self.dtype)

    def extend(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            grown = np.empty((max(need, 2 * len(self.data)), *self.shape), self.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used : need] = values
        self.used = need


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges ``starts[i] .. starts[i] + lengths[i]``, in order."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def sums_by_row(values: np.ndarray, counts: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values; empty runs give zero."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype)
    full = np.flatnonzero(counts)
    if full.size:
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=dtype)
    return out


def is_held_out(doc_id):
    """Rows no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
