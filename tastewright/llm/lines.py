"""Line dedup: sorted line hashes, first occurrences, keep bitmaps.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case. Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents keep their lines only in the largest document id.

Defined results: a null or empty text is one empty line. Rows of equal id count
as one document; each row keeps its own lines. Rows without an id are neither
counted nor changed. Lines and texts of any length are taken whole. Of documents
that tie for the largest id, all rows keep the line. An empty table gives an
empty table. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastewright.llm.common import id_and_text, quoted, slices, stored, texts_of

SPACE = b" \t\n\x0b\x0c\r"
KEYS = "hi long, lo long, doc_id long, sig long, line int"
DROPS = "doc_id long, sig long, line int"
BITMAPS = "doc_id long, sig long, keep binary"
EDGES = "hi long, lo long, n_docs long, last_doc long"


def line_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """One row per long line: 128-bit key hash, document, text signature, position."""

    def keys(batches):
        for batch in batches:
            for part in slices(batch):
                digests, rows, at = [], [], []
                for row, text in enumerate(texts_of(part)):
                    for number, line in enumerate(text.split(b"\n")):
                        if len(line) < min_chars:
                            continue
                        key = line.strip(SPACE).lower()
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            rows.append(row)
                            at.append(number)
                if rows:
                    pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    picked = part.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), picked.column("doc_id"),
                         picked.column("sig"), pa.array(at, pa.int32())],
                        names=["hi", "lo", "doc_id", "sig", "line"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(keys, KEYS)


def _columns(batch, names):
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _runs(batches):
    """Whole runs of equal keys of a sorted partition: arrays and the starts of the runs.

    A run that goes on in the next batch is carried over; range partitioning
    also splits by document, so a run is never longer than a partition.
    """
    held = None
    for batch in batches:
        fresh = _columns(batch, ["hi", "lo", "doc_id", "sig", "line"])
        held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
        hi, lo = held[:2]
        starts = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(hi) else []
        if len(starts) > 1:
            last = starts[-1]
            yield [x[:last] for x in held], starts[:-1]
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield held, np.array([0])


def _documents_in_runs(doc_id, starts):
    fresh = np.r_[True, doc_id[1:] != doc_id[:-1]]
    fresh[starts] = True
    return np.add.reduceat(fresh.astype(np.int64), starts)


def _edges(batches):
    first = last = None
    for (hi, lo, doc_id, _, _), starts in _runs(batches):
        n = _documents_in_runs(doc_id, starts)
        row = lambda k: (int(hi[starts[k]]), int(lo[starts[k]]), int(n[k]), int(doc_id[starts[k]]))
        first, last = first or row(0), row(-1)
    rows = [first] if first == last else [first, last]
    if first:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["hi", "lo", "n_docs", "last_doc"])


def dropped_lines(keys: DataFrame, min_docs: int = 5) -> DataFrame:
    """Lines that go: every one of a common key but those in its largest document.

    Keys are range-partitioned with the document in the bounds, so a key that
    fills many lines spreads over partitions. Each partition tells its first and
    last key (two rows a partition) and what a key has in all partitions decides.
    """
    order = [F.col("hi"), F.col("lo"), F.desc("doc_id")]
    ordered = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order, "sig", "line"))
    totals: dict[tuple[int, int], tuple[int, int]] = {}
    for r in ordered.mapInArrow(_edges, EDGES).collect():
        n, last = totals.get((r.hi, r.lo), (0, r.last_doc))
        totals[r.hi, r.lo] = (n + r.n_docs, max(last, r.last_doc))

    def drops(batches):
        for (hi, lo, doc_id, sig, line), starts in _runs(batches):
            n = _documents_in_runs(doc_id, starts)
            last = doc_id[starts].copy()
            for k in {0, len(starts) - 1}:
                n[k], last[k] = max((n[k], last[k]), totals.get((int(hi[starts[k]]), int(lo[starts[k]])), (0, 0)))
            lengths = np.diff(np.r_[starts, len(hi)])
            gone = np.repeat(n >= min_docs, lengths) & (np.repeat(last, lengths) != doc_id)
            if gone.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[gone]) for x in (doc_id, sig, line)], names=["doc_id", "sig", "line"])

    return ordered.mapInArrow(drops, DROPS)


def keep_bitmaps(drops: DataFrame) -> DataFrame:
    """``(doc_id, sig, keep)``: deflated bits, 1 for each line that stays.

    Bits end with the last dropped line; later lines stay. Documents that lose
    nothing have no row.
    """

    def bitmaps(batches):
        held = None
        for batch in _with_end(batches):
            fresh = None if batch is None else _columns(batch, ["doc_id", "sig", "line"])
            if fresh is not None:
                held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            if held is None or not len(held[0]):
                continue
            doc_id, sig, line = held
            starts = np.flatnonzero(np.r_[True, (doc_id[1:] != doc_id[:-1]) | (sig[1:] != sig[:-1])])
            ends = np.r_[starts[1:], len(doc_id)]
            done = len(starts) - (batch is not None)
            made = []
            for low, high in zip(starts[:done].tolist(), ends[:done].tolist()):
                bits = np.ones((int(line[high - 1]) | 7) + 1, np.uint8)  # whole bytes
                bits[line[low:high]] = 0
                made.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id[starts[:done]]), pa.array(sig[starts[:done]]), pa.array(made, pa.binary())],
                    names=["doc_id", "sig", "keep"])
            cut = int(ends[done - 1]) if done else 0
            held = [x[cut:] for x in held]

    by_doc = drops.repartition("doc_id", "sig").sortWithinPartitions("doc_id", "sig", "line")
    return by_doc.mapInArrow(bitmaps, BITMAPS)


def _with_end(batches):
    yield from batches
    yield None


def _apply(batches):
    for batch in (part for whole in batches for part in slices(whole)):
        texts, counts, dropped = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
            lines = (text or "").split("\n")
            counts.append(len(lines))
            if keep is None:
                texts.append(text)
                dropped.append(0)
                continue
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
            stays = [line for line, bit in zip(lines, bits.tolist()) if bit] + lines[len(bits):]
            texts.append("\n".join(stays))
            dropped.append(len(lines) - len(stays))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
             pa.array(dropped, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``(row, text, n_lines, n_dropped)``: the whole input row and its text without the lines that go."""
    signed = id_and_text(docs, id_col, text_col).withColumn("sig", F.xxhash64("text"))
    bitmaps = keep_bitmaps(dropped_lines(line_keys(signed, min_chars), min_docs))
    whole = docs.select(
        F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("sig"))
    joined = whole.join(bitmaps, ["doc_id", "sig"], "left").select("row", "text", "keep")
    schema = T.StructType([
        T.StructField("row", whole.schema["row"].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_apply, schema)
