"""SimHash near-dedup by bit-sliced comparison.

Words are runs without ASCII white space, with A-Z in lower case; shingles are
three words joined by spaces, repeats included. A fingerprint bit is 1 if it is
set in over half of the shingles' XXH64 values.

Defined results: fewer words than a shingle has are one shingle; no word (null or
empty text) gives fingerprint zero, linked like any other. Very long texts are
taken whole, one at a time. A bit set in exactly half of the shingles is 0. Rows
with equal ids are separate rows of one id; a row without an id gets its group's
smallest id, or null. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import id_and_text, ranges, slices, stored, sums_by_row, texts_of
from tastewright.llm.components import components
from tastewright.operators.lookup import lookup

SEED = 42
BLOCKS = 8  # bytes of a fingerprint
SHINGLE, RADIUS = 3, 2


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of a text."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[: -size]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(doc_id, sig, fp)``: a hash of the text, and the 64 bits as a signed long."""

    def prints(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, counts = [], []
                for text in texts_of(part):
                    own = shingle_hashes(text, size)
                    hashes += own
                    counts.append(len(own))
                counts = np.array(counts, np.int64)
                values = np.array(hashes, np.uint64)
                bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                over = 2 * sums_by_row(bits, counts, np.uint32) > counts[:, None]
                packed = np.packbits(over, axis=1, bitorder="little").reshape(-1, 8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("sig"), pa.array(packed.copy().view("<i8").ravel())],
                    names=["doc_id", "sig", "fp"])

    signed = id_and_text(docs, id_col, text_col).withColumn("sig", F.xxhash64("text"))
    return signed.mapInArrow(prints, "doc_id long, sig long, fp long")


def left_out(radius: int) -> list[tuple[int, ...]]:
    """The bytes each key leaves out: fingerprints within ``radius`` bits agree on all others of one key at least."""
    return list(combinations(range(BLOCKS), radius))


def _keys(radius: int):
    """Every fingerprint under each of its keys: the bytes kept with the key's number, and those left over."""

    def keys(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            first = batch.column("first_doc")
            octets = fp.astype("<i8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            for number, out in enumerate(left_out(radius)):
                key, rest = np.full(len(fp), number, np.int64), np.zeros(len(fp), np.int64)
                for b in range(BLOCKS):
                    if b in out:
                        rest = (rest << 8) | octets[:, b]
                    else:
                        key = (key << 8) | octets[:, b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(rest.astype(np.int32)), first], names=["key", "rest", "first_doc"])

    return keys


def _is_first_key(number: np.ndarray, differ: np.ndarray, radius: int) -> np.ndarray:
    """Whether a pair is met under this key before any other that shows it too."""
    outs = left_out(radius)
    bits = np.array([[1 << b for b in out] for out in outs])
    covers = bits.sum(axis=1)
    first = np.array([np.argmax(covers & need == need) for need in range(1 << BLOCKS)])
    need = np.zeros(len(number), np.int64)
    for place in range(radius):
        other = differ >> 8 * (radius - 1 - place) & 255
        need |= np.where(other != 0, bits[number, place], 0)
    return first[need] == number


def near_pairs(key: np.ndarray, rest: np.ndarray, radius: int = RADIUS):
    """Positions ``(x, y)`` of rows with equal keys and at most ``radius`` differing bits.

    ``key`` is sorted. Bit planes are stored vertically, one long integer for
    each bit of the bytes left over. At each distance in the order, one pass of exclusive
    ors compares all rows at once; a counter of carry-save planes adds up the
    differing bits, and the pass ends once every comparison exceeds the radius.
    """
    n = len(key)
    as_int = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    planes = [as_int((rest >> b) & 1) for b in range(8 * radius)]
    width = radius.bit_length()
    for shift in range(1, n):
        same = key[shift:] == key[:-shift]
        if not same.any():
            return
        alive = as_int(same)
        counter, over = [0] * width, 0
        for plane in planes:
            carry = (plane ^ (plane >> shift)) & alive
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            # equal to or above radius + 1, read off the counter's planes
            above, level = 0, alive
            for k in reversed(range(width)):
                if not radius >> k & 1:
                    above |= level & counter[k]
                    level &= ~counter[k]
                else:
                    level &= counter[k]
            alive &= ~(over | above)
            if not alive:
                break
        if alive:
            bits = np.frombuffer(alive.to_bytes((n + 7) // 8, "little"), np.uint8)
            x = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            yield x, x + shift


def _links(radius: int):
    """Links of a partition sorted by key; a key has as many fingerprints at most as its bytes left over have values."""
    kept_bits = 8 * (BLOCKS - radius)

    def linked(key, rest, first):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = (sizes > 1) & (sizes <= 64)
        groups = [ranges(starts[small], sizes[small])] if small.any() else []
        groups += [np.arange(s, s + n) for s, n in zip(starts[sizes > 64], sizes[sizes > 64])]
        for rows in groups:
            k, r, f = key[rows], rest[rows], first[rows]
            for x, y in near_pairs(k, r, radius):
                new = _is_first_key(k[x] >> kept_bits, r[x] ^ r[y], radius)
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(f[x][new]), pa.array(f[y][new])], names=["a", "b"])

    def links(batches):
        held = None
        for batch in batches:
            fresh = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "rest", "first_doc")]
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield from linked(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from linked(*held)

    return links


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: first documents of any two different fingerprints within the radius, once each."""
    keys = distinct.mapInArrow(_keys(radius), "key long, rest int, first_doc long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, radius: int) -> DataFrame:
    if not 1 <= radius <= 3:
        raise ValueError("radius is 1 to 3 bits")
    prints = stored(fingerprints(docs, id_col, text_col, size))
    # Rows without an id link nothing: they join the group of their fingerprint.
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    linked = components(links(distinct.where("first_doc IS NOT NULL"), radius))
    found = distinct.join(linked, distinct.first_doc == linked.node, "left").select(
        "fp", F.coalesce("root", "first_doc").alias("component_id"))
    return lookup(prints, found, "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: shingles of ``size`` words, links of ``radius`` bits or fewer."""
    return _groups(docs, id_col, text_col, size, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows of a group after its first, by id (null last) and text hash.

    Rows of equal id and text are one document and share their fate; rows of
    equal id and different texts are judged each for itself.
    """
    rows = _groups(docs, id_col, text_col, size, radius)
    # A group without any id is that of one fingerprint.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    placed = rows.select(group.alias("group"), place.alias("place")).distinct()
    first = placed.groupBy("group").agg(F.min("place").alias("first"))
    others = lookup(placed, first, "group").where("place <> first").select("place.doc_id", "place.sig")
    same = docs[id_col].cast("long").eqNullSafe(others.doc_id) & (F.xxhash64(docs[text_col].cast("string")) == others.sig)
    return docs.join(others, same, "left_anti")
