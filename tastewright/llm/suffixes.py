"""Suffix-array dedup of repeated byte strings across documents.

A byte goes if a string of ``SPAN`` bytes covers it that also starts in a
document with a smaller id. Sorting every suffix would move many times the
input, so suffixes are thinned first: every start takes as its anchor the place
of the least 16-byte hash among those inside its string, which equal strings
share. Starts in a row with one anchor are a *tile*, a suffix with its string.

1. Tiles are range-partitioned by the suffix from their anchor on: by its leading
   16 bytes as they stand, then by a hash of the whole string, at splitters drawn
   from a sample. A bucket sorts its tiles by multikey quicksort, word by word of
   eight bytes, where only ties go on to the next word, and answers each pack of
   documents: repeated (the same tile in a smaller document), plain (no other tile
   shares what its starts need), or open. A tile whose leading bytes stand at a
   splitter is open, as its bucket cannot see what is across the boundary.
   A repeated string reaches 17 bytes beyond the anchor's 16 on one side at
   least, so a tile also carries a byte of hash for either side, and only starts
   on a side that another tile shares are open.
2. Open starts, at the edges of repeats, send their strings alone.

Packs drop their own repeats before they send, so a string that all documents
share costs each pack one entry. Entries of packs travel as packed arrays. Packs
grow with the square root of the table and buckets are as many as its bytes ask
for, so that a task holds one bounded bucket whatever the table.
Tiles count as equal if the anchor's 16 bytes are and 64 bits of hash of the whole
string, which tell tiles of one anchor apart. Strings of round 2 count as equal if
96 bits of hash are, all of them of the whole string.

Defined results: null text is empty. Rows of equal id are one document to each
other: neither loses by the other. A row without an id neither loses nor makes
others lose. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import id_and_text, ranges, slices, stored, stored_by, texts_of

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
#: Text of a pack at least and at most, and of a table with packs of the least size.
PACK_BYTES, MOST_PACK_BYTES, SMALL_TABLE = 4 << 20, 64 << 20, 8 << 30
BLOCK = 1 << 21  # starts hashed at a time
#: Text of a bucket at most, and buckets of a shuffle partition at least.
BUCKET_BYTES, BUCKETS_PER_PARTITION = 64 << 20, 4
#: Packs and tiles of the sample at least; it has eight tiles a bucket.
SAMPLE_PACKS, SAMPLE_TILES, TILES_PER_BUCKET = 24, 4000, 8
SIDE = (SPAN - GRAM) // 2
PLAIN, REPEATED, OPEN_LEFT, OPEN_RIGHT = 0, 1, 2, 4
PLACE = np.uint64((1 << 24) - 1)
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * B
    return (x ^ (x >> np.uint64(29))) * C


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at every place."""
    n = len(data) - GRAM + 1
    word = np.ndarray((n + 8,), "<u8", data, strides=(1,))
    return _mix((word[:n] * A) ^ _mix(word[8 : n + 8] + C))


def multikey_order(*words: np.ndarray) -> np.ndarray:
    """The order of rows by several words, the first one first: quicksort of a word, then of the ties by the next."""
    order = np.argsort(words[0], kind="stable")
    group = np.zeros(len(order), np.int64)
    tied = np.arange(len(order))
    for k, word in enumerate(words[1:], 1):
        value = words[k - 1][order[tied]]
        new = np.ones(len(tied), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        tied, group = tied[several], number[several]
        if not tied.size:
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((word[rows], group))]
    return order


def _joined(*parts: np.ndarray) -> np.ndarray:
    out = parts[0]
    for part in parts[1:]:
        out = _mix(out * A + part)
    return out


class Tiles:
    """Tiles of the documents of a pack: first and last start, hash keys, document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, doc_ids: np.ndarray, usable: np.ndarray):
        self.data = data
        lows, highs, anchors, bodies, owners = [], [], [], [], []
        good = np.flatnonzero(usable & (np.diff(bounds) >= SPAN))
        # Runs of starts, cut so that a block stays within memory.
        first = bounds[good]
        count = bounds[good + 1] - first - SPAN + 1
        for low, size, whose in _blocks(first, count, good):
            grams = _grams(data[low[0] : low[-1] + size[-1] + SPAN - 1])
            base = int(low[0])
            least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
            width = 1
            while 2 * width <= WINDOW:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if WINDOW > width:
                least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
            starts = ranges(low - base, size)
            anchor = (least[starts] & PLACE).astype(np.int64)
            new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            lo, hi, q = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], anchor[new]
            shape = ((hi - lo) * 64 + (q - lo)).astype(np.uint64)
            bodies.append(_joined(shape, grams[lo], grams[lo + 16], grams[lo + 32], grams[hi + 2], grams[hi + 18], grams[hi + 34]))
            owners.append(np.repeat(whose, size)[new])
            lows.append(lo + base)
            anchors.append(q + base)
            highs.append(hi + base)
        whole = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.low, self.high, self.anchor = (whole(x, np.int64) for x in (lows, highs, anchors))
        self.doc = doc_ids[whole(owners, np.int64)] if len(doc_ids) else np.zeros(0, np.int64)
        left = self._side(self.anchor - SIDE, self.anchor - self.low >= SIDE)
        right = self._side(self.anchor + GRAM, self.anchor - self.high <= SIDE)
        word = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
        leading = [word[self.anchor + k].astype(np.uint64) for k in (0, 8)]
        self.entries = Entries(leading, whole(bodies, np.uint64), self.doc, left, right)

    def _side(self, place: np.ndarray, within: np.ndarray) -> np.ndarray:
        """One byte of hash, from 1 on, of the bytes beside the anchor; 0 where no start needs them."""
        out = np.zeros(len(place), np.uint8)
        at = place[within]
        if at.size:
            word = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
            value = _joined(word[at], word[at + 8], word[at + SIDE - 8])
            out[within] = (value >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
        return out

    def open_starts(self, status: np.ndarray):
        """Starts that are open by their tile's status, and the entries of their strings."""
        tiles = np.flatnonzero(status >= OPEN_LEFT)
        sizes = self.high[tiles] - self.low[tiles] + 1
        starts, own = ranges(self.low[tiles], sizes), np.repeat(tiles, sizes)
        before = self.anchor[own] - starts
        needs = OPEN_LEFT * (before >= SIDE) + OPEN_RIGHT * (before <= SPAN - GRAM - SIDE)
        met = status[own] & needs == needs
        starts, own = starts[met], own[met]
        word = np.ndarray((max(0, len(self.data) - 7),), "<u8", self.data, strides=(1,))
        grams = [_mix((word[starts + k] * A) ^ _mix(word[starts + k + 8] + C)) for k in (0, 16, 32, 34)]
        head, body = _joined(*grams), _joined(*grams[::-1])
        return starts, Entries([head], (body >> np.uint64(32)).astype(np.uint32), self.doc[own])


def _blocks(first, count, owner):
    """Groups of runs with at most ``BLOCK`` bytes between first and last; longer runs are cut."""
    lows, sizes, whose = [], [], []
    for low, n, k in zip(first.tolist(), count.tolist(), owner.tolist()):
        for at in range(low, low + n, BLOCK):
            size = min(BLOCK, low + n - at)
            if lows and at + size - lows[0] > BLOCK:
                yield np.array(lows), np.array(sizes), np.array(whose)
                lows, sizes, whose = [], [], []
            lows.append(at)
            sizes.append(size)
            whose.append(k)
    if lows:
        yield np.array(lows), np.array(sizes), np.array(whose)


class Entries:
    """Strings of a pack by leading words and hash; each different one is sent once, with its least document."""

    def __init__(self, leading: list[np.ndarray], body: np.ndarray, doc: np.ndarray, *sides: np.ndarray):
        order = multikey_order(*leading, body, doc)
        keys = [x[order] for x in (*leading, body)]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
        self.run = np.empty(len(order), np.int64)
        self.run[order] = np.cumsum(new) - 1
        *self.leading, self.body = (x[new] for x in keys)
        self.least = doc[order][new]
        self.sides = [x[order][new] for x in sides]
        self.later = doc > self.least[self.run]  # a smaller document of this pack has it

    def status(self, answers: np.ndarray) -> np.ndarray:
        """What holds for every string, from the answers for the different ones."""
        return np.where(self.later, REPEATED, answers[self.run])

    def cuts(self, splitters) -> np.ndarray:
        """Where the buckets begin in the sorted entries."""
        if not len(splitters):
            return np.array([0, len(self.body)], np.int64)
        keys = [np.array(x) for x in zip(*splitters)]
        low, high = np.searchsorted(self.leading[0], keys[0], "left"), np.searchsorted(self.leading[0], keys[0], "right")
        for k in np.flatnonzero(high > low).tolist():  # further words where the first is a splitter's
            a, b = int(low[k]), int(high[k])
            for own, key in zip(self.leading[1:], keys[1:-1]):
                a, b = a + int(np.searchsorted(own[a:b], key[k], "left")), a + int(np.searchsorted(own[a:b], key[k], "right"))
            low[k] = a + int(np.searchsorted(self.body[a:b], keys[-1][k], "right"))
        return np.concatenate([[0], low, [len(self.body)]]).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte, as sorted keys repeat their high bytes."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _spread(data: bytes, n: int, kinds):
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(np.ascontiguousarray(plane).view(kind).ravel())
        at += n * size
    return out


PACKS = "pack long, n int, blob binary"
PARTS = "bucket int, pack long, n int, blob binary"
ANSWERS = "pack long, bucket int, n int, answer binary"


def _pack_rows(batches, pack_bytes):
    part, seq = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0

    def flush():
        nonlocal seq, held
        given = np.array([i is not None for i in ids])
        named = np.array([0 if i is None else i for i in ids], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = named.tobytes() + given.tobytes() + sizes.tobytes() + b"".join(texts)
        row = pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | seq], pa.int64()), pa.array([len(ids)], pa.int32()),
             pa.array([zstandard.ZstdCompressor(level=3).compress(raw)], pa.binary())], names=["pack", "n", "blob"])
        seq, held = seq + 1, 0
        ids.clear()
        texts.clear()
        return row

    for batch in batches:
        for piece in slices(batch):
            ids += piece.column("doc_id").to_pylist()
            own = texts_of(piece)
            texts += own
            held += sum(map(len, own))
            if held >= pack_bytes:
                yield flush()
    if ids:
        yield flush()


def _unpack(blob: bytes, n: int):
    """``(ids, given, bounds, text bytes)`` of a pack."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ids, given = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, bool, n, 8 * n)
    sizes = np.frombuffer(raw[9 * n : 17 * n], np.int64)
    return ids, given, np.cumsum(np.r_[0, sizes]), np.frombuffer(raw, np.uint8, offset=17 * n)


def _tiles(blob, n):
    ids, given, bounds, data = _unpack(blob, n)
    return Tiles(data, bounds, ids, given)


def _send(entries: Entries, cuts: np.ndarray, pack: int):
    """A row for every bucket a pack has entries for."""
    low = int(entries.least.min()) if len(entries.least) else 0
    rows = []
    for bucket, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if b > a:
            head, doc = entries.leading[0][a:b], (entries.least[a:b] - low).astype(np.uint64)
            step = np.diff(head, prepend=np.uint64(0))
            more = (*entries.leading[1:], entries.body)
            blob = low.to_bytes(8, "little", signed=True) + _squeeze(step, *(x[a:b] for x in more), doc, *(x[a:b] for x in entries.sides))
            rows.append({"bucket": bucket, "pack": pack, "n": b - a, "blob": blob})
    return rows


PART_TYPE = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])
ANSWER_TYPE = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("answer", pa.binary())])


def _answer(bucket, packs, sizes, blobs, splitters, tiles: bool):
    """Statuses of all entries of a bucket: sorted by leading bytes, string and document."""
    parts = []
    words = 2 if tiles else 1  # of leading bytes, or of hash
    kinds = (*(np.uint64,) * words, np.uint64 if tiles else np.uint32, np.uint64, *(np.uint8, np.uint8) * tiles)
    for n, blob in zip(sizes, blobs):
        step, *others = _spread(blob[8:], n, kinds)
        others[words] = others[words].astype(np.int64) + int.from_bytes(blob[:8], "little", signed=True)
        parts.append((np.cumsum(step, dtype=np.uint64), *others))
    columns = [np.concatenate(x) for x in zip(*parts)]
    order = multikey_order(*columns[: words + 2])
    h, b, d = [x[order] for x in columns[:words]], columns[words][order], columns[words + 1][order]
    sides = columns[words + 2 :]
    new_head = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in h])]
    new = new_head | np.r_[True, b[1:] != b[:-1]]
    runs = np.cumsum(new) - 1
    status = np.where(d > d[np.flatnonzero(new)][runs], REPEATED, PLAIN).astype(np.uint8)
    if tiles:
        edge = np.zeros(len(order), bool)
        for first, second, _ in splitters[max(0, bucket - 1) : bucket + 1]:
            edge |= (h[0] == first) & (h[1] == second)
        group = (np.cumsum(new_head) - 1)[new]
        for side, flag in zip(sides, (OPEN_LEFT, OPEN_RIGHT)):
            value = side[order][new]
            kinds = np.unique(group * 256 + value, return_inverse=True)[1]
            shared = ((np.bincount(kinds)[kinds] > 1) & (value > 0))[runs] | edge
            status[(status != REPEATED) & shared] |= flag
    out = np.empty_like(status)
    out[order] = status
    ends = np.cumsum(np.r_[0, sizes]).tolist()
    squeeze = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_pylist([
        {"pack": p, "bucket": bucket, "n": n, "answer": squeeze.compress(out[s:e].tobytes())}
        for p, n, s, e in zip(packs, sizes, ends, ends[1:])], schema=ANSWER_TYPE)


def _answers(parts: DataFrame, splitters, tiles: bool) -> DataFrame:
    """Every pack's answers, as one array of ``(bucket, n, answer)``."""

    def buckets(batches):
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0] != row["bucket"]:
                    yield _answer(*held, splitters, tiles)
                    held = None
                held = held or (row["bucket"], [], [], [])
                for store, name in zip(held[1:], ("pack", "n", "blob")):
                    store.append(row[name])
        if held:
            yield _answer(*held, splitters, tiles)

    count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = parts.repartition(count, "bucket").sortWithinPartitions("bucket", "pack")
    answered = by_bucket.mapInArrow(buckets, ANSWERS)
    return answered.groupBy("pack").agg(F.collect_list(F.struct("bucket", "n", "answer")).alias("answers"))


def _read_answers(answers, total: int) -> np.ndarray:
    """One status for each entry a pack sent, in the order it sent them."""
    inflate = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(inflate.decompress(a["answer"]), np.uint8) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if len(out) != total:
        raise ValueError(f"{len(out)} answers for {total} entries")
    return out


def _splitters(packs: DataFrame, buckets: int):
    """Keys that cut the sampled tiles into equal parts: some tiles a bucket, whatever the packs."""
    total = packs.count()
    every = max(1, total // max(SAMPLE_PACKS, -(-TILES_PER_BUCKET * buckets // SAMPLE_TILES)))

    def sample(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = _tiles(row["blob"], row["n"]).entries
                step = max(1, len(found.body) // SAMPLE_TILES)
                keys = np.stack([x[step // 2 :: step] for x in (*found.leading, found.body)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], names=["keys"])

    drawn = packs.where(F.pmod(F.xxhash64("pack"), F.lit(every)) == 0).mapInArrow(sample, "keys binary").collect()
    keys = np.frombuffer(b"".join(r.keys for r in drawn), np.uint64).reshape(-1, 3)
    keys = keys[multikey_order(*keys.T)] if len(keys) else keys
    picked = keys[np.arange(1, buckets) * len(keys) // buckets] if len(keys) else keys
    return [tuple(k) for k in np.unique(picked, axis=0)] if len(picked) else []


def _even_splitters(buckets: int):
    return [(np.uint64((k << 64) // buckets), np.uint32(0)) for k in range(1, buckets)]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = SCHEMA + ", kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, and ``kept`` bytes if asked for."""
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = id_and_text(docs, id_col, text_col)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(BUCKETS_PER_PARTITION * count, -(-size // BUCKET_BYTES))
    pack_bytes = min(max(PACK_BYTES, int(PACK_BYTES * (size / SMALL_TABLE) ** 0.5)), max(PACK_BYTES, MOST_PACK_BYTES))
    # Hashed by pack once; answers then come to the packs where they are.
    packed = texts.mapInArrow(lambda batches: _pack_rows(batches, pack_bytes), PACKS)
    packs = stored_by(packed, count, "pack")
    splitters = _splitters(packs, buckets)

    def send_tiles(batches):
        for batch in batches:
            for row in batch.to_pylist():
                entries = _tiles(row["blob"], row["n"]).entries
                rows = _send(entries, entries.cuts(splitters), row["pack"])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=PART_TYPE)

    first = stored(_answers(packs.mapInArrow(send_tiles, PARTS), splitters, tiles=True).withColumnRenamed("answers", "first"))
    even = _even_splitters(buckets)

    def send_starts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tiles = _tiles(row["blob"], row["n"])
                status = tiles.entries.status(_read_answers(row["first"], len(tiles.entries.body)))
                _, entries = tiles.open_starts(status)
                rows = _send(entries, entries.cuts(even), row["pack"])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=PART_TYPE)

    asked = packs.join(first, "pack", "left")
    second = _answers(asked.mapInArrow(send_starts, PARTS), even, tiles=False).withColumnRenamed("answers", "second")

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, given, bounds, data = _unpack(row["blob"], row["n"])
                tiles = Tiles(data, bounds, ids, given)
                status = tiles.entries.status(_read_answers(row["first"], len(tiles.entries.body)))
                gone = np.flatnonzero(status == REPEATED)
                low, high = tiles.low[gone], tiles.high[gone] + SPAN
                if (status >= OPEN_LEFT).any():
                    starts, entries = tiles.open_starts(status)
                    again = starts[entries.status(_read_answers(row["second"], len(entries.body))) == REPEATED]
                    low, high = np.r_[low, again], np.r_[high, again + SPAN]
                n = len(data)
                depth = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))
                out = depth[:n] > 0
                rows = []
                for k, (s, e) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    mine = out[s:e]
                    removed = int(np.count_nonzero(mine))
                    kept = data[s:e] if not removed else data[s:e][~mine]
                    spans = int(mine[0]) + int(np.count_nonzero(mine[1:] & ~mine[:-1])) if removed else 0
                    rows.append({"doc_id": int(ids[k]) if given[k] else None, "n_bytes": e - s, "n_removed": removed,
                                 "n_spans": spans, "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest(),
                                 **({"kept": kept.tobytes()} if with_bytes else {})})
                fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                          ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_bytes
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return asked.join(second, "pack", "left").mapInArrow(finish, KEPT if with_bytes else SCHEMA)
