"""Token ids in directly addressable codes.

Ids are cut into 8-bit chunks, lowest first. Level 0 has the first chunk of
every id, level k the next chunk of the ids that go on, and a bitmap beside each
level tells which do. A rank directory over the bitmap gives the place in the
next level, so any token is read without decoding its neighbours.

A file is a row of an uncompressed parquet table in the shared folder; executors
can write no other shared file everywhere. Its columns are its place in the
order, ``doc_ids`` and ``ends`` of its documents, in ids from the file's start,
and for each level k the bytes of

    ck: a chunk of each id | bk: bitmap, big-endian 64-bit words, lowest bit first
    rk: for each word the ones before it, big-endian, 32 bits

Levels and files are columns and rows, so looking a token up reads the pages of
one level of the files asked for, and no other. Files are bounded, whatever a
partition holds.

Defined results: null or empty text is the end id alone. Documents are in
ascending id, those without one first; rows of equal id stand by text hash, and
rows equal in both are alike and stand in any order. A very long text is one
document of a file that ends with it. An empty table gives no file and no row.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import Rows, id_and_text, ranges, slices, stored, texts_of
from tastewright.operators.lookup import lookup
from tastewright.session import written_table

END_ID = 0
FILE_IDS = 1 << 16
LEVELS = 4  # of 8 bits, for any id of 32
#: Distinct parts of texts a worker remembers.
MEMO_PARTS = 2_000_000
NO_ID = -(1 << 63)
#: Bytes of texts that are cut and looked up at once.
ENCODED_AT_ONCE = 4 << 20
#: Rows of a sample that tells where partitions end, and text bytes of a partition.
SAMPLE_ROWS, PARTITION_BYTES = 20_000, 256 << 20
#: Pages of about one file's level, groups of a few files.
LAYOUT = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": 4 << 20,
          "parquet.page.size": 64 << 10, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 4}
#: Files whose keys are handed to the scan as a filter, when so few are asked for.
FEW_FILES = 1000
#: A space before one of these bytes, or the end, is not cut at: white space may
#: begin there, which belongs to the same piece.
UNSURE = re.compile(rb" (?:[\x00-\x20\xc2\xe1-\xe3]|\Z)")
FILES = "part int, seq int, first_id long, n_ids long, n_docs long, doc_ids array<bigint>, ends array<bigint>, " + ", ".join(
    f"c{k} binary, b{k} binary, r{k} binary" for k in range(LEVELS))


# --- encoding -----------------------------------------------------------------

def word_parts(text: bytes) -> list[bytes]:
    """Text cut at single spaces where the pre-tokenizer always cuts as well.

    Every part but the first stands for itself with a space before it; the first
    is marked by a leading space that is not part of it.
    """
    parts = text.split(b" ")
    parts[0] = b" " + parts[0]
    if UNSURE.search(text):
        merged = parts[:1]
        for part in parts[1:]:
            if not part or part[0] <= 32 or part[0] in (0xC2, 0xE1, 0xE2, 0xE3):
                merged[-1] += b" " + part
            else:
                merged.append(part)
        return merged
    return parts


# Pieces the byte-level pre-tokenizer cuts at for certain: Latin letters, digits,
# signs but the apostrophe, single line feeds; a space before belongs to a piece.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ITEM = "(?:[" + _LETTERS + "]+|[0-9]+|[" + re.escape('!"#$%&()*+,-./:;=>?@[\\]^_`{|}~') + "]+)"
CERTAIN, PIECES = re.compile(f" ?{_ITEM}+(?:\n{_ITEM}+)*\\Z"), re.compile(f" ?{_ITEM}|[\n\0]")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    """A tokenizer of the tokenizers library, asked once for each distinct part of a text.

    Parts that fall into certain pieces go to the library's model piece by piece,
    other parts through the whole tokenizer. Known parts are kept by 128-bit hash
    in sorted arrays, up to ``MEMO_PARTS`` of them.
    """

    def __init__(self, json_text: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        told = json.loads(json_text)
        cut = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("the tokenizer must be byte-level, without a normalizer")
        self.tokenizer = Tokenizer.from_str(json_text)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.ids = Rows(dtype=np.uint32)
        self._forget()

    def _forget(self):
        self.ids.clear()
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _piece_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that are ``CERTAIN``."""
        pieces = PIECES.findall("\0".join(texts))
        distinct = [piece for piece in dict.fromkeys(pieces) if piece != "\0"]
        as_letters = "\0".join(distinct).encode().decode("latin-1").translate(self.letters).split(chr(self.letters[0])) if distinct else []
        tokenize = self.model.tokenize
        known = dict(zip(distinct, [[t.id for t in tokenize(letters)] for letters in as_letters]))
        known["\0"] = None
        lists, own = [], []
        for ids in map(known.__getitem__, pieces):
            if ids is None:
                lists.append(own)
                own = []
            else:
                own = own + ids if own else ids
        return [*lists, own]

    def _compute(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of some new parts are kept, and how many each has."""
        texts = [(p[1:] if p[:1] == b" " else b" " + p).decode() for p in parts]
        certain = [CERTAIN.match(text) is not None for text in texts]
        others = [text for text, sure in zip(texts, certain) if not sure]
        given = [text for text, sure in zip(texts, certain) if sure]
        by_piece = iter(self._piece_ids(given) if given else ())
        whole = (e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        lists = [next(by_piece) if sure else next(whole) for sure in certain]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = self.ids.used + np.cumsum(lengths) - lengths
        self.ids.extend(np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())))
        return starts, lengths

    def _looked_up(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each part are kept, and how many it has; this holds until the next call."""
        if len(self.high) > MEMO_PARTS:
            self._forget()
        pair = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<u8").reshape(-1, 2)
        high, low = pair[:, 0], pair[:, 1]
        at = np.searchsorted(self.high, high)
        known = at < len(self.high)
        known[known] = (self.high[at[known]] == high[known]) & (self.low[at[known]] == low[known])
        starts, lengths = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        starts[known], lengths[known] = self.starts[at[known]], self.lengths[at[known]]
        missing = np.flatnonzero(~known)
        if missing.size:
            asked = [parts[k] for k in missing.tolist()]
            fresh = dict.fromkeys(asked)
            fresh = dict(zip(fresh, range(len(fresh))))
            which = np.fromiter(map(fresh.__getitem__, asked), np.int64, len(asked))
            new_starts, new_lengths = self._compute(list(fresh))
            starts[missing], lengths[missing] = new_starts[which], new_lengths[which]
            first = np.unique(which, return_index=True)[1]
            order = first[np.argsort(high[missing][first], kind="stable")]
            rows, kinds = missing[order], which[order]
            places = np.searchsorted(self.high, high[rows])
            self.low, self.starts = np.insert(self.low, places, low[rows]), np.insert(self.starts, places, new_starts[kinds])
            self.lengths = np.insert(self.lengths, places, new_lengths[kinds])
            self.high = np.insert(self.high, places, high[rows])
        return starts, lengths

    def _places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all parts of the texts where their ids are kept and how many there are; parts of each text."""
        unsure = [bool(UNSURE.search(text)) for text in texts]
        plain = pc.split_pattern(pa.array([t for t, odd in zip(texts, unsure) if not odd], pa.binary()), " ")
        cuts = plain.offsets.to_numpy().astype(np.int64)
        # each different part is looked up once; the first of a text has no space before it
        encoded = plain.flatten().dictionary_encode()
        number, kinds = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
        firsts = [b" " + kinds[k] for k in number[cuts[:-1]].tolist()]
        merged = [word_parts(t) for t, odd in zip(texts, unsure) if odd]
        found = self._looked_up(kinds + firsts + [p for parts in merged for p in parts])
        odd = np.array(unsure, bool)
        counts = np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = np.diff(cuts), [len(parts) for parts in merged]
        begin = np.cumsum(counts) - counts
        out = []
        for values in found:
            own = values[: len(kinds)][number]
            own[cuts[:-1]] = values[len(kinds) : len(kinds) + len(firsts)]
            every = np.empty(int(counts.sum()), np.int64)
            every[ranges(begin[~odd], counts[~odd])] = own
            every[ranges(begin[odd], counts[odd])] = values[len(kinds) + len(firsts) :]
            out.append(every)
        return *out, counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end ids included, and the number of each text."""
        filled = [text for text in texts if text]
        counts = np.zeros(len(texts), np.int64)
        starts = lengths = np.zeros(0, np.int64)
        if filled:
            starts, lengths, counts[[k for k, text in enumerate(texts) if text]] = self._places(filled)
        body = self.ids.data[ranges(starts, lengths)]
        ends = np.cumsum(np.r_[0, lengths])[np.cumsum(counts, dtype=np.int64)]
        sizes = np.diff(np.r_[0, ends])
        return np.insert(body, ends, END_ID), sizes + 1


# --- the format ---------------------------------------------------------------

def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """``(chunks, bitmap, ranks)`` of every level that some id reaches."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest >> 8 != 0
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // 64), "<u8")
        words.view(np.uint8)[: len(bits)] = bits
        ones = np.bitwise_count(words).astype(np.int64)
        levels.append(((rest & 255).astype(np.uint8).tobytes(), words.astype(">u8").tobytes(), (np.cumsum(ones) - ones).astype(">u4").tobytes()))
        rest = rest[more] >> 8
    return levels


class TokenFile:
    """The levels of a file: single tokens by place, or everything."""

    def __init__(self, levels: list[tuple[bytes, bytes, bytes]]):
        kinds = (np.uint8, ">u8", ">u4")
        self.levels = [tuple(np.frombuffer(x, t) for x, t in zip(level, kinds)) for level in levels]
        self.n_ids = len(self.levels[0][0]) if levels else 0

    @classmethod
    def of_row(cls, row: dict) -> TokenFile:
        """The file of a row of the table."""
        levels = [tuple(row[f"{name}{k}"] for name in "cbr") for k in range(LEVELS)]
        return cls([level for level in levels if level[0] is not None])

    def token(self, place: int) -> int:
        """The id at one place, read from a chunk, a bitmap word and a rank for each level."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = 0
        for depth, (chunks, words, before) in enumerate(self.levels):
            value |= int(chunks[place]) << 8 * depth
            word, bit = int(words[place >> 6]), place & 63
            if not word >> bit & 1:
                break
            place = int(before[place >> 6]) + (word & (1 << bit) - 1).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the deepest."""
        deeper = None
        for chunks, words, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            if deeper is not None:
                more = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[: len(chunks)].astype(bool)
                values[more] |= deeper << 8
            deeper = values
        return np.zeros(0, np.uint32) if deeper is None else deeper


# --- Spark: writing -----------------------------------------------------------

def partition_bounds(keys: DataFrame, least: int) -> list[tuple[int, int]]:
    """The last ``(doc_id, sig)`` of all partitions but the last, from a sample of rows.

    ``keys`` has doc_id (null: ``NO_ID``), sig and size. Partitions have about
    equal bytes; a key with very many rows is the bound of several.
    """
    every = max(1, keys.count() // SAMPLE_ROWS)
    drawn = keys.where(F.pmod(F.xxhash64("doc_id", "sig", F.monotonically_increasing_id()), F.lit(every)) == 0)
    sample = drawn.groupBy("doc_id", "sig").agg(F.sum(F.col("size") + 64).alias("weight")).collect()
    sample.sort(key=lambda r: (r.doc_id, r.sig))
    upto = np.cumsum([r.weight for r in sample]) if sample else np.zeros(1)
    count = max(least, int(upto[-1]) * every // PARTITION_BYTES + 1)
    places = np.searchsorted(upto, upto[-1] * np.arange(1, count) / count) if sample else []
    return [(sample[k].doc_id, sample[k].sig) for k in places]


def parts_of(doc_id: np.ndarray, sig: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The partition of each key; keys that are the bound of several go to these in turn."""
    ids = np.array([b[0] for b in bounds], np.int64)
    sigs = np.array([b[1] for b in bounds], np.int64)
    low, high = np.searchsorted(ids, doc_id, "left"), np.searchsorted(ids, doc_id, "right")
    for at in np.unique(low[high > low]).tolist():
        rows = np.flatnonzero((low == at) & (high > low))
        own = sigs[at : int(high[rows[0]])]
        first, last = np.searchsorted(own, sig[rows], "left"), np.searchsorted(own, sig[rows], "right")
        low[rows] = at + first + np.arange(len(rows)) % (last - first + 1)
    return low


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                      file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write all documents in id order; the table of files, read back.

    Compressed texts, not ids, travel to their place in the order. A file ends
    after the document with which it reaches ``file_ids``. The table goes when
    the session's Python ends.
    """
    with open(tokenizer_path, encoding="utf-8") as source:
        json_text = source.read()
    signed = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("sig"))
    bounds = partition_bounds(
        signed.select("doc_id", "sig", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")),
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deflate(batches):
        for batch in batches:
            squeeze = zstandard.ZstdCompressor(level=1)
            for part in slices(batch):
                doc_id, sig = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "sig"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts_of(doc_id, sig, bounds), pa.int32()), part.column("doc_id"), part.column("sig"),
                     pa.array([squeeze.compress(t) for t in texts_of(part)], pa.binary())],
                    names=["part", "doc_id", "sig", "packed"])

    level_columns = [(f"{name}{k}", pa.binary()) for k in range(LEVELS) for name in "cbr"]
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                       ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), *level_columns])

    def files(batches):
        # Tasks that a worker runs one after another share its encoder and memo.
        kept = sys.modules.setdefault("token_file_worker", ModuleType("token_file_worker"))
        if getattr(kept, "json_text", None) != json_text:
            kept.json_text, kept.encoder = json_text, Encoder(json_text)
        encoder, inflate = kept.encoder, zstandard.ZstdDecompressor()
        state = {"seq": 0, "first": 0}

        def row(part, names, sizes, ids):
            levels = pack(ids)
            filled = [x for level in levels for x in level] + [None] * (3 * (LEVELS - len(levels)))
            named = pa.array(names, mask=names == NO_ID)
            values = [part, state["seq"], state["first"], len(ids), len(names)]
            state["seq"] += 1
            state["first"] += len(ids)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), x) for x in (named, pa.array(np.cumsum(sizes)))]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, arrow)] + lists + [pa.array([x], pa.binary()) for x in filled], schema=arrow)

        part, names, sizes, ids = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for batch in batches:
            for piece in slices(batch, "packed", ENCODED_AT_ONCE // 3):
                part = piece.column("part")[0].as_py()
                got, counts = encoder.encode([inflate.decompress(x) for x in piece.column("packed").to_pylist()])
                names = np.concatenate([names, piece.column("doc_id").to_numpy(zero_copy_only=False)])
                sizes, ids = np.concatenate([sizes, counts]), np.concatenate([ids, got])
                # whole files of what is held; a document is never cut
                ends, doc, at = np.cumsum(sizes), 0, 0
                while True:
                    last = int(np.searchsorted(ends, at + file_ids))
                    if last >= len(ends):
                        break
                    end = int(ends[last])
                    yield row(part, names[doc : last + 1], sizes[doc : last + 1], ids[at:end])
                    doc, at = last + 1, end
                names, sizes, ids = names[doc:], sizes[doc:], ids[at:]
        if len(names):
            yield row(part, names, sizes, ids)

    packed = signed.mapInArrow(deflate, "part int, doc_id long, sig long, packed binary")
    ordered = packed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "sig")
    table, _ = written_table(ordered.mapInArrow(files, FILES), **LAYOUT)
    return table


# --- Spark: reading -----------------------------------------------------------

def _bases(files: DataFrame) -> dict[int, int]:
    """The ids before each part. One total per partition of the files goes through the driver."""
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    order = sorted(totals)
    return dict(zip(order, np.cumsum([0] + [totals[p] for p in order]).tolist()))


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    base = _bases(files)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = TokenFile.of_row(row).all().astype("<u4").tobytes()
                ends = np.array(row["ends"], np.int64)
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base[row["part"]] + row["first_id"]),
                     pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.drop("seq", "n_ids", "n_docs").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _based(files: DataFrame) -> DataFrame:
    """The directory: ``(part, seq, first, n_ids)`` with the place of each file's first id among all."""
    base = _bases(files)
    spark = files.sparkSession
    rows = spark.createDataFrame([(p, b) for p, b in base.items()], "part int, base long")  # a row for each partition
    return files.select("part", "seq", "first_id", "n_ids").join(rows, "part").select(
        "part", "seq", (F.col("base") + F.col("first_id")).alias("first"), "n_ids")


def _only(files: DataFrame, asked: DataFrame) -> DataFrame:
    """The files of the rows asked for: as a filter of the scan where they are few, which changes no result."""
    few = asked.select("part", "seq").distinct().limit(FEW_FILES + 1).collect()
    if len(few) > FEW_FILES:
        return files
    parts = {}
    for r in few:
        parts.setdefault(r.part, []).append(r.seq)
    wanted = F.lit(False)
    for part, seqs in parts.items():
        wanted = wanted | ((F.col("part") == part) & F.col("seq").isin(seqs))
    return files.where(wanted)


def _big_endian(data, start, size: int):
    """A number of ``size`` bytes of a binary column, as a long."""
    return F.conv(F.hex(F.substring(data, start + 1, F.lit(size))), 16, -10).cast("long")


def _found_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (position and other columns) with the file each is in and the place there; others are dropped."""
    bucket = lambda place: F.expr(f"{place} div {FILE_IDS}")
    covered = _based(files).withColumn("last", F.col("first") + F.col("n_ids") - 1).withColumn(
        "bucket", F.explode(F.sequence(bucket("first"), bucket("last"))))
    return places.withColumn("bucket", bucket("position")).join(covered, "bucket").where(
        "position BETWEEN first AND last").withColumn("place", F.col("position") - F.col("first")).drop(
        "bucket", "first", "last", "n_ids")


def read_tokens(files: DataFrame, positions: DataFrame) -> DataFrame:
    """``(position, id)`` of each distinct ``position``, counted over all files from 0; unknown ones are dropped.

    For every level a row of a file gives one chunk, one bitmap word and one rank;
    only the level's columns are read, and only files that still matter.
    """
    asked = _found_places(files, positions.select("position").where("position IS NOT NULL").distinct())
    return _tokens_at(files, asked).select("position", F.col("value").alias("id"))


def _tokens_at(files: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the id at ``place`` of its file as ``value``."""
    now = stored(asked.withColumn("value", F.lit(0).cast("long")))
    columns, done = [*asked.columns, "value"], None
    for level in range(LEVELS):
        read = _only(files, now).select("part", "seq", *[F.col(f"{name}{level}").alias(name) for name in "cbr"])
        word = F.shiftright(F.col("place"), 6)
        bit = F.col("place").bitwiseAND(F.lit(63)).cast("int")
        met = now.join(read, ["part", "seq"]).select(
            *now.columns, _big_endian("c", F.col("place").cast("int"), 1).alias("chunk"),
            _big_endian("b", (word * 8).cast("int"), 8).alias("word"),
            _big_endian("r", (word * 4).cast("int"), 4).alias("before"))
        below = F.col("word").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit)))
        stepped = stored(met.select(
            *[c for c in asked.columns if c != "place"],
            (F.col("before") + F.bit_count(below)).alias("next"), "place",
            (F.col("value") + F.call_function("shiftleft", F.col("chunk"), F.lit(8 * level))).alias("value"),
            (F.call_function("shiftrightunsigned", F.col("word"), bit).bitwiseAND(F.lit(1)) == 1).alias("more")))
        ended = stepped.where("NOT more").select(*columns)
        done = ended if done is None else done.union(ended)
        now = stepped.where("more").withColumn("place", F.col("next")).select(*columns)
        if level + 1 == LEVELS or now.isEmpty():
            break
    return done


def read_documents(files: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of every document whose id is in column ``doc_id`` of ``ids``; the end id comes last.

    Ids and ends of documents are read of all files, levels only of those asked
    for. Documents of equal id are rows of their own.
    """
    own = files.select("part", "seq", F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("number", "told"), F.col("ends").alias("all_ends"))
    ends = own.select(
        "part", "seq", F.col("told.doc_ids").alias("doc_id"), F.col("told.ends").alias("end"),
        F.when(F.col("number") == 0, F.lit(0).cast("long")).otherwise(F.get("all_ends", F.col("number") - 1)).alias("begin"))
    asked = ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    found = lookup(ends.where("doc_id IS NOT NULL"), asked, "doc_id")
    placed = found.join(_based(files).select("part", "seq", "first"), ["part", "seq"])
    places = placed.select(
        "doc_id", (F.col("first") + F.col("begin")).alias("start"), "part", "seq",
        F.explode(F.sequence("begin", F.col("end") - 1)).alias("place"))
    tokens = _tokens_at(files, places.withColumn("number", F.col("place")))
    listed = F.array_sort(F.collect_list(F.struct("number", "value")))
    return tokens.groupBy("doc_id", "start").agg(F.transform(listed, lambda t: t["value"]).alias("ids"))
