"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

An automaton over the pieces reads a text once. At each position the output
links give all pieces that end there, longest first, and each relaxes the best
score of its end. Pieces hold white space at their front only, so texts are cut
before each space and every distinct unit is solved once; units are solved side
by side, one position of all of them at a time.

A model of kind unigram is scored as it stands. One of kind BPE has merge ranks
instead of scores; it is read as a unigram model whose n-th piece has the
log-probability ``-log(n + 1) - log(pieces)`` (Zipf's law), since rank sums
would always prefer many frequent pieces.

Defined results: null and empty text give no ids. A character that no piece has
becomes its byte pieces. A literal U+2581 counts as such a character, so decoding
gives back every text exactly. Repeated rows give equal rows; a model whose
pieces hold a space after another character is not accepted. Of paths with equal
scores the one whose last piece is the longest is taken. Very long texts are taken
whole, one at a time. An empty table gives an empty table.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tastewright.llm.common import MEMO_WORDS, Rows, WordMemo, id_and_text, ranges, slices, texts_of

NORMAL, BYTE, USER = 1, 6, 4
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
LONG_UNIT = 200  # bytes; longer units are solved one at a time


def fields(message: bytes):
    """``(number, value)`` of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, message[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, message[at : at + size]
            at += size


def read_model(model: bytes) -> dict:
    """Pieces, scores and kinds of a model file, and whether it is a unigram model."""
    pieces, scores, kinds, unigram, prefix = [], [], [], True, True
    for number, value in fields(model):
        if number == 1:
            one = {n: v for n, v in fields(value)}
            pieces.append(one[1].decode())
            scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            kinds.append(one.get(3, NORMAL))
        elif number == 2:
            unigram = dict(fields(value)).get(3, UNIGRAM) == UNIGRAM
        elif number == 3:
            prefix = bool(dict(fields(value)).get(3, 1))
    return {"pieces": pieces, "scores": np.array(scores, np.float32), "kinds": kinds,
            "unigram": unigram, "prefix": prefix}


def zipf_scores(n: int) -> np.ndarray:
    return (-np.log(np.arange(n) + 2.0) - np.log(n)).astype(np.float32)


class Pieces:
    """The automaton and the tables of a model."""

    def __init__(self, model: bytes):
        read = read_model(model)
        self.prefix = read["prefix"]
        normal = [i for i, k in enumerate(read["kinds"]) if k in (NORMAL, USER)]
        scores = read["scores"].copy()
        if not read["unigram"]:
            scores[normal] = zipf_scores(len(normal))
        self.text = [p.replace("▁", " ").encode() for p in read["pieces"]]
        if any(b" " in self.text[i].lstrip(b" ") for i in normal):
            raise ValueError("a piece has a space after another character")
        self.byte_id = np.full(256, -1, np.int64)
        for i, kind in enumerate(read["kinds"]):
            if kind == BYTE:
                self.byte_id[int(read["pieces"][i][1:-1], 16)] = i
                self.text[i] = bytes([int(read["pieces"][i][1:-1], 16)])
            elif kind not in (NORMAL, USER):
                self.text[i] = b""
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        self.scores = scores
        self.fallback = np.float32(scores[normal].min() - UNKNOWN_PENALTY)
        self._build(normal)
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)

    def _build(self, normal):
        """States in breadth-first order: goto completed by fail links, output links."""
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i in normal:
            state = 0
            for byte in self.text[i]:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    piece.append(-1)
                state = children[state][byte]
            if state and piece[state] < 0:
                piece[state] = i
        n = len(children)
        self.goto = np.zeros((n, 256), np.int32)
        fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.piece = np.array(piece, np.int64)
        level = [0]
        while level:
            below = []
            for state in level:
                if state:
                    self.goto[state] = self.goto[fail[state]]
                for byte, child in children[state].items():
                    fail[child] = self.goto[fail[state], byte] if state else 0
                    link[child] = fail[child] if piece[fail[child]] >= 0 else link[fail[child]]
                    below.append(child)
                for byte, child in children[state].items():
                    self.goto[state, byte] = child
            level = below
        # For every state the first piece that ends there, then the shorter ones.
        self.first = np.where(self.piece >= 0, np.arange(n, dtype=np.int32), link)
        self.link = link
        self.length = np.zeros(n, np.int64)
        self.value = np.full(n, -np.inf, np.float32)
        ends = np.flatnonzero(self.piece >= 0)
        self.length[ends] = [len(self.text[i]) for i in self.piece[ends]]
        self.value[ends] = self.scores[self.piece[ends]]

    def solve_one(self, unit: bytes) -> list[int]:
        """Ids of one unit, by the same relaxation in plain Python."""
        n, state = len(unit), 0
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0], one = 0.0, np.float32
        lead = 0
        for p in range(1, n + 1):
            if unit[p - 1] & 0xC0 != 0x80:
                lead = p - 1
            state = int(self.goto[state, unit[p - 1]])
            if p < n and unit[p] & 0xC0 == 0x80:
                continue
            out, single = int(self.first[state]), False
            while out:
                size = int(self.length[out])
                single |= p - size == lead
                value = one(best[p - size]) + self.value[out]
                if value > best[p]:
                    best[p], back[p] = value, (p - size, int(self.piece[out]))
                out = int(self.link[out])
            if not single:
                value = one(best[lead]) + self.fallback
                if value > best[p]:
                    best[p], back[p] = value, (lead, -1)
        ids, p = [], n
        while p:
            before, piece = back[p]
            ids += [piece] if piece >= 0 else self.byte_id[list(unit[before:p][::-1])].tolist()
            p = before
        return ids[::-1]

    def solve(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units and the number of each: all units advance one byte at a time."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-sizes, kind="stable")
        alone = np.zeros(len(units), bool)
        alone[sizes > LONG_UNIT] = True
        order = order[~alone[order]]
        widest = int(sizes[order[0]]) if len(order) else 0
        padded = np.zeros((len(order), widest + 1), np.uint8)
        if len(order):
            joined = np.frombuffer(b"".join([units[i] for i in order.tolist()]), np.uint8)
            own = sizes[order]
            flat = ranges(np.arange(len(order)) * (widest + 1), own)
            padded.ravel()[flat] = joined
        n = len(order)
        best = np.full((widest + 1, n), -np.inf, np.float32)
        back = np.zeros((widest + 1, n), np.int64)  # a piece, or -1 - bytes of a fallback
        if n:
            best[0] = 0
        state, lead = np.zeros(n, np.int32), np.zeros(n, np.int64)
        active = np.searchsorted(-sizes[order], -np.arange(1, widest + 1), "right") if n else []
        for p in range(1, widest + 1):
            live = int(active[p - 1])
            byte, after = padded[:live, p - 1], padded[:live, p]
            lead[:live][byte & 0xC0 != 0x80] = p - 1
            state[:live] = self.goto[state[:live], byte]
            whole = after & 0xC0 != 0x80
            rows = np.flatnonzero(whole)
            out = self.first[state[rows]]
            single = np.zeros(len(rows), bool)
            at = np.flatnonzero(out)
            while at.size:
                o, r = out[at], rows[at]
                start = p - self.length[o]
                single[at] |= start == lead[r]
                value = best[start, r] + self.value[o]
                better = value > best[p, r]
                best[p, r[better]] = value[better]
                back[p, r[better]] = self.piece[o[better]]
                out[at] = self.link[o]
                at = at[out[at] > 0]
            r = rows[~single]
            if r.size:
                value = best[lead[r], r] + self.fallback
                better = value > best[p, r]
                r, value = r[better], value[better]
                best[p, r] = value
                back[p, r] = -1 - (p - lead[r])
        # Walk back: one piece of every unit at a time.
        found, spot = [], sizes[order].copy()
        left = np.flatnonzero(spot)
        while left.size:
            took = back[spot[left], left]
            fall = took < 0
            taken = np.where(fall, -1 - took, self.sizes[np.maximum(took, 0)])
            single_byte = fall & (taken == 1)
            took = np.where(single_byte, self.byte_id[padded[left, spot[left] - 1]], took)
            alone[order[left[fall & ~single_byte]]] = True
            found.append((left, took))
            spot[left] -= taken
            left = left[spot[left] > 0]
        counts = np.zeros(len(units), np.int64)
        for rows, _ in found:
            counts[order[rows]] += 1
        spelled = {i: self.solve_one(units[i]) for i in np.flatnonzero(alone).tolist()}
        for i, ids in spelled.items():
            counts[i] = len(ids)
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int64)
        for step, (rows, took) in enumerate(found):
            which = order[rows]
            keep = ~alone[which]
            ids[starts[which[keep]] + counts[which[keep]] - 1 - step] = took[keep]
        for i, own in spelled.items():
            ids[starts[i] : starts[i] + len(own)] = own
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of consecutive runs of ids."""
        sizes = self.sizes[ids]
        raw = self.blob[ranges(self.starts[ids], sizes)].tobytes()
        ends = np.cumsum(np.r_[0, sizes])[np.cumsum(np.r_[0, counts])].tolist()
        skip = int(self.prefix)
        return [raw[s + skip : e] if e > s else b"" for s, e in zip(ends, ends[1:])]


def units_of(text: bytes) -> list[bytes]:
    """A text cut before each run of spaces; a unit lacks the one space that begins it.

    The text counts as having a space in front, as the model asks.
    """
    if not text:
        return []
    parts = text.split(b" ")
    if b"" not in parts:
        return parts
    merged, spaces = [], b""
    for part in parts:
        if not part:
            spaces += b" "
        else:
            merged.append(spaces + part)
            spaces = b""
    if spaces:
        merged.append(spaces[1:])
    return merged


class Codec:
    """Encodes batches of texts, with a memo of distinct units."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        if not self.pieces.prefix:
            raise ValueError("the model must add a space in front of a text")
        self.ids, self.starts, self.lengths = Rows(dtype=np.int32), Rows(dtype=np.int64), Rows(dtype=np.int64)
        self.memo = WordMemo(self._compute, self._reset, MEMO_WORDS)

    def _reset(self):
        for rows in (self.ids, self.starts, self.lengths):
            rows.clear()

    def _compute(self, units):
        for low in range(0, len(units), 20_000):
            ids, counts = self.pieces.solve([b" " + u for u in units[low : low + 20_000]])
            self.starts.extend(self.ids.used + np.cumsum(counts) - counts)
            self.lengths.extend(counts)
            self.ids.extend(ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        units, counts = [], []
        for text in texts:
            own = units_of(text)
            units += own
            counts.append(len(own))
        codes = self.memo.codes(units)
        lengths = self.lengths.data[codes]
        ids = self.ids.data[ranges(self.starts.data[codes], lengths)]
        ends = np.cumsum(np.r_[0, lengths])[np.cumsum(np.r_[0, counts], dtype=np.int64)]
        return ids, np.diff(ends)


SCHEMA = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``; ``round_trip``: decoding the ids gives the text."""
    with open(model_path, "rb") as source:
        model = source.read()

    def encode(batches):
        codec = Codec(model)
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                ids, counts = codec.encode(texts)
                same = [a == b for a, b in zip(codec.pieces.decode(ids, counts), texts)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, counts]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), lists, pa.array(same)],
                    names=["doc_id", "n_tokens", "ids", "round_trip"])

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of a table with ``doc_id`` and ``ids``; null ids give an empty text."""
    with open(model_path, "rb") as source:
        model = source.read()

    def decode(batches):
        pieces = Pieces(model)
        for batch in batches:
            column = batch.column("ids").fill_null([])
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array([len(x) for x in column], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t.decode() for t in pieces.decode(ids, counts)], pa.string())],
                names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
