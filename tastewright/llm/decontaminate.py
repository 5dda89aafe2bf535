"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared with A-Z in lower case and runs of ASCII white
space as one space. An item of n characters may differ in ``floor(rate * n)``
edits; cut into one piece more than that, at least one piece stands unchanged in
any match. An Aho-Corasick automaton finds the pieces; around each hit Myers'
bit-parallel distance decides.

Defined results: null and empty texts and items match nothing. Repeated items
count once each, repeated documents get equal rows. Items without an id
are matched and carry a null id. An empty benchmark matches nothing. Other columns
pass through or are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import id_and_text, slices, stored, texts_of, whole_rows

#: Edits per character of an item.
ERROR_RATE = 0.06
#: Benchmark text sent to the executors at a time. A larger benchmark is matched
#: in several passes over the documents.
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, start long, end long, distance int"


def normal(text: bytes) -> str:
    return b" ".join(text.lower().split()).decode()


def pieces_of(item: str, rate: float) -> list[tuple[int, str]]:
    """``(offset, piece)`` of budget + 1 pieces that make up the item."""
    n = int(rate * len(item)) + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_bits: dict[str, int], length: int, text: str, budget: int) -> tuple[int, int] | None:
    """``(end, distance)`` of the best match of the pattern anywhere in ``text``, if within budget."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, distance, best = full, 0, length, None
    for place, c in enumerate(text):
        equal = pattern_bits.get(c, 0)
        x = equal | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | ~(d0 | plus) & full, d0 & plus
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance <= budget and (best is None or distance < best[1]):
            best = (place + 1, distance)
        up = up << 1 & full  # the match may begin anywhere: no carry in
        down = down << 1 & full
        plus, minus = down | ~(d0 | up) & full, d0 & up
    return best


def _masks(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for k, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << k
    return bits


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = ERROR_RATE):
        self.items = [(i, n) for i, n in ((i, normal(t.encode())) for i, t in items) if n]
        self.budget = [int(rate * len(n)) for _, n in self.items]
        self.automaton, where = ahocorasick.Automaton(), {}
        for k, (_, text) in enumerate(self.items):
            for offset, piece in pieces_of(text, rate):
                where.setdefault(piece, []).append((k, offset))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.masks: dict[int, tuple[dict, dict]] = {}

    def _verify(self, k: int, window: str):
        """``(start, end, distance)`` in the window, or None."""
        pattern, budget = self.items[k][1], self.budget[k]
        at = window.find(pattern)
        if at >= 0:
            return at, at + len(pattern), 0
        if not budget:
            return None
        if k not in self.masks:
            self.masks[k] = (_masks(pattern), _masks(pattern[::-1]))
        forward, backward = self.masks[k]
        hit = myers(forward, len(pattern), window, budget)
        if hit is None:
            return None
        end, distance = hit
        # The reversed pattern, read back from the end, gives the start.
        back = window[max(0, end - len(pattern) - budget) : end][::-1]
        size = self._anchored(backward, len(pattern), back, distance)
        return end - size, end, distance

    @staticmethod
    def _anchored(bits, length, text, distance):
        """Length of the prefix of ``text`` at ``distance`` from the pattern."""
        full, top = (1 << length) - 1, 1 << (length - 1)
        plus, minus, now = full, 0, length
        for place, c in enumerate(text):
            equal = bits.get(c, 0)
            x = equal | minus
            d0 = ((((x & plus) + plus) ^ plus) | x) & full
            up, down = minus | ~(d0 | plus) & full, d0 & plus
            now += 1 if up & top else -1 if down & top else 0
            if now == distance:
                return place + 1
            up = (up << 1 | 1) & full
            down = down << 1 & full
            plus, minus = down | ~(d0 | up) & full, d0 & up
        return len(text)

    def matches(self, text: bytes) -> dict[int, tuple[int, int, int]]:
        """Best ``(start, end, distance)`` of each item found, in normal characters."""
        if not self.items:
            return {}
        plain = normal(text)
        asked, found = set(), {}
        for end, (size, places) in self.automaton.iter(plain):
            for k, offset in places:
                length, budget = len(self.items[k][1]), self.budget[k]
                start = end + 1 - size - offset
                # Hits of one match differ by its edits at most; one window serves them.
                key = (k, start // (budget + 1))
                if key in asked:
                    continue
                asked.add(key)
                low = max(0, start // (budget + 1) * (budget + 1) - budget)
                window = plain[low : start // (budget + 1) * (budget + 1) + length + 2 * budget + 1]
                hit = self._verify(k, window)
                if hit and (k not in found or (hit[2], low + hit[0]) < (found[k][2], found[k][0])):
                    found[k] = (low + hit[0], low + hit[1], hit[2])
        return found


def original_places(text: str) -> list[int]:
    """For each normal character, its place in the text as it stands."""
    places, inside = [], False
    for place, c in enumerate(text):
        if c in " \t\n\x0b\x0c\r":
            if inside:
                places.append(place)
            inside = False
        else:
            places.append(place)
            inside = True
    return places


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The items in blocks of about ``block_bytes``, drawn by hash, and whether there are others.

    Where there are, what a block finds is stored before the next one is asked
    for, so that the driver holds one block.
    """
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    items = items.where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        yield [(r.item_id, r.text) for r in part.collect()], blocks > 1


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
          id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, start, end, distance)``: the best place of every item in every document that has it.

    Offsets are code points of the text as it stands, end exclusive.
    """
    def finder(items):
        def find(batches):
            matcher = Matcher(items, rate)
            for batch in batches:
                for part in slices(batch):
                    rows = []
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                        hits = matcher.matches(text)
                        if hits:
                            places = original_places(text.decode())
                            rows += [(doc_id, matcher.items[k][0], places[s], places[e - 1] + 1, d)
                                     for k, (s, e, d) in sorted(hits.items())]
                    if rows:
                        columns = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int32() if i == 4 else pa.int64()) for i, c in enumerate(columns)],
                            names=["doc_id", "item_id", "start", "end", "distance"])

        return find

    texts = id_and_text(docs, id_col, text_col)
    found = None
    for items, several in item_blocks(benchmark, block_bytes=block_bytes):
        one = texts.mapInArrow(finder(items), SCHEMA)
        one = stored(one) if several else one
        found = one if found is None else found.union(one)
    return found if found is not None else texts.sparkSession.createDataFrame([], SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
                    text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, unchanged."""
    def keeper(items, column):
        def keep(batches):
            matcher = Matcher(items, rate)
            for batch in batches:
                stays = [not matcher.matches(text) for part in slices(batch, column) for text in texts_of(part, column)]
                yield batch.filter(pa.array(stays, pa.bool_()))

        return keep

    for items, several in item_blocks(benchmark, block_bytes=block_bytes):
        docs = whole_rows(docs, text_col, partial(keeper, items))
        docs = stored(docs) if several else docs
    return docs
