"""Secret scan: fixed patterns, and strings that zstandard finds new.

Base kinds are patterns. The method adds ``novel`` spans: token-like strings
near a sensitive word that hardly compress although the compressor was primed
with the text around them and with a dictionary of the corpus' own identifiers.
Hardly means: to nearly as many bytes as random characters of the string's own
alphabet take, be it hexadecimal, base 32, 36, 62 or 64; as written, and in lower
case with its words set apart, as a dictionary knows them.

Defined results: null and empty texts have no span; offsets are code points of
the text; repeated rows give equal rows; of a string that base spans cover by half
or more, these alone are given. Very long texts are taken whole, one at a
time. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from random import Random

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastewright.llm.common import id_and_text, slices, texts_of

KINDS = ("assign", "access", "hex", "novel")
# On bytes with A-Z in lower case, where "either case" is one case.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT = re.compile(rb"passw|secret|token|api[_-]?key|credential|private|auth|bearer|akia|access[_-]?key|signature")
#: Least characters of a novel string, bytes before it in which a sensitive word
#: must stand, bytes of surrounding text the compressor is primed with.
LEAST, NEAR, AROUND = 20, 120, 400
#: Marginal compressed bytes over those of random characters of the same alphabet.
NOVELTY = 0.85
SETS = (re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"))
#: Alphabets from the smallest on.
ALPHABETS = [re.compile(rb"[" + letters + rb"]+") for letters in (
    rb"0-9a-f", rb"0-9A-F", rb"A-Z2-7", rb"a-z2-7", rb"0-9a-z", rb"0-9A-Z", rb"A-Za-z", rb"0-9A-Za-z", rb"0-9A-Za-z+/_=-")]
#: Where a name's words meet.
HUMP, SEAM = re.compile(rb"(?<=[a-z])(?=[A-Z])"), re.compile(rb"[+/_=-]+")
#: Names in text: words joined by underscores or humps, or before a sign of assignment or call.
NAME = re.compile(rb"(?<![A-Za-z_])(?:[A-Za-z]++(?:_[A-Za-z]++)++|[a-z]++(?:[A-Z][a-z]++)++|[A-Za-z]{3,}+(?=\x20?[:=(]))")
#: Different names a task counts before it hands them on, and those the dictionary holds.
NAMES_HELD, DICTIONARY = 50_000, 2000


def identifiers(docs: DataFrame, most: int = DICTIONARY, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The dictionary: the words of the ``most`` frequent names of all texts, the most frequent last, as nearest."""

    def counted(batches):
        def told():
            return pa.RecordBatch.from_arrays(
                [pa.array([n.decode() for n in names], pa.string()), pa.array(list(names.values()), pa.int64())], names=["name", "n"])

        names: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in texts_of(part):
                    names.update(m for m in NAME.findall(text) if len(m) <= 80)
                    if len(names) > NAMES_HELD:
                        yield told()
                        names.clear()
        if names:
            yield told()

    found = id_and_text(docs, id_col, text_col).mapInArrow(counted, "name string, n long")
    top = found.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(most).collect()
    return b" ".join(x for r in reversed(top) for x in dict.fromkeys((r.name.encode(), words_apart(r.name.encode())))) + b" "


def words_apart(name: bytes) -> bytes:
    """A name in lower case with spaces where its words meet."""
    return SEAM.sub(b" ", HUMP.sub(b" ", name)).lower()


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the fixed patterns, as byte offsets."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(low) if len(m[2]) >= 12]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def marginal(text: bytes, around: bytes, level: int = 3) -> int:
    """Compressed bytes that ``text`` adds after what the compressor was primed with."""
    primed = zstandard.ZstdCompressor(
        level=level, dict_data=zstandard.ZstdCompressionDict(around, zstandard.DICT_TYPE_RAWCONTENT),
        write_content_size=False, write_checksum=False)
    return len(primed.compress(text)) - len(primed.compress(b""))


@lru_cache(4096)
def random_like(alphabet: int, size: int) -> bytes:
    """Random characters of an alphabet, the same ones each time."""
    letters = [c for c in range(128) if ALPHABETS[alphabet].fullmatch(bytes([c]))]
    return bytes(Random(size).choices(letters, k=size))


def novelty(candidate: bytes, around: bytes, names: bytes = b"") -> float:
    """Marginal compressed bytes, over those of random characters of the candidate's alphabet and length."""
    alphabet = next(k for k, letters in enumerate(ALPHABETS) if letters.fullmatch(candidate))
    apart = words_apart(candidate)
    added = marginal(candidate, names + around)
    if apart != candidate:
        added = min(added, marginal(apart, names + around.lower()))
    return added / marginal(random_like(alphabet, len(candidate)), names + around)


class Scanner:
    """Finds the spans of texts with one dictionary and one set of limits."""

    def __init__(self, names: bytes = b"", least: int = LEAST, near: int = NEAR, around: int = AROUND, limit: float = NOVELTY):
        self.names, self.near, self.around, self.limit = names, near, around, limit
        self.candidate = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % least)

    def novel_spans(self, text: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Incompressible strings in a sensitive context that fixed patterns cover less than half of."""
        words = [m.end() for m in CONTEXT.finditer(text.lower())]
        if not words:
            return []
        found = []
        for m in self.candidate.finditer(text):
            start, end = m.span()
            before = bisect_right(words, start)
            if not before or words[before - 1] < start - self.near:
                continue
            covered = sum(max(0, min(e, end) - max(s, start)) for s, e, _ in taken)
            if 2 * covered >= end - start or sum(bool(x.search(m[0])) for x in SETS) < 2:
                continue
            around = text[max(0, start - self.around) : start] + text[end : end + self.around]
            if novelty(m[0], around, self.names) >= self.limit:
                found.append((start, end, 3))
        return found

    def scan(self, text: bytes) -> tuple[list[int], str, str]:
        """Counts by base kind, base spans and all spans of one text, in code points."""
        base = base_spans(text)
        extra = self.novel_spans(text, base)
        every = base + extra
        if every and not text.isascii():
            points = {}
            at = known = 0
            for cut in sorted({x for s, e, _ in every for x in (s, e)}):
                known += len(text[at:cut].decode())
                points[cut], at = known, cut
            base = [(points[s], points[e], k) for s, e, k in base]
            extra = [(points[s], points[e], k) for s, e, k in extra]
        by_place = lambda x: (x[0], x[2])
        counts = [sum(k == kind for _, _, k in base) for kind in range(3)]
        return counts, _joined(sorted(base, key=by_place)), _joined(sorted(base + extra, key=by_place))


def _joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(text: bytes) -> tuple[list[int], str, str]:
    """What a scanner without a dictionary finds."""
    return Scanner().scan(text)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY,
                 least: int = LEAST, near: int = NEAR, around: int = AROUND, limit: float = NOVELTY) -> DataFrame:
    """One row per document with its spans as ``kind:start:end``, by start and then kind."""
    names = identifiers(docs, dictionary, id_col, text_col)

    def rows(batches):
        scanner = Scanner(names, least, near, around, limit)
        for batch in batches:
            for part in slices(batch):
                found = [scanner.scan(text) for text in texts_of(part)]
                counts = [[r[0][k] for r in found] for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in found], pa.string()),
                     pa.array([r[2] for r in found], pa.string()),
                     pa.array([r[2].count("novel:") for r in found], pa.int64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, SCHEMA)
