"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space collapsed. An item of m characters
may differ by e = floor(max_error * m) edits. It is cut into e + 1 pieces; e edits cannot
touch them all, so every approximate occurrence holds some piece unchanged. One Aho-Corasick
pass over a text finds all exact piece hits; around each, Myers' bit-parallel algorithm
gives the least edit distance of the whole item to any substring. Items shorter than
``short`` characters must stand unchanged between word boundaries.

The benchmark is the stated query set. It is cut into blocks of ``block_chars`` characters,
each with an automaton of its own, so a benchmark of any size is matched whole, in bounded
memory. Documents are matched where they are read; nothing is shuffled.

Defined results: a null or empty text or item matches nothing. Repeated rows of documents
get equal rows; items with equal text are items of their own. Empty tables on
either side give no matches; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 20
BLOCK_CHARS = 500_000


def normalize(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and the first end of one that has it."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = pattern_bits.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph, mh = ph << 1, mh << 1
        pv = full & (mh | ~(xv | ph))
        mv = ph & xv & full
    return best, end


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        bits[c] |= 1 << i
    return dict(bits)


class Matcher:
    """One block of items: (item_id, normalized text)."""

    def __init__(self, items: list[tuple[int, str]], max_error: float, short: int):
        self.items = [(i, x, 0 if len(x) < short else int(max_error * len(x))) for i, x in items]
        self.short = short
        self.bits: dict[int, tuple[dict, dict]] = {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, x, e) in enumerate(self.items):
            for j in range(e + 1):
                start, stop = j * len(x) // (e + 1), (j + 1) * len(x) // (e + 1)
                pieces[x[start:stop]].append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """Item number -> (distance, start, end, places): the closest occurrence, the first of equals."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        if not text or not self.items:
            return {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                diagonals[n].add(end - size + 1 - at)
        out = {}
        for n, found in diagonals.items():
            _, item, e = self.items[n]
            m, hits = len(item), []
            if e == 0:
                for d in sorted(found):
                    whole = m >= self.short or (d == 0 or text[d - 1] == " ") and (d + m == len(text) or text[d + m] == " ")
                    hits += [(0, d, d + m)] * whole
            else:
                if n not in self.bits:
                    self.bits[n] = pattern_bits(item), pattern_bits(item[::-1])
                forward, back = self.bits[n]
                for low, high in _merged(sorted(found), e):
                    start, stop = max(0, low - e), min(len(text), high + m + e)
                    distance, end = myers(forward, m, text[start:stop])
                    if distance <= e:
                        end += start
                        _, length = myers(back, m, text[max(0, end - m - e) : end][::-1])
                        hits.append((distance, end - length, end))
            if hits:
                out[n] = (*min(hits), len({h[1:] for h in hits}))
        return out


def _merged(diagonals: list[int], e: int) -> Iterator[tuple[int, int]]:
    """Runs of diagonals at most e apart."""
    low = high = diagonals[0]
    for d in diagonals[1:]:
        if d - high > e:
            yield low, high
            low = d
        high = d
    yield low, high


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; the driver holds one block at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col("`item_id`").alias("item_id"), F.col("`text`").alias("text")).where("text is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if text := normalize(row["text"]):
            held.append((row["item_id"], text))
            size += len(text)
            if size >= block_chars:
                yield held
                held, size = [], 0
    if held:
        yield held


MATCH = "doc_id long, item_id long, distance int, start int, end int, places int"


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.08, short: int = SHORT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that it holds: MATCH, places in the normalized text."""
    source = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    out = None
    for items in blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, max_error, short)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    rows += [(doc_id, items[n][0], *hit) for n, hit in matcher.find(normalize(text.as_py())).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], [x.split()[0] for x in MATCH.split(", ")])

        part = source.mapInArrow(run, MATCH)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCH) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.08, short: int = SHORT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    for items in blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, max_error, short)
            for batch in batches:
                clean = [not matcher.find(normalize(x.as_py())) for x in batch["text"]]
                yield batch.filter(pa.array(clean, pa.bool_())) if batch.num_rows else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
