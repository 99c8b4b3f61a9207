"""Line dedup with a log-template tree.

A line's tokens are its words; words with a digit are variable fields from the start. The tree
has a fixed depth: the number of tokens, then the first ``LEAD`` tokens, then a leaf's
templates. A line joins the template that shares most tokens with it in place, if that is a share of
``alike`` at least; places that differ become variable. Lines meet their leaf in the order of
their hash, so results don't depend on how rows are dealt. In a leaf, lines find templates by
an index of blocks of tokens (some block of a similar line is unchanged), not by trying them all.

A template recurs if its lines stand in ``min_docs`` documents or more. Lines of a recurring
template stay in the document of least doc_id that has one, and are dropped from all others. Lines of
fewer than ``min_words`` words have no templates: they recur if the same words (digits too)
stand in ``short_docs`` documents or more, and always stay without it. Blank lines always stay.

Each chunk of documents sends each distinct line once, with the least ids that have it, as many as
are counted to, which is enough to count to them exactly; so a line that a third of all rows hold
costs one row a chunk. A task holds the distinct lines of one bucket of leaves.

Defined results: a null text stays null and has no lines. A null doc_id comes after all
ids; rows with one doc_id are one document. Empty tables give empty tables. Line ends are \\n.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FAN_IN, answer, ask, bucket_of, chunk_groups, encode, meet, mix, n_buckets, other_columns, words_of, write_chunks

LEAD, ALIKE, MIN_DOCS, MIN_WORDS = 3, 0.7, 5, 3
#: What the query and the pipeline take: lines recur from two documents on; short ones, which may
#: agree by chance, from five.
RECURRING = {"min_docs": 2, "short_docs": 5}
VARIABLE = 0
_LAST = np.iinfo(np.int64).max  # the place of a null doc_id
_DIGITS = np.isin(np.arange(256), np.arange(48, 58))


class Lines:
    """The lines of a chunk that have templates (or, with ``short``, any word): their tokens, documents and keys.

    Tokens are 32-bit hashes of words, VARIABLE for those with a digit; in lines of fewer than ``min_words`` words digits count.
    doc, number: of each line the row it stands in and which of its lines it is. n_lines: of each row the lines with words.
    """

    def __init__(self, table: pa.Table, min_words: int, short: bool = False):
        ids = np.array([_LAST if i is None else i for i in table["doc_id"].to_pylist()], np.int64)
        texts = [encode(t) for t in table["text"].to_pylist()]
        x, begin, size, h = words_of(texts)
        ends = np.flatnonzero(x == 10)  # each text is followed by one too
        last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1)  # each text's last line
        line = np.searchsorted(ends, begin)
        n_words = np.bincount(line, minlength=len(ends))
        doc = np.searchsorted(last, np.arange(len(ends)))
        self.n_lines = np.bincount(doc[n_words > 0], minlength=len(texts))
        picked = n_words >= (1 if short else max(1, min_words))
        digits = np.append(0, np.cumsum(_DIGITS.take(x)))
        token = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        token[token == VARIABLE] = 1
        token[(digits[begin + size] > digits[begin]) & (n_words[line] >= min_words)] = VARIABLE
        self.token = token[picked[line]]
        self.size = n_words[picked]
        self.doc = doc[picked]
        self.number = np.flatnonzero(picked) - np.append(0, last[:-1] + 1)[self.doc] if len(texts) else self.doc
        self.doc_id = ids[self.doc]
        self.start = np.cumsum(self.size) - self.size
        if not len(self.size):
            self.key = self.leaf = np.zeros(0, np.uint64)
            return
        place = np.arange(len(self.token)) - np.repeat(self.start, self.size)
        power = np.cumprod(np.full(int(self.size.max()), 0x9E3779B97F4A7C15, np.uint64))
        n = self.size.astype(np.uint64)
        self.key = mix(np.add.reduceat(self.token * power[place], self.start) + n)
        leaf = mix(n)
        for j in range(LEAD):
            there = self.size > j
            leaf = mix(leaf + np.where(there, self.token[np.where(there, self.start + j, 0)] + np.uint64(1), np.uint64(0)))
        self.leaf = leaf

    def distinct(self, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An index for each distinct line (in the order of keys), how many ids it has, these ids."""
        order = np.lexsort((self.doc_id, self.key))
        key, doc = self.key[order], self.doc_id[order]
        new_key = np.ones(len(order), bool)
        new_key[1:] = key[1:] != key[:-1]
        fresh = new_key.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        nth = np.cumsum(fresh)
        nth -= np.maximum.accumulate(np.where(new_key, nth, 0))
        taken = fresh & (nth < min_docs)
        line = np.cumsum(new_key) - 1
        first = order[new_key]
        return first, np.bincount(line[taken], minlength=len(first)), doc[taken]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the ranges, range by range."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _by_bucket(lines: Lines, min_docs: int, buckets: int) -> Iterable[tuple[int, np.ndarray, bytes]]:
    """For each bucket: the distinct lines' keys in the order sent, and the payload."""
    if not len(lines.key):
        return
    first, n_ids, ids = lines.distinct(min_docs)
    bucket = bucket_of(lines.leaf[first], buckets)
    order = np.argsort(bucket, kind="stable")
    size, counts = lines.size[first][order], n_ids[order]
    token = lines.token[_ragged(lines.start[first][order], size)]
    ids = ids[_ragged((np.cumsum(n_ids) - n_ids)[order], counts)]
    key, leaf = lines.key[first][order], lines.leaf[first][order]
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    t, i = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(counts))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        yield int(bucket[order[a]]), key[a:b], _write(key[a:b], leaf[a:b], size[a:b], counts[a:b], ids[i[a] : i[b]], token[t[a] : t[b]])


def _write(key: np.ndarray, leaf: np.ndarray, size: np.ndarray, counts: np.ndarray, ids: np.ndarray, token: np.ndarray) -> bytes:
    return b"".join([np.uint32(len(key)).tobytes(), key.tobytes(), leaf.tobytes(), size.astype(np.uint32).tobytes(), counts.astype(np.uint8).tobytes(), ids.tobytes(), token.tobytes()])


def _read(p: bytes) -> tuple[np.ndarray, ...]:
    m = int(np.frombuffer(p, np.uint32, 1)[0])
    key, leaf = np.frombuffer(p, np.uint64, m, 4), np.frombuffer(p, np.uint64, m, 4 + 8 * m)
    size, counts = np.frombuffer(p, np.uint32, m, 4 + 16 * m).astype(np.int64), np.frombuffer(p, np.uint8, m, 4 + 20 * m).astype(np.int64)
    ids = np.frombuffer(p, np.int64, int(counts.sum()), 4 + 21 * m)
    return key, leaf, size, counts, ids, np.frombuffer(p, np.uint32, -1, 4 + 21 * m + 8 * len(ids))


class Leaf:
    """A leaf's templates. ``add`` gives the number of the template that a line joins."""

    def __init__(self, n: int, alike: float):
        self.n, self.templates, self.index = n, [], {}
        self.need = int(np.ceil(alike * n - 1e-9))
        parts = n - self.need + 1  # at most n - need places differ, so some block does not
        self.cuts = [(j * n // parts, (j + 1) * n // parts) for j in range(parts)]

    def add(self, line: np.ndarray) -> int:
        raw = line.tobytes()
        blocks = [(a, raw[4 * a : 4 * b]) for a, b in self.cuts]
        best, most = -1, self.need - 1
        for t in sorted({t for block in blocks for t in self.index.get(block, ())}):
            same = int(((self.templates[t] == line) & (line != VARIABLE)).sum()) + int(((self.templates[t] == VARIABLE) & (line == VARIABLE)).sum())
            if same > most:
                best, most = t, same
        if best < 0:
            best = len(self.templates)
            self.templates.append(line.copy())
            for block in blocks:
                self.index.setdefault(block, []).append(best)
        else:
            template = self.templates[best]
            template[template != line] = VARIABLE
        return best


def recurring(chunks: list[int], payloads: list[bytes], min_docs: int, alike: float, min_words: int = 0, short_docs: int = 0) -> Iterable[tuple[int, bytes]]:
    """For each chunk a bit for each line it sent (its template recurs), then for those the first id."""
    parts = [_read(p) for p in payloads]
    key, leaf, size, counts, ids, token = (np.concatenate(x) for x in zip(*parts, strict=True))
    t, i = np.cumsum(size) - size, np.cumsum(counts) - counts
    order = np.lexsort((key, leaf))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    line_of = np.empty(len(order), np.int64)
    line_of[order] = np.cumsum(new) - 1
    first = order[new]  # of each distinct line, by leaf and key
    template_of = np.arange(len(first))
    leaves = leaf[first]
    cuts = np.append(np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])), len(first))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            tree = Leaf(int(size[first[a]]), alike)
            template_of[a:b] = [a + tree.add(token[t[x] : t[x] + size[x]]) for x in first[a:b].tolist()]
    of_row = template_of[line_of]
    of_id = np.repeat(of_row, counts)
    pair = np.lexsort((ids, of_id))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (of_id[pair[1:]] != of_id[pair[:-1]]) | (ids[pair[1:]] != ids[pair[:-1]])
    n_docs = np.bincount(of_id[pair[fresh]], minlength=len(first))
    lead = np.full(len(first), _LAST)
    np.minimum.at(lead, of_id, ids)
    again = n_docs[of_row] >= np.where(size < min_words, short_docs, min_docs)
    start = 0
    for chunk, part in zip(chunks, parts, strict=True):
        stop = start + len(part[0])
        if again[start:stop].any():
            yield chunk, np.packbits(again[start:stop]).tobytes() + lead[of_row[start:stop][again[start:stop]]].tobytes()
        start = stop


def merge_lines(payloads: list[bytes], most: int) -> bytes:
    """The distinct lines of several payloads, in the order of keys, each with its ``most`` least ids."""
    key, leaf, size, counts, ids, token = (np.concatenate(x) for x in zip(*[_read(p) for p in payloads], strict=True))
    _, first, line = np.unique(key, return_index=True, return_inverse=True)
    of_id = np.repeat(line, counts)
    order = np.lexsort((ids, of_id))
    of_id, ids = of_id[order], ids[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (of_id[1:] != of_id[:-1]) | (ids[1:] != ids[:-1])
    of_id, ids = of_id[fresh], ids[fresh]
    nth = np.arange(len(ids)) - np.searchsorted(of_id, of_id)
    taken = nth < most
    starts = np.cumsum(size) - size
    return _write(key[first], leaf[first], size[first], np.bincount(of_id[taken], minlength=len(first)), ids[taken], token[_ragged(starts[first], size[first])])


def share_lines(payloads: list[bytes], found: bytes | None) -> Iterable[bytes | None]:
    """Of a group's answer each chunk's part."""
    sent = [_read(p)[0] for p in payloads]
    every = np.unique(np.concatenate(sent))
    again, lead = np.zeros(len(every), bool), np.zeros(len(every), np.int64)
    if found is not None:
        n = (len(every) + 7) // 8
        again = np.unpackbits(np.frombuffer(found, np.uint8, n), count=len(every)).astype(bool)
        lead[again] = np.frombuffer(found, np.int64, -1, n)
    for own in sent:
        at = np.searchsorted(every, own)
        yield np.packbits(again[at]).tobytes() + lead[at][again[at]].tobytes() if again[at].any() else None


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, alike: float = ALIKE, short_docs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``docs``, all columns, with the kept lines as text, and n_lines, n_dropped (lines with words).

    A column n_chars follows the text. Columns called n_lines or n_dropped (in any case of letters) give way to the results'.
    """
    columns = other_columns(docs, ("n_lines", "n_dropped"))
    chunks = write_chunks(docs.select(*[f"`{c}`" for c in columns]), [f"`{c}`" for c in columns])
    buckets = n_buckets(chunks)
    short, most = short_docs is not None, max(min_docs, short_docs or 0)

    def send(table: pa.Table) -> Iterable[tuple[int, bytes]]:
        return ((b, p) for b, _, p in _by_bucket(Lines(table, min_words, short), most, buckets))

    def reduce(ids: list[int], payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
        return recurring(ids, payloads, min_docs, alike, min_words, short_docs or 0)

    def drop(chunk_id: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        lines = Lines(table, min_words, short)
        recurs, leads = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]  # keys of recurring lines, the documents that keep them
        for bucket, keys, _ in _by_bucket(lines, most, buckets):
            if bucket in got:
                n = (len(keys) + 7) // 8
                recurs.append(keys[np.unpackbits(np.frombuffer(got[bucket], np.uint8, n), count=len(keys)).astype(bool)])
                leads.append(np.frombuffer(got[bucket], np.int64, -1, n))
        keys, first = np.unique(np.concatenate(recurs), return_index=True)
        gone: dict[int, set[int]] = {}
        if len(keys):
            at = np.minimum(np.searchsorted(keys, lines.key), len(keys) - 1)
            out = (keys[at] == lines.key) & (np.concatenate(leads)[first][at] != lines.doc_id)
            for d, i in zip(lines.doc[out].tolist(), lines.number[out].tolist(), strict=True):
                gone.setdefault(d, set()).add(i)
        texts = table["text"].to_pylist()
        for d, out in gone.items():
            texts[d] = "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in out)
        table = table.set_column(table.column_names.index("text"), "text", pa.array(texts, table.schema.field("text").type))
        if "n_chars" in table.column_names:
            n = table["n_chars"].to_pylist()
            for d in gone:
                n[d] = len(texts[d])
            table = table.set_column(table.column_names.index("n_chars"), "n_chars", pa.array(n, table.schema.field("n_chars").type))
        table = table.append_column("n_lines", pa.array(lines.n_lines, pa.int64()))
        return table.append_column("n_dropped", pa.array([len(gone.get(d, ())) for d in range(table.num_rows)], pa.int64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns)
    found = answer(ask(chunks, send), reduce, chunk_groups(chunks, fan_in), lambda payloads: merge_lines(payloads, most), share_lines)
    return meet(chunks, found, drop, f"{ddl}, n_lines long, n_dropped long")
