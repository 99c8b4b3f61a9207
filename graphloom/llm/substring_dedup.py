"""Substring dedup by seed and extend.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``. A window is ``length`` consecutive
words of one document. A word goes if some window over it also starts earlier: in a document
of smaller id, or earlier in the same document. Windows are judged on the input.

Seeds. Of the word k-grams of each window the one of least hash is its anchor (winnowing), so
equal windows have equal anchors at equal places, and about 2 in length - k + 2 places are
anchors. Chunks of documents report their distinct anchors; the anchors' buckets answer
which occur in another chunk.

Extension. From each anchor that recurs, matches extend to both sides as far as the windows it
anchors reach, up to length - k words. Its windows' hashes, as runs of neighbouring windows,
go to the anchor's bucket, which answers for each window whether an earlier one equals it:
all occurrences of an anchor are extended at once, not pair by pair. What recurs within one chunk is
settled there. Overlapping answers merge into the maximal repeats.

Nothing but anchors and the windows of recurring anchors is shuffled, once for each chunk, so a
passage that a third of all rows share costs as many rows as there are chunks. Windows are equal if both
their hash (64 bits) and their anchor's (64 bits) are: of n windows n * n / 2 ** 129 pairs are expected
to be taken for equal by chance, under one in 10 ** 12 for the 10 ** 13 windows of 100 TB. Words are told
apart by 64 bits, within one run of windows.

Defined results: a null text has no words; its kept text is empty. A null doc_id comes after all
ids. Rows with one doc_id count as one document whose windows have the place their own row
gives them: windows at equal places don't remove each other. Empty tables give empty tables;
other columns are ignored. Very long texts are chunks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FAN_IN, answer, ask, bucket_of, chunk_groups, encode, materialize, meet, n_buckets, split_by, windows, words_of, write_chunks

LENGTH, ANCHOR = 20, 8
_LAST = np.iinfo(np.int64).max  # the place of a null doc_id


class Windows:
    """All windows of a chunk, in the chunk's order, with their anchors."""

    def __init__(self, table: pa.Table, length: int, k: int):
        self.texts = [encode(t) for t in table["text"].to_pylist()]
        _, begin, _, h = words_of(self.texts)
        sizes = np.bincount(np.searchsorted(np.cumsum([len(t) + 1 for t in self.texts]), begin, "right"), minlength=len(self.texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
        first = np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1)
        self.at = self.starts[doc] + np.arange(len(doc)) - first[doc]  # in the chunk's words
        ids = np.array([_LAST if i is None else i for i in table["doc_id"].to_pylist()], np.int64)
        self.doc_id, self.place = ids[doc], self.at - self.starts[doc]
        self.hash = windows(h, length)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        grams = windows(h, k)
        best = grams[self.at] if len(self.at) else np.zeros(0, np.uint64)
        for j in range(1, length - k + 1):
            best = np.minimum(best, grams[self.at + j])
        self.anchor = best

    def earliest(self) -> np.ndarray:
        """Of each distinct window the index of its earliest place in the chunk; ascending."""
        order = np.lexsort((self.place, self.doc_id, self.hash))
        new = np.ones(len(order), bool)
        new[1:] = self.hash[order[1:]] != self.hash[order[:-1]]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        lead = order[new]
        # of equal windows in this chunk, those that start later than the earliest
        self.later = (self.doc_id != self.doc_id[lead][self.group]) | (self.place != self.place[lead][self.group])
        return np.sort(lead)


def _anchors(table: pa.Table, buckets: int, length: int, k: int) -> Iterable[tuple[int, np.ndarray]]:
    found = np.unique(Windows(table, length, k).anchor, sorted=True)
    for bucket, at in split_by(bucket_of(found, buckets)):
        yield bucket, found[at]


def _seeds(found: np.ndarray, several: np.ndarray | None = None) -> bytes:
    """Ascending anchors, and whether more than one chunk is known to have each."""
    return np.uint32(len(found)).tobytes() + found.tobytes() + np.packbits(np.zeros(len(found), bool) if several is None else several).tobytes()


def _read_seeds(p: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(p, np.uint32, 1)[0])
    return np.frombuffer(p, np.uint64, n, 4), np.unpackbits(np.frombuffer(p, np.uint8, -1, 4 + 8 * n), count=n).astype(bool)


def _counted_seeds(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What each has sent; all anchors, ascending; which of them more than one chunk has."""
    sent = [_read_seeds(p) for p in payloads]
    every, back, count = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True, return_counts=True)
    several = count > 1
    several[back[np.concatenate([x for _, x in sent])]] = True
    return [k for k, _ in sent], every, several


def _recurring(chunks: list[int], payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
    """One bit for each anchor that a chunk has sent: another chunk has it too."""
    sent, every, several = _counted_seeds(payloads)
    for chunk, own in zip(chunks, sent, strict=True):
        again = several[np.searchsorted(every, own)]
        if again.any():
            yield chunk, np.packbits(again).tobytes()


def _merge_seeds(payloads: list[bytes]) -> bytes:
    _, every, several = _counted_seeds(payloads)
    return _seeds(every, several)


def _share_seeds(payloads: list[bytes], found: bytes | None) -> Iterable[bytes | None]:
    sent, every, _ = _counted_seeds(payloads)
    bits = None if found is None else np.unpackbits(np.frombuffer(found, np.uint8), count=len(every)).astype(bool)
    for own in sent:
        again = None if bits is None else bits[np.searchsorted(every, own)]
        yield np.packbits(again).tobytes() if again is not None and again.any() else None


_RUN = np.dtype([("doc_id", "<i8"), ("anchor", "<u8"), ("place", "<i4"), ("n", "<u4")])


def _runs(w: Windows, picked: np.ndarray) -> np.ndarray:
    """Where, in the ascending indexes ``picked``, a run of neighbouring windows with one anchor begins."""
    new = np.ones(len(picked), bool)
    new[1:] = (np.diff(picked) != 1) | (w.anchor[picked[1:]] != w.anchor[picked[:-1]]) | (w.doc_id[picked[1:]] != w.doc_id[picked[:-1]]) | (w.place[picked[1:]] != w.place[picked[:-1]] + 1)
    return np.flatnonzero(new)


def _asked(w: Windows, lead: np.ndarray, table: pa.Table, recurs: dict[int, bytes], buckets: int) -> Iterable[tuple[int, np.ndarray]]:
    """By bucket, the earliest windows (indexes) of recurring anchors."""
    anchors = np.unique(w.anchor, sorted=True)
    again = np.zeros(len(anchors), bool)
    for bucket, at in split_by(bucket_of(anchors, buckets)):
        if bucket in recurs:
            again[at] = np.unpackbits(np.frombuffer(recurs[bucket], np.uint8), count=len(at)).astype(bool)
    picked = lead[again[np.searchsorted(anchors, w.anchor[lead])]]
    for bucket, at in split_by(bucket_of(w.anchor[picked], buckets)):
        yield bucket, picked[at]


def _send(w: Windows, picked: np.ndarray) -> bytes:
    begin = _runs(w, picked)
    runs = np.zeros(len(begin), _RUN)
    runs["doc_id"], runs["place"], runs["anchor"] = w.doc_id[picked[begin]], w.place[picked[begin]], w.anchor[picked[begin]]
    runs["n"] = np.diff(np.append(begin, len(picked)))
    return np.uint32(len(runs)).tobytes() + runs.tobytes() + w.hash[picked].tobytes()


class _Sent:
    """The windows that chunks have sent to a bucket, end to end; lead: of each the earliest equal one (in anchor and hash)."""

    def __init__(self, payloads: list[bytes]):
        hashes, anchors, ids, places, counts = [], [], [], [], []
        for p in payloads:
            n = int(np.frombuffer(p, np.uint32, 1)[0])
            runs = np.frombuffer(p, _RUN, n, 4)
            size = runs["n"].astype(np.int64)
            hashes.append(np.frombuffer(p, np.uint64, -1, 4 + n * _RUN.itemsize))
            anchors.append(np.repeat(runs["anchor"], size))
            ids.append(np.repeat(runs["doc_id"], size))
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            places.append(np.repeat(runs["place"].astype(np.int64), size) + step)
            counts.append(len(hashes[-1]))
        self.hash, self.anchor, self.doc_id, self.place = (np.concatenate(x) for x in (hashes, anchors, ids, places))
        self.end = np.cumsum(counts)
        self.begin = self.end - counts
        order = np.lexsort((self.place, self.doc_id, self.anchor, self.hash))
        new = np.ones(len(order), bool)
        new[1:] = (self.hash[order[1:]] != self.hash[order[:-1]]) | (self.anchor[order[1:]] != self.anchor[order[:-1]])
        self.leads = order[new]  # in the order of hashes
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        lead = self.leads[self.which]
        self.later = (self.doc_id != self.doc_id[lead]) | (self.place != self.place[lead])


def _earlier(chunks: list[int], payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
    """One bit for each window that a chunk has sent: an equal one starts earlier elsewhere."""
    sent = _Sent(payloads)
    for chunk, a, b in zip(chunks, sent.begin, sent.end, strict=True):
        if sent.later[a:b].any():
            yield chunk, np.packbits(sent.later[a:b]).tobytes()


def _merge_windows(payloads: list[bytes]) -> bytes:
    """The earliest of equal windows, each a run of its own."""
    sent = _Sent(payloads)
    runs = np.zeros(len(sent.leads), _RUN)
    runs["doc_id"], runs["place"], runs["anchor"], runs["n"] = sent.doc_id[sent.leads], sent.place[sent.leads], sent.anchor[sent.leads], 1
    return np.uint32(len(runs)).tobytes() + runs.tobytes() + sent.hash[sent.leads].tobytes()


def _share_windows(payloads: list[bytes], found: bytes | None) -> Iterable[bytes | None]:
    sent = _Sent(payloads)
    later = sent.later
    if found is not None:
        later = later | np.unpackbits(np.frombuffer(found, np.uint8), count=len(sent.leads)).astype(bool)[sent.which]
    for a, b in zip(sent.begin, sent.end, strict=True):
        yield np.packbits(later[a:b]).tobytes() if later[a:b].any() else None


RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<int>"


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, texts: bool = True, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: RESULT; kept_text is null if ``texts`` is false.

    repeats: the maximal repeats that went, as first word, end, first word, end ... (words from 0).
    """
    chunks = write_chunks(docs, ["doc_id", "text"])
    buckets, groups = n_buckets(chunks), chunk_groups(chunks, fan_in)

    def anchors(table: pa.Table) -> Iterable[tuple[int, bytes]]:
        return ((b, _seeds(x)) for b, x in _anchors(table, buckets, length, k))

    seeds = answer(ask(chunks, anchors), _recurring, groups, _merge_seeds, _share_seeds)

    def extend(chunk_id: int, table: pa.Table, recurs: dict[int, bytes]) -> pa.Table:
        w = Windows(table, length, k)
        lead = w.earliest()
        out = [(b, chunk_id, _send(w, picked)) for b, picked in _asked(w, lead, table, recurs, buckets)]
        # the chunk's own copy of what recurs goes along: the last phase asks in the same order
        out.append((-1, chunk_id, _pack(recurs)))
        b, c, p = zip(*out, strict=True)
        return pa.table({"bucket": pa.array(b, pa.int64()), "chunk_id": pa.array(c, pa.int64()), "payload": pa.array(p, pa.binary())})

    requests = materialize(meet(chunks, seeds, extend, "bucket long, chunk_id long, payload binary"), "windows")
    found = answer(requests.where("bucket >= 0"), _earlier, groups, _merge_windows, _share_windows).unionByName(requests.where("bucket < 0"))

    def remove(chunk_id: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        w = Windows(table, length, k)
        lead = w.earliest()
        gone = w.later.copy()
        first = np.zeros(len(w.hash), bool)
        for bucket, picked in _asked(w, lead, table, _unpack(got.pop(-1)), buckets):
            if bucket in got:
                first[picked] = np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=len(picked)).astype(bool)
        if len(lead):
            gone |= first[lead[np.argsort(w.group[lead])]][w.group]
        steps = np.zeros((int(w.ends[-1]) if len(w.ends) else 0) + 1, np.int64)
        np.add.at(steps, w.at[gone], 1)
        np.add.at(steps, w.at[gone] + length, -1)
        covered = np.cumsum(steps) > 0
        rows = []
        for text, a, b in zip(w.texts, w.starts.tolist(), w.ends.tolist(), strict=True):
            words, drop = text.split(), covered[a:b]
            kept = b" ".join([x for x, out in zip(words, drop.tolist(), strict=True) if not out] if drop.any() else words)
            ends = np.flatnonzero(np.diff(drop, prepend=False, append=False)).tolist() if drop.any() else []
            rows.append((b - a, int(drop.sum()), kept.decode("utf-8", "surrogatepass") if texts else None, hashlib.sha256(kept).hexdigest(), ends))
        n, removed, kept, sha, repeats = zip(*rows, strict=True)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "kept_sha256": pa.array(sha, pa.string()), "repeats": pa.array(repeats, pa.list_(pa.int32()))})

    return meet(chunks, found, remove, RESULT)


def _pack(recurs: dict[int, bytes]) -> bytes:
    out = [np.array([len(recurs)], "<i8").tobytes()]
    for b, p in recurs.items():
        out += [np.array([b, len(p)], "<i8").tobytes(), p]
    return b"".join(out)


def _unpack(raw: bytes) -> dict[int, bytes]:
    out, at = {}, 8
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        b, n = np.frombuffer(raw, "<i8", 2, at).tolist()
        out[b] = raw[at + 16 : at + 16 + n]
        at += 16 + n
    return out
