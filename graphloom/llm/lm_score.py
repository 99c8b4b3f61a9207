"""LM scoring by online logistic context mixing, beside a base score by token counts.

Base. Tokens are the words of the lower-cased (A-Z) text and one end a text. Chunks of documents
send each distinct token once, with its count in their training documents, to its bucket
and get back its count in all; nothing per token of a document is shuffled.

Model. The lower-cased text's bytes, and a final 0, are coded by binary codes, one for each byte
before, and for each of the commonest pairs before (Huffman codes of the training documents' bytes). Each binary decision is predicted by several
predictors, one for each order: the counts of both outcomes, over all training documents, after the last
2, 4 or 6 bytes at the place in the code. Stretched predictions, which grow with their counts, are mixed with weights
chosen by a gate (the highest order that has seen the context, and how sure it is), and the mixed one
is refined by an adaptive map (an offset by gate). Weights and map start
from fixed values in each document and learn online from it: every block is scored before it is learnt
from, so the product of all decisions' probabilities is the text's probability. The first block is
``BLOCK`` bytes, and none is longer than that or a ``SHARE``-th of the text before it.

Counts are kept for every distinct context, under exact keys, so no two contexts share one and
the model grows with the training documents. Contexts live in buckets as the tokens do: a chunk
sends each distinct context and next byte once, with its count, and gets back the
predictions on that byte's path. Nothing of the model but the codes of bytes (a fixed size) is
broadcast or sent to the driver. Within a chunk the texts are gone through in pieces, a long text in several.

Defined results: a null text is empty (one token, its end). A null doc_id has no crc32; it is a training
document. Repeated rows count, and are scored, each. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FAN_IN, answer, ask, bucket_of, chunk_groups, encode, materialize, meet, mix, n_buckets, split_by, words_of, write_chunks

ORDERS = (2, 4, 6)
LAST = max(ORDERS)
CHUNK, PIECE = 12 << 20, 1 << 19
BLOCK, SHARE = 32, 16
#: Gates: highest order seen (0: none), three ranges of how sure it is.
GATES = 3 * (len(ORDERS) + 1)
START, RATE, STEADY = 0.33, 0.02, 0.05


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the ranges, range by range."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


# ---------------------------------------------------------------- the codes of bytes
class Code:
    """Binary codes of the next byte: one for each byte before it, one for each of the commonest pairs before it.

    pairs: counts of byte pairs (256 x 256). after: by pair of bytes (the earlier * 256 + the later), counts of what follows.
    By ``at``: length and beginning of a byte's path; of all paths: nodes and outcomes.
    """

    def __init__(self, pairs: np.ndarray, after: dict[int, np.ndarray]):
        one = pairs.sum(0) + 1.0
        one /= one.sum()
        weights = [row + 4 * one + 1e-4 for row in pairs]
        self.state = np.arange(1 << 16, dtype=np.int32) & 255
        for k, (before, counts) in enumerate(sorted(after.items())):
            near = weights[before & 255]
            weights.append(counts + 4 * near / near.sum() + 1e-4)
            self.state[before] = 256 + k
        length, nodes, outcomes = [], [], []
        for weight in weights:
            heap = [(w, b) for b, w in enumerate(weight.tolist())]
            heapq.heapify(heap)
            tree: list[tuple[int, int]] = []
            while len(heap) > 1:
                (u, a), (v, b) = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (u + v, 256 + len(tree)))
                tree.append((a, b))
            paths: dict[int, tuple[list[int], list[bool]]] = {}
            todo: list[tuple[int, list[int], list[bool]]] = [(heap[0][1], [], [])]
            while todo:
                at, n, o = todo.pop()
                if at < 256:
                    paths[at] = n, o
                else:
                    todo += [(child, [*n, at - 256], [*o, bit]) for bit, child in zip((False, True), tree[at - 256], strict=True)]
            for b in range(256):
                length.append(len(paths[b][0]))
                nodes += paths[b][0]
                outcomes += paths[b][1]
        self.length, self.node, self.outcome = np.array(length), np.array(nodes, np.uint8), np.array(outcomes, bool)
        self.begin = np.cumsum(self.length) - self.length

    def at(self, runs: np.ndarray) -> np.ndarray:
        """Of numbers whose lowest byte is the one to code, and the next two those before it: its place in length and begin."""
        return self.state.take(((runs >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)) * 256 + (runs & np.uint64(0xFF)).astype(np.int32)


#: So many pairs of bytes have a code of their own.
PAIRS = 256


def byte_triples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of three bytes, as numbers, and their counts; two 0s stand before each text and one after it."""
    x = np.frombuffer(b"".join(part for t in texts for part in (b"\0\0", t, b"\0")), np.uint8).astype(np.uint32)
    own = np.concatenate([np.ones(0, bool), *[np.arange(len(t) + 3) >= 2 for t in texts]])
    triples = np.sort((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:])[own[2:]]) if len(x) else x
    new = np.flatnonzero(np.append(True, triples[1:] != triples[:-1])) if len(triples) else np.zeros(0, np.int64)
    return triples[new], np.diff(np.append(new, len(triples)))


def code_of(texts: list[bytes]) -> Code:
    """The code that these training texts give."""
    triples, n = byte_triples(texts)
    pairs = np.bincount(triples & 0xFFFF, n, 1 << 16).reshape(256, 256)
    total = np.bincount(triples >> 8, n, 1 << 16)
    top = np.argsort(-total, kind="stable")[:PAIRS]
    return Code(pairs, {int(c): np.bincount(triples[own] & 0xFF, n[own], 256) for c in top.tolist() if total[c] for own in [triples >> 8 == c]})


# ---------------------------------------------------------------- contexts
def run_numbers(texts: list[bytes], before: bytes = b"", closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each text has with its end, and each byte with the six before it as a number, the latest lowest.

    before: what stands before the text, if it is the later part of a longer one; closed: whether it ends here.
    """
    lead = before[-LAST:].rjust(LAST + 1, b"\0")
    end = b"\0" if closed else b""
    raw = b"".join(part for t in texts for part in (lead, t, end))
    size = np.array([len(t) + closed for t in texts], np.int64)
    wide = np.ndarray(max(0, len(raw) - 7), ">u8", raw, strides=(1,))  # eight bytes from each place on
    own = ragged(np.cumsum(size + len(lead)) - size - 7, size)
    return size, wide[own].astype(np.uint64) & np.uint64(2**56 - 1)


def pieces_of(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, int, list[bytes], bytes, bool]]:
    """Runs of texts of about ``most`` bytes: index of the first, where in it they begin (0, or later in a long one),
    the texts, what stands before, whether they end here."""
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield first, 0, held, b"", True
            held, size = [], 0
        if not held:
            first = i
        if len(t) > most:
            for a in range(0, len(t), most):
                yield i, a, [t[a : a + most]], t[max(0, a - LAST) : a], a + most >= len(t)
            continue
        held.append(t)
        size += len(t)
    if held:
        yield first, 0, held, b"", True


def all_runs(texts: list[bytes], trains: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of seven bytes of the texts, ascending, and how often each occurs in training texts.

    Beside the result it holds eight bytes for each of the texts', sorted in place.
    """
    x = np.empty(sum(map(len, texts)) + len(texts), np.uint64)
    a = 0
    for i, _, part, before, closed in pieces_of(texts):
        size, wide = run_numbers(part, before, closed)
        own = x[a : a + len(wide)]
        np.left_shift(wide, np.uint64(1), out=own)
        if trains is not None:
            own |= np.repeat(np.array([not y for y in trains[i : i + len(part)]], np.uint64), size)
        a += len(wide)
    x.sort()
    new = [np.flatnonzero(np.append(not a, x[a + 1 : a + PIECE] >> np.uint64(1) != x[a : a + PIECE - 1][: len(x) - a - 1] >> np.uint64(1))) + a for a in range(0, len(x), PIECE)]
    for k, a in enumerate(range(PIECE, len(x), PIECE), 1):  # a part's first may be new as well
        if x[a] >> np.uint64(1) != x[a - 1] >> np.uint64(1):
            new[k] = np.append(a, new[k])
    first = np.concatenate(new) if new else np.zeros(0, np.int64)
    runs = x[first] >> np.uint64(1)
    x &= np.uint64(1)
    n = np.diff(np.append(first, len(x))) - (np.add.reduceat(x, first).astype(np.int64) if len(first) else 0)
    return runs, n


def keys_of(runs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct (order, context, next byte) of the runs, as exact ascending keys, and by order each run's key."""
    keys, at, base = [], [], 0
    for tag, order in enumerate(ORDERS):
        own, back = np.unique(runs & np.uint64(2 ** (8 * order + 8) - 1), return_inverse=True) if order < LAST else (runs, np.arange(len(runs)))
        keys.append(own | np.uint64(tag << 56))
        at.append((base + back).astype(np.int32))
        base += len(own)
    return np.concatenate(keys), at


def counted_keys(texts: list[bytes], trains: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct keys, ascending, and their counts in its training texts."""
    runs, count = all_runs(texts, trains)
    keys, at = keys_of(runs)
    out = np.zeros(len(keys), np.int64)
    for own in at:
        out += np.bincount(own, count, len(keys)).astype(np.int64)
    return keys, out


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """All bytes after one context meet in one bucket."""
    return split_by(bucket_of(keys >> np.uint64(8), buckets))


def planes(x: np.ndarray) -> bytes:
    """Eight-byte numbers, first bytes first: near numbers compress better."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unplanes(p: bytes) -> np.ndarray:
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(zstandard.decompress(p), np.uint8).reshape(8, -1).T).tobytes(), np.uint64)


def send_runs(keys: np.ndarray, n: np.ndarray, buckets: int) -> Iterable[tuple[int, bytes]]:
    for bucket, at in by_bucket(keys, buckets):
        yield bucket, _write_counts(b"C", keys[at], n[at])


def predict(code: Code, ids: list[int], payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
    """For each chunk the stretched predictions on the paths of all bytes it sent, from the counts of all chunks."""
    sent, keys, back, n = _summed(payloads)
    context = np.cumsum(np.diff(keys >> np.uint64(8), prepend=np.uint64(0)) != 0)
    pair = code.at(keys)  # the context's last byte is its lowest
    length = code.length[pair]
    at = ragged(code.begin[pair], length)
    which = np.repeat(np.arange(len(keys)), length)
    place, found = pd.factorize(context[which] * 256 + code.node[at])
    ones = np.bincount(place, n[which] * code.outcome[at], len(found))
    value = stretched(np.bincount(place, n[which], len(found)) - ones, ones)[place]
    begin = np.cumsum(length) - length
    start = 0
    for chunk, own in zip(ids, sent, strict=True):
        mine = back[start : start + len(own)]
        yield chunk, zstandard.compress(value[ragged(begin[mine], length[mine])].tobytes(), 1)
        start += len(own)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds of outcome 1 in sixteenths, within 8; 0 only where nothing was counted."""
    q = np.rint(np.clip(np.log((n1 + 0.2) / (n0 + 0.2)), -7.9, 7.9) * 16).astype(np.int8)
    q[(q == 0) & (n0 + n1 > 0)] = 1
    return q


# ---------------------------------------------------------------- scoring
def packed(code: Code, runs: np.ndarray, at: list[np.ndarray], begin: np.ndarray, value: np.ndarray, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: number and beginning of its decisions; of each decision four numbers in a word: the predictions, gate and outcome.

    ``most`` runs are worked on at a time.
    """
    pair = code.at(runs)
    length = code.length.take(pair)
    first = np.cumsum(length) - length
    out = np.empty((int(length.sum()), 4), np.int8)
    for a in range(0, len(runs), most):
        own = slice(a, a + most)
        which = np.repeat(np.arange(len(length[own])), length[own])
        step = np.arange(len(which)) - (first[own] - first[a]).take(which)
        part = out[first[a] : first[a] + len(which)]
        gate, sure = np.zeros(len(which), np.int8), np.zeros(len(which), np.int8)
        for o, keys in enumerate(at):
            seen = value.take(begin.take(keys[own]).take(which) + step)
            part[:, o] = seen
            there = seen != 0
            gate[there] = 3 * (o + 1)
            np.copyto(sure, seen, where=there)
        np.abs(sure, out=sure)
        gate += (sure > 24).view(np.int8) + (sure > 56).view(np.int8)
        part[:, 3] = gate * 2 + code.outcome.take(code.begin.take(pair[own]).take(which) + step)
    return length.astype(np.int32), first.astype(np.int32 if len(out) < 2**31 else np.int64), out.view(np.uint32).ravel()


class Mixer:
    """Weights and map of some documents, each its own, and where in its text each stands."""

    def __init__(self, n: int):
        self.weights = np.full((len(ORDERS), n * GATES), START / 16, np.float32)  # predictions are in sixteenths
        self.map = np.zeros(n * GATES, np.float32)
        self.done = 0

    def nats(self, size: np.ndarray, length: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each text minus log its probability.

        size: the texts' bytes. length, first: number and beginning of each byte's decisions in ``words`` (see ``packed``).
        All texts' first blocks are scored and learnt from, then their second ones, and so on.
        """
        n = len(size)
        bounds = [0]
        while bounds[-1] < self.done + int(size.max()):
            bounds.append(bounds[-1] + max(BLOCK, bounds[-1] // SHARE))
        # all texts' first bytes, then their second ones, and so on: neighbours then count in different cells, which is faster
        most = int(size.max())
        alive = n - np.cumsum(np.bincount(size, minlength=most + 1))[:most]  # texts that are longer
        doc = np.argsort(-size, kind="stable").take(ragged(np.zeros(most, np.int64), alive))
        order = (np.cumsum(size) - size).take(doc) + np.repeat(np.arange(most), alive)
        length = length.take(order)
        ends = np.cumsum(length)
        bounds_ = np.array(bounds)
        mine = bounds_[1:] > self.done
        blocks = np.diff(bounds_)[mine]
        cuts = np.append(0, np.cumsum(alive))[np.append(0, np.minimum(bounds_[1:][mine] - self.done, most))]
        base = first.take(order) - (ends - length)  # from a decision's place in the order of blocks to that in ``words``
        own = doc * GATES
        starts = np.append(0, ends)[cuts]
        steps = np.arange(int(np.diff(starts).max()))
        loss = np.zeros(n * GATES)
        for a, b, start, stop, bytes_ in zip(cuts[:-1].tolist(), cuts[1:].tolist(), starts[:-1].tolist(), starts[1:].tolist(), blocks.tolist(), strict=True):
            # a block's numbers are made when its turn comes, so that they are still in the cache when they are used
            at = np.repeat(base[a:b] + start, length[a:b])
            at += steps[: stop - start]
            four = words.take(at).view(np.int8).reshape(-1, 4)
            g = np.repeat(own[a:b], length[a:b])
            g += four[:, 3] >> 1
            y = ((four[:, 3] & 1) * np.int8(2) - np.int8(1)).astype(np.float32)
            t = [four[:, o].astype(np.float32) for o in range(len(ORDERS))]
            z = t[0] * self.weights[0].take(g)
            for x, w in zip(t[1:], self.weights[1:], strict=True):
                z += x * w.take(g)
            np.clip(z, -8, 8, out=z)
            z += self.map.take(g)
            z *= y
            e = np.exp(np.negative(z, out=z), out=z)
            one = 1 + e  # e is e**-8 at least, so nothing is lost
            e /= one
            loss += np.bincount(g, np.log(one, out=one), n * GATES)
            e *= y  # the error: outcome minus probability
            # learn from the block, after it is scored; the more decisions a step sums, the smaller it is
            rate = RATE / (1 + STEADY * bytes_)
            for x, w in zip(t, self.weights, strict=True):
                w += (rate / 256 * np.bincount(g, e * x, n * GATES)).astype(np.float32)
            self.map += (rate * np.bincount(g, e, n * GATES)).astype(np.float32)
        self.done += int(size.max())
        return loss.reshape(n, GATES).sum(1)


def places(wide: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The place of each number among ``runs``, which are ascending and hold them all."""
    order = np.argsort(wide)
    ordered = wide.take(order)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(wide) else np.zeros(0, np.int64)
    out = np.empty(len(wide), np.int64)
    out[order] = np.repeat(np.searchsorted(runs, ordered.take(first)), np.diff(np.append(first, len(wide))))
    return out


def log10_probabilities(code: Code, texts: list[bytes], runs: np.ndarray, decisions: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probabilities of the lower-cased texts and their ends. runs: ``all_runs``; decisions: ``packed`` of them."""
    length, first, words = decisions
    out = np.zeros(len(texts))
    mixer = Mixer(0)
    for i, a, part, before, closed in pieces_of(texts):
        if not a:
            mixer = Mixer(len(part))
        size, wide = run_numbers(part, before, closed)
        at = places(wide, runs)
        out[i : i + len(part)] -= mixer.nats(size, length.take(at), first.take(at), words)
    return out / float(np.log(10))


_END = 0x9E3779B97F4A7C15  # as a word of no bytes


def _lower(table: pa.Table) -> list[bytes]:
    return [encode(t).lower() for t in table["text"].to_pylist()]


def _trains(table: pa.Table) -> list[bool]:
    return [not held_out(i) for i in table["doc_id"].to_pylist()]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and a hash of each word."""
    _, begin, _, h = words_of(texts)
    own = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")  # the text of each word
    return np.bincount(own, minlength=len(texts)), h


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens each text has; the distinct ones' hashes, ascending; which of them each token is."""
    counts, hashes = [], []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size > PIECE or i == len(texts) - 1:
            n, h = _word_hashes(held)
            counts.append(n)
            hashes.append(h)
            held, size = [], 0
    back, found = pd.factorize(np.append(np.concatenate(hashes), mix(np.array([_END], np.uint64))))
    order = np.argsort(found)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    sizes = np.concatenate(counts) + 1
    out = np.full(int(sizes.sum()), place[back[-1]])
    words = np.ones(len(out), bool)
    words[np.cumsum(sizes) - 1] = False
    out[words] = place[back[:-1]]
    return sizes, found[order], out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _note(n: np.ndarray, triples: np.ndarray) -> bytes:
    return zstandard.compress(np.uint32(len(n)).tobytes() + triples.astype(np.uint32).tobytes() + n.astype(np.int64).tobytes(), 1)


def corpus_code(chunks: DataFrame) -> Code:
    """The code of the training documents' bytes, from the notes of chunks.

    The driver gets 65,536 sums of pairs at most, the ``PAIRS`` commonest pairs, and 256 sums for each of these.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for note in batch["note"]:
                raw = zstandard.decompress(note.as_py())
                m = int(np.frombuffer(raw, np.uint32, 1)[0])
                both = np.concatenate([sums, np.frombuffer(raw, np.int64, m, 4 + 4 * m)])
                found, back = np.unique(np.concatenate([found, np.frombuffer(raw, np.uint32, m, 4)]), return_inverse=True)
                sums = np.bincount(back, both, len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(sums)], ["triple", "n"])

    triples = chunks.select("note").mapInArrow(total, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    triples = materialize(triples, "triples")
    pairs = np.zeros(1 << 16)
    for row in triples.groupBy((F.col("triple") % 65_536).alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[row["pair"]] = row["n"]
    before = F.floor(F.col("triple") / 256).cast("long").alias("before")
    top = [r["before"] for r in triples.groupBy(before).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "before").limit(PAIRS).collect()]
    after: dict[int, np.ndarray] = {c: np.zeros(256) for c in top}
    if top:
        for row in triples.withColumn("before", before).where(F.col("before").isin(top)).collect():
            after[row["before"]][row["triple"] % 256] = row["n"]
    return Code(pairs.reshape(256, 256), after)


def _read_counts(p: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and counts of a payload of tokens (T) or contexts (C)."""
    m = int(np.frombuffer(p, np.uint32, 1, 1)[0])
    if p[:1] == b"T":
        return np.frombuffer(p, np.uint64, m, 5), np.frombuffer(zstandard.decompress(p[5 + 8 * m :]), np.int64)
    return np.cumsum(unplanes(p[5 : 5 + m])), unplanes(p[5 + m :]).astype(np.int64)


def _write_counts(kind: bytes, keys: np.ndarray, n: np.ndarray) -> bytes:
    if kind == b"T":
        return kind + np.uint32(len(keys)).tobytes() + keys.tobytes() + zstandard.compress(n.tobytes(), 1)
    packed_ = planes(np.diff(keys, prepend=np.uint64(0)))
    return kind + np.uint32(len(packed_)).tobytes() + packed_ + planes(n)


def _summed(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What each has sent; all keys, ascending; the place of each sent key among them, end to end; their counts in all."""
    sent = [_read_counts(p) for p in payloads]
    keys, back = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, back, np.concatenate([c for _, c in sent]))
    return [k for k, _ in sent], keys, back, n


def merge_counts(payloads: list[bytes]) -> bytes:
    _, keys, _, n = _summed(payloads)
    return _write_counts(payloads[0][:1], keys, n)


def share_counts(code: Code, payloads: list[bytes], found: bytes | None) -> Iterable[bytes | None]:
    """Of a group's answer each chunk's part: counts of its tokens, or predictions for its contexts."""
    sent, keys, back, _ = _summed(payloads)
    whole, start = zstandard.decompress(found), 0
    tokens = payloads[0][:1] == b"T"
    if not tokens:
        length = code.length[code.at(keys)]
        begin = np.cumsum(length) - length
    for own in sent:
        mine = back[start : start + len(own)]
        part = np.frombuffer(whole, np.int64)[mine] if tokens else np.frombuffer(whole, np.int8)[ragged(begin[mine], length[mine])]
        yield zstandard.compress(part.tobytes(), 1)
        start += len(own)


def score_documents(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: RESULT."""

    def note(table: pa.Table) -> bytes:
        triples, n = byte_triples([t for t, own in zip(_lower(table), _trains(table), strict=True) if own])
        return _note(n, triples)

    chunks = write_chunks(docs, ["doc_id", "text"], CHUNK, note)
    code = corpus_code(chunks)
    buckets = n_buckets(chunks)

    # buckets from 0 are those of tokens, from ``buckets`` those of contexts
    def send(table: pa.Table) -> Iterable[tuple[int, bytes]]:
        texts, trains = _lower(table), _trains(table)
        sizes, keys, back = _tokens(texts)
        n = np.bincount(back[np.repeat(np.array(trains), sizes)], minlength=len(keys)).astype(np.int64)
        for bucket, at in split_by(bucket_of(keys, buckets)):
            yield bucket, _write_counts(b"T", keys[at], n[at])
        for bucket, p in send_runs(*counted_keys(texts, trains), buckets):
            yield buckets + bucket, p

    def reduce(ids: list[int], payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
        return total(ids, payloads) if payloads[0][:1] == b"T" else predict(code, ids, payloads)

    def total(ids: list[int], payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
        sent, _, back, n = _summed(payloads)
        yield -1, np.array([(n > 0).sum(), n.sum()], np.int64).tobytes()
        start = 0
        for chunk, own in zip(ids, sent, strict=True):
            yield chunk, zstandard.compress(n[back[start : start + len(own)]].tobytes(), 1)
            start += len(own)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vn = np.array([np.frombuffer(p.as_py(), np.int64) for p in batch["payload"]], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(vn[:, 0]), pa.array(vn[:, 1])], ["v", "n"])

    found = answer(ask(chunks, send), reduce, chunk_groups(chunks, fan_in), merge_counts, lambda payloads, of: share_counts(code, payloads, of))
    answers = materialize(found, "counts")
    row = answers.where("chunk_id = -1").mapInArrow(sizes, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    v, n_all = int(row[0] or 0), int(row[1] or 0)

    def score(chunk_id: int, table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        texts = _lower(table)
        sizes, keys, back = _tokens(texts)
        c = np.zeros(len(keys), np.int64)
        for bucket, at in split_by(bucket_of(keys, buckets)):
            c[at] = np.frombuffer(zstandard.decompress(got[bucket]), np.int64)
        own = c[back]
        starts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10(own + 1.0), starts) - sizes * np.log10(n_all + v + 1.0)
        known = np.add.reduceat((own > 0).astype(np.int64), starts)
        ids = table["doc_id"].to_pylist()
        del c, back, own
        got = {b: p for b, p in got.items() if b >= buckets}
        runs, _ = all_runs(texts)
        keys, at = keys_of(runs)
        length = code.length[code.at(keys)]
        begin = np.cumsum(length) - length
        value = np.empty(int(length.sum()), np.int8)
        for bucket, mine in by_bucket(keys, buckets):
            value[ragged(begin[mine], length[mine])] = np.frombuffer(zstandard.decompress(got[buckets + bucket]), np.int8)
        decisions = packed(code, runs, at, begin, value)
        del keys, at, length, begin, value
        scores = log10_probabilities(code, texts, runs, decisions)
        per_byte = -scores / np.log10(2) / np.array([len(t) + 1 for t in texts])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids], pa.bool_()), "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(ids), n_all), "base_score": base, "score": scores, "bits_per_byte": per_byte})

    return meet(chunks.drop("note"), answers.where("chunk_id >= 0"), score, RESULT)
