"""What the operators of this subpackage share: words, hashes, written tables, chunks.

A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``, which is
exactly what ``bytes.split()`` yields on UTF-8 text.

Chunked scatter and gather
--------------------------
Several operators need facts about the whole corpus for every word window, line
or token of every document. Shuffling one row per window costs several times the
input. They use chunks instead: ``write_chunks`` packs documents into rows of a
few MB (a written table, so chunk ids stay the same when a task is retried), each
chunk sends every distinct item once to the item's bucket, the bucket answers in
the order asked, and answers meet their chunk again. A key that a third of all
rows share is so sent once a chunk, never once a row; and where chunks are many, groups of chunks
merge what they send to a bucket, so no task takes the payloads of all chunks.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.written import cleanup, materialize

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``: for a scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def n_buckets(df: DataFrame, bytes_each: int = 1 << 20, least: int = 512) -> int:
    """Buckets that keep one bucket's share of ``df`` small at any input size."""
    return max(least, min(1 << 30, plan_bytes(df) // bytes_each))


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """From now on rows go to Python in batches of about ``size`` bytes, or of one row; a session with a setting of its own keeps that.

    Spark fills batches up to 64 MB. The JVM holds such a batch twice while its buffers grow, the worker
    while the next one is read, and neither gives the memory back to the system, so executors
    that run stage after stage get ever larger.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(size))


def other_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that don't bear one of the names; Spark resolves names without regard to case, so that counts for nothing."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- words and hashes
def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class Hashes(dict):
    """64-bit hash of a byte string; remembers ``most`` of them."""

    def __init__(self, most: int = 1 << 19):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, each followed by a line end; of each word its beginning there, its size, a 64-bit hash.

    A hash takes in eight bytes of the word at a time, mixed in turn.
    """
    raw = b"".join(part for t in texts for part in (t, b"\n")) + b"\0" * 8
    x = np.frombuffer(raw, np.uint8)
    blank = _BLANK.take(x)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(x) > 8 and not blank[0]:
        edge = np.append(0, edge)
    begin, size = edge[0:-1:2], edge[1::2] - edge[0:-1:2]  # the zeros after the last blank are an unclosed word
    wide = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, done = np.arange(len(begin)), 0
    while len(at):
        left = np.minimum(size[at] - done, 8).astype(np.uint64)
        lane = wide[begin[at] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        h[at] = mix(h[at] * np.uint64(3) + lane)
        done += 8
        at = at[size[at] > done]
    return x[:-8], begin, size, h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values of ``h`` (polynomial, then mixed)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : n + j]
    return mix(out)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % np.uint64(n)).astype(np.int64)


def split_by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the (ascending) indexes that have it."""
    order = np.argsort(keys, kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            yield int(keys[part[0]]), part


# ---------------------------------------------------------------- chunks
def _pack(batches: list[pa.RecordBatch]) -> bytes:
    out = io.BytesIO()
    table = pa.Table.from_batches(batches).combine_chunks()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Cut a stream of batches into lists of slices with about ``size`` bytes of ``column`` each."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, min(int(np.searchsorted(ends, base + size - have, "right")), start + 20_000))
            held.append(batch.slice(start, stop - start))
            have += int(ends[stop - 1]) - base
            if have >= size * 0.9 or stop < batch.num_rows:
                yield held
                held, have = [], 0
            start = stop
    if held:
        yield held


def write_chunks(docs: DataFrame, columns: list[str], size: int = CHUNK_BYTES, note: Callable[[pa.Table], bytes] | None = None) -> DataFrame:
    """A written table (chunk_id, blob): the rows of ``docs`` in packs of about ``size`` bytes of text.

    A very long text is a pack of its own. ``unpack(blob)`` gives the rows as an Arrow table.
    ``note`` adds a column of that name with what it says of a pack's rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, held in enumerate(pieces(batches, "text", size)):
            more = {"note": pa.array([note(pa.Table.from_batches(held))], pa.binary())} if note else {}
            yield pa.RecordBatch.from_pydict({"chunk_id": [first + i], "blob": pa.array([_pack(held)], pa.binary())} | more)

    return materialize(docs.select(*columns).mapInArrow(pack, "chunk_id long, blob binary" + ", note binary" * bool(note)), "chunks")


REQUEST = "bucket long, chunk_id long, payload binary"


def _request_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, c, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.binary())], ["bucket", "chunk_id", "payload"])


def ask(chunks: DataFrame, emit: Callable[[pa.Table], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Requests of all chunks: ``emit`` turns a chunk's rows into (bucket, payload) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, blob in zip(batch["chunk_id"].to_pylist(), batch["blob"], strict=True):
                yield _request_batch([(b, chunk_id, p) for b, p in emit(unpack(blob.as_buffer()))])

    return chunks.mapInArrow(run, REQUEST)


#: Bytes of written chunks, a few thousand chunks, whose payloads a bucket takes at once; where there are more, groups of
#: chunks come between them and the bucket.
FAN_IN = 2 << 30

Reduce = Callable[[list[int], list[bytes]], Iterable[tuple[int, bytes]]]


def chunk_groups(chunks: DataFrame, fan_in: int) -> int:
    """How many groups of ``fan_in`` bytes the written chunks make."""
    return max(1, -(-plan_bytes(chunks) // fan_in))


def answer(requests: DataFrame, reduce: Reduce, groups: int = 1, merge: Callable[[list[bytes]], bytes] | None = None, share: Callable[[list[bytes], bytes | None], Iterable[bytes | None]] | None = None) -> DataFrame:
    """Answers of all buckets: ``reduce`` gets a bucket's chunk ids and payloads, gives (chunk_id, payload).

    With several ``groups`` of chunks a bucket never sees all its chunks: ``merge`` makes one payload of those of a group, the
    bucket answers the groups, and ``share`` makes of a group's payloads and its answer (or none) each chunk's
    answer (or none). So an item that every chunk has costs a task a group's payloads or all groups', not all chunks'.
    """
    if groups > 1:
        return _answer_by_groups(requests, reduce, groups, merge, share)

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        rows = [(bucket, c, p) for c, p in reduce(table["chunk_id"].to_pylist(), table["payload"].to_pylist())]
        return pa.Table.from_batches([_request_batch(rows)])

    return requests.groupBy("bucket").applyInArrow(run, REQUEST)


def _answer_by_groups(requests: DataFrame, reduce: Reduce, groups: int, merge, share) -> DataFrame:
    requests = materialize(requests.withColumn("of", F.pmod(F.xxhash64("chunk_id"), F.lit(groups))), "requests")

    def combine(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_request_batch([(table["bucket"][0].as_py(), table["of"][0].as_py(), merge(table["payload"].to_pylist()))])])

    top = materialize(answer(requests.groupBy("bucket", "of").applyInArrow(combine, REQUEST), reduce), "group-answers")

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        if left.num_rows:
            found = right["payload"][0].as_py() if right.num_rows else None
            own = share(left["payload"].to_pylist(), found)
            rows = [(left["bucket"][0].as_py(), c, p) for c, p in zip(left["chunk_id"].to_pylist(), own, strict=True) if p is not None]
        return pa.Table.from_batches([_request_batch(rows)])

    groups_ = top.where("chunk_id >= 0").withColumnRenamed("chunk_id", "of").groupBy("bucket", "of")
    return requests.groupBy("bucket", "of").cogroup(groups_).applyInArrow(spread, REQUEST).unionByName(top.where("chunk_id < 0"))


def meet(chunks: DataFrame, answers: DataFrame, apply: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Bring each chunk together with its answers (bucket -> payload) and return ``apply``'s rows."""
    empty = _empty(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        got = dict(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True))
        return apply(left["chunk_id"][0].as_py(), unpack(left["blob"][0].as_buffer()), got)

    return chunks.groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


__all__ = ["cleanup", "materialize", "Hashes", "FAN_IN", "answer", "ask", "chunk_groups", "bucket_of", "encode", "fresh", "meet", "mix", "n_buckets", "other_columns", "pieces", "plan_bytes", "small_batches", "split_by", "unpack", "windows", "words_of", "write_chunks", "WORD"]
