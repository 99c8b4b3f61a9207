"""Vectors: normalization, exact top-k by cosine for a stated set of queries, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that travel with the plan at a time.
BLOCK = 4_096
#: Rows that meet them at once: a matrix of 8 MB.
ROWS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _arrays(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the exact k nearest of each query by cosine, the smaller id of equals.

    The queries are the stated set. They go in blocks of ``block`` vectors against all rows, which
    are read where they lie, ``ROWS`` at a time: each task keeps the k best of each query and sends them on at its end,
    and the k best of these are the result. Null vectors are no candidates.
    """
    out = None
    kind = "string" if dict(vectors.dtypes)[id] == "string" else "long"
    as_ids = (lambda x: np.array(x, np.int64)) if kind == "long" else (lambda x: np.array(x, str))
    schema = f"query_id {kind}, id {kind}, score double"
    rows = queries.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v")).where("v is not null").orderBy("id")
    source = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v")).where("v is not null")
    for held in _blocks(rows, block):
        ids = as_ids([r["id"] for r in held])
        wanted = _arrays(pa.array([r["v"] for r in held], pa.list_(pa.float64())))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, wanted=wanted) -> Iterator[pa.RecordBatch]:
            n = len(ids)
            # scores to 9 digits decide, then ids; the whole scores go with them
            best, who, whole = np.full((n, k), -np.inf), np.zeros((n, k), ids.dtype), np.full((n, k), -np.inf)
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    own = as_ids(part["id"].to_pylist())
                    scores = wanted @ _arrays(part["v"]).T
                    if exclude_self:
                        scores[ids[:, None] == own[None, :]] = -np.inf
                    raw, scores = scores, np.round(scores, 9)
                    # what is not behind the k-th best so far; of a query's new ones the k best at most count, and their equals
                    least = best[:, -1]
                    if len(own) > k:
                        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                    q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                    s, o, x = np.append(scores[q, at], best.ravel()), np.append(own[at], who.ravel()), np.append(raw[q, at], whole.ravel())
                    q = np.append(q, np.repeat(np.arange(n), k))
                    order = np.lexsort((o, -s, q))
                    first = order[np.searchsorted(q[order], np.arange(n))[:, None] + np.arange(k)]
                    best, who, whole = s[first], o[first], x[first]
            real = np.isfinite(best)
            q = np.broadcast_to(ids[:, None], best.shape)
            yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(who[real]), pa.array(whole[real])], ["query_id", "id", "score"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, block: int) -> Iterator[list]:
    held = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held
