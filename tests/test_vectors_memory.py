"""Nearest vectors take little of a worker's memory, and equal scores go by id wherever the rows lie."""

import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.operators import kge, vectors


def test_top_k_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(2000, 0, -1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.top_k(v.where("vec_id in (7, 8)"), v, 3, exclude_self=True).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got) == [(7, 1, 1, 1.0), (7, 2, 3, 1.0), (7, 3, 5, 1.0), (8, 1, 2, 1.0), (8, 2, 4, 1.0), (8, 3, 6, 1.0)]


def peak(monkeypatch, run, batches) -> float:
    tracemalloc.start()
    for _ in run(iter(batches)):
        pass
    out = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out


def test_memory_of_a_task(spark, monkeypatch):
    """A full block of queries against a batch of rows."""
    rng, held = np.random.default_rng(0), []
    kind = type(spark.range(1))
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: held.append(f) or own(self, f, *a, **b))
    rows = [(i, rng.random(8).tolist()) for i in range(4096)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors.top_k(v, v, 10)
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "v": pa.array([x for _, x in rows], pa.list_(pa.float64()))})
    assert peak(monkeypatch, held[0], [batch]) < 150
    named = v.selectExpr("cast(vec_id as string) id", "embedding vector")
    one = spark.createDataFrame([("r", [1.0] * 8)], "id string, vector array<double>")
    test = named.limit(2048).selectExpr("id head", "'r' relation", "id tail")
    held.clear()
    kge.ranks(test, named, one, test, "distmult")
    assert peak(monkeypatch, held[0], [pa.RecordBatch.from_pydict({"vector": batch["v"]})]) < 80
