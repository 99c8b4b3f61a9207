"""The pipeline hands texts to Python in small batches, and results don't depend on how large these are."""

import pytest

import corpus_pipeline
from graphloom.llm import quality_rules as Q
from graphloom.llm.common import BATCH_BYTES, Hashes, pieces
from tests.llm.conftest import prose


@pytest.fixture
def unset(spark):
    spark.conf.unset(BATCH_BYTES)
    yield
    spark.conf.unset(BATCH_BYTES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty texts of some 120 kB in one partition, labelled, and a few odd ones."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, prose(i, 25_000), "en", "s") for i in range(40)] + [(50, None, "en", "s"), (51, "", "en", None), (52, "short", "en", "s"), (None, prose(60, 40), "en", "s")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(7, 25_000)[5000:5100])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_quality_rules_get_small_batches(spark, unset, tables, monkeypatch):
    def watched(batches, column, size=2 << 20):
        def seen():
            for batch in batches:
                assert batch.get_total_buffer_size() < 2 << 20, f"a batch of {batch.get_total_buffer_size()} bytes"
                yield batch

        return pieces(seen(), column, size)

    monkeypatch.setattr(Q, "pieces", watched)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert corpus_pipeline.keep_quality(spark, docs, tables).count() > 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_bound_batches(spark, unset, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage(spark, docs, tables)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    assert 0 < max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 2 << 20


def test_a_setting_stays(spark, unset, tables):
    spark.conf.set(BATCH_BYTES, "12345")
    corpus_pipeline.drop_benchmark(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    assert spark.conf.get(BATCH_BYTES).rstrip("b") == "12345"


def test_batches_make_no_difference(spark, unset, tables):
    found = []
    for size in ("1000", str(64 << 20)):
        spark.conf.set(BATCH_BYTES, size)
        found.append(sorted(map(str, corpus_pipeline.run(spark, tables).collect())))
    assert found[0] == found[1] and found[0]


def test_hashes_forget():
    words = [b"w%d" % (i % 70) for i in range(500)]
    few, many = Hashes(16), Hashes()
    assert few.of(words).tolist() == many.of(words).tolist()
    assert len(few) <= 16 and len(many) == 70
