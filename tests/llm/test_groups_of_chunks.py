"""Groups of chunks between chunks and buckets give the same rows."""

import pytest

from graphloom.llm import common, line_dedup, lm_score, substring_dedup


@pytest.fixture
def many_chunks(spark, monkeypatch):
    """The rows of a small table in chunks of a few texts."""
    own = common.write_chunks

    def small(docs, columns, size=0, note=None):
        return own(docs, columns, 20_000, note)

    for m in (line_dedup, lm_score, substring_dedup):
        monkeypatch.setattr(m, "write_chunks", small)


@pytest.mark.parametrize("name", ["op4", "op7", "op10"])
def test_same_rows(spark, small_dir, many_chunks, odd_docs, name):
    run = {
        "op4": lambda d, n: substring_dedup.dedup_substrings(d, fan_in=n),
        "op7": lambda d, n: lm_score.score_documents(d, fan_in=n),
        "op10": lambda d, n: line_dedup.dedup_lines(d, fan_in=n, **line_dedup.RECURRING),
    }[name]
    for docs in (spark.read.parquet(f"{small_dir}/documents.parquet").limit(120), odd_docs):
        docs = common.materialize(docs, "docs")
        one, several = (sorted(map(repr, run(docs, n).collect())) for n in (common.FAN_IN, 5_000))
        assert one == several
    assert common.chunk_groups(common.write_chunks(docs, ["doc_id", "text"], 20_000), 5_000) > 1
