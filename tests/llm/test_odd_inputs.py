"""Empty tables, texts of several MB, repeated ids and columns that clash in other letters, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import drop_contaminated, find_contamination
from graphloom.llm.html_extract import extract_html
from graphloom.llm.license_scan import scan_licenses
from graphloom.llm.line_dedup import RECURRING, dedup_lines
from graphloom.llm.lm_score import score_documents
from graphloom.llm.mixing import mix_sources
from graphloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from graphloom.llm.quality_rules import quality_rules
from graphloom.llm.substring_dedup import dedup_substrings
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([(1, "words of an item that nobody has")], BENCH)
    assert near_duplicates(no_docs).collect() == []
    assert drop_near_duplicates(no_docs).collect() == []
    assert find_contamination(no_docs, bench).collect() == []
    assert drop_contaminated(no_docs, bench).collect() == []
    assert score_documents(no_docs).collect() == []
    assert extract_html(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_empty_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_in_every_stage(spark, odd_rows, tmp_path):
    """Nulls, blanks, repeats and ties: every stage keeps a subset of what it gets, rows without an id or text included."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (12, 0, None), (None, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(5, 50)), (2, None), (3, "")], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    for (name, stage), last in zip(pipeline.STAGES, (0, 0, 0, 0, 1), strict=True):
        out = pipeline.materialize(stage(spark, docs, str(tmp_path)), "odd")
        assert out.count() <= docs.count() and (last or out.columns == docs.columns)
        # a stage alone on the odd rows, each with only some columns filled
        assert out.where("doc_id = 8").count() <= 2
        docs = out if not last else docs
    assert {r["doc_id"] for r in docs.collect()} >= {1, 9}


LONG = 2_600_000


@pytest.fixture(scope="module")
def long_rows():
    a = prose(1, 450_000)[:LONG]
    lines = "\n".join(f"line of words number {'abcdefgh'[i % 8] * (1 + i % 5)} {i}" for i in range(60_000))
    return [(1, a), (2, "short one before it"), (3, lines), (4, "short one before it and after"), (5, a[: LONG // 2])]


def test_texts_of_megabytes(spark, long_rows):
    df = spark.createDataFrame(long_rows, "doc_id long, text string").coalesce(1)
    assert max(len(t) for _, t in long_rows) > 2 << 20
    rows = {r["doc_id"]: r for r in dedup_substrings(df).collect()}
    assert rows[1]["n_removed"] == 0 or rows[1]["n_words"] > rows[1]["n_removed"]
    assert rows[5]["n_removed"] >= rows[5]["n_words"] - 1  # all but what the cut has left of its last word
    assert rows[2]["kept_sha256"] == hashlib.sha256(b"short one before it").hexdigest()
    scores = {r["doc_id"]: r for r in score_documents(df).collect()}
    assert all(scores[i]["n_tokens"] == len(t.split()) + 1 and 0 < scores[i]["bits_per_byte"] < 8 for i, t in long_rows)
    out = {r["doc_id"]: r for r in dedup_lines(df, **RECURRING).collect()}
    assert out[3]["n_lines"] == 60_000 and out[1]["text"] == long_rows[0][1]
    same = spark.createDataFrame([*long_rows, (6, long_rows[0][1])], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in near_duplicates(same).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1)}
    item = long_rows[0][1][2_000_000:2_000_200]
    bench = spark.createDataFrame([(7, item)], BENCH)
    assert {r["doc_id"] for r in find_contamination(df, bench).collect()} == {1}
    assert {r["doc_id"]: r["n_words"] for r in quality_rules(df, spark.createDataFrame([], LABELS)).collect()} == {i: len(t.split()) for i, t in long_rows}
    assert {r["doc_id"]: r["size"] for r in mix_sources(df.withColumn("source", F.lit("a"))).collect()} == {i: len(t.split()) for i, t in long_rows}
    assert scan_licenses(df).where("n_words > 400000").count() == 1


def test_clashes_in_other_letters(spark):
    rows = [(1, prose(1, 60), "s", 0), (2, prose(2, 60), "s", 0)]
    df = lambda *names: spark.createDataFrame(rows, f"doc_id long, text string, source string, {names[0]} long")
    labels = spark.createDataFrame([], LABELS)
    assert [r["kept"] for r in quality_rules(df("KEPT"), labels).select("kept").collect()] == [True, True]
    assert [r["n_lines"] for r in dedup_lines(df("N_Lines")).select("n_lines").collect()] == [1, 1]
    assert drop_near_duplicates(df("Class_ID")).columns == ["doc_id", "text", "source", "Class_ID"]
    assert drop_near_duplicates(df("Row")).count() == 2
    assert drop_contaminated(df("ITEM_ID"), spark.createDataFrame([], BENCH)).columns == ["doc_id", "text", "source", "ITEM_ID"]
    assert mix_sources(df("SIZE"), carry=["SIZE", "doc_id"]).select("size", "row.SIZE").count() == 2


def test_rows_of_one_id(spark):
    """Of several rows with an id that stays, the one with the least text stays, whatever the order."""
    rows = [(1, prose(1, 50), "a"), (1, prose(2, 50), "b"), (2, prose(3, 50), "c"), (2, prose(3, 50), "d"), (3, None, "e"), (None, prose(1, 50), "f")]
    want = None
    for order in (rows, rows[::-1]):
        got = sorted(map(tuple, drop_near_duplicates(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)).collect()), key=repr)
        assert want is None or got == want
        want = got
    assert [r[0] for r in want] == [1, 2, 3, None] and want[0][1] == min(prose(1, 50), prose(2, 50))
