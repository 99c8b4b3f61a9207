"""Rows of one id are one document: each of its texts, not only two of them, brings its copies into the document's class."""

import corpus_pipeline

from graphloom.llm.near_dedup import near_duplicates

from tests.llm.test_python_operators import brute_classes


def _rows():
    """Document 9 has the texts of 1, 5, 6 and one of its own, which 12 has too; 7 is near 5, 20 is alone."""
    a, b, c, d, e = (" ".join(f"{p}{i}" for i in range(60)) for p in "abcde")
    near = b.replace("b30", "changed")
    return [(1, a), (5, b), (6, c), (7, near), *[(9, t) for t in (a, b, c, d)], (12, d), (20, e)]


def test_all_texts_of_an_id_link_their_documents(spark):
    rows = _rows()
    want = brute_classes(rows)
    assert {c for i, c in want if i != 20} == {1}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=repr) == want


def test_the_pipeline_drops_copies_of_all_texts_of_an_id(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, df, "").collect()) == [1, 20]
