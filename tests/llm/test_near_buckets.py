"""A bucket of many near copies loses no link, though no document of it is near most others."""

import random

import pytest

import corpus_pipeline

from tests.llm.test_python_operators import brute_classes

from graphloom.llm import near_dedup


@pytest.fixture(scope="module")
def near_copies():
    """400 texts of 120 words, each with two of its own: some links join classes that no central document is near."""
    r = random.Random(2)
    base = [f"w2x{i}" for i in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        for at in r.sample(range(120), 2):
            text[at] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows, brute_classes(rows)


@pytest.mark.parametrize("block", [near_dedup.BLOCK_DOCS, 40])
def test_every_pair_of_a_bucket_is_compared(spark, near_copies, monkeypatch, block):
    """In one block a bucket, and in many, which meet in several tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rows, want = near_copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=repr) == want


def test_the_pipeline_keeps_one_document_of_each_class(spark, near_copies):
    """Its stage drops every text that a chain of links joins to one of lesser id."""
    rows, want = near_copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_copies(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want if i == c)
