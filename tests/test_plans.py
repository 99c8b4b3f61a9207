"""What grows with the data is not broadcast by a guess of its size."""

import pytest

from graphloom.operators import chunking
from graphloom.plans import queries


@pytest.mark.parametrize("name", ["question_entities", "question_facts", "typed_facts", "question_routes", "ask_answers"])
def test_no_broadcast_by_guess(spark, small_dir, name):
    df = queries.queries()[name](spark, small_dir)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_names_meet_texts_without_a_shuffle(spark):
    c = spark.createDataFrame([("a", "The Big  bolt, the big bolt"), ("b", "big"), ("c", None)], "chunk_id string, text string")
    n = spark.createDataFrame([("Big Bolt",), ("big bolt",), ("big",), ("big",), ("bolt the big",), ("...",)], "name string")
    for block in (1, 100):
        df = chunking.mentioned(c, n, block)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == [("a", "Big Bolt"), ("a", "big"), ("a", "big bolt"), ("a", "bolt the big"), ("b", "big")]
