"""Questions that share the same words with the chunks are scored once, with the scores that each would have alone."""

import math

from graphloom.operators import retrieval


def test_equal_lists_of_words_are_scored_once(spark, monkeypatch):
    seen, own = [], retrieval._scorer
    monkeypatch.setattr(retrieval, "_scorer", lambda block, *args: seen.append(len(block)) or own(block, *args))
    q = spark.createDataFrame([(i, f"Who is name{i}?" + " The cat." * (i % 2)) for i in range(60)], "question_id long, question string")
    c = spark.createDataFrame([(i, "is " * (i % 4) + "cat" * (i == 7)) for i in range(20)], "chunk_id long, text string")
    got = {}
    for r in retrieval.lexical_retrieve(q, c, 3).collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    idf = lambda df: math.log(21 / (df + 0.5))
    is_, cat = lambda tf: (1 + math.log(tf)) * idf(15), idf(1)
    plain = [(1, 3, round(is_(3), 6)), (2, 7, round(is_(3), 6)), (3, 11, round(is_(3), 6))]
    with_cat = [(1, 7, round(is_(3) + cat, 6)), (2, 3, round(is_(3), 6)), (3, 11, round(is_(3), 6))]
    assert sum(seen) == 2
    assert {i: sorted(x) for i, x in got.items()} == {i: with_cat if i % 2 else plain for i in range(60)}
