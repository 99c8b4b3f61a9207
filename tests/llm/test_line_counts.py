"""Lines recur from two documents on, short ones from five, in the query and the pipeline."""

from graphloom.llm import queries

LONG = "a line of seven words in two"


def test_lines_of_two_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"{LONG if i < 2 else 'first of ' + 'abcdefg'[i]}\nRead more\nPage {i}\n{'once only' if i > 2 else 'nothing here'}\n") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        lines = t.split("\n")
        # LONG stands in 0 and 1, "Read more" in all seven; the others in four at most or with other digits
        want.append((i, "\n".join(x for x in lines if not (x == LONG and i == 1) and not (x == "Read more" and i > 0))))
    got = queries.op10_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == want
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_lines(spark, df, str(tmp_path)).collect()) == want
