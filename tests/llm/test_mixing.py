"""Documents are included as often as their expected copies say; the plan for many sources gives the same rows."""

import math
from collections import defaultdict

from graphloom.llm.mixing import mix_sources


def docs(spark):
    sizes = [1, 3, 7, 15, 40, 200]
    rows = [(i, "w " * sizes[i % 6], f"s{i // 6 % 4}") for i in range(12_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_inclusion_follows_expected_copies(spark):
    by = defaultdict(list)
    for r in mix_sources(docs(spark), weights=(5, 3, 1, 1), share=0.7).collect():
        assert r["copies"] in (math.floor(r["expected"]), math.ceil(r["expected"]))
        by[r["source"], r["size"]].append((r["copies"], r["expected"]))
    expected = {k: v[0][1] for k, v in by.items()}
    assert len({round(e, 6) for e in expected.values()}) > 12 and any(0 < e < 1 for e in expected.values())
    for k, v in by.items():
        p = expected[k] % 1
        mean = sum(c for c, _ in v) / len(v)
        assert abs(mean - expected[k]) <= 4 * math.sqrt(p * (1 - p) / len(v)) + 0.01
    # longer documents of a source are expected more often
    for s in {k[0] for k in by}:
        es = [expected[s, n] for n in (1, 3, 7, 15, 40, 200)]
        assert es == sorted(es) and (es[0] < es[-1] or es[0] == 2)


def test_many_sources_give_the_same_rows(spark):
    a, b = (sorted(map(repr, mix_sources(docs(spark), broadcast_rows=n).collect())) for n in (100, 0))
    assert a == b


def test_equal_weights(spark):
    rows = mix_sources(docs(spark), share=0.5, equal=True).collect()
    assert len({(r["source"], round(r["expected"], 9)) for r in rows}) == 4
