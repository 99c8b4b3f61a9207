import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, u double, key string, label string, n_words long, class_id long, kept boolean, verdict string, host string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ro", "ti", "ke", "mu", "sa", "le"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): nulls, blanks, repeats, ties, a long text, copies of both kinds."""
    base = prose(1, 300)
    near = base.split()
    near[40] = "changed"
    passage = prose(2, 60)
    rows = [
        (1, base, "a"),
        (2, base, "b"),
        (3, " ".join(near), "a"),
        (4, None, "a"),
        (5, "", None),
        (6, " \n\t \x0b", "b"),
        (7, prose(3, 40) + "\n" + passage + "\n" + prose(4, 30), "a"),
        (8, passage + " " + prose(5, 50), None),
        (8, passage + " " + prose(5, 50), None),
        (9, prose(6, 20_000), "c"),
        (None, prose(7, 30), "a"),
        (None, None, None),
        (10, "one", "c"),
        (11, "Released under the MIT License. all RIGHTS reserved", "c"),
        (12, "ba " * 200, "d"),
        (13, "a b\x1cc\u00a0d \x85e", "d"),
        *[(20 + i, f"the same line stands in all of these\nuser {i} has logged in from here\n{prose(50 + i, 25)}", "e") for i in range(8)],
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names clash with results' and internals'."""
    rows = [(i, t, "en", s, 0, -1, 0.5, "k", "x", -2, -3, None, "v", "h") for i, t, s in odd_rows]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
