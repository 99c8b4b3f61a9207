"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from graphloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small_dir, name):
    df = queries.queries()[name](spark, small_dir)
    rows = df.collect()
    if name not in queries.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in names) for r in rows), key=repr)
    assert got == sorted((tuple(map(cell, r)) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
