"""Queries that SQL can express, against DuckDB: on the smallest tables and on odd rows."""

import math

import duckdb
import pytest

from graphloom.llm import queries, sql
from graphloom.llm.license_scan import scan_licenses
from graphloom.llm.mixing import mix_sources
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.substring_dedup import dedup_substrings
from graphloom.llm.url_filter import Rule, host_rule, url_filter


def plain(rows):
    def cell(v):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


def same(df, con, query):
    want = con.execute(query)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_small_tables(spark, small_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    same(queries.queries()[name](spark, small_dir), con, sql.oracle_sql()[name])


OPERATORS = {
    "op2_near_dedup": near_duplicates,
    "op3_mix_sources": lambda d: mix_sources(d).select("doc_id", "size", "source_size", "target", "taken"),
    "op4_substring_dedup": lambda d: dedup_substrings(d, texts=False).drop("kept_text", "repeats"),
    "op5_license_scan": scan_licenses,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd_docs, odd_rows, name):
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in odd_rows], "Int64"), "text": [r[1] for r in odd_rows], "source": [r[2] for r in odd_rows]})
    con.register("frame", frame)
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, cast(text as varchar) as text, cast(source as varchar) as source from frame")
    same(OPERATORS[name](odd_docs), con, sql.oracle_sql()[name])


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


def test_mix_meets_targets_and_reruns_agree(odd_docs):
    rows = mix_sources(odd_docs, carry=["doc_id", "key"]).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mix_sources(odd_docs.repartition(5), carry=["doc_id", "key"]).collect()))
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        got = by.setdefault(r["source"], [0, r["target"], 0])
        got[0] += r["taken"]
        got[2] = max(got[2], r["size"])
    assert all(abs(taken - target) <= largest / 2 + 1 for taken, target, largest in by.values())


URLS = [
    (1, "http://Sub.Example.NET/en/x?q#f"), (2, "https://example.net/de/"), (3, "http://notexample.net/en/"), (4, "http://example.com/de/1"), (5, "http://a.org/fr/"),
    (6, "http://a.org/fr"), (7, "example.net/en/"), (8, None), (9, ""), (10, "http://example.net"), (11, "http://x.cheap-pills.example.org/en/"), (12, "http://docs.cheap-pills.com/"),
    (13, "x://a.com/casino/"), (13, "x://a.com/casino/"), (None, "x://ads.com/"), (14, "http://u@example.net:80/en/"), (15, "http://ÄB.NET/x"),
]


def test_odd_urls(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", URLS)
    df = spark.createDataFrame([(i, u, "clash", "clash", "kept") for i, u in URLS], "page_id long, url string, HOST string, Verdict string, best_of_rules string")
    rules = queries.BASE_RULES + queries.OWN_RULES
    inline, joined = (url_filter(df, rules, inline_bytes=n) for n in (100_000, 0))
    assert inline.columns == joined.columns == ["page_id", "url", "best_of_rules", "host", "path", "rule_name", "rule_tier", "verdict"]
    assert plain(inline.collect()) == plain(joined.select(inline.columns).collect())
    from pyspark.sql import functions as F

    is_base = F.col("rule_tier") == 2
    named = joined.select("page_id", "host", "path", F.when(is_base, F.col("rule_name")).alias("rule"), "verdict", F.when(~is_base, F.col("rule_name")).alias("own_rule"))
    same(named, con, sql.OP1)


def test_rule_tokens():
    assert Rule("", "||example.net/en/", "block").tokens() == ["example", "net", "en"]
    assert Rule("", "ads*track.gif|", "block").tokens() == ["gif"]
    assert Rule("", "banner", "block").tokens() == []


def test_many_rules(spark):
    """Thousands of rules, with and without tokens, against trying each on each URL."""
    import re

    rules = [host_rule(f"h{i}.example/", "block") for i in range(3000)] + [Rule(f"p{i}", f"/k{i}/*x{i % 7}", "block", i % 3) for i in range(500)] + [Rule("*zz*", "*zz*", "allow", 5)]
    rows = [(i, f"http://a.h{i * 7}.example/k{i % 40}/q/x{i % 9}{'zz' if i % 11 == 0 else ''}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    compiled = [(r.tier, len(r.name), i, r.name, re.compile(r.regex())) for i, r in enumerate(rules)]
    want = {}
    for i, u in rows:
        subject = "//" + u.split("://")[1]
        fits = [c[:4] for c in compiled if c[4].search(subject)]
        want[i] = max(fits)[3] if fits else None
    for n in (4 << 20, 0):
        assert {r["page_id"]: r["rule_name"] for r in url_filter(df, rules, inline_bytes=n).collect()} == want


def test_no_urls(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(df, queries.BASE_RULES).collect() == []
    assert url_filter(df, []).collect() == []
