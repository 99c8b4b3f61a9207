"""The test tables as a graph: each row of a dimension is a typed, labelled entity, each foreign key a link."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import LABEL, TYPE, as_set, triple, union

NS = "http://graphloom.example/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(kind: str, key: str):
    return F.concat(F.lit(f"{NS}{kind}/"), F.col(key).cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    parts = []
    for name, key, label in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")):
        parts.append(triple(t(name), iri(name, key), TYPE, F.lit(f"{NS}{name.capitalize()}")))
        parts.append(triple(t(name), iri(name, key), LABEL, F.col(label), "lit"))
    parts.append(triple(t("nation"), iri("nation", "n_nationkey"), f"{NS}inRegion", iri("region", "n_regionkey")))
    parts.append(triple(t("customer"), iri("customer", "c_custkey"), f"{NS}inNation", iri("nation", "c_nationkey")))
    parts.append(triple(t("supplier"), iri("supplier", "s_suppkey"), f"{NS}inNation", iri("nation", "s_nationkey")))
    parts.append(triple(t("orders"), iri("order", "o_orderkey"), f"{NS}placedBy", iri("customer", "o_custkey")))
    return as_set(union(*parts))


_IRI = lambda kind, key: f"'{NS}{kind}/' || {key}"

#: The same graph for DuckDB, as the WITH part ``g``.
GRAPH_SQL = "g AS (" + " UNION ".join(
    [f"SELECT {_IRI(n, k)} AS s, '{TYPE}' AS p, '{NS}{n.capitalize()}' AS o, 'iri' AS o_kind FROM {n} UNION SELECT {_IRI(n, k)}, '{LABEL}', {label}, 'lit' FROM {n}" for n, k, label in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    + [f"SELECT {_IRI(a, k)}, '{NS}{p}', {_IRI(b, f)}, 'iri' FROM {t}" for a, k, p, b, f, t in (("nation", "n_nationkey", "inRegion", "region", "n_regionkey", "nation"), ("customer", "c_custkey", "inNation", "nation", "c_nationkey", "customer"), ("supplier", "s_suppkey", "inNation", "nation", "s_nationkey", "supplier"), ("order", "o_orderkey", "placedBy", "customer", "o_custkey", "orders"))]
) + ")"
