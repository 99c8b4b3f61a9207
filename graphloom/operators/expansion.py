"""Bounded breadth-first expansion over a table of claims, and claims from entity documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.written import materialize
from .abox import XSD, typed, typed_union
from .triples import LABEL


def cap_claims(claims: DataFrame, per_property: int = 20, literal_length: int = 200) -> DataFrame:
    """At most ``per_property`` claims of each subject and property (an argument of this operator), no long literals."""
    kept = claims.where((F.col("o_kind") != "lit") | (F.length("o") <= literal_length))
    turn = Window.partitionBy("s", "p").orderBy("o_kind", "o")
    return kept.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_property).drop("turn")


def expand(claims: DataFrame, seeds: DataFrame, hops: int = 3, through: Sequence[str] | None = None, max_entities: int | None = None) -> DataFrame:
    """(uri, depth): what is reached from the seeds (uri) over iri claims, each at its least depth.

    A level is one join of the frontier with the claims and an anti-join with what is known; each
    level is a written table. ``max_entities`` stops the growth, nearest first, then by name.
    """
    edges = claims.where("o_kind = 'iri'")
    if through is not None:
        edges = edges.where(F.col("p").isin(list(through)))
    edges = edges.select(F.col("s").alias("uri"), F.col("o").alias("next"))
    known = frontier = materialize(seeds.select("uri").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, hops + 1):
        step = frontier.join(edges, "uri").select(F.col("next").alias("uri")).distinct().join(known, "uri", "left_anti")
        frontier = materialize(step.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known if max_entities is None else known.orderBy("depth", "uri").limit(max_entities)


def expanded_triples(claims: DataFrame, reached: DataFrame) -> DataFrame:
    """The claims of everything reached."""
    return claims.join(reached.select(F.col("uri").alias("s")), "s", "left_semi").distinct()


# ---------------------------------------------------------------- entity documents
_VALUE = "struct<value:string>"
#: An entity document: texts by language, claims by property; a claim's value stays JSON until its type is known.
ENTITY = (
    f"labels map<string,{_VALUE}>, descriptions map<string,{_VALUE}>, aliases map<string,array<{_VALUE}>>, "
    "claims map<string,array<struct<mainsnak:struct<snaktype:string,datavalue:struct<type:string,value:string>>>>>"
)
DESCRIPTION, ALT_LABEL = "http://schema.org/description", "http://www.w3.org/2004/02/skos/core#altLabel"


def read_entities(rows: DataFrame, id: str = "qid", json: str = "json") -> DataFrame:
    """(qid, labels, descriptions, aliases, claims) of entity documents; what isn't JSON has no parts."""
    return rows.select(F.col(f"`{id}`").alias("qid"), F.from_json(F.col(f"`{json}`"), ENTITY).alias("e")).select("qid", "e.*")


def best_value(texts: str, languages: Sequence[str] = ("en", "fr")) -> Column:
    """(value, lang): the text of the first of the languages that has one, else of the least other language that has."""
    entries = F.transform(F.map_entries(texts), lambda e: F.struct(F.trim(e["value"]["value"]).alias("value"), e["key"].alias("lang")))
    there = F.filter(entries, lambda e: e["value"] != "")
    turn = lambda e: F.coalesce(*[F.when(e["lang"] == x, i) for i, x in enumerate(languages)], F.lit(len(languages)))
    ordered = F.array_sort(F.transform(there, lambda e: F.struct(turn(e).alias("turn"), e["lang"].alias("lang"), e["value"].alias("value"))))
    return F.get(ordered, F.lit(0))


def entity_metadata(entities: DataFrame, base: str, languages: Sequence[str] = ("en", "fr"), most_aliases: int = 5) -> DataFrame:
    """Typed triples: one label and one description of each entity by language, aliases (``most_aliases`` a language)."""
    s = F.concat(F.lit(base), "qid")
    parts = []
    for column, p in (("labels", LABEL), ("descriptions", DESCRIPTION)):
        best = entities.withColumn("best", best_value(column, languages)).where("best is not null")
        parts.append(typed(best, s, p, F.col("best.value"), "lit", F.col("best.lang")))

    def of(lang: str) -> Column:
        own = F.slice(F.coalesce(F.col("aliases")[lang], F.array().cast(f"array<{_VALUE}>")), 1, most_aliases)
        return F.transform(own, lambda a: F.struct(F.lit(lang).alias("lang"), a["value"].alias("value")))

    listed = F.flatten(F.array(*[of(x) for x in languages]))
    other = entities.select("qid", F.explode(listed).alias("alias"))
    parts.append(typed(other, s, ALT_LABEL, F.col("alias.value"), "lit", F.col("alias.lang")))
    return typed_union(*parts)


def claim_triples(entities: DataFrame, base: str, properties: str, allowed: Sequence[str], literals: bool = True, literal_length: int = 200, per_property: int = 20) -> DataFrame:
    """Typed triples of the entities' claims, by allowed property the first ``per_property`` that have a usable value.

    Values: items are entities of ``base``; strings; times as xsd:date if day and month are known, else as the plain date, and as
    they stand if they are none (the sign of a year is dropped); quantities as their amount, without a unit; texts with
    their language. ``per_property`` and ``literal_length`` are what the caller asks for.
    """
    rows = entities.select("qid", F.explode("claims").alias("pid", "claims")).where(F.col("pid").isin(list(allowed)))
    rows = rows.select("qid", "pid", F.posexplode("claims").alias("pos", "claim")).where("claim.mainsnak.snaktype = 'value' and claim.mainsnak.datavalue is not null")
    kind, value = F.col("claim.mainsnak.datavalue.type"), F.col("claim.mainsnak.datavalue.value")
    get = lambda path: F.get_json_object(value, path)
    item = F.when((get("$.entity-type") == "item") & get("$.numeric-id").isNotNull(), F.concat(F.lit(base + "Q"), get("$.numeric-id")))
    time, pattern = get("$.time"), r"^[+-](\d{1,16})-(\d{2})-(\d{2})T\d{2}:\d{2}:\d{2}Z$"
    y, m, d = (F.regexp_extract(time, pattern, i) for i in (1, 2, 3))
    known = time.rlike(pattern)
    whole = known & (m != "00") & (d != "00")
    plain_year = F.regexp_replace(y, "^0+(?=.)", "")
    date = F.when(whole, F.concat_ws("-", F.when(F.length(plain_year) < 4, F.lpad(plain_year, 4, "0")).otherwise(plain_year), m, d)).when(known, F.concat_ws("-", y, m, d)).otherwise(time)
    literal = F.when(kind == "string", value).when(kind == "time", date).when(kind == "quantity", get("$.amount")).when(kind == "monolingualtext", get("$.text"))
    rows = rows.withColumns({"item": item, "literal": F.when(item.isNull() & F.lit(literals), literal), "lang": F.when(kind == "monolingualtext", F.coalesce(get("$.language"), F.lit("en"))), "dtype": F.when((kind == "time") & whole, f"{XSD}date")})
    rows = rows.where((F.col("item").isNotNull()) | (F.length("literal") <= literal_length))
    turn = Window.partitionBy("qid", "pid").orderBy("pos")
    rows = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_property)
    s, p = F.concat(F.lit(base), "qid"), F.concat(F.lit(properties), "pid")
    return typed_union(typed(rows.where("item is not null"), s, p, F.col("item")), typed(rows.where("item is null"), s, p, F.col("literal"), "lit", F.col("lang"), F.col("dtype")))
