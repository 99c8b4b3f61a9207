"""A graph as a DataFrame of triples (s, p, o, o_kind), a set; o_kind is iri, bnode or lit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_name

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TYPE, LABEL, SAME_AS, STATEMENT = f"{RDF}type", f"{RDFS}label", f"{OWL}sameAs", f"{RDF}Statement"
COLUMNS = ["s", "p", "o", "o_kind"]


def spread(df: DataFrame) -> DataFrame:
    """``df``, joined with by sorting both sides, never broadcast.

    Before a query runs, Spark guesses a table's size from its files: exploded rows count as one, built strings as 20 bytes. A side that
    grows with the data would so go through the driver whole.
    """
    return df.hint("merge")


def triple(df: DataFrame, s: Column, p: str | Column, o: Column, kind: str = "iri") -> DataFrame:
    """Triples from rows; rows with a null part give none."""
    p = F.lit(p) if isinstance(p, str) else p
    return df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")).where("s is not null and p is not null and o is not null")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(COLUMNS))
    return out


def as_set(triples: DataFrame) -> DataFrame:
    return triples.dropDuplicates(COLUMNS)


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """A triple pattern; None matches anything. The filters reach the scan."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(column) == value)
    return triples


def entity_links(triples: DataFrame, prefix: str = "http") -> DataFrame:
    """Distinct (head, relation, tail) whose tail is an entity."""
    return triples.where(F.col("o").startswith(prefix)).select(F.col("s").alias("head"), F.col("p").alias("relation"), F.col("o").alias("tail")).distinct()


def best_labels(triples: DataFrame) -> DataFrame:
    """One label (the least) for each subject that has one: (uri, label)."""
    return triples.where((F.col("p") == LABEL) & (F.col("o_kind") == "lit")).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label"))


def classes(triples: DataFrame) -> DataFrame:
    """One class (the least local name, statements apart) for each typed subject: (uri, class)."""
    typed = triples.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & (F.col("o") != STATEMENT))
    return typed.groupBy(F.col("s").alias("uri")).agg(F.min(local_name(F.col("o"))).alias("class"))


def degrees(triples: DataFrame) -> DataFrame:
    """(uri, n_out, n_in, n_neighbours) over entity links."""
    links = triples.where("o_kind = 'iri'").where(F.col("p") != TYPE)
    ends = links.select(F.col("s").alias("uri"), F.lit(1).alias("out"), F.col("o").alias("other")).unionByName(links.select(F.col("o").alias("uri"), F.lit(0).alias("out"), F.col("s").alias("other")))
    return ends.groupBy("uri").agg(F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"), F.countDistinct("other").alias("n_neighbours"))


def one_hop(triples: DataFrame, seeds: DataFrame, blocked: list[str] = (LABEL, TYPE, SAME_AS)) -> DataFrame:
    """Facts of the seeds (uri): subject, predicate, object, direction; labels and classes resolved."""
    facts = triples.where(~F.col("p").isin(list(blocked)))
    out = facts.join(seeds.select(F.col("uri").alias("s")), "s").select("s", "p", "o", "o_kind", F.lit("out").alias("direction"))
    into = facts.where("o_kind = 'iri'").join(seeds.select(F.col("uri").alias("o")), "o").select("s", "p", "o", "o_kind", F.lit("in").alias("direction"))
    found = out.unionByName(into)
    labels, kinds = spread(best_labels(triples)), spread(classes(triples))
    for side in ("s", "o"):
        found = found.join(labels.select(F.col("uri").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
        found = found.join(kinds.select(F.col("uri").alias(side), F.col("class").alias(f"{side}_class")), side, "left")
    literal = F.col("o_kind") == "lit"
    found = found.select(
        F.col("s").alias("subject_uri"), F.coalesce("s_label", local_name(F.col("s"))).alias("subject_label"), F.coalesce("s_class", F.lit("Unknown")).alias("subject_class"),
        F.col("p").alias("predicate_uri"), local_name(F.col("p")).alias("predicate_label"),
        F.when(~literal, F.col("o")).alias("object_uri"), F.when(literal, F.col("o")).otherwise(F.coalesce("o_label", local_name(F.col("o")))).alias("object_label"),
        F.when(literal, "Literal").otherwise(F.coalesce("o_class", F.lit("Unknown"))).alias("object_class"), "direction",
    )
    return found.withColumn("fact_text", F.concat("subject_label", F.lit(" --"), "predicate_label", F.lit("--> "), "object_label"))


def reify(edges: DataFrame, properties: list[str], namespace: str) -> DataFrame:
    """Edges (s, p, o, properties ...) as statements: one blank node an edge, named by its hash."""
    node = F.concat(F.lit("_:"), F.sha1(F.concat_ws("\u0001", "s", "p", "o", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in properties])))
    rows = edges.withColumn("node", node)
    parts = [triple(rows, F.col("node"), TYPE, F.lit(STATEMENT))]
    parts += [triple(rows, F.col("node"), f"{RDF}{name}", F.col(c)) for name, c in (("subject", "s"), ("predicate", "p"), ("object", "o"))]
    parts += [triple(rows, F.col("node"), f"{namespace}{c}", F.col(c).cast("string"), "lit") for c in properties]
    return as_set(union(*parts))


def unreify(triples: DataFrame, properties: list[str], namespace: str) -> DataFrame:
    """The edges back from their statements."""
    names = {f"{RDF}subject": "s", f"{RDF}predicate": "p", f"{RDF}object": "o"} | {f"{namespace}{c}": c for c in properties}
    nodes = triples.where(F.col("p").isin(list(names))).groupBy(F.col("s").alias("node")).pivot("p", list(names)).agg(F.min("o"))
    return nodes.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()]).where("s is not null and p is not null and o is not null")


def split(links: DataFrame, test_share: float = 0.2, seed: str = "split") -> DataFrame:
    """(head, relation, tail, part): train, valid and test, by hash; what has an entity unknown to train goes.

    A hash decides instead of a shuffled order, so the split needs no sort and reruns agree.
    """
    digest = F.md5(F.concat_ws("\t", F.lit(seed), "head", "relation", "tail"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000
    cut = int(test_share * 10_000)
    parts = links.withColumn("part", F.when(u >= cut, "train").when(u < cut // 2, "valid").otherwise("test"))
    known = parts.where("part = 'train'").select(F.explode(F.array("head", "tail")).alias("uri")).distinct()
    held = parts.where("part <> 'train'")
    held = held.join(known.withColumnRenamed("uri", "head"), "head", "left_semi").join(known.withColumnRenamed("uri", "tail"), "tail", "left_semi")
    return parts.where("part = 'train'").unionByName(held)
