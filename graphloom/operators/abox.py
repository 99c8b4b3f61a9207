"""Entities and relations as graph statements with provenance, and predicates aligned to another vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triples import LABEL, OWL, RDF, RDFS, STATEMENT, TYPE

XSD = "http://www.w3.org/2001/XMLSchema#"
TYPED = ["s", "p", "o", "o_kind", "o_lang", "o_dtype"]


def typed(df: DataFrame, s: Column, p: str | Column, o: Column, kind: str = "iri", lang: str | Column | None = None, dtype: str | Column | None = None) -> DataFrame:
    """Triples with language and datatype; rows with a null or empty part give none."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    rows = df.select(s.alias("s"), lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), lit(lang).alias("o_lang"), lit(dtype).alias("o_dtype"))
    return rows.where("s <> '' and p <> '' and o <> ''")


def typed_each(df: DataFrame, *specs: tuple) -> DataFrame:
    """The triples of several ``typed`` at once: each spec has its arguments behind ``df``. A row of ``df`` is made once for all."""
    lit = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")

    def row(s: Column, p: str | Column, o: Column, kind: str = "iri", lang: str | Column | None = None, dtype: str | Column | None = None) -> Column:
        return F.struct(*[lit(x).alias(c) for c, x in zip(TYPED, (s, p, o, kind, lang, dtype), strict=True)])

    return df.select(F.explode(F.array(*[row(*spec) for spec in specs])).alias("t")).select("t.*").where("s <> '' and p <> '' and o <> ''")


def typed_union(*parts: DataFrame) -> DataFrame:
    """A set of typed triples."""
    out = parts[0].select(TYPED)
    for part in parts[1:]:
        out = out.unionByName(part.select(TYPED))
    return out.dropDuplicates(TYPED)


def local_slug(c: Column) -> Column:
    """A local name from a label: lower case, apostrophes dropped, other runs to '_', never empty, no digit first."""
    low = F.regexp_replace(F.lower(F.trim(c)), "['’]", "")
    out = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(out == "", "entity").otherwise(out)
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("e_"), out)).otherwise(out)


def iri_of(id_: Column, base: str) -> Column:
    """``base`` and the id if it is a safe local name, else its slug."""
    return F.concat(F.lit(base), F.when(id_.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), id_).otherwise(local_slug(id_)))


#: Provenance columns of a relation: the property's local name, its datatype.
PROVENANCE = {
    "confidence": ("confidence", f"{XSD}decimal"),
    "evidence": ("evidence", None),
    "evidence_start_char": ("evidenceStartChar", f"{XSD}integer"),
    "evidence_end_char": ("evidenceEndChar", f"{XSD}integer"),
    "source_url": ("sourceUrl", f"{XSD}anyURI"),
}


def _mapped(c: Column, table: dict[str, str], otherwise: Column) -> Column:
    if not table:
        return otherwise
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c], otherwise)


def entity_triples(entities: DataFrame, base: str, classes: dict[str, str], lang: str = "en") -> DataFrame:
    """Type, label and source of each entity (entity_id, canonical_text, entity_class, url). Unknown classes are Things."""
    s = iri_of(F.col("entity_id"), base)
    kind = _mapped(F.upper(F.trim(F.coalesce("entity_class", F.lit("")))), classes, F.lit("Thing"))
    label = F.coalesce(F.nullif(F.col("canonical_text"), F.lit("")), F.col("entity_id"))
    parts = [(s, TYPE, F.concat(F.lit(base), kind)), (s, LABEL, label, "lit", lang)]
    if "url" in entities.columns:
        parts.append((s, f"{base}sourceUrl", F.col("url"), "lit", None, f"{XSD}anyURI"))
    return typed_union(typed_each(entities, *parts))


def relation_triples(relations: DataFrame, base: str, properties: dict[str, str], strict: bool = True) -> DataFrame:
    """Each relation (subject_id, relation, object_id) as a triple, and what is known of it as a reified statement.

    properties: a relation's name (upper case) to its property. Others are left out, or if not ``strict`` named by their
    slug. The columns of PROVENANCE that are there, and not null, hang on the statement: a blank node named
    by the hash of the relation and these values, so equal rows are one statement.
    """
    name = F.upper(F.trim("relation"))
    local = _mapped(name, properties, F.lit(None).cast("string") if strict else local_slug(F.lower(name)))
    rows = relations.where("subject_id <> '' and object_id <> ''").withColumns({"s": iri_of(F.col("subject_id"), base), "o": iri_of(F.col("object_id"), base), "local": local}).where("local is not null")
    rows = rows.withColumn("p", F.concat(F.lit(base), "local"))
    known = {c: v for c, v in PROVENANCE.items() if c in relations.columns}
    parts = [(F.col("s"), F.col("p"), F.col("o"))]
    if known:
        values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in known]
        node = F.col("node")  # null where nothing is known, and then no triple
        rows = rows.withColumn("node", F.when(F.concat(*values) != "", F.concat(F.lit("_:"), F.sha1(F.concat_ws("\u0001", "s", "p", "o", *values)))))
        parts.append((node, TYPE, F.lit(STATEMENT)))
        parts += [(node, f"{RDF}{part}", F.col(c)) for part, c in (("subject", "s"), ("predicate", "p"), ("object", "o"))]
        parts += [(node, f"{base}{local}", F.col(c), "lit", None, dtype) for c, (local, dtype) in known.items()]
    return typed_union(typed_each(rows, *parts))


# ---------------------------------------------------------------- alignment
EQUIVALENT, SUB_PROPERTY, COMMENT = f"{OWL}equivalentProperty", f"{RDFS}subPropertyOf", f"{RDFS}comment"


def alignment(table: DataFrame, base: str, target: str) -> DataFrame:
    """Alignment triples of rows (local, kind, property, note): kind is equivalent or subproperty; other kinds are an error."""
    s, o = F.concat(F.lit(base), "local"), F.concat(F.lit(target), "property")
    p = F.when(F.col("kind") == "equivalent", EQUIVALENT).when(F.col("kind") == "subproperty", SUB_PROPERTY).otherwise(F.raise_error(F.concat(F.lit("unknown kind of alignment: "), F.coalesce("kind", F.lit("null")))).cast("string"))
    return typed_union(typed(table, s, p, o), typed(table, s, COMMENT, F.col("note"), "lit"))


def align(triples: DataFrame, aligned: DataFrame) -> DataFrame:
    """``triples`` and, for aligned predicates, the same statements by the other vocabulary. Alignments are a schema's, so few."""
    pairs = F.broadcast(aligned.where(F.col("p").isin(EQUIVALENT, SUB_PROPERTY)).select(F.col("s").alias("p"), F.col("o").alias("other")))
    more = triples.join(pairs, "p").withColumn("p", F.col("other")).select(triples.columns)
    return triples.unionByName(more).distinct()


def suggest_properties(catalog: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    """(property, label) of a catalog's properties whose label holds the keyword (case ignored), by label, at most ``limit``."""
    word = keyword.strip().lower()
    found = catalog.where(F.contains(F.lower("label"), F.lit(word)) & F.lit(bool(word)))
    return found.select("property", "label").distinct().orderBy("label", "property").limit(limit)
