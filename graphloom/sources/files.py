"""Readers and writers: pages and links (JSON lines), tables with packed lists (CSV), triples (TSV, N-Triples, Turtle)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import RDF

PAGES = "url string, domain string, title string, date string, text string, depth int"
LINKS = "url string, domain string, depth int, out_links array<string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).json(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, pos): one row a link."""
    rows = spark.read.schema(LINKS).json(path)
    return rows.select(F.col("url").alias("src"), F.posexplode("out_links").alias("pos", "dst")).select("src", "dst", "pos")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, lists: tuple[str, ...] = (), separator: str = "|") -> DataFrame:
    """Strings by name; the columns in ``lists`` become arrays."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in lists:
        cells = F.transform(F.split(F.coalesce(F.col(c), F.lit("")), re.escape(separator)), F.trim)
        df = df.withColumn(c, F.filter(cells, lambda x: x != ""))
    return df


def write_csv(df: DataFrame, path: str, separator: str = "|") -> None:
    """Arrays are joined; everything else is written as it is."""
    packed = [F.concat_ws(separator, c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*packed).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("head string, relation string, tail string").option("sep", "\t").option("quote", "").csv(path)


def write_tsv(links: DataFrame, path: str) -> None:
    links.select("head", "relation", "tail").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"\S*)\s*\.\s*$'
_ESCAPES = [(r"\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples with o_lang and o_dtype, parsed in the JVM line by line."""
    rows = spark.read.text(path).where(F.col("value").rlike(_NT))
    part = lambda i: F.regexp_extract("value", _NT, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    body = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    for plain, coded in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ('"', r'\\"'), ("\\\\", r"\\\\")):
        body = F.regexp_replace(body, coded, plain)
    return rows.select(
        bare(part(1)).alias("s"), part(2).alias("p"), F.when(literal, body).otherwise(bare(o)).alias("o"),
        F.when(literal, "lit").when(o.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.nullif(F.regexp_extract(o, r'"@([\w-]+)$', 1), F.lit("")).alias("o_lang"), F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit("")).alias("o_dtype"),
    ).distinct()


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Triples as lines; literals may have columns o_lang and o_dtype."""
    text = F.col("o")
    for plain, coded in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        text = F.regexp_replace(text, plain, coded)
    suffix = F.lit("")
    if "o_dtype" in triples.columns:
        suffix = F.when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise(suffix)
    if "o_lang" in triples.columns:
        suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(suffix)
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    o = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), text, F.lit('"'), suffix)).otherwise(node("o"))
    triples.select(F.concat_ws(" ", node("s"), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Triples as Turtle files: a subject's statements together, predicates and objects by ';' and ','; safe names by prefix."""
    prefixes = prefixes or {}
    for c in ("o_lang", "o_dtype"):
        if c not in triples.columns:
            triples = triples.withColumn(c, F.lit(None).cast("string"))

    def named(c: Column) -> Column:
        out = F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
        for name, iri in prefixes.items():
            local = F.substring(c, F.lit(len(iri) + 1), F.length(c))
            out = F.when(F.startswith(c, F.lit(iri)) & local.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{name}:"), local)).otherwise(out)
        return out

    text = F.col("o")
    for plain, coded in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        text = F.regexp_replace(text, plain, coded)
    suffix = F.when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^"), named(F.col("o_dtype")))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise("")
    o = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), text, F.lit('"'), suffix)).otherwise(named(F.col("o")))
    p = F.when(F.col("p") == f"{RDF}type", "a").otherwise(named(F.col("p")))
    rows = triples.select(named(F.col("s")).alias("s"), p.alias("p"), o.alias("o")).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), " , ").alias("o"))
    rows = rows.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ").alias("body"))
    head = "".join(f"@prefix {name}: <{iri}> .\n" for name, iri in prefixes.items())
    # each line stands alone with its prefixes, so each file of the folder is a document
    rows.select(F.concat(F.lit(head), "s", F.lit(" "), "body", F.lit(" .\n")).alias("value")).write.mode("overwrite").text(path)


_TURTLE = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[a-zA-Z][\w-]*)|(?P<dt>\^\^)|(?P<num>[+-]?\d+(?:\.\d+)?(?=[\s;,.\])]))|(?P<name>[^\s;,\[\]()<>"@^.]*(?:\.[^\s;,\[\]()<>"@^.]+)*:?[^\s;,\[\]()<>"@^.]*(?:\.[^\s;,\[\]()<>"@^.]+)*)(?<!\s)|(?P<mark>[;,.\[\]])')
XSD = "http://www.w3.org/2001/XMLSchema#"


def parse_turtle(text: str, tag: str = "") -> Iterator[tuple]:
    """(s, p, o, o_kind, o_lang, o_dtype) of a Turtle document: prefixes, lists by ';' and ',', blank nodes, literals."""
    prefixes: dict[str, str] = {}
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TURTLE.finditer(text) if m.lastgroup and m[m.lastgroup]]
    at, blank = 0, 0

    def resolve(kind: str, value: str) -> str:
        if kind == "iri":
            return value[1:-1]
        if value == "a":
            return f"{RDF}type"
        if value.startswith("_:"):
            return value + tag
        prefix, _, local = value.partition(":")
        return prefixes.get(prefix, prefix + ":") + local

    def unescape(s: str) -> str:
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)

    def term() -> tuple:
        nonlocal at, blank
        kind, value = tokens[at]
        at += 1
        if kind in ("str", "long"):
            body, lang, dtype = unescape(value[3:-3] if kind == "long" else value[1:-1]), None, None
            if at < len(tokens) and tokens[at][0] == "lang":
                lang, at = tokens[at][1][1:], at + 1
            elif at < len(tokens) and tokens[at][0] == "dt":
                dtype, at = resolve(*tokens[at + 1]), at + 2
            return body, "lit", lang, dtype
        if kind == "num":
            return value, "lit", None, XSD + ("decimal" if "." in value else "integer")
        if value in ("true", "false"):
            return value, "lit", None, f"{XSD}boolean"
        if value == "[":
            blank += 1
            node = f"_:b{blank}{tag}"
            if tokens[at][1] == "]":
                at += 1
            else:
                yielded.extend(statements(node, "]"))
            return node, "bnode", None, None
        found = resolve(kind, value)
        return found, "bnode" if found.startswith("_:") else "iri", None, None

    def statements(subject: str, end: str) -> list[tuple]:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at][1] != end:
            if tokens[at][1] == ";":
                at += 1
                continue
            p = resolve(*tokens[at])
            at += 1
            while True:
                out.append((subject, p, *term()))
                if at < len(tokens) and tokens[at][1] == ",":
                    at += 1
                    continue
                break
        at += 1
        return out

    yielded: list[tuple] = []
    while at < len(tokens):
        kind, value = tokens[at]
        if kind == "lang" and value == "@prefix" or value.lower() == "prefix":
            prefixes[tokens[at + 1][1].rstrip(":").partition(":")[0]] = tokens[at + 2][1][1:-1]
            at += 3
            at += at < len(tokens) and tokens[at][1] == "."
            continue
        yielded.extend(statements(term()[0], "."))
        yield from yielded
        yielded.clear()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files, a file a row: Turtle's prefixes and lists run over lines, so a file is the unit."""
    schema = "s string, p string, o string, o_kind string, o_lang string, o_dtype string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["value"].to_pylist()):
                columns = list(zip(*parse_turtle(text, f"x{i}"), strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [x.split()[0] for x in schema.split(", ")])

    return spark.read.text(path, wholetext=True).mapInArrow(run, schema).distinct()
