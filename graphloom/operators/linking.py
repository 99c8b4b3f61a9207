"""Linking entities to candidates of another graph: variants, scores, the best link, a rule cascade."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_key, canonical_label, contains_any, local_name, normalize_spaces, similarity
from .abox import XSD, typed, typed_union
from .triples import RDF, SAME_AS, STATEMENT, TYPE


def search_variants(label: Column, kind: Column, people: Sequence[str] = ("Character", "RealPerson"), episodes: Sequence[str] = ("Episode",), works: Sequence[str] = ("Work", "Book"), series: str | None = None) -> Column:
    """Distinct forms (ignoring case) under which a label is looked up, the label itself first.

    series: the name of the work that episodes belong to; it is added to theirs, and looked up for works that bear it.
    """
    name = canonical_label(label)
    words = F.split(name, " ")
    forms = F.array(
        name,
        F.trim(F.regexp_replace(name, "(?i)^(the|a|an)\\s+", "")),
        normalize_spaces(F.translate(name, ",", " ")),
        F.when(kind.isin(list(people)) & (F.size(words) >= 3), F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, -1))),
        F.when(kind.isin(list(episodes)) & F.lit(series is not None), F.concat(name, F.lit(f" {series}"))),
        F.when(kind.isin(list(episodes)), F.concat(name, F.lit(" episode"))),
        F.when(kind.isin(list(works)) & F.lit(series is not None) & F.contains(ascii_key(name), ascii_key(F.lit(series or ""))), F.lit(series)),
    )
    forms = F.filter(forms, lambda v: v.isNotNull() & (v != ""))
    return F.filter(forms, lambda v, i: F.array_position(F.transform(forms, F.lower), F.lower(v)) == i + 1)


@dataclass(frozen=True)
class Hints:
    good: tuple[str, ...] = ()
    bad: tuple[str, ...] = ()
    domain: tuple[str, ...] = ()


@dataclass(frozen=True)
class Boost:
    """What a candidate of an entity's type gains (or loses) if its description holds one of the patterns, or none if ``absent``.

    labels: only for entities with one of these labels (as ascii_key gives them).
    """

    kinds: tuple[str, ...]
    patterns: tuple[str, ...]
    amount: float
    absent: bool = False
    labels: tuple[str, ...] = ()


#: Labels that are read as countries or states.
COUNTRIES = ("austria", "france", "hungary", "italy", "norway", "russia", "sweden", "yugoslavia", "united states", "the united states", "mexico", "canada", "united kingdom")
#: Types whose labels of one word are risky.
RISKY = ("Character", "Location", "Organization", "Event")


def boosts(series: str) -> tuple[Boost, ...]:
    """What types gain and lose by the words of a description. Fixed values; series: the work that the graph is about, in lower case."""
    return (
        Boost(("Episode",), ("episode",), 0.08),
        Boost(("Episode",), (series,), 0.20),
        Boost(("Episode",), (series,), -0.22, absent=True),
        Boost(("Character",), ("fictional",), 0.10),
        Boost(("Character",), (series,), 0.15),
        Boost(("Character",), ("actor", "actress"), -0.15),
        Boost(("RealPerson",), ("fictional",), -0.20),
        Boost(("RealPerson",), ("actor", "actress", "director", "writer", "screenwriter", "producer", "chess player"), 0.07),
        Boost(("Work", "Book"), ("novel", "series", "miniseries", "television series"), 0.08),
        Boost(("Work", "Book"), (series,), 0.16),
        Boost(("Location",), ("country", "state of the united states", "capital"), 0.10, labels=COUNTRIES),
        Boost(("Location",), ("town in", "village in", "municipality"), -0.14, labels=COUNTRIES),
        Boost(("Organization",), ("building", "film", "aircraft"), -0.18),
    )


def candidates(entities: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entities (uri, label, type) with the catalog's rows (qid, label, description) that a variant names.

    The look-up is an equi-join on the normalized variant, so it needs no service.
    """
    wanted = entities.withColumn("query", F.explode(search_variants(F.col("label"), local_name(F.col("type"))))).withColumn("key", ascii_key(F.col("query")))
    found = catalog.select(F.col("qid"), F.col("label").alias("found_label"), "description", ascii_key(F.col("label")).alias("key"))
    return wanted.join(found, "key").drop("key")


def score(rows: DataFrame, hints: dict[str, Hints], adjust: Sequence[Boost] = (), domain: Sequence[str] = (), risky: Sequence[str] | None = None, ambiguous: Sequence[str] = ()) -> DataFrame:
    """``rows`` of ``candidates`` with confidence: lexical steps, then the description's words by type.

    adjust: gains by type (see ``boosts``); domain: words that any description gains by. risky: types whose labels of one
    word lose (None: all types); ambiguous: of these labels those that lose more. Each ratio is computed once a
    distinct pair of names, and not at all for equal ones.
    """
    # what is needed after the ratios is computed before them, once
    rows = rows.withColumns({"own": canonical_label(F.col("label")), "found": canonical_label(F.col("found_label")), "own_key": ascii_key(F.col("label")), "found_key": ascii_key(F.col("found_label")), "query_key": ascii_key(F.col("query")), "kind": local_name(F.col("type"))})
    rows = rows.withColumns({f"{x}_tokens": F.array_distinct(F.regexp_extract_all(f"{x}_key", F.lit("[a-z0-9]+"), F.lit(0))) for x in ("own", "found")})
    ratio = lambda x: F.when(F.col(x) == F.col("found_key"), 1.0).otherwise(similarity(F.col(x), F.col("found_key")))
    rows = rows.withColumns({"sim": ratio("own_key"), "query_sim": F.when(F.col("query_key") == F.col("own_key"), ratio("own_key")).otherwise(ratio("query_key"))})
    a, b = F.col("own"), F.col("found")
    overlap = F.size(F.array_intersect("own_tokens", "found_tokens")) / F.greatest(F.size("own_tokens"), F.size("found_tokens"), F.lit(1))
    base = F.when(F.col("sim") >= 0.985, 0.82).when(F.col("sim") >= 0.94, 0.76).when(F.col("sim") >= 0.88, 0.68).when(F.col("sim") >= 0.75, 0.58)
    base = base.when(overlap >= 0.8, 0.54).when(overlap >= 0.5, 0.45).otherwise(0.28)
    add = lambda condition, value: F.when(condition, F.lit(float(value))).otherwise(0.0)
    total = base + add(F.lower(a) == F.lower(b), 0.08) + F.greatest(F.lit(0.0), F.col("query_sim") - 0.80) * 0.12
    text = F.col("description")
    for kind, h in hints.items():
        own = F.lit(0.0)
        for pattern in h.good:
            own = own + add(contains_any(text, [pattern]), 0.06)
        for pattern in h.bad:
            own = own - add(contains_any(text, [pattern]), 0.10)
        if h.domain:
            own = own + add(contains_any(text, list(h.domain)), 0.14)
        total = total + F.when(F.col("kind") == kind, own).otherwise(0.0)
    if domain:
        total = total + add(contains_any(text, list(domain)), 0.14)
    for x in adjust:
        holds = contains_any(text, list(x.patterns))
        fits = F.col("kind").isin(list(x.kinds)) & (~holds if x.absent else holds)
        total = total + add(fits & F.col("own_key").isin(list(x.labels)) if x.labels else fits, x.amount)
    single = F.size(F.split(a, " ")) == 1
    if risky is not None:
        single = single & F.col("kind").isin(list(risky))
    total = total - add(single, 0.07)
    if ambiguous:
        total = total - add(single & F.lower("label").isin([x.lower() for x in ambiguous]), 0.08)
    return rows.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), total)), 9)).drop("sim", "query_sim", "own", "found", "own_key", "found_key", "query_key", "own_tokens", "found_tokens")


def best_links(scored: DataFrame, least: float = 0.70) -> DataFrame:
    """The most confident candidate of each entity, at least ``least``; the smaller id of equals."""
    turn = Window.partitionBy("uri").orderBy(F.desc("confidence"), "qid", "query")
    return scored.where(F.col("confidence") >= least).withColumn("turn", F.row_number().over(turn)).where("turn = 1").drop("turn")


@dataclass(frozen=True)
class TypeRule:
    min_conf: float
    good: tuple[str, ...]
    bad: tuple[str, ...]


@dataclass(frozen=True)
class Safeguard:
    """Links of a type fail under ``least`` if the description holds none of the patterns (or one of them, if ``present``)."""

    kind: str
    patterns: tuple[str, ...]
    least: float
    present: bool = False


#: Descriptions that no link may have.
NEVER = ("given name", "male given name", "female given name", "family name", "disambiguation page", "wikimedia disambiguation page")


def safeguards(series: str) -> tuple[Safeguard, ...]:
    """Fixed values; series: the work that the graph is about, in lower case."""
    return (Safeguard("Episode", ("episode",), 0.98), Safeguard("Character", ("fictional", series), 0.95), Safeguard("Location", ("village", "municipality"), 0.95, present=True))


def accepted(
    rules: dict[str, TypeRule],
    reject_ids: Sequence[str] = (),
    accept_labels: Sequence[str] = (),
    reject_text: Sequence[str] = (),
    reject_pairs: Sequence[tuple[str, str]] = (),
    reject_labels: Sequence[str] = (),
    reject_found: Sequence[str] = (),
    never: Sequence[str] = (),
    guards: Sequence[Safeguard] = (),
) -> Column:
    """Whether a link row passes: hard rejects, hard accepts, general rejects, then its type's rule; without one it fails.

    Rows: label, kind, qid, description, confidence, and found_label if ``reject_found`` is given. The lists are written by hand.
    """
    text, conf = F.col("description"), F.coalesce(F.col("confidence"), F.lit(0.0))
    label, qid = F.trim(F.coalesce("label", F.lit(""))), F.coalesce("qid", F.lit(""))
    among = lambda c, xs: c.isin(list(xs)) if xs else F.lit(False)
    out = F.lit(False)
    for kind, r in rules.items():
        strong = conf >= max(0.96, r.min_conf + 0.18)
        passes = (conf >= r.min_conf) & ~contains_any(text, list(r.bad)) & (contains_any(text, list(r.good)) | strong)
        for g in guards:
            if g.kind == kind:
                holds = contains_any(text, list(g.patterns))
                passes = passes & ~((holds if g.present else ~holds) & (conf < g.least))
        out = F.when(F.col("kind") == kind, passes).otherwise(out)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    out = F.when(contains_any(text, list(never)) | blank & (conf < 0.96), False).otherwise(out)
    out = F.when(among(label, accept_labels), True).otherwise(out)
    reject = among(qid, reject_ids) | among(label, reject_labels) | contains_any(text, list(reject_text))
    if reject_found:
        reject = reject | among(F.trim(F.coalesce("found_label", F.lit(""))), reject_found)
    for x, y in reject_pairs:
        reject = reject | ((label == x) & (qid == y))
    return F.when(reject, False).otherwise(out)


def same_as(links: DataFrame, base: str, target: str) -> DataFrame:
    """Typed triples of links (uri, qid, confidence, and found_label, description, method, query if known).

    Each link is a sameAs triple, and a statement named ``{uri}/sameAs/{qid}`` that bears what is known of it.
    """
    node, other = F.concat("uri", F.lit("/sameAs/"), "qid"), F.concat(F.lit(target), "qid")
    parts = [typed(links, F.col("uri"), SAME_AS, other), typed(links, node, TYPE, F.lit(STATEMENT))]
    parts += [typed(links, node, f"{RDF}{name}", o) for name, o in (("subject", F.col("uri")), ("predicate", F.lit(SAME_AS)), ("object", other))]
    parts.append(typed(links, node, f"{base}confidence", F.col("confidence").cast("string"), "lit", dtype=f"{XSD}decimal"))
    for c, local, lang in (("found_label", "foundLabel", "en"), ("description", "foundDescription", "en"), ("method", "linkingMethod", None), ("query", "matchedQuery", None)):
        if c in links.columns:
            parts.append(typed(links, node, f"{base}{local}", F.col(c), "lit", lang))
    return typed_union(*parts)
