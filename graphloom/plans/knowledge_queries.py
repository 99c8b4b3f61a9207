"""Queries that make and widen a graph: labels, relations, statements, alignments, links, entity documents, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import abox, chunking, entities, expansion, extract, linking, triples
from .graph_tables import GRAPH_SQL, NS, graph, table
from .queries import _KEY, _mention_rows
from .registry import query

_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"
_ID = f"{{1}} || ':' || {_SLUG.format('{0}')} || '-' || substr(sha1({{1}} || ':' || {{0}}), 1, 6)"
_INITCAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

# ---------------------------------------------------------------- labels and relations
LABELS = ["PERSON", "ORG", "GPE", "LOC", "FAC", "NORP", "EVENT"]


@query(f"""WITH m AS (SELECT l_suppkey AS page_id, l_returnflag AS canonical_text, l_returnflag || (l_quantity::BIGINT % 3) AS surface, {LABELS!r}[1 + (l_partkey + l_linenumber) % 7] AS label FROM lineitem),
  l AS (SELECT page_id, canonical_text, label, count(*) AS n FROM m GROUP BY ALL), f AS (SELECT page_id, canonical_text, surface, count(*) AS n FROM m GROUP BY ALL),
  p AS (SELECT *, CASE label WHEN 'GPE' THEN 5 WHEN 'LOC' THEN 4 WHEN 'FAC' THEN 4 WHEN 'ORG' THEN 3 WHEN 'NORP' THEN 2 ELSE 1 END AS priority FROM l),
  best AS (SELECT page_id, canonical_text, first(label ORDER BY n DESC, priority DESC, label) AS entity_label, CAST(sum(n) AS BIGINT) AS mention_count FROM p GROUP BY page_id, canonical_text),
  forms AS (SELECT page_id, canonical_text, list(surface ORDER BY n DESC, surface) AS s FROM f GROUP BY page_id, canonical_text)
SELECT page_id, canonical_text, entity_label, s[1] AS preferred_text, array_to_string(s, '|') AS aliases, mention_count,
  CASE WHEN entity_label = 'PERSON' THEN (CASE WHEN page_id % 2 = 0 THEN 'REAL_PERSON' ELSE 'CHARACTER' END) WHEN entity_label = 'ORG' THEN 'ORGANIZATION' WHEN entity_label = 'NORP' THEN 'GROUP' WHEN entity_label = 'EVENT' THEN 'EVENT' ELSE 'LOCATION' END AS entity_class
FROM best JOIN forms USING (page_id, canonical_text)""")
def voted_labels(spark, sf_dir):
    """A label for each name of a page by vote, and its class."""
    pick = F.get(F.array(*[F.lit(x) for x in LABELS]), ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.col("l_returnflag").alias("canonical_text"), F.concat("l_returnflag", (F.col("l_quantity").cast("long") % 3).cast("string")).alias("surface"), pick.alias("label"))
    out = extract.vote_labels(rows)
    kind = extract.entity_class(F.col("entity_label"), F.col("canonical_text"), F.col("page_id") % 2 == 0)
    return out.withColumns({"aliases": F.concat_ws("|", "aliases"), "entity_class": kind})


VERBS = ["met", "won", "lost", "played", "entered", "defeated", "drew", "studied", "loves", "trained", "competes", "helped", "married"]
BETWEEN = [" ", " the ", " with ", " to ", " in the ", " at last, as all had hoped who came to see it, "]
OTHERS = ["Big Bolt", "Spring Cup", "Hot Gear", "Fast Widget", "The Small Plate Story"]
KNOWN = [("Spring Cup", "EVENT"), ("Hot Gear", "ORG"), ("Fast Widget", "GPE")]


def _pages(spark, sf_dir):
    """A page for each part: one sentence without a relation, one with."""
    k = F.col("p_partkey")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int"))
    text = F.concat(F.lit("Nothing  much here. "), F.initcap("p_name"), F.lit(" "), pick(VERBS, k), pick(BETWEEN, k / 13), pick(OTHERS, k / 3), F.lit("! And so on."))
    return table(spark, sf_dir, "part").select(k.alias("page_id"), F.concat(F.lit("http://x/"), k.cast("string")).alias("url"), text.alias("text"))


_RELATIONS = f"""p AS (SELECT p_partkey AS page_id, 'http://x/' || p_partkey AS url, {_INITCAP.format("p_name")} AS subject, {VERBS!r}[1 + p_partkey % {len(VERBS)}] AS verb, {BETWEEN!r}[1 + (p_partkey // 13) % {len(BETWEEN)}] AS between_, {OTHERS!r}[1 + (p_partkey // 3) % {len(OTHERS)}] AS object, p_partkey % 2 = 0 AS real FROM part),
  c AS (SELECT *, CASE verb WHEN 'met' THEN 'meet' WHEN 'won' THEN 'win' WHEN 'lost' THEN 'lose' WHEN 'played' THEN 'play' WHEN 'entered' THEN 'enter' WHEN 'defeated' THEN 'defeat' WHEN 'drew' THEN 'draw' WHEN 'studied' THEN 'study' WHEN 'loves' THEN 'love' WHEN 'trained' THEN 'train' WHEN 'competes' THEN 'compete' WHEN 'helped' THEN 'help' ELSE 'marry' END AS verb_lemma,
      CASE object WHEN 'Spring Cup' THEN 'EVENT' WHEN 'Hot Gear' THEN 'ORG' WHEN 'Fast Widget' THEN 'GPE' ELSE 'PERSON' END AS object_label, CASE subject WHEN 'Hot Gear' THEN 'ORG' WHEN 'Fast Widget' THEN 'GPE' ELSE 'PERSON' END AS subject_label,
      subject || ' ' || verb || between_ || object || '!' AS evidence FROM p),
  k AS (SELECT *, CASE object_label WHEN 'EVENT' THEN 'EVENT' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'GPE' THEN 'LOCATION' ELSE CASE WHEN object = 'The Small Plate Story' THEN 'WORK' WHEN real THEN 'REAL_PERSON' ELSE 'CHARACTER' END END AS object_class,
      CASE subject_label WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'GPE' THEN 'LOCATION' ELSE CASE WHEN real THEN 'REAL_PERSON' ELSE 'CHARACTER' END END AS subject_class, trim(between_) IN ('with', 'to', 'in the') AS prep FROM c),
  h AS (SELECT *, object_class IN ('CHARACTER', 'REAL_PERSON') AS human, object_class IN ('EVENT', 'WORK') OR regexp_matches(lower(evidence), 'tournament|championship|title|final|match|event|open|cup|masters') AS eventish FROM k),
  r AS (SELECT *, CASE WHEN verb_lemma = 'win' THEN (CASE WHEN human THEN 'DEFEATED' ELSE 'WON' END) WHEN verb_lemma = 'lose' THEN (CASE WHEN human THEN 'LOST_TO' ELSE 'LOST' END)
      ELSE map {{'meet': 'MET', 'play': 'PLAYED', 'enter': 'ENTERED', 'defeat': 'DEFEATED', 'draw': 'DREW_WITH', 'study': 'LEARNED_FROM', 'love': 'LOVED', 'train': 'TRAINED_BY', 'compete': 'COMPETED_IN', 'help': 'HELPED', 'marry': 'MARRIED'}}[verb_lemma] END AS relation,
      CASE WHEN prep THEN 0.70 WHEN verb_lemma IN ('win', 'lose') AND (human OR eventish) THEN 0.85 ELSE 0.75 END::DOUBLE AS pattern_score, CASE WHEN prep THEN 0.65 ELSE 0.75 END::DOUBLE AS distance_score FROM h),
  rel AS (SELECT {_ID.format("subject", "subject_class")} AS subject_id, subject, subject_label, subject_class, relation, {_ID.format("object", "object_class")} AS object_id, object, object_label, object_class, verb_lemma,
      CASE WHEN prep THEN 'dep:verb_nsubj_pobj' ELSE 'dep:verb_nsubj_obj' END AS relation_rule, round(0.4 * pattern_score + 0.25 * 0.75 + 0.2 * distance_score + 0.15 * 0.75, 6)::DOUBLE AS confidence, pattern_score, 0.75::DOUBLE AS ner_score, distance_score, 0.75::DOUBLE AS page_bias,
      evidence, evidence AS context_window, CAST(20 - 1 AS INTEGER) AS evidence_start_char, CAST(19 + length(evidence) AS INTEGER) AS evidence_end_char, CASE WHEN real THEN 'REAL_WORLD' ELSE 'IN_UNIVERSE' END AS page_context, url, page_id
    FROM r WHERE subject <> object AND (relation IN ('WON', 'LOST', 'ENTERED', 'COMPETED_IN') AND object_class IN ('EVENT', 'WORK') OR relation NOT IN ('WON', 'LOST', 'ENTERED', 'COMPETED_IN') AND human))"""


def _relations(spark, sf_dir):
    labels = spark.createDataFrame(KNOWN, "name string, label string")
    return extract.scored_relations(_pages(spark, sf_dir), "page_id", "text", labels, url="url", real_world=F.col("page_id") % 2 == 0)


@query(f"WITH {_RELATIONS} SELECT * FROM rel")
def scored_relations(spark, sf_dir):
    return _relations(spark, sf_dir)


@query(f"""WITH {_RELATIONS}, a AS (SELECT * REPLACE (
    CASE WHEN subject LIKE 'Cold %' THEN 'Big Bolt' ELSE subject END AS subject, CASE WHEN subject LIKE 'Cold %' THEN 'X:big' ELSE subject_id END AS subject_id,
    CASE WHEN object = 'Big Bolt' AND object_class = 'CHARACTER' THEN 'X:big' ELSE object_id END AS object_id) FROM rel WHERE subject NOT LIKE 'Cold %' OR subject_class IN ('CHARACTER', 'REAL_PERSON'))
SELECT subject_id, subject, relation, object_id, object, url, evidence, max(confidence) AS confidence FROM a WHERE subject_id <> object_id GROUP BY ALL""")
def rewritten_relations(spark, sf_dir):
    """Relations after their names are replaced by what they stand for."""
    names = [r[0] for r in table(spark, sf_dir, "part").where("p_name like 'cold %'").select(F.initcap("p_name")).distinct().collect()]
    rows = [(c, n, "Big Bolt", "X:big") for n in names for c in ("CHARACTER", "REAL_PERSON")] + [("CHARACTER", "Big Bolt", "Big Bolt", "X:big")]
    aliases = spark.createDataFrame(rows, "entity_class string, alias string, canonical_text string, entity_id string")
    return extract.rewrite_aliases(_relations(spark, sf_dir), aliases).select("subject_id", "subject", "relation", "object_id", "object", "url", "evidence", "confidence")


@query()
def entity_aliases(spark, sf_dir):
    """The alias table of the resolved entities."""
    return entities.resolve_entities(_mention_rows(spark, sf_dir))[1]


# ---------------------------------------------------------------- statements
BASE = f"{NS}kb#"
_LOCAL_SLUG = "CASE WHEN regexp_matches({0}, '^[0-9]') THEN 'e_' || {0} ELSE {0} END"
_PLAIN = "coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim({0})), '[''’]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'entity')"
_ABOX = f"""e AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'CHARACTER:' || c_name WHEN 1 THEN 'safe_' || c_custkey WHEN 2 THEN c_custkey || ' d''Or' ELSE '#' || c_custkey END AS id, c_custkey AS k, c_name, c_mktsegment FROM customer),
  i AS (SELECT *, '{BASE}' || CASE WHEN regexp_matches(id, '^[A-Za-z_][A-Za-z0-9_-]*$') THEN id ELSE {_LOCAL_SLUG.format(_PLAIN.format("id"))} END AS s FROM e),
  r AS (SELECT a.s, b.s AS o, CASE o_orderstatus WHEN 'F' THEN 'met' WHEN 'O' THEN 'lostTo' END AS local, o_orderkey, '0.' || (o_orderkey % 90 + 10) AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'seen in ' || o_orderkey ELSE NULL END AS evidence, o_orderkey % 50 AS start FROM orders JOIN i a ON o_custkey = a.k JOIN i b ON (o_custkey * 3 + 1) % (SELECT count(*) FROM customer) = b.k),
  t AS (SELECT *, '{BASE}' || local AS p, '_:' || sha1(concat_ws(chr(1), s, '{BASE}' || local, o, confidence, coalesce(evidence, ''), CAST(start AS VARCHAR))) AS node FROM r WHERE local IS NOT NULL)"""


def _entities(spark, sf_dir):
    k = F.col("c_custkey")
    id_ = F.when(k % 4 == 0, F.concat(F.lit("CHARACTER:"), "c_name")).when(k % 4 == 1, F.concat(F.lit("safe_"), k.cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(" d'Or"))).otherwise(F.concat(F.lit("#"), k.cast("string")))
    url = F.when(k % 5 == 0, F.concat(F.lit("http://x/"), k.cast("string")))
    return table(spark, sf_dir, "customer").select(k, id_.alias("entity_id"), F.col("c_name").alias("canonical_text"), F.lower("c_mktsegment").alias("entity_class"), url.alias("url"))


@query(f"""WITH {_ABOX} SELECT DISTINCT * FROM (
  SELECT s, '{triples.TYPE}' AS p, '{BASE}' || CASE c_mktsegment WHEN 'FURNITURE' THEN 'Work' WHEN 'BUILDING' THEN 'Location' ELSE 'Thing' END AS o, 'iri' AS o_kind, NULL AS o_lang, NULL AS o_dtype FROM i
  UNION ALL SELECT s, '{triples.LABEL}', c_name, 'lit', 'en', NULL FROM i UNION ALL SELECT s, '{BASE}sourceUrl', 'http://x/' || k, 'lit', NULL, '{abox.XSD}anyURI' FROM i WHERE k % 5 = 0
  UNION ALL SELECT s, p, o, 'iri', NULL, NULL FROM t UNION ALL SELECT node, '{triples.TYPE}', '{triples.STATEMENT}', 'iri', NULL, NULL FROM t
  UNION ALL SELECT node, '{triples.RDF}subject', s, 'iri', NULL, NULL FROM t UNION ALL SELECT node, '{triples.RDF}predicate', p, 'iri', NULL, NULL FROM t UNION ALL SELECT node, '{triples.RDF}object', o, 'iri', NULL, NULL FROM t
  UNION ALL SELECT node, '{BASE}confidence', confidence, 'lit', NULL, '{abox.XSD}decimal' FROM t UNION ALL SELECT node, '{BASE}evidence', evidence, 'lit', NULL, NULL FROM t WHERE evidence IS NOT NULL
  UNION ALL SELECT node, '{BASE}evidenceStartChar', CAST(start AS VARCHAR), 'lit', NULL, '{abox.XSD}integer' FROM t)""")
def abox_triples(spark, sf_dir):
    """Entities and relations as statements with provenance."""
    e = _entities(spark, sf_dir)
    n = e.count()
    k = F.col("o_orderkey")
    rel = table(spark, sf_dir, "orders").select(
        "o_custkey", ((F.col("o_custkey") * 3 + 1) % n).alias("other"), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("relation"),
        F.concat(F.lit("0."), (k % 90 + 10).cast("string")).alias("confidence"), F.when(k % 3 == 0, F.concat(F.lit("seen in "), k.cast("string"))).alias("evidence"), (k % 50).alias("evidence_start_char"),
    )
    ids = e.select("c_custkey", "entity_id")
    rel = rel.join(ids.withColumnsRenamed({"c_custkey": "o_custkey", "entity_id": "subject_id"}), "o_custkey").join(ids.withColumnsRenamed({"c_custkey": "other", "entity_id": "object_id"}), "other")
    return abox.typed_union(abox.entity_triples(e, BASE, {"FURNITURE": "Work", "BUILDING": "Location"}), abox.relation_triples(rel, BASE, {"F": "met", "O": "lostTo"}))


@query(f"WITH {GRAPH_SQL} SELECT s, p, o, o_kind FROM g UNION SELECT s, 'http://t/P17', o, o_kind FROM g WHERE p = '{NS}inNation' UNION SELECT s, 'http://t/P361', o, o_kind FROM g WHERE p = '{NS}inRegion'")
def aligned_triples(spark, sf_dir):
    """The graph with its aligned predicates' statements in the other vocabulary too."""
    rows = spark.createDataFrame([("inNation", "equivalent", "P17", "a note"), ("inRegion", "subproperty", "P361", None)], "local string, kind string, property string, note string")
    return abox.align(graph(spark, sf_dir), abox.alignment(rows, NS, "http://t/"))


@query("SELECT 'P' || p_partkey AS property, p_name AS label FROM part WHERE contains(lower(p_name), 'bolt') ORDER BY label, property LIMIT 75")
def property_search(spark, sf_dir):
    """Properties of a catalog whose label holds a word; the limit is the caller's."""
    catalog = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("property"), F.col("p_name").alias("label"))
    return abox.suggest_properties(catalog, " Bolt ", 75)


# ---------------------------------------------------------------- links
@query(f"""WITH l AS (SELECT '{NS}part/' || p_partkey AS uri, 'Q' || p_size AS qid, '0.' || (p_size + 10) AS confidence, p_name AS found_label, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS description FROM part), n AS (SELECT *, uri || '/sameAs/' || qid AS node, 'http://t/' || qid AS other FROM l)
SELECT uri AS s, '{triples.SAME_AS}' AS p, other AS o, 'iri' AS o_kind, NULL AS o_lang, NULL AS o_dtype FROM n UNION SELECT node, '{triples.TYPE}', '{triples.STATEMENT}', 'iri', NULL, NULL FROM n
UNION SELECT node, '{triples.RDF}subject', uri, 'iri', NULL, NULL FROM n UNION SELECT node, '{triples.RDF}predicate', '{triples.SAME_AS}', 'iri', NULL, NULL FROM n UNION SELECT node, '{triples.RDF}object', other, 'iri', NULL, NULL FROM n
UNION SELECT node, '{BASE}confidence', confidence, 'lit', NULL, '{abox.XSD}decimal' FROM n UNION SELECT node, '{BASE}foundLabel', found_label, 'lit', 'en', NULL FROM n UNION SELECT node, '{BASE}foundDescription', description, 'lit', 'en', NULL FROM n WHERE description IS NOT NULL""")
def same_as_triples(spark, sf_dir):
    """Accepted links as sameAs statements."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit(f"{NS}part/"), k.cast("string")).alias("uri"), F.concat(F.lit("Q"), size.cast("string")).alias("qid"), F.concat(F.lit("0."), (size + 10).cast("string")).alias("confidence"), F.col("p_name").alias("found_label"), F.when(k % 3 > 0, F.col("p_type")).alias("description"))
    return linking.same_as(rows, BASE, "http://t/")


KINDS = ["Character", "RealPerson", "Location", "Episode", "Work", "Organization", "Other"]
DESCRIPTIONS = ["", "fictional character", "American actor", "village in Spain", "episode of the saga", "capital city", "given name", "novel of the saga", "a company", "painter", "country"]
_RULES = {
    "Character": linking.TypeRule(0.5, ("fictional character", "saga"), ("actor",)), "RealPerson": linking.TypeRule(0.4, ("actor",), ("fictional",)), "Location": linking.TypeRule(0.6, ("city", "country", "village"), ("company",)),
    "Episode": linking.TypeRule(0.3, ("episode",), ("novel",)), "Work": linking.TypeRule(0.45, ("novel", "saga"), ("city",)), "Organization": linking.TypeRule(0.7, ("company",), ("actor",)),
}
_DECIDE = f"""r AS (SELECT p_partkey, {KINDS!r}[1 + p_partkey % 7] AS kind, {DESCRIPTIONS!r}[1 + (p_partkey // 7) % 11] AS d, p_name AS label, p_brand AS qid, ((p_partkey * 37) % 101) / 100.0::DOUBLE AS c FROM part)"""


@query(f"""WITH {_DECIDE} SELECT p_partkey, CASE
  WHEN qid = 'Brand#13' OR label = 'cold widget' AND qid = 'Brand#5' OR label = 'hot bolt' OR contains(d, 'painter') THEN false WHEN label = 'small gear' THEN true
  WHEN contains(d, 'given name') OR d = '' AND c < 0.96 THEN false
  WHEN kind = 'Character' THEN c >= 0.5 AND NOT contains(d, 'actor') AND NOT (NOT (contains(d, 'fictional') OR contains(d, 'saga')) AND c < 0.95) AND (contains(d, 'fictional character') OR contains(d, 'saga') OR c >= 0.96)
  WHEN kind = 'RealPerson' THEN c >= 0.4 AND NOT contains(d, 'fictional') AND (contains(d, 'actor') OR c >= 0.96)
  WHEN kind = 'Location' THEN c >= 0.6 AND NOT contains(d, 'company') AND NOT (contains(d, 'village') AND c < 0.95) AND (contains(d, 'city') OR contains(d, 'country') OR contains(d, 'village') OR c >= 0.96)
  WHEN kind = 'Episode' THEN c >= 0.3 AND NOT contains(d, 'novel') AND NOT (NOT contains(d, 'episode') AND c < 0.98) AND (contains(d, 'episode') OR c >= 0.96)
  WHEN kind = 'Work' THEN c >= 0.45 AND NOT contains(d, 'city') AND (contains(d, 'novel') OR contains(d, 'saga') OR c >= 0.96)
  WHEN kind = 'Organization' THEN c >= 0.7 AND NOT contains(d, 'actor') AND (contains(d, 'company') OR c >= 0.96) ELSE false END AS accepted FROM r""")
def link_cascade(spark, sf_dir):
    """The cascade with pairs, general rejects and the types' safeguards."""
    k = F.col("p_partkey")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int"))
    rows = table(spark, sf_dir, "part").select(k, F.col("p_name").alias("label"), pick(KINDS, k).alias("kind"), F.col("p_brand").alias("qid"), pick(DESCRIPTIONS, k / 7).alias("description"), ((k * 37 % 101) / 100.0).alias("confidence"))
    passes = linking.accepted(_RULES, ["Brand#13"], ["small gear"], ["painter"], reject_pairs=[("cold widget", "Brand#5")], reject_labels=["hot bolt"], never=linking.NEVER, guards=linking.safeguards("saga"))
    return rows.select("p_partkey", passes.alias("accepted"))


@query(f"""WITH {_DECIDE}, a AS (SELECT *, lower({_INITCAP.format("label")}) AS q FROM r),
  s AS (SELECT p_partkey, 0.82 + 0.08 + 0.2 * 0.12 + CASE WHEN kind = 'Character' AND contains(d, 'fictional') THEN 0.06 ELSE 0 END + CASE WHEN contains(d, 'saga') THEN 0.14 ELSE 0 END
    + CASE kind WHEN 'Episode' THEN CASE WHEN contains(d, 'episode') THEN 0.08 ELSE 0 END + CASE WHEN contains(d, 'saga') THEN 0.20 ELSE -0.22 END
      WHEN 'Character' THEN CASE WHEN contains(d, 'fictional') THEN 0.10 ELSE 0 END + CASE WHEN contains(d, 'saga') THEN 0.15 ELSE 0 END - CASE WHEN contains(d, 'actor') THEN 0.15 ELSE 0 END
      WHEN 'RealPerson' THEN CASE WHEN contains(d, 'fictional') THEN -0.20 ELSE 0 END + CASE WHEN contains(d, 'actor') THEN 0.07 ELSE 0 END
      WHEN 'Work' THEN CASE WHEN contains(d, 'novel') THEN 0.08 ELSE 0 END + CASE WHEN contains(d, 'saga') THEN 0.16 ELSE 0 END ELSE 0 END AS total FROM a)
SELECT p_partkey, round(greatest(0, least(0.99, total)), 6)::DOUBLE AS confidence FROM s""")
def link_scores(spark, sf_dir):
    """Confidence with the gains and losses of each type; each part is its own candidate."""
    k = F.col("p_partkey")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int"))
    name = F.initcap("p_name")
    rows = table(spark, sf_dir, "part").select(k, name.alias("label"), name.alias("query"), F.col("p_name").alias("found_label"), F.concat(F.lit("http://x#"), pick(KINDS, k)).alias("type"), pick(DESCRIPTIONS, k / 7).alias("description"))
    scored = linking.score(rows, {"Character": linking.Hints(good=("fictional",))}, linking.boosts("saga"), domain=("saga",), risky=linking.RISKY)
    return scored.select("p_partkey", F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- entity documents, claims
def _documents(spark, sf_dir):
    """An entity document for each customer, as a service would send it."""
    k = F.col("c_custkey")
    text = k.cast("string")
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    label = F.when(k % 3 == 0, j('{"fr":{"value":"nom ', text, '"},"en":{"value":" name ', text, ' "}}')).when(k % 3 == 1, j('{"fr":{"value":"nom ', text, '"},"de":{"value":"Name"}}')).otherwise(j('{"es":{"value":"nombre"},"de":{"value":"Name ', text, '"}}'))
    description = F.when(k % 2 == 0, j('{"en":{"value":"described ', text, '"}}')).otherwise(F.lit("{}"))
    aliases = j('{"en":[', ",".join(f'{{"value":"a{i}"}}' for i in range(7)), '],"de":[{"value":"no"}],"fr":[{"value":"b', text, '"}]}')
    snak = lambda kind, value: j('{"mainsnak":{"snaktype":"value","datavalue":{"type":"', kind, '","value":', value, "}}}")
    item = lambda n: snak("wikibase-entityid", j('{"entity-type":"item","numeric-id":', n, "}"))
    none = '{"mainsnak":{"snaktype":"novalue"}}'
    day = F.lpad((k % 28).cast("string"), 2, "0")
    claims = j(
        '{"P31":[', none, ",", item((k % 10).cast("string")), ",", item((k % 10 + 1).cast("string")), ",", item((k % 10 + 2).cast("string")), '],"P999":[', item("5"), "]",
        ',"P569":[', snak("time", j('{"time":"+0', (k % 900 + 100).cast("string"), "-05-", day, 'T00:00:00Z"}')), ",", snak("time", '{"time":"someday"}'), "]",
        ',"P2048":[', snak("quantity", j('{"amount":"+', text, '.5","unit":"1"}')), '],"P1476":[', snak("monolingualtext", j('{"text":"title ', text, '","language":"fr"}')), "]",
        ',"P18":[', snak("string", j('"', F.repeat(F.lit("x"), (k % 2 * 300 + 3).cast("int")), '"')), "]}",
    )
    doc = j('{"labels":', label, ',"descriptions":', description, ',"aliases":', aliases, ',"claims":', claims, "}")
    return expansion.read_entities(table(spark, sf_dir, "customer").select(F.concat(F.lit("Q"), text).alias("qid"), doc.alias("json")))


@query(f"""WITH c AS (SELECT c_custkey AS k, 'http://t/Q' || c_custkey AS s FROM customer)
SELECT s, '{triples.LABEL}' AS p, CASE k % 3 WHEN 0 THEN 'name ' || k WHEN 1 THEN 'nom ' || k ELSE 'Name ' || k END AS o, 'lit' AS o_kind, CASE k % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS o_lang, NULL AS o_dtype FROM c
UNION ALL SELECT s, '{expansion.DESCRIPTION}', 'described ' || k, 'lit', 'en', NULL FROM c WHERE k % 2 = 0
UNION ALL SELECT s, '{expansion.ALT_LABEL}', 'a' || i, 'lit', 'en', NULL FROM c, range(5) r(i) UNION ALL SELECT s, '{expansion.ALT_LABEL}', 'b' || k, 'lit', 'fr', NULL FROM c""")
def entity_metadata(spark, sf_dir):
    """Labels, descriptions and aliases of entity documents by language."""
    return expansion.entity_metadata(_documents(spark, sf_dir), "http://t/")


@query(f"""WITH c AS (SELECT c_custkey AS k, 'http://t/Q' || c_custkey AS s, lpad(CAST(c_custkey % 28 AS VARCHAR), 2, '0') AS day FROM customer)
SELECT s, 'http://w/P31' AS p, 'http://t/Q' || (k % 10 + i) AS o, 'iri' AS o_kind, NULL AS o_lang, NULL AS o_dtype FROM c, range(2) r(i)
UNION ALL SELECT s, 'http://w/P569', CASE WHEN day = '00' THEN '0' || (k % 900 + 100) || '-05-00' ELSE '0' || (k % 900 + 100) || '-05-' || day END, 'lit', NULL, CASE WHEN day <> '00' THEN '{abox.XSD}date' END FROM c
UNION ALL SELECT s, 'http://w/P569', 'someday', 'lit', NULL, NULL FROM c UNION ALL SELECT s, 'http://w/P2048', '+' || k || '.5', 'lit', NULL, NULL FROM c
UNION ALL SELECT s, 'http://w/P1476', 'title ' || k, 'lit', 'fr', NULL FROM c UNION ALL SELECT s, 'http://w/P18', 'xxx', 'lit', NULL, NULL FROM c WHERE k % 2 = 0""")
def claim_triples(spark, sf_dir):
    """Claims of entity documents as typed statements, two at most of a property."""
    return expansion.claim_triples(_documents(spark, sf_dir), "http://t/", "http://w/", ["P31", "P569", "P2048", "P1476", "P18"], per_property=2)


@query(f"""WITH {GRAPH_SQL}, c AS (SELECT o AS s, p, s AS o, o_kind FROM g WHERE p IN ('{NS}inNation', '{NS}inRegion')),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY o_kind, o) AS i FROM c) WHERE i <= 20),
  d1 AS (SELECT DISTINCT o AS uri FROM k WHERE s = '{NS}region/1'), reached AS (SELECT '{NS}region/1' AS uri UNION SELECT uri FROM d1 UNION SELECT o FROM k JOIN d1 ON k.s = d1.uri)
SELECT DISTINCT s, p, o, o_kind FROM k JOIN reached ON s = uri""")
def capped_expansion(spark, sf_dir):
    """Claims capped by property (the caller's argument), what two hops reach over them, and its claims."""
    g = graph(spark, sf_dir).where(F.col("p").isin(f"{NS}inNation", f"{NS}inRegion"))
    claims = expansion.cap_claims(g.select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "o_kind"), 20)
    reached = expansion.expand(claims, spark.createDataFrame([(f"{NS}region/1",)], "uri string"), hops=2)
    return expansion.expanded_triples(claims, reached)


# ---------------------------------------------------------------- chunks, pages
@query(f"""WITH n AS (SELECT DISTINCT {_KEY.format("array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[:2], ' ')")} AS name FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
  d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, ' ' || {_KEY.format("text")} || ' ' AS x FROM documents)
SELECT chunk_id, name FROM d JOIN n ON name <> '' AND contains(x, ' ' || name || ' ')""")
def chunk_entities(spark, sf_dir):
    """Which of some names stand in each text: the first two words of every twentieth document."""
    from ..functions.text import match_key

    docs = table(spark, sf_dir, "documents")
    two = match_key(F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 2), " "))
    names = docs.where("doc_id % 20 = 0 and text is not null").select(two.alias("name")).distinct()
    return chunking.mentioned(docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text"), names)


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site, list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#]*)', 1), lambda x: trim(x)), lambda x: starts_with(x, '/') AND NOT starts_with(x, '//')) AS all_ FROM pages),
  u AS (SELECT page_id, site, list_filter(all_, lambda x, i: list_position(all_, x) = i)[:80] AS links FROM h WHERE site <> '')
SELECT page_id, CAST(unnest(range(len(links))) AS INTEGER) AS pos, site || unnest(links) AS link FROM u""")
def page_links(spark, sf_dir):
    """The links of a page to its own site; how many a crawler takes is its argument."""
    return extract.page_links(table(spark, sf_dir, "pages"), "page_id", "url", "html")
