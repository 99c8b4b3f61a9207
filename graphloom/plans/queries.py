"""The registered queries of the core, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, entities, expansion, extract, kge, linking, retrieval, rules, triples, vectors
from . import registry
from .graph_tables import GRAPH_SQL, NS, graph, iri, table
from .registry import query

_G = f"WITH {GRAPH_SQL} "
_LOCAL = "CASE WHEN contains({0}, '#') THEN regexp_extract({0}, '^[^#]*#(.*)$', 1) ELSE regexp_extract({0}, '([^/]*)$', 1) END"
_KEY = "trim(regexp_replace(regexp_replace(replace(lower(trim(coalesce({0}, ''))), '’', ''''), '[^a-z0-9\\s''_:-]', ' ', 'g'), '\\s+', ' ', 'g'))"


# ---------------------------------------------------------------- triples
@query(_G + "SELECT p, o_kind, count(*) AS n_triples, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM g GROUP BY p, o_kind")
def kg_profile(spark, sf_dir):
    return graph(spark, sf_dir).groupBy("p", "o_kind").agg(F.count("*").alias("n_triples"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"))


@query(_G + f"SELECT s, o FROM g WHERE p = '{NS}inNation' AND o = '{NS}nation/3'")
def kg_pattern(spark, sf_dir):
    return triples.match(graph(spark, sf_dir), p=f"{NS}inNation", o=f"{NS}nation/3").select("s", "o")


@query(_G + "SELECT DISTINCT s AS head, p AS relation, o AS tail FROM g WHERE starts_with(o, 'http')")
def kg_entity_links(spark, sf_dir):
    return triples.entity_links(graph(spark, sf_dir))


@query(_G + f"""SELECT uri, sum(out) AS n_out, sum(1 - out) AS n_in, count(DISTINCT other) AS n_neighbours FROM (
  SELECT s AS uri, 1 AS out, o AS other FROM g WHERE o_kind = 'iri' AND p <> '{triples.TYPE}' UNION ALL SELECT o, 0, s FROM g WHERE o_kind = 'iri' AND p <> '{triples.TYPE}') GROUP BY uri""")
def kg_degrees(spark, sf_dir):
    return triples.degrees(graph(spark, sf_dir))


@query(_G + f"""SELECT uri, label, class FROM (SELECT s AS uri, min(o) AS label FROM g WHERE p = '{triples.LABEL}' GROUP BY s)
  JOIN (SELECT s AS uri, min({_LOCAL.format("o")}) AS class FROM g WHERE p = '{triples.TYPE}' GROUP BY s) USING (uri)""")
def kg_labels_classes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return triples.best_labels(g).join(triples.classes(g), "uri")


_ONE_HOP = f"""seeds AS (SELECT '{NS}nation/' || n_nationkey AS uri FROM nation WHERE n_regionkey = 1),
  f AS (SELECT * FROM g WHERE p NOT IN ('{triples.LABEL}', '{triples.TYPE}', '{triples.SAME_AS}')),
  hop AS (SELECT s, p, o, o_kind, 'out' AS direction FROM f JOIN seeds ON s = uri UNION ALL SELECT s, p, o, o_kind, 'in' FROM f JOIN seeds ON o = uri WHERE o_kind = 'iri'),
  lab AS (SELECT s AS uri, min(o) AS label FROM g WHERE p = '{triples.LABEL}' GROUP BY s), cls AS (SELECT s AS uri, min({_LOCAL.format("o")}) AS class FROM g WHERE p = '{triples.TYPE}' GROUP BY s)"""


@query(f"""WITH {GRAPH_SQL}, {_ONE_HOP}
SELECT s AS subject_uri, coalesce(a.label, {_LOCAL.format("s")}) AS subject_label, coalesce(ac.class, 'Unknown') AS subject_class, p AS predicate_uri, {_LOCAL.format("p")} AS predicate_label,
  o AS object_uri, coalesce(b.label, {_LOCAL.format("o")}) AS object_label, coalesce(bc.class, 'Unknown') AS object_class, direction,
  coalesce(a.label, {_LOCAL.format("s")}) || ' --' || {_LOCAL.format("p")} || '--> ' || coalesce(b.label, {_LOCAL.format("o")}) AS fact_text
FROM hop LEFT JOIN lab a ON s = a.uri LEFT JOIN cls ac ON s = ac.uri LEFT JOIN lab b ON o = b.uri LEFT JOIN cls bc ON o = bc.uri""")
def kg_one_hop(spark, sf_dir):
    seeds = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(iri("nation", "n_nationkey").alias("uri"))
    return triples.one_hop(graph(spark, sf_dir), seeds)


@query(_G + f""", l AS (SELECT DISTINCT s AS head, p AS relation, o AS tail FROM g WHERE starts_with(o, 'http') AND p <> '{triples.TYPE}'),
  u AS (SELECT *, CAST('0x' || substr(md5('split' || chr(9) || head || chr(9) || relation || chr(9) || tail), 1, 8) AS BIGINT) % 10000 AS u FROM l),
  parts AS (SELECT head, relation, tail, CASE WHEN u >= 2000 THEN 'train' WHEN u < 1000 THEN 'valid' ELSE 'test' END AS part FROM u),
  known AS (SELECT head AS uri FROM parts WHERE part = 'train' UNION SELECT tail FROM parts WHERE part = 'train')
SELECT * FROM parts WHERE part = 'train' OR head IN (SELECT uri FROM known) AND tail IN (SELECT uri FROM known)""")
def kg_split(spark, sf_dir):
    return triples.split(triples.entity_links(graph(spark, sf_dir).where(F.col("p") != triples.TYPE)))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS s, 'bought' AS p, CAST(o_custkey AS VARCHAR) AS o, o_orderpriority AS priority, o_orderstatus AS status FROM orders""")
def kg_reified_round_trip(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("s"), F.lit("bought").alias("p"), F.col("o_custkey").cast("string").alias("o"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return triples.unreify(triples.reify(edges, ["priority", "status"], NS), ["priority", "status"], NS)


# ---------------------------------------------------------------- rules
_AXIOMS = rules.Axioms(symmetric=(f"{NS}near",), inverse={f"{NS}inNation": f"{NS}nationOf"}, sub_property={f"{NS}inNation": f"{NS}locatedIn", f"{NS}inRegion": f"{NS}locatedIn"}, sub_class={f"{NS}Customer": f"{NS}Party", f"{NS}Supplier": f"{NS}Party"}, transitive=(f"{NS}locatedIn",))


@query(_G + f""", loc AS (SELECT s, o FROM g WHERE p IN ('{NS}inNation', '{NS}inRegion')), far AS (SELECT s, o FROM loc UNION SELECT a.s, b.o FROM loc a JOIN loc b ON a.o = b.s)
SELECT p, count(*) AS n FROM (
  SELECT s, p, o FROM g UNION SELECT s, '{NS}locatedIn', o FROM far UNION SELECT o, '{NS}nationOf', s FROM g WHERE p = '{NS}inNation'
  UNION SELECT s, p, '{NS}Party' FROM g WHERE p = '{triples.TYPE}' AND o IN ('{NS}Customer', '{NS}Supplier')) GROUP BY p""")
def rules_entailment(spark, sf_dir):
    return rules.entail(graph(spark, sf_dir), _AXIOMS).groupBy("p").agg(F.count("*").alias("n"))


@query(_G + f"""SELECT n.s AS s, '{NS}orderRegion' AS p, r.o AS o FROM (SELECT a.s, b.o FROM g a JOIN g b ON a.o = b.s WHERE a.p = '{NS}placedBy' AND b.p = '{NS}inNation') n JOIN g r ON n.o = r.s WHERE r.p = '{NS}inRegion'
UNION SELECT a.s, '{NS}orderNation', b.o FROM g a JOIN g b ON a.o = b.s WHERE a.p = '{NS}placedBy' AND b.p = '{NS}inNation'""")
def rules_inference(spark, sf_dir):
    first = rules.Rule(("?o", f"{NS}orderNation", "?n"), (("?o", f"{NS}placedBy", "?c"), ("?c", f"{NS}inNation", "?n")))
    second = rules.Rule(("?o", f"{NS}orderRegion", "?r"), (("?o", f"{NS}orderNation", "?n"), ("?n", f"{NS}inRegion", "?r")))
    return rules.infer(graph(spark, sf_dir), [first, second]).select("s", "p", "o")


@query(_G + f""", RECURSIVE_SEED AS (SELECT '{NS}region/1' AS uri), e AS (SELECT o AS a, s AS b FROM g WHERE o_kind = 'iri' AND p <> '{triples.TYPE}'),
  d1 AS (SELECT DISTINCT b FROM e JOIN RECURSIVE_SEED ON a = uri), d2 AS (SELECT DISTINCT e.b FROM e JOIN d1 ON e.a = d1.b), d3 AS (SELECT DISTINCT e.b FROM e JOIN d2 ON e.a = d2.b)
SELECT uri, min(depth) AS depth FROM (SELECT uri, 0 AS depth FROM RECURSIVE_SEED UNION ALL SELECT b, 1 FROM d1 UNION ALL SELECT b, 2 FROM d2 UNION ALL SELECT b, 3 FROM d3) GROUP BY uri""")
def expand_from_region(spark, sf_dir):
    g = graph(spark, sf_dir).where(F.col("p") != triples.TYPE).where("o_kind = 'iri'").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "o_kind")
    return expansion.expand(g, spark.createDataFrame([(f"{NS}region/1",)], "uri string"), hops=3)


# ---------------------------------------------------------------- text and entities
@query(f"""SELECT p_partkey, {_KEY.format("p_name || ' (' || p_brand || ')'")} AS match_key, p_type || ':' || coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') || '-' || substr(sha1(p_type || ':' || p_name), 1, 6) AS entity_id,
  trim(regexp_replace(p_name || ' (' || p_brand || ')', '\\s*\\([^)]*\\)\\s*$', '')) AS canonical FROM part""")
def text_keys(spark, sf_dir):
    p, full = table(spark, sf_dir, "part"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return p.select("p_partkey", T.match_key(full).alias("match_key"), T.entity_id(F.col("p_type"), F.col("p_name")).alias("entity_id"), T.canonical_label(full).alias("canonical"))


def _mention_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("entity_class"), F.initcap("p_name").alias("canonical_text"), F.col("p_size").alias("mention_count"), F.col("p_brand").alias("url"), F.array("p_brand", F.lit("")).alias("aliases"), F.lower("p_type").alias("entity_label"), F.when(F.col("p_size") > 45, "REAL_WORLD").otherwise("IN_UNIVERSE").alias("page_context"))


@query("""SELECT entity_class, canonical_text, CAST(sum(p_size) AS BIGINT) AS total_count, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS urls, lower(entity_class) AS entity_label, CASE WHEN max(p_size) > 45 THEN 'REAL_WORLD' ELSE 'IN_UNIVERSE' END AS page_context
FROM (SELECT *, p_type AS entity_class, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS canonical_text FROM part) GROUP BY entity_class, canonical_text""")
def entities_global(spark, sf_dir):
    out = entities.global_entities(_mention_rows(spark, sf_dir))
    return out.select("entity_class", "canonical_text", "total_count", F.concat_ws("|", "urls").alias("urls"), "entity_label", "page_context")


@query()
def entities_resolved(spark, sf_dir):
    resolved, _ = entities.resolve_entities(_mention_rows(spark, sf_dir))
    return resolved.withColumns({"urls": F.concat_ws("|", "urls"), "aliases": F.concat_ws("|", "aliases")})


#: White space runs to one space, trimmed; sentences end behind '.', '!' or '?' that white space follows.
_SENTENCES = "string_split(regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""SELECT page_id, canonical_text, count(*) AS mention_count FROM (
  SELECT page_id, unnest(regexp_extract_all(sentence, '\\p{{Lu}}[\\p{{L}}''-]+(?: \\p{{Lu}}[\\p{{L}}''-]+)*')) AS canonical_text FROM (
    SELECT doc_id AS page_id, unnest({_SENTENCES.format("text")}) AS sentence FROM documents)) WHERE lower(canonical_text) NOT IN ('the', 'and') GROUP BY page_id, canonical_text""")
def entity_mentions(spark, sf_dir):
    return extract.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", stop=["The", "And"])


@query("""WITH own AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part),
  catalog AS (SELECT p_name AS label, min('Q' || p_partkey) AS qid, min(lower(p_type)) AS description FROM part GROUP BY p_name)
SELECT 'http://graphloom.example/part/' || p_partkey AS uri, c.qid, name AS label,
  round(0.82 + 0.08 + 0.2 * 0.12 + CASE WHEN p_type = 'ECONOMY' THEN (CASE WHEN contains(description, 'economy') THEN 0.06 ELSE 0 END) - (CASE WHEN contains(description, 'promo') THEN 0.10 ELSE 0 END) ELSE 0 END, 6)::DOUBLE AS confidence
FROM own JOIN catalog c ON lower(name) = lower(c.label)""")
def link_best(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = p.select(iri("part", "p_partkey").alias("uri"), F.initcap("p_name").alias("label"), F.concat(F.lit(f"{NS}"), "p_type").alias("type"))
    catalog = p.groupBy(F.col("p_name").alias("label")).agg(F.min(F.concat(F.lit("Q"), F.col("p_partkey"))).alias("qid"), F.min(F.lower("p_type")).alias("description"))
    scored = linking.score(linking.candidates(own, catalog), {"ECONOMY": linking.Hints(good=("economy",), bad=("promo",))})
    return linking.best_links(scored).select("uri", "qid", "label", F.round("confidence", 6).alias("confidence"))


_TYPES = {"ECONOMY": linking.TypeRule(0.3, ("widget",), ("cold",)), "STANDARD": linking.TypeRule(0.5, ("gear", "bolt"), ("hot",)), "PROMO": linking.TypeRule(0.78, ("fast",), ())}


@query("""WITH r AS (SELECT p_partkey, p_name AS label, p_type AS kind, p_brand AS qid, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS description, p_size / 50.0 AS confidence FROM part)
SELECT p_partkey, CASE WHEN qid = 'Brand#13' OR contains(description, 'blue') THEN false WHEN label = 'cold widget' THEN true WHEN description = '' AND confidence < 0.96 THEN false
  WHEN kind = 'ECONOMY' THEN confidence >= 0.3 AND NOT contains(description, 'cold') AND (contains(description, 'widget') OR confidence >= 0.96)
  WHEN kind = 'STANDARD' THEN confidence >= 0.5 AND NOT contains(description, 'hot') AND (contains(description, 'gear') OR contains(description, 'bolt') OR confidence >= 0.96)
  WHEN kind = 'PROMO' THEN confidence >= 0.78 AND (contains(description, 'fast') OR confidence >= 0.96) ELSE false END AS accepted FROM r""")
def link_accepted(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_type").alias("kind"), F.col("p_brand").alias("qid"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name")).alias("description"), (F.col("p_size") / 50.0).alias("confidence"))
    return rows.select("p_partkey", linking.accepted(_TYPES, ["Brand#13"], ["cold widget"], ["blue"]).alias("accepted"))


# ---------------------------------------------------------------- chunks, vectors, link prediction
#: A step takes each open text's next sentence, as the fold does.
_CHUNKS = f"""RECURSIVE s AS (SELECT doc_id, {_SENTENCES.format("coalesce(text, '')")} AS all_ FROM documents),
  t AS (SELECT doc_id, list_filter(all_, lambda x: x <> '') AS all_ FROM s),
  fold(doc_id, i, n, open, done, shut) AS (
    SELECT doc_id, 0, 0, CAST([] AS VARCHAR[]), -1, CAST(NULL AS VARCHAR[]) FROM t WHERE len(all_) > 0
    UNION ALL
    SELECT doc_id, i + 1, CASE WHEN big THEN least(len(open), 50) ELSE n END + len(w), CASE WHEN big THEN list_concat(open[-50:], w) ELSE list_concat(open, w) END, done + CAST(big AS INTEGER), CASE WHEN big THEN open END
    FROM (SELECT f.*, string_split(all_[i + 1], ' ') AS w, len(open) > 0 AND n + len(string_split(all_[i + 1], ' ')) > 220 AS big, i < len(all_) AS more FROM fold f JOIN t USING (doc_id)) WHERE more
  ),
  made AS (SELECT doc_id, done AS j, shut AS words FROM fold WHERE shut IS NOT NULL UNION ALL SELECT doc_id, done + 1, open FROM fold JOIN t USING (doc_id) WHERE i = len(all_))"""


@query(f"WITH {_CHUNKS} SELECT doc_id || '::chunk_' || j AS chunk_id, CAST(doc_id AS VARCHAR) AS page_id, j AS chunk_index, array_to_string(words, ' ') AS text, CAST(len(words) AS INTEGER) AS n_words FROM made")
def text_chunks(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def vector_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.top_k(e.where("vec_id % 20 = 0"), e, 10, exclude_self=True).withColumn("score", F.round("score", 6))


@query("""SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_aggregate(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y), 'sum'))), 'sum'), 6) AS total FROM embeddings""")
def vector_normalized(spark, sf_dir):
    v = vectors.l2_normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


#: Entities are the vectors, the one relation's is all ones; a tenth of the entities have a true tail each.
_RANKS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), test AS (SELECT vec_id AS h, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS t FROM embeddings WHERE vec_id % 10 = 0),
  s AS (SELECT t.h, t.t, list_dot_product(a.e, b.e) AS score FROM test t JOIN v a ON t.h = a.vec_id JOIN v b ON t.t = b.vec_id),
  tails AS (SELECT s.h, s.t, 'tail' AS side, 1.0 + count(*) FILTER (x.vec_id <> s.t AND list_dot_product(a.e, x.e) > s.score + 1e-12) AS rank FROM s JOIN v a ON s.h = a.vec_id, v x GROUP BY s.h, s.t),
  heads AS (SELECT s.h, s.t, 'head' AS side, 1.0 + count(*) FILTER (x.vec_id <> s.h AND NOT (x.vec_id % 10 = 0 AND (x.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) = s.t) AND list_dot_product(x.e, b.e) > s.score + 1e-12) AS rank FROM s JOIN v b ON s.t = b.vec_id, v x GROUP BY s.h, s.t),
  ranks AS (SELECT * FROM tails UNION ALL SELECT * FROM heads)"""


def _ranks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n, width = e.count(), 64
    vectors_ = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    ones = spark.createDataFrame([("r", [1.0] * width)], "id string, vector array<double>")
    test = e.where("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("head"), F.lit("r").alias("relation"), ((F.col("vec_id") * 7 + 1) % n).cast("string").alias("tail"))
    return kge.ranks(test, vectors_, ones, test, "distmult")


@query(f"WITH {_RANKS} SELECT CAST(h AS VARCHAR) AS head, CAST(t AS VARCHAR) AS tail, side, CAST(rank AS DOUBLE) AS rank FROM ranks")
def kge_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).select("head", "tail", "side", "rank")


@query(f"WITH {_RANKS} SELECT avg(1.0 / rank) AS mrr, avg(CAST(rank <= 1 AS DOUBLE)) AS hits_at_1, avg(CAST(rank <= 3 AS DOUBLE)) AS hits_at_3, avg(CAST(rank <= 10 AS DOUBLE)) AS hits_at_10, CAST(avg(rank) AS DOUBLE) AS mean_rank, count(*) AS n FROM ranks")
def kge_rank_metrics(spark, sf_dir):
    return kge.rank_metrics(_ranks(spark, sf_dir))


@query()
def kge_link_prediction(spark, sf_dir):
    """Training on all links between entities, then filtered ranks of the held-out ones."""
    links = triples.entity_links(graph(spark, sf_dir))
    parts = triples.split(links)
    made, test = parts.where("part = 'train'"), parts.where("part <> 'train'").select("head", "relation", "tail")
    e, r = kge.train(made, "distmult")
    return kge.rank_metrics(kge.ranks(test, e, r, links, "distmult"))


# ---------------------------------------------------------------- questions
def _questions(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("Who is "), "c_name", F.lit(" of NATION_"), "c_nationkey", F.lit("?")).alias("question"))


_Q = "q AS (SELECT c_custkey AS question_id, 'Who is ' || c_name || ' of NATION_' || c_nationkey || '?' AS question FROM customer WHERE c_custkey % 20 = 0)"


#: Openings and endings of questions, in all cases; which type a text has follows from its words alone.
_OPEN = ["Who is ", "  what ARE ", "Who portrays ", "Which episode has ", "What happens in ", "Tell me: what is happening in ", "who are", "WHO IS ", "What episode is ", "Is it that "]
_CLOSE = ["?", " portrays?", " played by them?", " appears in?", " what happens in it?", " Portrays", ""]


@query(f"""WITH t AS (SELECT conv_id, turn, {_OPEN!r}[1 + (conv_id * 3 + turn) % {len(_OPEN)}] || text || {_CLOSE!r}[1 + (conv_id + turn * 5) % {len(_CLOSE)}] AS question FROM conversations),
  l AS (SELECT *, lower(trim(question)) AS q FROM t)
SELECT conv_id, turn, CASE
  WHEN q LIKE '%what is happening in%' OR q LIKE '%what happens in%' THEN 'episode_summary'
  WHEN q LIKE 'who is %' OR q LIKE 'what is %' OR q LIKE 'who are %' OR q LIKE 'what are %' THEN 'identity'
  WHEN q LIKE '%portrays%' OR q LIKE '%played by%' THEN 'portrayal'
  WHEN q LIKE '%which episode%' OR q LIKE '%what episode%' OR q LIKE '%appears in%' THEN 'episode_membership' ELSE 'generic' END AS question_type FROM l""")
def question_types(spark, sf_dir):
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int"))
    key, turn = F.col("conv_id"), F.col("turn")
    q = F.concat(pick(_OPEN, key * 3 + turn), "text", pick(_CLOSE, key + turn * 5))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.question_type(q).alias("question_type"))


_MATCHED = f"""idx AS (SELECT DISTINCT label_norm, uri FROM (SELECT {_KEY.format("o")} AS label_norm, s AS uri FROM g WHERE p = '{triples.LABEL}'
    UNION ALL SELECT {_KEY.format("replace(" + _LOCAL.format("s") + ", '_', ' ')")}, s FROM g) WHERE label_norm <> ''),
  hits AS (SELECT question_id, uri, max(length(label_norm)) AS size FROM q JOIN idx ON length(label_norm) >= 3 AND contains({_KEY.format("question")}, label_norm) GROUP BY question_id, uri),
  found AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY size DESC, uri DESC) AS INTEGER) AS rank FROM hits) WHERE rank <= 5)"""


@query(f"WITH {GRAPH_SQL}, {_Q}, {_MATCHED} SELECT question_id, uri, CAST(size AS INTEGER) AS size, rank FROM found")
def question_entities(spark, sf_dir):
    return retrieval.match_entities(_questions(spark, sf_dir), retrieval.label_index(graph(spark, sf_dir)))


_FACTS = f"""f AS (SELECT * FROM g WHERE p NOT IN ('{triples.LABEL}', '{triples.SAME_AS}')),
  hop AS (SELECT question_id, s, p, o FROM f JOIN found ON s = uri UNION SELECT question_id, s, p, o FROM f JOIN found ON o = uri WHERE o_kind = 'iri'),
  lab AS (SELECT s AS uri, min(o) AS label FROM g WHERE p = '{triples.LABEL}' GROUP BY s),
  r AS (SELECT question_id, s AS subject_uri, p AS predicate_uri, o AS object_uri, coalesce(b.label, {_LOCAL.format("o")}) AS object_label, CASE WHEN p = '{triples.TYPE}' THEN 6.0 ELSE 1.0 END::DOUBLE AS score,
    coalesce(a.label, {_LOCAL.format("s")}) || ' --' || {_LOCAL.format("p")} || '--> ' || coalesce(b.label, {_LOCAL.format("o")}) AS fact_text FROM hop LEFT JOIN lab a ON s = a.uri LEFT JOIN lab b ON o = b.uri),
  best AS (SELECT * FROM (SELECT question_id, subject_uri, predicate_uri, object_uri, score, fact_text, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, subject_uri, predicate_uri, object_uri, object_label) AS INTEGER) AS rank FROM r) WHERE rank <= 12)"""


@query(f"WITH {GRAPH_SQL}, {_Q}, {_MATCHED}, {_FACTS} SELECT * FROM best")
def question_facts(spark, sf_dir):
    return retrieval.facts(_questions(spark, sf_dir), graph(spark, sf_dir)).select("question_id", "subject_uri", "predicate_uri", "object_uri", "score", "fact_text", "rank")


_LEXICAL = f"""q AS (SELECT item_id AS question_id, text AS question FROM benchmark), c AS (SELECT doc_id AS chunk_id, text FROM documents),
  asked AS (SELECT DISTINCT question_id, unnest(string_split({_KEY.format("question")}, ' ')) AS word FROM q), wanted AS (SELECT DISTINCT word FROM asked WHERE word <> ''),
  terms AS (SELECT chunk_id, word, count(*) AS tf FROM (SELECT chunk_id, unnest(string_split({_KEY.format("text")}, ' ')) AS word FROM c) WHERE word IN (SELECT word FROM wanted) GROUP BY chunk_id, word),
  df AS (SELECT word, count(*) AS df FROM terms GROUP BY word),
  s AS (SELECT question_id, chunk_id, round(sum((1 + ln(tf)) * ln(((SELECT count(*) FROM c) + 1.0) / (df + 0.5))), 6) AS score FROM asked JOIN df USING (word) JOIN terms USING (word) GROUP BY question_id, chunk_id)"""


@query(f"WITH {_LEXICAL} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def lexical_top_k(spark, sf_dir):
    return retrieval.lexical_retrieve(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@query(f"""WITH {GRAPH_SQL}, {_Q}, {_MATCHED}, {_FACTS}, c AS (SELECT doc_id AS chunk_id, text FROM documents),
  asked AS (SELECT DISTINCT question_id, unnest(string_split({_KEY.format("question")}, ' ')) AS word FROM q),
  terms AS (SELECT DISTINCT chunk_id, unnest(string_split({_KEY.format("text")}, ' ')) AS word FROM c),
  t AS (SELECT question_id, least(3, count(DISTINCT chunk_id)) AS n FROM asked JOIN terms USING (word) WHERE word <> '' GROUP BY question_id),
  k AS (SELECT question_id, count(*) AS n FROM best WHERE rank <= 8 GROUP BY question_id)
SELECT question_id, 'identity' AS question_type, regexp_extract(question, '^Who is (.*)\\?$', 1) || ' is a character.' AS answer, CAST(coalesce(k.n, 0) AS INTEGER) AS n_facts, CAST(coalesce(t.n, 0) AS INTEGER) AS n_texts
FROM q LEFT JOIN k USING (question_id) LEFT JOIN t USING (question_id)""")
def evidence_packs(spark, sf_dir):
    """The whole way: facts and texts for each question, packed with an answer."""
    q = _questions(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    found = retrieval.lexical_retrieve(q, docs, 3).join(docs, "chunk_id")
    packs = retrieval.answers(retrieval.evidence(q, found, retrieval.facts(q, graph(spark, sf_dir)), n_text=3, n_facts=8))
    return packs.select("question_id", "question_type", "answer", F.size("kg_evidence").alias("n_facts"), F.size("text_evidence").alias("n_texts"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda x: x <> '')) AS r
  FROM conversations JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, text AS b FROM benchmark) ON conv_id % (SELECT count(*) FROM benchmark) = i)
SELECT conv_id, turn, len(list_intersect(a, r)) / greatest(len(r), 1) AS overlap, CASE WHEN overlap > 0.35 THEN 3 WHEN overlap > 0.20 THEN 2 WHEN overlap > 0.08 THEN 1 ELSE 0 END AS grade FROM w""")
def answer_grades(spark, sf_dir):
    return retrieval.answer_scores(_answers(spark, sf_dir)).select("conv_id", "turn", "overlap", "grade")


def _answers(spark, sf_dir):
    """Turns as answers, each with a benchmark item, in turn, as its reference."""
    items = table(spark, sf_dir, "benchmark")
    numbered = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("i"), F.col("text").alias("reference"))
    return table(spark, sf_dir, "conversations").withColumn("i", (F.col("conv_id") % items.count()).cast("int")).join(numbered, "i").withColumnRenamed("text", "answer")


@query("""WITH w AS (SELECT role, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda x: x <> '')) AS r
  FROM conversations JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, text AS b FROM benchmark) ON conv_id % (SELECT count(*) FROM benchmark) = i),
  o AS (SELECT role, len(list_intersect(a, r)) / greatest(len(r), 1) AS overlap FROM w)
SELECT role AS system, count(*) AS n, round(avg(overlap), 6) AS mean_overlap, round(avg(CASE WHEN overlap > 0.35 THEN 3 WHEN overlap > 0.20 THEN 2 WHEN overlap > 0.08 THEN 1 ELSE 0 END), 6) AS mean_grade,
  count(*) FILTER (overlap > 0.35) AS n_full FROM o GROUP BY role""")
def system_comparison(spark, sf_dir):
    """Two systems' answers to the same questions, graded: here the roles of a conversation."""
    return retrieval.compare_systems(_answers(spark, sf_dir).withColumnRenamed("role", "system"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import knowledge_queries, story_queries  # noqa: F401  they register theirs

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)
