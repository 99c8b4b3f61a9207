"""Queries of question answering over a graph that has every kind of predicate and class the answers know."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, triples, vectors
from .graph_tables import NS, table
from .queries import _KEY, _LOCAL, _MATCHED
from .registry import query

CLASSES = ["Character", "RealPerson", "Episode", "Work", "Thing"]
PREDICATES = ["portrays", "performer", "appearsInEpisode", "partOfSeries", "met", "defeated", "P57", "altLabel", "creator", "presentInWork", "instanceOf", "P449", "occupation"]
OPENINGS = ["Who is {}?", "Who portrays {}?", "Which episode has {}?", "What is happening in episode {}?", "What happens in the episode {}", "Tell me of {}"]


def story(spark, sf_dir):
    """Customers as figures: class, label, description, a motto, three links each."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    n = c.count()
    of = lambda k: F.concat(F.lit(f"{NS}story/"), k.cast("string"))
    pick = lambda words, i: F.get(F.array(*[F.lit(NS + w) for w in words]), i.cast("int"))
    s, k = of(F.col("k")), F.col("k")
    parts = [triples.triple(c, s, triples.TYPE, pick(CLASSES, k % 5)), triples.triple(c, s, triples.LABEL, F.concat(F.lit("Figure "), k.cast("string")), "lit")]
    parts.append(triples.triple(c, s, retrieval.SCHEMA_DESCRIPTION, F.concat(F.lit("about "), k.cast("string")), "lit"))
    parts.append(triples.triple(c, s, f"{NS}motto", F.concat(F.lit("word "), (k % 7).cast("string")), "lit"))
    parts += [triples.triple(c, s, pick(PREDICATES, (k * 3 + j * 5) % 13), of((k * 7 + j * 11 + 1) % n)) for j in range(3)]
    return triples.as_set(triples.union(*parts))


def questions(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.lit("Figure "), k.cast("string"))
    text = F.get(F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in (x.split("{}") for x in OPENINGS)]), ((k / 20).cast("long") % len(OPENINGS)).cast("int"))
    return table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(k.alias("question_id"), text.alias("question"))


_STORY = f"""st AS (SELECT c_custkey AS k, (SELECT count(*) FROM customer) AS n, '{NS}story/' || c_custkey AS s FROM customer),
  g AS (SELECT s, '{triples.TYPE}' AS p, '{NS}' || {CLASSES!r}[1 + k % 5] AS o, 'iri' AS o_kind FROM st UNION SELECT s, '{triples.LABEL}', 'Figure ' || k, 'lit' FROM st
    UNION SELECT s, '{retrieval.SCHEMA_DESCRIPTION}', 'about ' || k, 'lit' FROM st UNION SELECT s, '{NS}motto', 'word ' || (k % 7), 'lit' FROM st
    UNION SELECT s, '{NS}' || {PREDICATES!r}[1 + (k * 3 + j * 5) % 13], '{NS}story/' || ((k * 7 + j * 11 + 1) % n), 'iri' FROM st, (VALUES (0), (1), (2)) v(j)),
  q AS (SELECT k AS question_id, replace({OPENINGS!r}[1 + (k // 20) % 6], '{{}}', 'Figure ' || k) AS question FROM st WHERE k % 20 = 0),
  kinds AS (SELECT question_id, ['identity', 'portrayal', 'episode_membership', 'episode_summary', 'episode_summary', 'generic'][1 + (question_id // 20) % 6] AS question_type FROM q)"""

_LABELLED = "CASE {0} WHEN 'P57' THEN 'director' WHEN 'P449' THEN 'originalBroadcaster' ELSE {0} END"

_STORY_FACTS = f"""hop AS (
    SELECT question_id, uri, s, p, o, o_kind, 'out' AS direction FROM found JOIN g ON s = uri UNION ALL SELECT question_id, uri, s, p, o, o_kind, 'in' FROM found JOIN g ON o = uri WHERE o_kind = 'iri'),
  lab AS (SELECT s AS uri, min(o) AS label FROM g WHERE p = '{triples.LABEL}' GROUP BY s), cls AS (SELECT s AS uri, min({_LOCAL.format("o")}) AS class FROM g WHERE p = '{triples.TYPE}' GROUP BY s),
  f AS (SELECT question_id, question_type, s, p, CASE WHEN o_kind = 'iri' THEN o END AS o, direction, {_LABELLED.format(_LOCAL.format("p"))} AS pl, coalesce(a.label, {_LOCAL.format("s")}) AS sl,
      CASE WHEN o_kind = 'lit' THEN o ELSE coalesce(b.label, {_LOCAL.format("o")}) END AS ol, coalesce(ac.class, 'Unknown') AS sc, CASE WHEN o_kind = 'lit' THEN 'Literal' ELSE coalesce(bc.class, 'Unknown') END AS oc
    FROM hop JOIN kinds USING (question_id) LEFT JOIN lab a ON s = a.uri LEFT JOIN cls ac ON s = ac.uri LEFT JOIN lab b ON o = b.uri LEFT JOIN cls bc ON o = bc.uri
    WHERE p NOT IN ('{triples.LABEL}', '{triples.SAME_AS}', '{retrieval.SCHEMA_DESCRIPTION}') AND lower({_LOCAL.format("p")}) <> 'altlabel'),
  scored AS (SELECT *, sl || ' --' || pl || '--> ' || ol AS fact_text, CASE WHEN pl = 'type' AND question_type = 'identity' AND direction = 'out' THEN 6.0 ELSE
      1.0 + CASE WHEN sc IN ('Character', 'Episode', 'RealPerson', 'Work') THEN 0.2 ELSE 0 END + CASE WHEN oc IN ('Character', 'Episode', 'RealPerson', 'Work', 'Location', 'Organization', 'Class') THEN 0.2 ELSE 0 END
      + CASE WHEN question_type = 'identity' AND lower(pl) IN ('type', 'hastype', 'instanceof', 'presentinwork', 'partofseries', 'appearsinepisode', 'portrays', 'creator', 'author', 'director', 'castmember', 'performer') THEN 4.0
             WHEN question_type = 'identity' AND lower(pl) IN ('met', 'defeated', 'lostto', 'wonagainst', 'interactswith') THEN -1.5
             WHEN question_type = 'portrayal' AND lower(pl) IN ('portrays', 'performer') THEN 5.0
             WHEN question_type = 'episode_membership' AND lower(pl) IN ('appearsinepisode', 'partofseries') THEN 5.0
             WHEN question_type = 'episode_summary' AND lower(pl) IN ('partofseries', 'instanceof', 'director', 'originalbroadcaster') THEN 4.0 ELSE 0 END END AS score FROM f),
  once AS (SELECT question_id, question_type, s, p, o, ol, max(score)::DOUBLE AS score, min(fact_text) AS fact_text, min(pl) AS pl, min(sl) AS sl FROM scored GROUP BY question_id, question_type, s, p, o, ol),
  best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, s, p, o NULLS FIRST, ol) AS INTEGER) AS rank FROM once) WHERE rank <= 12)"""


@query(f"WITH {_STORY}, {_MATCHED}, {_STORY_FACTS} SELECT question_id, question_type, fact_text, round(score, 6) AS score, rank FROM best")
def typed_facts(spark, sf_dir):
    """Facts scored by the question's type, over all predicates and classes that a score knows."""
    return retrieval.facts(questions(spark, sf_dir), story(spark, sf_dir)).select("question_id", "question_type", "fact_text", "score", "rank")


_ANSWERS = """told AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i, lower(pl) AS lp FROM best WHERE lower(pl) NOT IN ('altlabel', 'languagespoken', 'occupation')),
  lists AS (SELECT q.question_id, question, kinds.question_type,
      list(ol ORDER BY i) FILTER (lp = 'type' AND i <= 8) AS types, list(ol ORDER BY i) FILTER (lp = 'instanceof' AND i <= 8) AS instances, list(ol ORDER BY i) FILTER (lp = 'presentinwork' AND i <= 8) AS works,
      list(ol ORDER BY i) FILTER (lp = 'creator' AND i <= 8) AS creators, list(ol ORDER BY i) FILTER (lp IN ('performer', 'portrays') AND i <= 8) AS actors0,
      min(row(i, lp, sl, ol)) FILTER (lp IN ('portrays', 'performer') AND i <= 8) AS cast_,
      list(CASE lp WHEN 'appearsinepisode' THEN sl || ' appears in the episode ' || ol || '.' ELSE sl || ' is part of the series ' || ol || '.' END ORDER BY i) FILTER (lp IN ('appearsinepisode', 'partofseries') AND i <= 8) AS member,
      list(CASE lp WHEN 'partofseries' THEN 'It is part of the series *' || ol || '*.' WHEN 'director' THEN 'It was directed by ' || ol || '.' ELSE 'It was released on ' || ol || '.' END ORDER BY i) FILTER (lp IN ('partofseries', 'director', 'originalbroadcaster') AND i <= 6) AS summary,
      list(sl || ' ' || CASE lp WHEN 'type' THEN 'is a' WHEN 'presentinwork' THEN 'appears in' WHEN 'creator' THEN 'was created by' WHEN 'performer' THEN 'is performed or portrayed by' WHEN 'instanceof' THEN 'is an instance of' WHEN 'partofseries' THEN 'is part of the series' WHEN 'director' THEN 'was directed by' ELSE pl END || ' ' || ol || '.' ORDER BY i) FILTER (i <= 5) AS lines
    FROM q JOIN kinds USING (question_id) LEFT JOIN told USING (question_id) GROUP BY q.question_id, question, kinds.question_type),
  focused AS (SELECT *, CASE WHEN question_type IN ('identity', 'episode_summary') THEN 'Figure ' || question_id ELSE rtrim(question, '?') END AS focus FROM lists),
  named AS (SELECT *, list_filter(list_concat(coalesce(types, []), coalesce(instances, [])), lambda c: contains(lower(c), 'character') OR contains(lower(c), 'fictional'))[1] AS kind,
      list_filter(coalesce(actors0, []), lambda x: lower(x) <> lower(focus)) AS actors1 FROM focused),
  once_each AS (SELECT *, list_filter(actors1, lambda x, j: list_position(actors1, x) = j) AS actors, list_filter(summary, lambda x, j: list_position(summary, x) = j) AS summary1, list_filter(member, lambda x, j: list_position(member, x) = j) AS member1, list_filter(lines, lambda x, j: list_position(lines, x) = j) AS lines1 FROM named),
  answered AS (SELECT question_id, question_type, CASE question_type
    WHEN 'identity' THEN
      CASE WHEN works[1] IS NOT NULL AND kind IS NOT NULL THEN focus || ' is a ' || lower(kind) || ' in *' || works[1] || '*.' WHEN works[1] IS NOT NULL THEN focus || ' is associated with *' || works[1] || '*.' WHEN kind IS NOT NULL THEN focus || ' is a ' || lower(kind) || '.' ELSE focus || ' is a character.' END
      || CASE WHEN creators[1] IS NOT NULL THEN ' The character was created by ' || creators[1] || '.' ELSE '' END
      || CASE WHEN len(actors) = 1 THEN ' In screen adaptations, ' || focus || ' is performed or portrayed by ' || actors[1] || '.' WHEN len(actors) > 1 THEN ' In screen adaptations, ' || focus || ' is performed or portrayed by ' || array_to_string(actors[:len(actors) - 1], ', ') || ' and ' || actors[len(actors)] || '.' ELSE '' END
    WHEN 'portrayal' THEN CASE WHEN cast_[2] = 'portrays' THEN cast_[4] || ' is portrayed by ' || cast_[3] || '.' WHEN cast_[2] = 'performer' THEN focus || ' is performed or portrayed by ' || cast_[4] || '.' ELSE 'I could not find a high-confidence portrayal relation in the retrieved evidence.' END
    WHEN 'episode_membership' THEN coalesce(array_to_string(member1[:3], ' '), 'I could not find a direct episode-related fact in the retrieved evidence.')
    WHEN 'episode_summary' THEN '*' || focus || '* is an episode of *the series*.' || coalesce(' ' || array_to_string(summary1, ' '), '')
    ELSE coalesce(array_to_string(lines1[:4], ' '), 'I could not generate a grounded answer from the retrieved evidence.') END AS answer FROM once_each)"""


@query(f"""WITH {_STORY}, {_MATCHED}, {_STORY_FACTS}, {_ANSWERS}, n AS (SELECT question_id, CAST(least(4, count(*)) AS INTEGER) AS n FROM best GROUP BY question_id)
SELECT question_id, question_type, answer, coalesce(n, 0) AS n_sources FROM answered LEFT JOIN n USING (question_id)""")
def ask_answers(spark, sf_dir):
    """The whole way, with a template for each type of question. The parts' names share no word with a question, so facts answer."""
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_name").alias("text"))
    return retrieval.ask(questions(spark, sf_dir), story(spark, sf_dir), chunks).select("question_id", "question_type", "answer", F.size("sources").alias("n_sources"))


@query(f"""WITH {_STORY}, {_MATCHED}, r AS (SELECT question_id, uri, CASE WHEN {_KEY.format("question")} LIKE 'who is%' OR {_KEY.format("question")} LIKE 'what is%' THEN 'types' ELSE 'facts' END AS kind FROM q JOIN found USING (question_id)),
  f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o) AS i FROM g)
SELECT question_id, uri, p, o FROM r JOIN f ON s = uri WHERE kind = 'types' AND p = '{triples.TYPE}' OR kind = 'facts' AND i <= 10""")
def question_routes(spark, sf_dir):
    """Graph queries routed by the question, and what they give."""
    q, g = questions(spark, sf_dir), story(spark, sf_dir)
    return retrieval.run_routes(retrieval.route(q, retrieval.match_entities(q, retrieval.label_index(g))), g)


#: Questions name the first two words of a document whose vector asks.
_HYBRID = f"""d AS (SELECT doc_id, source, coalesce(text, '') AS text, 'Who is ' || array_to_string(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ')[:2], ' ') || '?' AS question FROM documents),
  v AS (SELECT q.vec_id AS question_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
  top AS (SELECT question_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id) AS rank FROM v) WHERE rank <= 10),
  x AS (SELECT question_id, CAST(d.doc_id AS VARCHAR) AS chunk_id, score, {_KEY.format("d.source")} AS t, {_KEY.format("d.text")} AS x, {_KEY.format("regexp_extract(rtrim(q.question, '?'), '^Who is (.+)$', 1)")} AS focus FROM top JOIN d ON d.doc_id = id JOIN d q ON q.doc_id = question_id WHERE length(q.question) > 9),
  r AS (SELECT question_id, chunk_id, round(score + CASE WHEN t = focus THEN 0.5 WHEN contains(t, focus) THEN 0.3 ELSE 0 END + CASE WHEN starts_with(x, focus) THEN 0.4 ELSE 0 END
    + CASE WHEN contains(x[:300], focus || ' is ') THEN 0.35 ELSE 0 END + CASE WHEN contains(x[:300], focus || ' was ') THEN 0.25 ELSE 0 END + CASE WHEN focus <> '' AND contains(x, focus) THEN 0.1 ELSE 0 END, 6) AS rerank_score FROM x)"""


@query(f"WITH {_HYBRID} SELECT question_id, chunk_id, rerank_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, chunk_id) AS INTEGER) AS rank FROM r")
def hybrid_evidence(spark, sf_dir):
    """Dense candidates, ranked anew by the question's words, unfolded from the packs."""
    e = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    two = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 2), " ")
    q = docs.join(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("question_id"), F.concat(F.lit("Who is "), two, F.lit("?")).alias("question")).where("length(question) > 9")
    dense = vectors.top_k(e.where("vec_id % 20 = 0"), e, 10, exclude_self=True).select(F.col("query_id").alias("question_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("vector_score"))
    found = dense.join(docs, "doc_id").withColumn("chunk_id", F.col("doc_id").cast("string"))
    ranked = retrieval.rerank(found.select("question_id", "chunk_id", "title", "text", "vector_score"), q)
    none = spark.createDataFrame([], "question_id long, rank int, score double, fact_text string, subject_class string, object_class string, subject_uri string, predicate_uri string, predicate_label string, object_uri string, object_label string")
    packs = retrieval.evidence(q, ranked, none, n_text=10)
    return packs.select("question_id", F.explode("text_evidence").alias("t")).select("question_id", "t.chunk_id", F.col("t.score").alias("rerank_score"), "t.rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT 'e' || query_id AS entity, 'e' || id AS neighbour, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, 'e' || id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def kge_neighbours(spark, sf_dir):
    """Nearest entities by their vectors, for a stated set of entities."""
    from ..operators import kge

    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 20 == 0).alias("asked"))
    return kge.neighbours(e.where("asked").select("id"), e.drop("asked"), 5).withColumn("score", F.round("score", 6))
