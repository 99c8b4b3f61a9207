"""Question-driven retrieval over a graph and chunks; every operator takes a DataFrame of questions (question_id, question)."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import local_name, match_key, normalize_spaces
from ..plans.written import materialize
from .triples import LABEL, SAME_AS, TYPE, best_labels, classes, one_hop, spread


def question_type(question: Column) -> Column:
    q = F.trim(F.lower(question))
    has = lambda *xs: F.greatest(*[F.contains(q, F.lit(x)) for x in xs], F.lit(False))
    return (
        F.when(has("what is happening in", "what happens in"), "episode_summary")
        .when(q.rlike("^(who|what) (is|are) "), "identity")
        .when(q.startswith("who portrays ") | has("portrays", "played by"), "portrayal")
        .when(has("which episode", "what episode", "appears in"), "episode_membership")
        .otherwise("generic")
    )


def focus_phrase(question: Column) -> Column:
    """What a question is about: the rest of 'who is ...', of '... happening in episode ...', or the question."""
    q = F.regexp_replace(F.trim(question), r"\?+$", "")
    patterns = (r"(?i)^what\s+(?:is|are)\s+happening in (?:the )?episode (.+)$", r"(?i)^who\s+(?:is|are)\s+happening in (?:the )?episode (.+)$", r"(?i)^(?:who|what)\s+(?:is|are)\s+(.+)$", r"(?i)^what\s+happens in (?:the )?episode (.+)$")
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(q, p, 1)), F.lit("")) for p in patterns], q)


def label_index(triples: DataFrame) -> DataFrame:
    """(label_norm, uri): labels, and local names with spaces for underscores."""
    # exploded, a key is made once; filters of a projected one would each make it again, before rows are distinct
    norm = lambda c: F.explode(F.array(match_key(c))).alias("label_norm")
    labels = triples.where((F.col("p") == LABEL) & (F.col("o_kind") == "lit")).select(norm(F.col("o")), F.col("s").alias("uri"))
    names = triples.select("s").distinct().where(~F.col("s").startswith("_:")).select(norm(F.translate(local_name(F.col("s")), "_", " ")), F.col("s").alias("uri"))
    return labels.unionByName(names).where("label_norm <> ''").distinct()


def match_entities(questions: DataFrame, index: DataFrame, k: int = 5, least: int = 3) -> DataFrame:
    """(question_id, uri, size, rank): entities one of whose labels stands in the question, longest first.

    Labels match as substrings. The question set is cut into its substrings of the lengths that labels have, and these
    meet the labels by equality: rows grow with the questions and with what matches, not with the labels. These rows are
    many times what the questions' files show, so they and the labels, a written table, are both sorted.
    """
    index = materialize(index.where(F.length("label_norm") >= max(3, least)).select("label_norm", "uri"), "labels")
    q = questions.select("question_id", match_key(F.col("question")).alias("q")).where("length(q) >= 3")
    longest = q.agg(F.max(F.length("q"))).first()[0] or 0
    keyed = index.where(F.length("label_norm") <= longest)
    # at most as many numbers as the longest question has characters
    sizes = sorted(r[0] for r in keyed.select(F.length("label_norm")).distinct().collect())
    lengths = F.filter(F.lit(sizes or [0]).cast("array<int>"), lambda n: (n > 0) & (n <= F.length("q")))
    cut = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("q") - n + 1), lambda i: F.substring(F.col("q"), i, n))))
    runs = q.select("question_id", F.explode(F.array_distinct(cut)).alias("label_norm"))
    hits = runs.join(spread(keyed), "label_norm").groupBy("question_id", "uri").agg(F.max(F.length("label_norm")).alias("size"))
    order = Window.partitionBy("question_id").orderBy(F.desc("size"), F.desc("uri"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SCHEMA_DESCRIPTION = "http://schema.org/description"


@dataclass(frozen=True)
class FactWeights:
    """Which predicates and classes a question type favours. They must equal these for equal answers."""

    #: What each question type adds for a predicate's normalized label.
    bonus: dict[str, tuple[tuple[tuple[str, ...], float], ...]] = field(
        default_factory=lambda: {
            "identity": (
                (("type", "hastype", "instanceof", "presentinwork", "partofseries", "appearsinepisode", "portrays", "creator", "author", "director", "castmember", "performer"), 4.0),
                (("met", "defeated", "lostto", "wonagainst", "interactswith"), -1.5),
            ),
            "portrayal": ((("portrays", "performer"), 5.0),),
            "episode_membership": ((("appearsinepisode", "partofseries"), 5.0),),
            "episode_summary": ((("partofseries", "instanceof", "director", "originalbroadcaster"), 4.0),),
        }
    )
    #: Predicates that tell little, by label: no facts.
    low: tuple[str, ...] = ("altlabel", "matchedquery", "confidence", "linkingmethod", "subject", "predicate", "object")
    subjects: tuple[str, ...] = ("Character", "Episode", "RealPerson", "Work")
    objects: tuple[str, ...] = ("Character", "Episode", "RealPerson", "Work", "Location", "Organization", "Class")
    class_bonus: float = 0.2
    #: An identity question's explicit type facts.
    type_score: float = 6.0
    #: Predicates that are no facts, by uri.
    blocked: tuple[str, ...] = (LABEL, SAME_AS, SCHEMA_DESCRIPTION)
    #: Local names of predicates to be shown by another label.
    labels: dict[str, str] = field(
        default_factory=lambda: {
            "P31": "instanceOf", "P106": "occupation", "P1412": "languageSpoken", "P1441": "presentInWork", "P170": "creator", "P175": "performer",
            "P50": "author", "P57": "director", "P161": "castMember", "P179": "partOfSeries", "P361": "partOf", "P527": "hasPart", "P17": "country",
            "P131": "locatedIn", "P276": "location", "P495": "countryOfOrigin", "P449": "originalBroadcaster",
        }
    )


def fact_score(kind: Column, predicate: Column, subject_class: Column, object_class: Column, w: FactWeights) -> Column:
    p = match_key(predicate)
    add = lambda condition, value: F.when(condition, F.lit(value)).otherwise(0.0)
    total = F.lit(1.0) + add(subject_class.isin(*w.subjects), w.class_bonus) + add(object_class.isin(*w.objects), w.class_bonus)
    for name, rows in w.bonus.items():
        for predicates, value in rows:
            total = total + add((kind == name) & p.isin(*predicates), value)
    return F.round(total, 6)


def facts(questions: DataFrame, triples: DataFrame, k_entities: int = 5, k_facts: int = 12, weights: FactWeights | None = None, found: DataFrame | None = None) -> DataFrame:
    """The best one-hop facts of each question's entities, with score and rank.

    An entity's facts are ranked once for each type of question that asks for it, and only its best ``k_facts``
    meet the questions, so a hub costs its own degree and not that times its questions.
    """
    w = weights or FactWeights()
    found = match_entities(questions, label_index(triples), k_entities) if found is None else found
    found = found.where(~F.contains("uri", F.lit("/sameAs/"))).select("question_id", "uri")
    found = found.join(spread(questions.select("question_id", question_type(F.col("question")).alias("question_type"))), "question_id")
    asked = found.select("uri", "question_type").distinct()
    seeds = spread(asked.select("uri").distinct())
    hop = one_hop(triples, seeds, list(w.blocked)).where(~((F.col("direction") == "in") & F.contains("subject_uri", F.lit("/sameAs/"))))
    shown = F.col("predicate_label")
    if w.labels:
        shown = F.coalesce(F.create_map(*[F.lit(x) for pair in w.labels.items() for x in pair])[shown], shown)
    # exploded, the label is made where it stands; the filter would make it anew for every triple, before triples are distinct
    hop = hop.select(*[c for c in hop.columns if c != "predicate_label"], F.explode(F.array(shown)).alias("predicate_label")).where(~match_key(F.col("predicate_label")).isin(*w.low))
    hop = hop.withColumn("fact_text", F.concat("subject_label", F.lit(" --"), "predicate_label", F.lit("--> "), "object_label"))
    hop = hop.withColumn("uri", F.when(F.col("direction") == "out", F.col("subject_uri")).otherwise(F.col("object_uri")))
    rows = hop.join(spread(asked), "uri")
    rows = rows.withColumn("score", fact_score(F.col("question_type"), F.col("predicate_label"), F.col("subject_class"), F.col("object_class"), w))
    # the classes of what an identity question asks for come first, as facts of their own
    names = ["subject_uri", "subject_label", "subject_class", "predicate_uri", "predicate_label", "object_uri", "object_label", "object_class", "fact_text"]
    explicit = (F.col("predicate_uri") == TYPE) & (F.col("question_type") == "identity") & (F.col("direction") == "out") & F.col("object_uri").isNotNull()
    kind = local_name(F.col("object_uri"))
    typed = rows.where(explicit).withColumns({"score": F.lit(w.type_score), "predicate_label": F.lit("type"), "object_label": kind, "object_class": F.lit("Class"), "fact_text": F.concat("subject_label", F.lit(" --type--> "), kind)})
    rows = rows.unionByName(typed)
    key = ["subject_uri", "predicate_uri", "object_uri", "object_label"]
    rest = [n for n in names if n not in key]
    best = F.max(F.struct("score", *rest)).alias("best")  # one row a fact, its best score

    def ranked(df: DataFrame, *by: str) -> DataFrame:
        once = df.groupBy(*by, *key).agg(best).select(*by, *key, "best.*")
        order = Window.partitionBy(*by).orderBy(F.desc("score"), *key)
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_facts)

    own = ranked(rows, "uri", "question_type").drop("rank")
    return ranked(found.join(spread(own), ["uri", "question_type"]), "question_id", "question_type").select("question_id", "question_type", *names, "score", "rank")


def lexical_retrieve(questions: DataFrame, chunks: DataFrame, k: int = 10, block_terms: int = 200_000) -> DataFrame:
    """(question_id, chunk_id, score, rank) by tf-idf over shared words; questions are the stated query set.

    chunks: chunk_id, text. Document frequencies count all chunks. Questions that share the same words with the chunks get the same
    scores, so each such list of words is scored once. The lists travel with the plan, in blocks of ``block_terms`` words at most;
    each task scores its chunks against a block and keeps its best k, so no pair of a question and a chunk is a row.
    """
    words = lambda c: F.filter(F.split(match_key(c), " "), lambda w: w != "")
    asked = questions.select("question_id", F.explode(F.array_distinct(words(F.col("question")))).alias("word"))
    keyed = chunks.select("chunk_id", match_key(F.col("text")).alias("key"))
    df = keyed.select("key").mapInArrow(_word_counts, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))
    n = chunks.count()
    idf = F.log((F.lit(float(n)) + 1) / (F.col("df") + 0.5))
    terms = asked.join(spread(df), "word").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("word", idf.alias("idf")))).alias("terms"))
    terms = materialize(terms.withColumn("words", F.array_join("terms.word", " ")), "asked")
    lists = terms.groupBy("words").agg(F.min("terms").alias("terms")).orderBy("words")
    id_type = dict(chunks.dtypes)["chunk_id"]
    schema = f"words string, chunk_id {id_type}, score double"
    out = None
    for block in _blocks(lists.toLocalIterator(), block_terms):
        part = keyed.mapInArrow(_scorer(block, k), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = questions.sparkSession.createDataFrame([], schema)
    order = lambda by: Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    best = out.withColumn("rank", F.row_number().over(order("words"))).where(F.col("rank") <= k)
    return terms.select("question_id", "words").join(spread(best), "words").select("question_id", "chunk_id", "score", "rank")


#: Different words that a task counts before it sends them on; chunks, and pairs of a chunk and a list of words, that are scored at once.
COUNTED, CHUNKS_AT_ONCE, SCORES_AT_ONCE = 500_000, 1_024, 1 << 21


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's chunks (key) each word stands."""
    counts: Counter[str] = Counter()
    send = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "df"])
    for batch in batches:
        for key in batch["key"]:
            counts.update(set(key.as_py().split(" ")))
            if len(counts) >= COUNTED:
                yield send()
                counts.clear()
    yield send()


def _blocks(rows: Iterator, most: int) -> Iterator[list[tuple]]:
    """Rows (words, terms) in lists of about ``most`` terms."""
    held: list[tuple] = []
    n = 0
    for row in rows:
        if held and n + len(row["terms"]) > most:
            yield held
            held, n = [], 0
        held.append((row["words"], [(t["word"], t["idf"]) for t in row["terms"]]))
        n += len(row["terms"])
    if held:
        yield held


def _scorer(block: list[tuple], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of chunks against a block of lists of words; the best k of each list in this task.

    Word by word, in their order, so a sum has its parts in the same order in every run.
    """
    asks: dict[str, list[tuple[int, float]]] = {}
    for i, (_, terms) in enumerate(block):
        for word, idf in terms:
            asks.setdefault(word, []).append((i, idf))
    asks_ = {w: (np.array([i for i, _ in x]), np.array([v for _, v in x])) for w, x in asks.items()}
    names = [words for words, _ in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in names]
        floor = np.zeros(len(names))  # a full list's least score
        full = np.zeros(len(names), bool)
        kind = None
        step = max(1, min(CHUNKS_AT_ONCE, SCORES_AT_ONCE // len(names)))
        for batch in batches:
            kind = batch["chunk_id"].type
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part["chunk_id"].to_pylist()
                where: dict[str, tuple[list[int], list[float]]] = {}
                for c, key in enumerate(part["key"].to_pylist()):
                    for word, tf in Counter(key.split(" ")).items():
                        if word in asks_:
                            own = where.setdefault(word, ([], []))
                            own[0].append(c)
                            own[1].append(1 + math.log(tf))
                total = np.zeros((len(names), len(ids)))
                hit = np.zeros((len(names), len(ids)), bool)
                for word in sorted(where):
                    (i, idf), (c, tf) = asks_[word], where[word]
                    at = (i[:, None], np.array(c)[None, :])
                    total[at] += idf[:, None] * np.array(tf)[None, :]
                    hit[at] = True
                total = np.round(total, 6)
                hit &= ~full[:, None] | (total >= floor[:, None])
                for i in np.flatnonzero(hit.any(1)).tolist():
                    at = np.flatnonzero(hit[i])
                    best[i] = heapq.nsmallest(k, best[i] + [(-s, ids[c]) for s, c in zip(total[i, at].tolist(), at.tolist(), strict=True)])
                    if len(best[i]) == k:
                        full[i], floor[i] = True, -best[i][-1][0]
        rows = [(w, c, -s) for w, own in zip(names, best, strict=True) for s, c in own]
        for start in range(0, len(rows), 100_000):
            w, c, s = zip(*rows[start : start + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c, kind), pa.array(s, pa.float64())], ["words", "chunk_id", "score"])

    return run


def rerank(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results (question_id, chunk_id, title, text, vector_score) with rerank_score and a new rank; other columns stay."""
    rows = results.join(questions, "question_id").withColumns({"kind": question_type(F.col("question")), "focus": match_key(focus_phrase(F.col("question"))), "t": match_key(F.col("title")), "x": match_key(F.col("text"))})
    add = lambda condition, value: F.when(condition, F.lit(value)).otherwise(0.0)
    intro = F.substring("x", 1, 300)
    holds = lambda suffix: F.contains(intro, F.concat("focus", F.lit(suffix)))
    # fixed values
    about = F.when(F.col("t") == F.col("focus"), 0.5).when(F.contains("t", F.col("focus")), 0.3).otherwise(0.0) + add(F.startswith("x", F.col("focus")), 0.4)
    about = about + add(holds(" is "), 0.35) + add(holds(" was "), 0.25)
    total = F.col("vector_score") + F.when(F.col("kind").isin("identity", "episode_summary"), about).otherwise(0.0) + add((F.col("focus") != "") & F.contains("x", F.col("focus")), 0.1)
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), "chunk_id")
    once = rows.withColumn("rerank_score", F.round(total, 6)).dropDuplicates(["question_id", "title", "chunk_id"])
    return once.withColumn("rank", F.row_number().over(order)).select(*[c for c in results.columns if c not in ("rank", "rerank_score")], "rerank_score", "rank")


def evidence(questions: DataFrame, text_results: DataFrame, fact_rows: DataFrame, found: DataFrame | None = None, triples: DataFrame | None = None, n_text: int = 6, n_facts: int = 12) -> DataFrame:
    """One row a question: question_type, matched_entities, text_evidence, kg_evidence, as arrays of structs.

    text_results: question_id, chunk_id, text, rank, a score (rerank_score or score), and title and url if they are known.
    With ``found`` (question_id, uri, rank) and ``triples``, matched entities come with label and class.
    """
    score = "rerank_score" if "rerank_score" in text_results.columns else "score"
    there = lambda c: F.col(c).cast("string") if c in text_results.columns else F.lit(None).cast("string")
    text = F.struct("rank", F.col(score).alias("score"), there("title").alias("title"), there("url").alias("url"), F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    texts = text_results.where(F.col("rank") <= n_text).groupBy("question_id").agg(F.array_sort(F.collect_list(text)).alias("text_evidence"))
    fact = F.struct("rank", "score", "fact_text", "subject_class", "object_class", "subject_uri", "predicate_uri", "predicate_label", "object_uri", "object_label")
    known = fact_rows.where(F.col("rank") <= n_facts).groupBy("question_id").agg(F.array_sort(F.collect_list(fact)).alias("kg_evidence"))
    out = questions.withColumn("question_type", question_type(F.col("question")))
    if found is not None and triples is not None:
        named = found.where(~F.contains("uri", F.lit("/sameAs/"))).join(spread(best_labels(triples)), "uri", "left").join(spread(classes(triples)), "uri", "left")
        named = named.select("question_id", F.struct("rank", "uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), F.coalesce("class", F.lit("Unknown")).alias("class")).alias("e"))
        out = out.join(spread(named.groupBy("question_id").agg(F.array_sort(F.collect_list("e")).alias("matched_entities"))), "question_id", "left")
        out = out.withColumn("matched_entities", F.coalesce("matched_entities", F.array().cast("array<struct<rank:int,uri:string,label:string,class:string>>")))
    out = out.join(spread(texts), "question_id", "left").join(spread(known), "question_id", "left")
    types = {c: d.schema[c].dataType for d, c in ((texts, "text_evidence"), (known, "kg_evidence"))}
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in types.items()})


# ---------------------------------------------------------------- answers
_FACT = r"^(.*?)\s+--(.*?)-->\s+(.*?)$"

#: Predicates and objects that no answer tells, and how a generic answer words a predicate.
UNTOLD_PREDICATES = ("altlabel", "languagespoken", "occupation")
UNTOLD_OBJECTS = ("q1860", "q10873124", "q15360275")
WORDING = {"type": "is a", "presentinwork": "appears in", "creator": "was created by", "performer": "is performed or portrayed by", "instanceof": "is an instance of", "partofseries": "is part of the series", "director": "was directed by"}


def keep_order(a: Column) -> Column:
    """The distinct strings (case and outer spaces ignored) in the order they come; blank ones go."""
    low = F.transform(a, lambda x: F.lower(F.trim(x)))
    return F.filter(a, lambda x, i: (F.trim(x) != "") & (F.array_position(low, F.lower(F.trim(x))) == i + 1))


def told_facts(kg: Column, most: int) -> Column:
    """The facts an answer may tell, each once, as structs s, p, o: the parts of their texts, p lower-cased too."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    useful = F.filter(kg, lambda f: ~low(f["predicate_label"]).isin(*UNTOLD_PREDICATES) & ~low(f["object_label"]).isin(*UNTOLD_OBJECTS))
    once = keep_order(F.transform(useful, lambda f: f["fact_text"]))
    parts = F.filter(F.slice(once, 1, most), lambda t: F.rlike(t, F.lit(_FACT)))
    piece = lambda t, i: F.trim(F.regexp_extract(t, _FACT, i))
    return F.transform(parts, lambda t: F.struct(piece(t, 1).alias("s"), piece(t, 2).alias("label"), F.lower(piece(t, 2)).alias("p"), piece(t, 3).alias("o")))


def answers(packs: DataFrame, about: str = "series", work: str = "the series") -> DataFrame:
    """``packs`` with an answer by templates, one for each type of question.

    work: the series that episode answers name. Every answer tells nothing but the pack's facts and texts.
    """
    of = lambda facts_, *ps: keep_order(F.transform(F.filter(facts_, lambda f: f["p"].isin(*ps)), lambda f: f["o"]))
    first = lambda a: F.get(a, F.lit(0))
    told = {f"told{n}": told_facts(F.col("kg_evidence"), n) for n in (5, 6, 8)}
    rows = packs.withColumns({"focus": focus_phrase(F.col("question")), **told})
    rows = rows.withColumns({"works": of(F.col("told8"), "presentinwork"), "creators": of(F.col("told8"), "creator"), "kinds": F.concat(of(F.col("told8"), "type"), of(F.col("told8"), "instanceof"))})
    rows = rows.withColumn("actors", F.filter(of(F.col("told8"), "performer", "portrays"), lambda x: F.lower(x) != F.lower(F.col("focus"))))
    kind = F.lower(first(F.filter("kinds", lambda c: F.contains(F.lower(c), F.lit("character")) | F.contains(F.lower(c), F.lit("fictional")))))
    work_ = first(F.col("works"))
    n = F.size("actors")
    listed = F.when(n == 1, first(F.col("actors"))).otherwise(F.concat(F.array_join(F.slice("actors", 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at("actors", -1)))
    lead_title = match_key(F.get("text_evidence", F.lit(0))["title"])
    some = lambda condition, text: F.when(condition, text).otherwise("")
    joined = lambda *texts: F.array_join(keep_order(F.array(*texts)), " ")
    identity = joined(
        F.when(work_.isNotNull() & kind.isNotNull(), F.concat("focus", F.lit(" is a "), kind, F.lit(" in *"), work_, F.lit("*.")))
        .when(work_.isNotNull(), F.concat("focus", F.lit(" is associated with *"), work_, F.lit("*.")))
        .when(kind.isNotNull(), F.concat("focus", F.lit(" is a "), kind, F.lit(".")))
        .otherwise(F.concat("focus", F.lit(" is a character."))),
        some(F.size("creators") > 0, F.concat(F.lit("The character was created by "), first(F.col("creators")), F.lit("."))),
        some(n > 0, F.concat(F.lit("In screen adaptations, "), "focus", F.lit(" is performed or portrayed by "), listed, F.lit("."))),
        some(lead_title == match_key(F.col("focus")), F.lit(f"The retrieved source passages also show that this character is central to the narrative and closely connected to major events and relationships in the {about}.")),
    )
    cast = first(F.filter("told8", lambda f: f["p"].isin("portrays", "performer")))
    portrayal = F.when(cast["p"] == "portrays", F.concat(cast["o"], F.lit(" is portrayed by "), cast["s"], F.lit("."))).when(cast["p"] == "performer", F.concat("focus", F.lit(" is performed or portrayed by "), cast["o"], F.lit("."))).otherwise("I could not find a high-confidence portrayal relation in the retrieved evidence.")
    seen = F.filter("told8", lambda f: f["p"].isin("appearsinepisode", "partofseries"))
    lines = keep_order(F.transform(seen, lambda f: F.when(f["p"] == "appearsinepisode", F.concat(f["s"], F.lit(" appears in the episode "), f["o"], F.lit("."))).otherwise(F.concat(f["s"], F.lit(" is part of the series "), f["o"], F.lit(".")))))
    membership = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 3), " ")).otherwise("I could not find a direct episode-related fact in the retrieved evidence.")
    known = F.filter("told6", lambda f: f["p"].isin("partofseries", "director", "originalbroadcaster"))
    about_it = F.transform(known, lambda f: F.when(f["p"] == "partofseries", F.concat(F.lit("It is part of the series *"), f["o"], F.lit("*."))).when(f["p"] == "director", F.concat(F.lit("It was directed by "), f["o"], F.lit("."))).otherwise(F.concat(F.lit("It was released on "), f["o"], F.lit("."))))
    piece = F.trim(F.substring(normalize_spaces(F.get("text_evidence", F.lit(0))["text"]), 1, 500))
    opening = F.concat(F.lit("*"), "focus", F.lit(f"* is an episode of *{work}*."))
    summary = F.array_join(keep_order(F.concat(F.array(opening), about_it, F.array(some(piece != "", F.concat(F.lit("According to the retrieved episode page, "), piece))))), " ")
    words = F.create_map(*[F.lit(x) for pair in WORDING.items() for x in pair])
    generic_lines = keep_order(F.transform("told5", lambda f: F.concat_ws(" ", f["s"], F.coalesce(words[f["p"]], f["label"]), F.concat(f["o"], F.lit(".")))))
    generic = F.when(F.size(generic_lines) > 0, F.array_join(F.slice(generic_lines, 1, 4), " ")).otherwise("I could not generate a grounded answer from the retrieved evidence.")
    by_type = {"identity": identity, "portrayal": portrayal, "episode_membership": membership, "episode_summary": summary}
    answer = generic
    for name, text in by_type.items():
        answer = F.when(F.col("question_type") == name, text).otherwise(answer)
    return rows.withColumn("answer", answer).select(*packs.columns, "answer")


def sources(n_text: int = 6, n_facts: int = 4) -> Column:
    """A pack's sources as structs id, type, title, url, domain, snippet, fact, score: S1.. for texts (one a url), then K1.. for facts."""
    none = F.lit(None).cast("string")
    texts = F.filter(F.slice("text_evidence", 1, n_text), lambda e: F.trim(F.coalesce(e["url"], F.lit(""))) != "")
    urls = F.transform(texts, lambda e: F.trim(e["url"]))
    texts = F.filter(texts, lambda e, i: F.array_position(urls, F.trim(e["url"])) == i + 1)
    facts_ = F.filter(F.slice("kg_evidence", 1, n_facts), lambda e: F.trim(e["fact_text"]) != "")
    host = lambda u: F.replace(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    row = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    text = F.transform(texts, lambda e, i: row(id=F.concat(F.lit("S"), (i + 1).cast("string")), type=F.lit("text"), title=F.trim(F.coalesce(e["title"], F.lit("Untitled source"))), url=F.trim(e["url"]), domain=host(F.trim(e["url"])), snippet=F.trim(F.substring(normalize_spaces(e["text"]), 1, 220)), fact=none, score=F.round(e["score"], 3)))
    fact = F.transform(facts_, lambda e, i: row(id=F.concat(F.lit("K"), (i + 1).cast("string")), type=F.lit("kg"), title=F.lit("Knowledge Graph"), url=none, domain=none, snippet=none, fact=F.trim(e["fact_text"]), score=F.round(e["score"], 3)))
    return F.concat(text, fact)


def source_rows(packs: DataFrame, n_text: int = 6, n_facts: int = 4) -> DataFrame:
    """(question_id, id, type, title, url, domain, snippet, fact, score)."""
    return packs.select("question_id", F.explode(sources(n_text, n_facts)).alias("source")).select("question_id", "source.*")


def ask(questions: DataFrame, triples: DataFrame, chunks: DataFrame, results: DataFrame | None = None, model: Callable[[DataFrame], DataFrame] | None = None, weights: FactWeights | None = None) -> DataFrame:
    """The whole way for each question: its pack with an answer and sources (array).

    chunks: chunk_id, text, and title, url if known. results: dense results (question_id, chunk_id, vector_score);
    without them texts are found by their words. model: takes prompts (question_id, prompt) and gives (question_id, reply);
    where it gives none, or is none, the template answers.
    """
    found = match_entities(questions, label_index(triples))
    if results is None:
        texts = lexical_retrieve(questions, chunks.select("chunk_id", "text"), 6).join(spread(chunks), "chunk_id")
    else:
        known = results.join(spread(chunks), "chunk_id")
        texts = rerank(known if "title" in chunks.columns else known.withColumn("title", F.lit("")), questions)
    packs = answers(evidence(questions, texts, facts(questions, triples, weights=weights, found=found), found, triples))
    if model is not None:
        replies = model(prompts(packs)).select("question_id", F.nullif(F.trim("reply"), F.lit("")).alias("reply"))
        packs = packs.join(replies, "question_id", "left").withColumn("answer", F.coalesce("reply", "answer")).drop("reply")
    return packs.withColumn("sources", sources())


def route(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, uri, kind, sparql): the graph query for each matched entity: its types, or ten of its facts."""
    q = match_key(F.col("question"))
    rows = questions.join(spread(found.where(~F.contains("uri", F.lit("/sameAs/"))).select("question_id", "uri")), "question_id")
    kind = F.when(q.startswith("who is") | q.startswith("what is"), "types").otherwise("facts")
    types = F.concat(F.lit("SELECT ?type WHERE {\n    <"), "uri", F.lit("> rdf:type ?type .\n}"))
    some = F.concat(F.lit("SELECT ?p ?o WHERE {\n    <"), "uri", F.lit("> ?p ?o .\n}\nLIMIT 10"))
    rows = rows.withColumn("kind", kind)
    return rows.select("question_id", "uri", "kind", F.when(F.col("kind") == "types", types).otherwise(some).alias("sparql"))


def run_routes(routes: DataFrame, triples: DataFrame, most: int = 10) -> DataFrame:
    """(question_id, uri, p, o): what the routed queries give; of facts the first ``most`` by (p, o)."""
    asked = routes.select("uri", "kind").distinct()
    rows = triples.join(spread(asked.withColumnRenamed("uri", "s")), "s").where("kind = 'facts' or p = '" + TYPE + "'").select(F.col("s").alias("uri"), "kind", "p", "o").distinct()
    order = Window.partitionBy("uri", "kind").orderBy("p", "o")
    rows = rows.withColumn("turn", F.row_number().over(order)).where((F.col("kind") == "types") | (F.col("turn") <= most))
    return routes.select("question_id", "uri", "kind").join(spread(rows), ["uri", "kind"]).select("question_id", "uri", "p", "o")


def prompts(packs: DataFrame) -> DataFrame:
    """A language model's prompt for each evidence pack; calling a model is left to the caller."""
    numbered = lambda c, f: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e[f])), "\n")
    text = F.concat(F.lit("Answer only from the evidence.\n\nFacts:\n"), numbered("kg_evidence", "fact_text"), F.lit("\n\nTexts:\n"), numbered("text_evidence", "text"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nAnswer:"))
    return packs.select("question_id", text.alias("prompt"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """Rows (answer, reference) with overlap, the share of the reference's words in the answer, and a grade of 0 to 3."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != ""))
    overlap = F.size(F.array_intersect(words("answer"), words("reference"))) / F.greatest(F.size(words("reference")), F.lit(1))
    rows = answers.withColumn("overlap", overlap)
    return rows.withColumn("grade", F.when(F.col("overlap") > 0.35, 3).when(F.col("overlap") > 0.20, 2).when(F.col("overlap") > 0.08, 1).otherwise(0))


def compare_systems(answers_: DataFrame) -> DataFrame:
    """Rows (system, answer, reference) to one row a system: n, mean_overlap, mean_grade, n_full (answers of the best grade)."""
    graded = answer_scores(answers_)
    return graded.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.avg("grade"), 6).alias("mean_grade"), F.sum((F.col("grade") == 3).cast("long")).alias("n_full"))
