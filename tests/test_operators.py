"""Operators that SQL can't express, against plain Python."""

import difflib
import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import abox, chunking, entities, expansion, extract, kge, linking, retrieval, rules, triples, vectors
from graphloom.operators.components import connected_components
from graphloom.sources import files
from graphloom.streaming import streams


# ---------------------------------------------------------------- text
def test_text_functions(spark):
    rows = [("  The “Big”  Cat (film) ", "http://x/y#a/b"), (None, "http://x/y_z"), ("L’Été-à b!", "plain")]
    got = spark.createDataFrame(rows, "a string, u string").select(T.normalize_label(F.col("a")), T.canonical_label(F.col("a")), T.ascii_key(F.col("a")), T.match_key(F.col("a")), T.local_name(F.col("u")), T.slug(F.coalesce("a", F.lit("!")))).collect()
    assert [tuple(r) for r in got] == [
        ('The "Big" Cat (film)', "The Big Cat", "the big cat", "the big cat film", "a/b", "the_big_cat_film"),
        ("", "", "", "", "y_z", "unknown"),
        ("L'Été-à b!", "L'Été-à b!", "l' t - b", "l' t - b", "plain", "l_t_b"),
    ]
    ids = spark.range(1).select(T.entity_id(F.lit("CHARACTER"), F.lit("Ann Lee"))).first()[0]
    import hashlib

    assert ids == "CHARACTER:ann_lee-" + hashlib.sha1(b"CHARACTER:Ann Lee").hexdigest()[:6]


# ---------------------------------------------------------------- chunks
def plain_chunks(text, size, overlap):
    text = re.sub(r"\s+", " ", text or "").strip()
    done, held, n = [], [], 0
    for s in [x for x in re.split(r"(?<=[.!?])\s+", text) if x]:
        k = len(s.split())
        if held and n + k > size:
            done.append(" ".join(held))
            tail = done[-1].split()[-overlap:] if overlap else []
            held, n = ([" ".join(tail)] if tail else []), len(tail)
        held.append(s)
        n += k
    return done + ([" ".join(held)] if held else [])


@pytest.mark.parametrize("overlap", [0, 4])
def test_chunks(spark, overlap):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "bb", "ccc.", "d!", "e?\n"]) for _ in range(n)) for n in (0, 1, 5, 40, 400)] + [None, "  ", "one long sentence without an end " * 9]
    got = chunking.chunks(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", 12, overlap).collect()
    want = [(f"{i}::chunk_{j}", str(i), j, c, len(c.split())) for i, t in enumerate(texts) for j, c in enumerate(plain_chunks(t, 12, overlap))]
    assert sorted(map(tuple, got)) == sorted(want)
    short = chunking.chunks(spark.createDataFrame([(1, "a. " + "b " * 20)], "id long, t string"), "id", "t", 5, 0, least=3).collect()
    assert [r["chunk_index"] for r in short] == [1]


# ---------------------------------------------------------------- entities
def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and {x for e in edges for x in e if e[0] != e[1]} == set(got)


NAMES = ["Benjamin Watts", "Benjamin Wats", "Benjamin Wattss", "Ann Lee", "Ann Leee", "Annn Lee", "Methuen Home School", "Methuen Home Schol", "Lee", "Lee (film)", "Watts", "IBM", "ibm labs", "Anna", "Annab", "The Long Name Of A Place In The North", "The Long Name Of A Place In The Nort", "The Longg Name Of A Place In The Norh"]


def test_similar_names_find_every_pair(spark):
    r = random.Random(5)
    names = set(NAMES)
    for _ in range(150):
        x = list(r.choice(NAMES))
        for _ in range(r.randint(1, 3)):
            i = r.randrange(len(x))
            x[i : i + 1] = r.choice([[], [r.choice("abe")], [x[i], r.choice("xyz")]])
        names.add("".join(x).strip() or "x")
    fit = [n for n in names if "(" not in n and not (len(re.findall(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?", n)) == 1 and len(n) < 5)]
    alike = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.94
    want = {(a, b) for a, b in itertools.combinations(sorted(fit), 2) if abs(len(a) - len(b)) <= 3 and alike(a, b)}
    got = {(r["a"], r["b"]) for r in entities.similar_names(spark.createDataFrame([("P", n) for n in names], "entity_class string, name string")).collect()}
    assert got == want


def test_resolution(spark):
    rows = [("P", "Benjamin Watts", 9), ("P", "Benjamin Wats", 1), ("P", "Watts", 4), ("P", "Ann Lee", 3), ("P", "Lee", 5), ("P", "IBM", 2), ("P", "Big IBM", 7), ("Q", "Lee", 1)]
    m = spark.createDataFrame([(*r, f"u{r[2]}", [r[1], " x "], "lab", "REAL_WORLD" if r[2] == 1 else None) for r in rows], "entity_class string, canonical_text string, mention_count long, url string, aliases array<string>, entity_label string, page_context string")
    resolved, aliases = entities.resolve_entities(m)
    got = {(r["entity_class"], r["canonical_text"]): (r["total_count"], r["page_context"]) for r in resolved.collect()}
    assert got == {("P", "Benjamin Watts"): (14, "REAL_WORLD"), ("P", "Ann Lee"): (8, "IN_UNIVERSE"), ("P", "IBM"): (2, "IN_UNIVERSE"), ("P", "Big IBM"): (7, "IN_UNIVERSE"), ("Q", "Lee"): (1, "REAL_WORLD")}
    names = {(r["entity_class"], r["alias"]): r["canonical_text"] for r in aliases.collect()}
    assert names["P", "Watts"] == names["P", "Benjamin Wats"] == "Benjamin Watts" and names["P", "Lee"] == "Ann Lee" and names["Q", "Lee"] == "Lee" and len(names) == len(rows)


def test_cleaning(spark):
    e = spark.createDataFrame([("P", "Ann", 2, ["u"], ["a"]), ("P", "Anne", 1, ["v"], []), ("P", "Unknown", 5, [], []), ("P", "Paris", 1, [], [])], "entity_class string, canonical_text string, total_count long, urls array<string>, aliases array<string>")
    clean = entities.clean_entities(e, drop=["unknown"], rename={"Anne": "Ann"}, reclass={"Paris": "PLACE"})
    assert {(r["entity_class"], r["canonical_text"], r["total_count"], tuple(r["urls"])) for r in clean.collect()} == {("P", "Ann", 3, ("u", "v")), ("PLACE", "Paris", 1, ())}
    rel = spark.createDataFrame([("Ann", "MET", "Bob", 0.5), ("Ann", "MET", "Bob", 0.9), ("Ann", "MET", "Paris", 0.9), ("Ann", "MET", "Ann ", 1.0), ("Unknown", "MET", "Bob", 1.0), ("Ann", "SAW", "Paris", 0.3)], "subject string, relation string, object string, confidence double")
    rel = rel.withColumns({"subject_id": F.lit("s"), "object_id": F.concat(F.lit("o"), "object"), "subject_class": F.lit("P"), "object_class": F.lit("P")})
    got = entities.clean_relations(rel, clean, drop=["Unknown"], objects={"MET": ["P"]})
    assert {(r["subject"], r["relation"], r["object"], r["confidence"]) for r in got.collect()} == {("Ann", "MET", "Bob", 0.9), ("Ann", "SAW", "Paris", 0.3)}


# ---------------------------------------------------------------- linking
def test_linking(spark):
    e = spark.createDataFrame([("u1", "The Ann Mary Lee", "http://x#Character"), ("u2", "Paris (city)", "http://x#Location"), ("u3", "Nobody", "http://x#Character")], "uri string, label string, type string")
    c = spark.createDataFrame([("Q1", "Ann Mary Lee", "fictional character"), ("Q2", "The Lee", "village"), ("Q3", "Paris", "capital city"), ("Q4", "Paris", "village in Texas")], "qid string, label string, description string")
    scored = linking.score(linking.candidates(e, c), {"Location": linking.Hints(good=("capital",), bad=("village",)), "Character": linking.Hints(good=("fictional",))})
    best = {r["uri"]: (r["qid"], round(r["confidence"], 4)) for r in linking.best_links(scored, 0.5).collect()}
    assert best["u2"] == ("Q3", round(0.82 + 0.08 + 0.2 * 0.12 + 0.06 - 0.07, 4)) and best["u1"][0] == "Q1" and "u3" not in best
    forms = e.select(linking.search_variants(F.col("label"), T.local_name(F.col("type"))).alias("v")).collect()
    assert forms[0]["v"] == ["The Ann Mary Lee", "Ann Mary Lee", "The Lee"] and forms[1]["v"] == ["Paris"]


# ---------------------------------------------------------------- rules, expansion
def test_closure_and_rules(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n7"), ("x", "x")]
    got = {tuple(r) for r in rules.closure(spark.createDataFrame(edges, "s string, o string")).collect()}
    want, new = set(edges), set(edges)
    while new:
        new = {(a, d) for a, b in want for c, d in edges if b == c} - want
        want |= new
    assert got == want
    facts = spark.createDataFrame([("a", "beat", "b", "iri"), ("b", "beat", "c", "iri"), ("c", "beat", "a", "iri"), ("a", "is", "P", "iri")], "s string, p string, o string, o_kind string")
    rival = rules.Rule(("?x", "rival", "?z"), (("?x", "is", "P"), ("?x", "beat", "?y"), ("?y", "beat", "?z")), differ=(("?x", "?z"),))
    back = rules.Rule(("?z", "rival", "?x"), (("?x", "rival", "?z"),))
    assert {tuple(r)[:3] for r in rules.infer(facts, [rival, back]).collect()} == {("a", "rival", "c"), ("c", "rival", "a")}
    with pytest.raises(ValueError):
        rules.infer(facts, [rules.Rule(("?x", "q", "?z"), (("?x", "is", "P"), ("?y", "beat", "?z")))])
    ax = rules.Axioms(symmetric=("near",), inverse={"beat": "lostTo"}, sub_property={"beat": "met"})
    got = {tuple(r)[:3] for r in rules.entail(facts, ax).collect()}
    assert {("b", "lostTo", "a"), ("a", "met", "b")} < got and len(got) == 10


def test_expansion(spark):
    claims = spark.createDataFrame([("a", "p", "b", "iri"), ("b", "q", "c", "iri"), ("b", "p", "d", "iri"), ("d", "p", "a", "iri"), ("d", "p", "e", "iri"), ("a", "l", "x" * 300, "lit"), ("a", "l", "ok", "lit")], "s string, p string, o string, o_kind string")
    seeds = spark.createDataFrame([("a",)], "uri string")
    assert {tuple(r) for r in expansion.expand(claims, seeds, hops=2).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert {r["uri"] for r in expansion.expand(claims, seeds, hops=9, through=["p"]).collect()} == {"a", "b", "d", "e"}
    assert [r["uri"] for r in expansion.expand(claims, seeds, 3, max_entities=2).collect()] == ["a", "b"]
    assert expansion.expanded_triples(claims, seeds).count() == 3 and expansion.cap_claims(claims, 1).where("s = 'a'").count() == 2


# ---------------------------------------------------------------- vectors, link prediction
def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (3, 100):
        got = sorted(map(tuple, vectors.top_k(df.where("vec_id % 50 = 3"), df, 5, exclude_self=True, block=block).select("query_id", "rank", "id").collect()))
        want = []
        for q in range(3, 300, 50):
            s = np.round(n @ n[q], 9)
            order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
            want += [(q, r + 1, int(i)) for r, i in enumerate(order)]
        assert got == sorted(want)
    assert vectors.top_k(df.limit(0), df, 5).count() == 0


@pytest.mark.parametrize("model", ["transe", "distmult", "complex"])
def test_ranks(spark, model):
    rng = np.random.default_rng(1)
    names = [f"e{i}" for i in range(30)]
    e = {x: rng.normal(size=8) for x in names}
    r = {x: rng.normal(size=8) for x in ("r0", "r1")}
    e["e5"] = e["e4"].copy()
    known = {(names[a], f"r{c % 2}", names[b]) for a, b, c in rng.integers(0, 30, (80, 3))}
    test = sorted(known)[:12]
    table = lambda d: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], "id string, vector array<double>")
    frame = lambda t: spark.createDataFrame(list(t), "head string, relation string, tail string")
    got = {tuple(x)[:4]: x["rank"] for x in kge.ranks(frame(test), table(e), table(r), frame(known), model).collect()}
    for h, p, t in test:
        for side in ("head", "tail"):
            true = float(kge.scores(e[h], r[p], e[t], model))
            others = [float(kge.scores(e[x], r[p], e[t], model) if side == "head" else kge.scores(e[h], r[p], e[x], model)) for x in names if ((x, p, t) if side == "head" else (h, p, x)) not in known or x == (h if side == "head" else t)]
            tie = [abs(s - true) <= 1e-9 * abs(true) + 1e-12 for s in others]
            assert got[h, p, t, side] == sum(s > true and not b for s, b in zip(others, tie, strict=True)) + (sum(tie) + 1) / 2
    row = spark.createDataFrame([(e["e1"].tolist(), r["r0"].tolist(), e["e2"].tolist())], "h array<double>, r array<double>, t array<double>").select(kge.score(F.col("h"), F.col("r"), F.col("t"), model)).first()[0]
    assert abs(row - float(kge.scores(e["e1"], r["r0"], e["e2"], model))) < 1e-9


@pytest.mark.parametrize("model", ["transe", "distmult", "complex"])
def test_training_learns(spark, model):
    links = [(f"a{i}", "likes", f"b{i % 4}") for i in range(40)] + [(f"b{i}", "near", f"b{(i + 1) % 4}") for i in range(4)]
    df = spark.createDataFrame(links, "head string, relation string, tail string")
    test = df.where("relation = 'likes'").limit(10)
    run = lambda n: kge.rank_metrics(kge.ranks(test, *kge.train(df, model, dim=8, rounds=n, rate=0.1), df, model)).first()["mrr"]
    assert run(25) > max(0.3, run(0))


def test_training_in_blocks(spark):
    """Three blocks: every entity keeps one vector, every pair of blocks meets, and it learns."""
    links = [(f"a{i}", "likes", f"b{i % 4}") for i in range(40)] + [(f"b{i}", "near", f"b{(i + 1) % 4}") for i in range(4)]
    df = spark.createDataFrame(links, "head string, relation string, tail string")
    test = df.where("relation = 'likes'").limit(10)
    e, r = kge.train(df, "distmult", dim=8, rounds=8, rate=0.3, block_entities=15)
    rows = e.collect()
    assert len(rows) == len({x["id"] for x in rows}) == 44 and {x["id"] for x in r.collect()} == {"likes", "near"}
    again = {x["id"]: x["vector"] for x in kge.train(df.repartition(3), "distmult", dim=8, rounds=8, rate=0.3, block_entities=15)[0].collect()}
    assert all(np.allclose(x["vector"], again[x["id"]]) for x in rows)
    start = kge.rank_metrics(kge.ranks(test, *kge.train(df, "distmult", dim=8, rounds=0), df, "distmult")).first()["mrr"]
    assert kge.rank_metrics(kge.ranks(test, e, r, df, "distmult")).first()["mrr"] > max(0.3, start)
    small = sorted(map(tuple, kge.ranks(test, e, r, df, "distmult", block=3).collect()))
    assert small == sorted(map(tuple, kge.ranks(test, e, r, df, "distmult").collect()))


# ---------------------------------------------------------------- questions
def test_questions_and_evidence(spark):
    q = spark.createDataFrame([(1, "Who is Ann Lee?"), (2, "What happens in Fork"), (3, "who portrays Ann Lee"), (4, "zz")], "question_id long, question string")
    kinds = q.select("question_id", retrieval.question_type(F.col("question")), retrieval.focus_phrase(F.col("question"))).orderBy("question_id").collect()
    assert [tuple(r)[1:] for r in kinds] == [("identity", "Ann Lee"), ("episode_summary", "What happens in Fork"), ("portrayal", "who portrays Ann Lee"), ("generic", "zz")]
    g = spark.createDataFrame([("http://x/ann", triples.LABEL, "Ann Lee", "lit"), ("http://x/ann", triples.TYPE, "http://x/Character", "iri"), ("http://x/bob", "http://x/portrays", "http://x/ann", "iri"), ("http://x/ann", "http://x/met", "http://x/bob", "iri"), ("http://x/ann", "http://x/confidence", "1", "lit")], "s string, p string, o string, o_kind string")
    facts = retrieval.facts(q, g).orderBy("question_id", "rank").collect()
    want = [(1, "Ann Lee --type--> Character", 6.0), (1, "bob --portrays--> Ann Lee", 5.2), (1, "Ann Lee --met--> bob", -0.3), (3, "bob --portrays--> Ann Lee", 6.2), (3, "Ann Lee --type--> Character", 1.2), (3, "Ann Lee --met--> bob", 1.2)]
    assert [(r["question_id"], r["fact_text"], r["score"]) for r in facts] == want
    c = spark.createDataFrame([("c1", "T", "Ann Lee is a player. " * 3, 0.1), ("c2", "Ann Lee", "someone else", 0.3), ("c3", "", "nothing", 0.7)], "chunk_id string, title string, text string, vector_score double")
    ranked = retrieval.rerank(c.crossJoin(q.where("question_id = 1").select("question_id")), q).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in ranked] == [("c1", 0.95), ("c2", 0.8), ("c3", 0.7)]
    found = retrieval.match_entities(q, retrieval.label_index(g))
    packs = retrieval.answers(retrieval.evidence(q, retrieval.lexical_retrieve(q, c).join(c, "chunk_id"), retrieval.facts(q, g), found, g)).orderBy("question_id").collect()
    assert [r["answer"] for r in packs] == [
        "Ann Lee is a character.",
        "*What happens in Fork* is an episode of *the series*.",
        "Ann Lee is portrayed by bob.",
        "I could not generate a grounded answer from the retrieved evidence.",
    ]
    assert [(e["label"], e["class"]) for e in packs[0]["matched_entities"]] == [("Ann Lee", "Character")] and packs[3]["matched_entities"] == []
    prompt = retrieval.prompts(retrieval.evidence(q, retrieval.lexical_retrieve(q, c).join(c, "chunk_id"), retrieval.facts(q, g))).where("question_id = 1").first()["prompt"]
    assert "[2] bob --portrays--> Ann Lee" in prompt and prompt.endswith("Question: Who is Ann Lee?\nAnswer:")


def test_asking(spark):
    q = spark.createDataFrame([(1, "Who is Ann Lee?"), (2, "zz")], "question_id long, question string")
    g = spark.createDataFrame([("http://x/ann", triples.LABEL, "Ann Lee", "lit"), ("http://x/ann", triples.TYPE, "http://x/FictionalHero", "iri"), ("http://x/ann", "http://x/P1441", "A Book", "lit"), ("http://x/ann", "http://x/creator", "Bob", "lit"), ("http://x/ann", "http://x/performer", "C", "lit"), ("http://x/ann", "http://x/performer", "D", "lit")], "s string, p string, o string, o_kind string")
    c = spark.createDataFrame([("c1", "Ann Lee", "Ann Lee plays. " * 3, "http://www.a.b/x"), ("c2", None, "Ann again", "http://www.a.b/x"), ("c3", "T", "Lee", None)], "chunk_id string, title string, text string, url string")
    out = {r["question_id"]: r for r in retrieval.ask(q, g, c).collect()}
    assert out[1]["answer"] == "Ann Lee is a fictionalhero in *A Book*. The character was created by Bob. In screen adaptations, Ann Lee is performed or portrayed by C and D. The retrieved source passages also show that this character is central to the narrative and closely connected to major events and relationships in the series."
    sources = [(s["id"], s["type"], s["domain"]) for s in out[1]["sources"]]
    assert sources == [("S1", "text", "a.b"), *[(f"K{i}", "kg", None) for i in range(1, 5)]] and out[2]["sources"] == []
    replies = lambda prompts: prompts.select("question_id", F.when(F.col("question_id") == 2, "a model's words").alias("reply"))
    out = {r["question_id"]: r["answer"] for r in retrieval.ask(q, g, c, model=replies).collect()}
    assert out[2] == "a model's words" and out[1].startswith("Ann Lee is a fictionalhero")
    routes = retrieval.route(q, retrieval.match_entities(q, retrieval.label_index(g))).collect()
    assert [(r["question_id"], r["kind"]) for r in routes] == [(1, "types")] and "rdf:type" in routes[0]["sparql"]


def test_matches_are_substrings_however_long(spark):
    r = random.Random(2)
    labels = {"".join(r.choice("ab c") for _ in range(r.randint(1, 9))).strip() for _ in range(60)} - {""}
    asked = ["".join(r.choice("ab c") for _ in range(r.randint(0, 40))) for _ in range(30)]
    index = spark.createDataFrame([(" ".join(x.split()), f"u{i}") for i, x in enumerate(sorted(labels))], "label_norm string, uri string")
    q = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    got = {(x["question_id"], x["uri"], x["size"]) for x in retrieval.match_entities(q, index, k=100).collect()}
    want = {(i, u, len(n)) for i, t in enumerate(asked) for n, u in index.collect() if len(n) >= 3 and n in " ".join(t.split())}
    assert got == want


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "Ann Lee met Bob in Paris. Then Ann Lee, who played well, defeated Carl Moe! the Bob")], "id long, t string")
    assert {tuple(r) for r in extract.mentions(pages, "id", "t", stop=["then"]).collect()} >= {(1, "Bob", 2), (1, "Paris", 1), (1, "Carl Moe", 1), (1, "Ann Lee", 1)}
    got = extract.relations(pages, "id", "t", {"met": "MET", "defeated": "DEFEATED"}).collect()
    assert ("Ann Lee", "MET", "Bob") in {(r["subject"], r["relation"], r["object"]) for r in got} and all(0.5 <= r["confidence"] <= 1 for r in got)


def test_scored_relations(spark):
    text = "Nothing here. Ann Lee  lost to Bob Moe in May! Ann Lee won the Cup of Tea. Ann Lee met Paris. Ann Lee met Ann Lee."
    pages = spark.createDataFrame([(1, text)], "id long, t string")
    labels = spark.createDataFrame([("Cup", "EVENT"), ("Paris", "GPE")], "name string, label string")
    got = {(r["relation"], r["object"]): r for r in extract.scored_relations(pages, "id", "t", labels).collect()}
    assert set(got) == {("LOST_TO", "Bob Moe"), ("WON", "Cup")}
    plain = " ".join(text.split())
    for r in got.values():
        assert plain[r["evidence_start_char"] : r["evidence_end_char"]] == r["evidence"] and "won" in r["evidence"] or "lost" in r["evidence"]
    lost, won = got["LOST_TO", "Bob Moe"], got["WON", "Cup"]
    assert (lost["relation_rule"], lost["pattern_score"], lost["distance_score"]) == ("dep:verb_nsubj_pobj", 0.70, 0.65)
    assert abs(won["confidence"] - (0.4 * 0.85 + 0.6 * 0.75)) < 1e-9 and won["object_class"] == "EVENT"
    long = "x " * 300
    row = spark.createDataFrame([(long + "played " + long,)], "s string").select(extract.shorten(F.col("s")).alias("short"), extract.context_window(F.col("s"), F.lit("played")).alias("window")).first()
    assert len(row["short"]) <= 251 and row["short"].endswith("x…") and row["window"].startswith("…") and "played" in row["window"] and row["window"].endswith("…")


def test_documents_with_odd_values(spark):
    claims = {"P1": [{"mainsnak": {"snaktype": "value", "datavalue": {"type": "time", "value": {"time": t}}}} for t in ("-0044-03-15T00:00:00Z", "+2020-00-00T00:00:00Z", "soon")], "P2": [{"mainsnak": {"snaktype": "value"}}]}
    docs = [("Q1", json.dumps({"labels": {"en": {"value": "  "}, "xx": {"value": "X"}, "aa": {"value": "A"}}, "claims": claims})), ("Q2", "no json"), ("Q3", None), ("Q4", "{}")]
    e = expansion.read_entities(spark.createDataFrame(docs, "qid string, json string"))
    assert {(r["s"], r["o"], r["o_lang"]) for r in expansion.entity_metadata(e, "u/").collect()} == {("u/Q1", "A", "aa")}
    got = {(r["o"], r["o_dtype"]) for r in expansion.claim_triples(e, "u/", "p/", ["P1", "P2"]).collect()}
    assert got == {("0044-03-15", f"{abox.XSD}date"), ("2020-00-00", None), ("soon", None)}
    assert expansion.claim_triples(e, "u/", "p/", ["P1"], literals=False).count() == 0


def test_alignment_kinds(spark):
    from pyspark.errors import PySparkException

    rows = lambda kind: spark.createDataFrame([("a", kind, "P1", None)], "local string, kind string, property string, note string")
    assert [(r["p"], r["o"]) for r in abox.alignment(rows("equivalent"), "b/", "t/").collect()] == [(abox.EQUIVALENT, "t/P1")]
    with pytest.raises(PySparkException, match="unknown kind"):
        abox.alignment(rows("odd"), "b/", "t/").collect()


def test_turtle_is_read_back(spark, tmp_path):
    e = spark.createDataFrame([("CHARACTER:x-1", 'A "q" \\ \n label', "character", "http://u")], "entity_id string, canonical_text string, entity_class string, url string")
    rel = spark.createDataFrame([("CHARACTER:x-1", "met", "y", "0.5", "text")], "subject_id string, relation string, object_id string, confidence string, evidence string")
    t = abox.typed_union(abox.entity_triples(e, "http://k#", {"CHARACTER": "Character"}), abox.relation_triples(rel, "http://k#", {"MET": "met"}))
    files.write_turtle(t, str(tmp_path / "t"), {"k": "http://k#", "xsd": abox.XSD})
    back = files.read_turtle(spark, str(tmp_path / "t"))
    plain = lambda df: sorted((r["p"], r["o"] if r["o_kind"] != "bnode" else "", r["o_lang"], r["o_dtype"]) for r in df.collect())
    assert plain(back) == plain(t)


# ---------------------------------------------------------------- sources, streams
TURTLE = """@prefix x: <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment
x:ann a x:Character ; x:met x:bob , x:carl ; x:name "Ann \\"A\\" Lee"@en ; x:age 12 ; x:when "1970-01-01"^^xsd:date .
[] a x:Statement ; x:score "0.5"^^xsd:decimal .
<http://y#z> x:has [ x:part x:bob ] .
"""


def test_turtle_and_ntriples(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    df = files.read_turtle(spark, str(tmp_path / "a.ttl"))
    got = {tuple(r) for r in df.collect()}
    assert ("http://x/ann", triples.TYPE, "http://x/Character", "iri", None, None) in got
    assert ("http://x/ann", "http://x/name", 'Ann "A" Lee', "lit", "en", None) in got
    assert ("http://x/ann", "http://x/age", "12", "lit", None, files.XSD + "integer") in got
    assert ("http://x/ann", "http://x/when", "1970-01-01", "lit", None, files.XSD + "date") in got
    assert len(got) == 10
    odd = df.unionByName(spark.createDataFrame([("http://s", "http://p", 'tab\t nl\n back\\ "q"', "lit", None, None)], df.schema))
    files.write_ntriples(odd, str(tmp_path / "nt"))
    assert {tuple(r) for r in files.read_ntriples(spark, str(tmp_path / "nt")).collect()} == {tuple(r) for r in odd.collect()}


def test_tables(spark, tmp_path):
    links = spark.createDataFrame([("a", "r", 'b "q"'), ("c", "r", "d")], "head string, relation string, tail string")
    files.write_tsv(links, str(tmp_path / "t"))
    assert sorted(files.read_tsv(spark, str(tmp_path / "t")).collect()) == sorted(links.collect())
    df = spark.createDataFrame([("x", ["a", "b"]), ('y "z"\n2', [])], "name string, aliases array<string>")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(files.read_csv(spark, str(tmp_path / "c"), lists=("aliases",)).collect()) == sorted(df.collect())
    pages = spark.createDataFrame([("u", "d", "t", None, "text", 0)], files.PAGES)
    files.write_json(pages, str(tmp_path / "p"))
    assert files.read_pages(spark, str(tmp_path / "p")).collect() == pages.collect()
    files.write_json(spark.createDataFrame([("u", "d", 0, ["v", "w"])], files.LINKS), str(tmp_path / "l"))
    assert [tuple(r) for r in files.read_links(spark, str(tmp_path / "l")).collect()] == [("u", "v", 0), ("u", "w", 1)]


def test_streams(spark, tmp_path):
    rows = spark.sql("select 's' || id % 3 as s, 'p' as p, 'o' as o, 'iri' as o_kind, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as ts from range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = []
    for name, df in (("a", streams.new_triples(stream())), ("b", streams.windowed_counts(stream(), "s", width="5 minutes"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "a" else "complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        out.append(spark.table(name).collect())
    assert len(out[0]) == 3 and sum(r["n"] for r in out[1]) == 12
    texts = spark.createDataFrame([(1, "A b. C d.")], "id long, t string")
    texts.write.parquet(str(tmp_path / "pages"))
    q = streams.stream_chunks(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "pages")), "id", "t", 2, 0).writeStream.format("memory").queryName("c").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r["text"] for r in spark.table("c").collect()) == ["A b.", "C d."]
