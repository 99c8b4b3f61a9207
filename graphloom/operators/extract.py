"""Mentions and relations from text by patterns, all in the JVM.

A mention is a run of capitalized words; a relation is two mentions of one sentence with a verb
of the lexicon between them. A pluggable tagger (any function of a DataFrame) may replace the
pattern; what follows only needs its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id, sentences

NAME = r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*"


def sentence_rows(pages: DataFrame, id: str, text: str) -> DataFrame:
    """(page_id, sentence_index, sentence)."""
    return pages.select(F.col(f"`{id}`").alias("page_id"), F.posexplode(sentences(F.col(f"`{text}`"))).alias("sentence_index", "sentence"))


def mentions(pages: DataFrame, id: str, text: str, stop: Sequence[str] = (), name: str = NAME) -> DataFrame:
    """(page_id, canonical_text, mention_count): names per page; names in ``stop`` are none."""
    found = sentence_rows(pages, id, text).select("page_id", F.explode(F.regexp_extract_all("sentence", F.lit(name), F.lit(0))).alias("canonical_text"))
    return found.where(~F.lower("canonical_text").isin([s.lower() for s in stop] or [""])).groupBy("page_id", "canonical_text").agg(F.count("*").alias("mention_count"))


def entity_rows(found: DataFrame, entity_class: Column) -> DataFrame:
    """Mentions with class and id."""
    rows = found.withColumn("entity_class", entity_class)
    return rows.withColumn("entity_id", entity_id(F.col("entity_class"), F.col("canonical_text")))


def relations(pages: DataFrame, id: str, text: str, verbs: dict[str, str], gap: int = 60, name: str = NAME) -> DataFrame:
    """(page_id, sentence_index, subject, relation, object, confidence, evidence): name, verb, name within ``gap`` characters.

    Confidence: 0.5, and up to 0.5 more the closer the names stand. The verbs' table is written by hand, so small.
    """
    words = "|".join(sorted(verbs, key=len, reverse=True))
    pattern = rf"({name})\b([^.!?]{{0,{gap}}}?)\b({words})\b([^.!?]{{0,{gap}}}?)\b({name})"
    group = lambda i: F.regexp_extract("hit", pattern, i)
    hits = sentence_rows(pages, id, text).withColumn("hit", F.explode(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))))
    names = pages.sparkSession.createDataFrame(list(verbs.items()), "verb string, relation string")
    between = F.length(group(2)) + F.length(group(4))
    rows = hits.select("page_id", "sentence_index", group(1).alias("subject"), group(3).alias("verb"), group(5).alias("object"), F.round(1 - between / F.lit(4.0 * gap), 4).alias("confidence"), F.col("sentence").alias("evidence"))
    return rows.join(names, "verb").where("subject <> object").drop("verb")


# ---------------------------------------------------------------- labels and classes
#: Which label wins among equally frequent ones (the larger), and a label's class.
LABEL_PRIORITY = {"GPE": 5, "LOC": 4, "FAC": 4, "ORG": 3, "NORP": 2, "PERSON": 1, "EVENT": 1}
CLASS_OF = {"ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "NORP": "GROUP", "EVENT": "EVENT"}
HUMAN = ("CHARACTER", "REAL_PERSON")


def _looked_up(c: Column, table: dict, otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c], otherwise)


def vote_labels(found: DataFrame) -> DataFrame:
    """Rows (page_id, canonical_text, surface, label) to one row a page and name: entity_label, preferred_text, aliases, mention_count.

    The most frequent label wins, of equals the one of higher priority, then the lesser name. The most frequent surface is
    preferred, of equals the lesser; aliases are the ten most frequent ones.
    """
    by = ["page_id", "canonical_text"]
    labels = found.groupBy(*by, "label").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), (-_looked_up(F.col("label"), LABEL_PRIORITY, F.lit(0))).alias("p"), "label")
    labels = labels.groupBy(*by).agg(F.min(order)["label"].alias("entity_label"), F.sum("n").alias("mention_count"))
    forms = found.groupBy(*by, "surface").agg(F.count("*").alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "surface"))).alias("forms"))
    forms = forms.select(*by, F.slice(F.transform("forms", lambda f: f["surface"]), 1, 10).alias("aliases"))
    return labels.join(forms, by).select(*by, "entity_label", F.get("aliases", F.lit(0)).alias("preferred_text"), "aliases", "mention_count")


def entity_class(label: Column, name: Column, real_world: Column, works: Sequence[str] = (), actor: Column | None = None) -> Column:
    """A label's class. Persons are characters, on pages about the real world (and as actors) real persons; names that hold
    one of ``works``, or are three words or more that begin with an article, are works."""
    work = name.rlike(r"(?i)^(a|an|the)\s+\S+\s+\S+")
    for w in works:
        work = work | F.contains(F.lower(name), F.lit(w.lower()))
    person = F.when(work, "WORK").when(real_world | (F.lit(False) if actor is None else actor), "REAL_PERSON").otherwise("CHARACTER")
    return F.when(label == "PERSON", person).otherwise(_looked_up(label, CLASS_OF, F.lit("THING")))


# ---------------------------------------------------------------- scored relations
#: Fixed values. Verbs by lemma; relations that need a human object; words that make an event of a sentence.
RELATION_OF = {
    "play": "PLAYED", "compete": "COMPETED_IN", "enter": "ENTERED", "beat": "DEFEATED", "defeat": "DEFEATED", "draw": "DREW_WITH", "learn": "LEARNED_FROM", "study": "LEARNED_FROM",
    "train": "TRAINED_BY", "meet": "MET", "help": "HELPED", "support": "SUPPORTED", "befriend": "BEFRIENDED", "love": "LOVED", "marry": "MARRIED", "divorce": "DIVORCED",
}
OF_HUMANS = ("MET", "MARRIED", "DIVORCED", "LOVED", "BEFRIENDED", "HELPED", "SUPPORTED", "LEARNED_FROM", "TRAINED_BY", "DEFEATED", "LOST_TO", "DREW_WITH", "PLAYED")
OF_EVENTS = ("WON", "LOST", "ENTERED", "COMPETED_IN")
EVENT_WORDS = ("tournament", "championship", "title", "final", "match", "event", "open", "cup", "masters")
PREPOSITIONS = ("against", "with", "from", "to", "under", "at", "in")
WEIGHTS = {"pattern_score": 0.40, "ner_score": 0.25, "distance_score": 0.20, "page_bias": 0.15}
EVIDENCE_CHARS, WINDOW_CHARS = 250, 120
#: Forms in which the verbs stand in texts.
FORMS = {form: lemma for lemma, forms in {
    "play": "play plays played", "compete": "compete competes competed", "enter": "enter enters entered", "win": "win wins won", "beat": "beat beats", "defeat": "defeat defeats defeated",
    "lose": "lose loses lost", "draw": "draw draws drew", "learn": "learn learns learned learnt", "study": "study studies studied", "train": "train trains trained", "meet": "meet meets met",
    "help": "help helps helped", "support": "support supports supported", "befriend": "befriend befriends befriended", "love": "love loves loved", "marry": "marry marries married", "divorce": "divorce divorces divorced",
}.items() for form in forms.split()}


def shorten(c: Column, most: int = EVIDENCE_CHARS) -> Column:
    """At most ``most`` characters, cut at a space, with an ellipsis if cut."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head), F.lit("…")))


def context_window(sentence: Column, word: Column, window: int = WINDOW_CHARS) -> Column:
    """What stands up to ``window`` characters around the word's first place."""
    most = 2 * window + 40
    at = F.instr(F.lower(sentence), F.lower(word))
    start, end = F.greatest(F.lit(1), at - window), F.least(F.length(sentence) + 1, at + F.length(word) + window)
    part = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substring(sentence, start, end - start)), F.when(end <= F.length(sentence), "…").otherwise(""))
    return F.when(F.length(sentence) <= most, sentence).when(at == 0, F.concat(F.rtrim(F.substring(sentence, 1, most)), F.lit("…"))).otherwise(part)


def scored_relations(pages: DataFrame, id: str, text: str, labels: DataFrame, url: str | None = None, real_world: Column | None = None, forms: dict[str, str] | None = None, gap: int = 60, name: str = NAME) -> DataFrame:
    """Relations with four component scores, character offsets and evidence: name, verb, name within ``gap`` characters.

    labels: (name, label), what a tagger or a gazetteer knows; other names are persons. A pronoun is no name. Columns: subject_id, subject,
    subject_label, subject_class, relation, object_id, object, object_label, object_class, verb_lemma, relation_rule, confidence,
    its four scores, evidence, context_window, evidence_start_char, evidence_end_char (in the text with white space
    normalized), page_context, url, page_id.
    """
    forms = forms or FORMS
    words = "|".join(sorted(forms, key=len, reverse=True))
    pattern = rf"({name})\b([^.!?]{{0,{gap}}}?)\b({words})\b([^.!?]{{0,{gap}}}?)\b({name})"
    group = lambda i: F.regexp_extract("hit", pattern, i)
    real = F.lit(False) if real_world is None else real_world
    link = F.lit(None).cast("string") if url is None else F.col(f"`{url}`")
    page = pages.select(F.col(f"`{id}`").alias("page_id"), link.alias("url"), real.alias("real"), sentences(F.col(f"`{text}`")).alias("all"))
    rows = page.select("page_id", "url", "real", "all", F.posexplode("all").alias("i", "sentence"))
    rows = rows.withColumn("start", F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0), lambda s, x: s + F.length(x) + 1)).drop("all")
    rows = rows.withColumn("hit", F.explode(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))))
    rows = rows.select("page_id", "url", "real", "sentence", "start", group(1).alias("subject"), group(3).alias("verb"), group(4).alias("between"), group(5).alias("object"))
    rows = rows.withColumn("verb_lemma", _looked_up(F.col("verb"), forms, F.lit(None).cast("string")))
    known = labels.select("name", "label").groupBy("name").agg(F.min("label").alias("label"))
    for side in ("subject", "object"):
        rows = rows.join(known.select(F.col("name").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
        rows = rows.withColumn(f"{side}_label", F.coalesce(f"{side}_label", F.lit("PERSON")))
        rows = rows.withColumn(f"{side}_class", entity_class(F.col(f"{side}_label"), F.col(side), F.col("real")))
        rows = rows.withColumn(f"{side}_id", entity_id(F.col(f"{side}_class"), F.col(side)))
    human = F.col("object_class").isin(*HUMAN)
    eventish = F.col("object_class").isin("EVENT", "WORK") | F.lower("sentence").rlike("|".join(EVENT_WORDS))
    won, lost = F.col("verb_lemma") == "win", F.col("verb_lemma") == "lose"
    relation = F.when(won & human, "DEFEATED").when(lost & human, "LOST_TO").when(won, "WON").when(lost, "LOST").otherwise(_looked_up(F.col("verb_lemma"), RELATION_OF, F.lit("")))
    prepositional = F.lower(F.trim("between")).rlike(rf"(^|\s)({'|'.join(PREPOSITIONS)})(\s+(the|a|an))?$")
    sure = (won | lost) & (human | eventish)
    scores = {"pattern_score": F.when(prepositional, 0.70).when(sure, 0.85).otherwise(0.75), "ner_score": F.lit(0.75), "distance_score": F.when(prepositional, 0.65).otherwise(0.75), "page_bias": F.lit(0.75)}
    rows = rows.withColumns({"relation": relation, "relation_rule": F.when(prepositional, "dep:verb_nsubj_pobj").otherwise("dep:verb_nsubj_obj"), **scores})
    rows = rows.withColumn("confidence", F.round(sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)), 6))
    fits = (F.col("relation") != "") & (~F.col("relation").isin(*OF_HUMANS) | human) & (~F.col("relation").isin(*OF_EVENTS) | F.col("object_class").isin("EVENT", "WORK"))
    rows = rows.where(fits & (F.col("subject_id") != F.col("object_id")))
    out = ["subject_id", "subject", "subject_label", "subject_class", "relation", "object_id", "object", "object_label", "object_class", "verb_lemma", "relation_rule", "confidence", *WEIGHTS]
    return rows.select(
        *out, shorten(F.col("sentence")).alias("evidence"), context_window(F.col("sentence"), F.col("verb_lemma")).alias("context_window"),
        F.col("start").alias("evidence_start_char"), (F.col("start") + F.length("sentence")).alias("evidence_end_char"), F.when(F.col("real"), "REAL_WORLD").otherwise("IN_UNIVERSE").alias("page_context"), "url", "page_id",
    )


def rewrite_aliases(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations whose ends are replaced by what their aliases (entity_class, alias, canonical_text, entity_id) stand for.

    Relations of an entity with itself go; of equal ones (ends, relation, url, evidence) the most confident stays, of
    equals the least. An alias of several entities stands for the one of least id.
    """
    table = aliases.groupBy("entity_class", "alias").agg(F.min(F.struct("entity_id", "canonical_text")).alias("to"))
    out = relations
    for side in ("subject", "object"):
        named = table.select(F.col("entity_class").alias(f"{side}_class"), F.col("alias").alias(side), F.col("to").alias(f"{side}_to"))
        out = out.join(named, [f"{side}_class", side], "left")
        out = out.withColumns({side: F.coalesce(f"{side}_to.canonical_text", side), f"{side}_id": F.coalesce(f"{side}_to.entity_id", f"{side}_id")}).drop(f"{side}_to")
    out = out.select(relations.columns).where("subject_id <> object_id")
    key = [c for c in ("subject_id", "relation", "object_id", "url", "evidence") if c in out.columns]
    rest = [c for c in out.columns if c not in key]
    order = F.struct((-F.col("confidence")).alias("by"), *[F.col(c) for c in rest])
    return out.groupBy(*key).agg(F.min(order).alias("best")).select(*key, *[F.col(f"best.{c}").alias(c) for c in rest]).select(relations.columns)


# ---------------------------------------------------------------- pages
def page_links(pages: DataFrame, id: str, url: str, html: str, inside: str = "/", skip: Sequence[str] = (), most: int = 80) -> DataFrame:
    """(page_id, pos, link): the page's first ``most`` different links to its own host, absolute and without fragments.

    Links count if their path begins with ``inside`` and with none of ``skip``. ``most`` is what a crawler asks for.
    """
    hrefs = F.regexp_extract_all(F.col(f"`{html}`"), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]*)"""), F.lit(1))
    skipped = ("//", *skip)
    own = F.filter(F.transform(hrefs, F.trim), lambda h: F.startswith(h, F.lit(inside)) & ~F.greatest(F.lit(False), *[F.startswith(h, F.lit(x)) for x in skipped]))
    site = F.regexp_extract(F.col(f"`{url}`"), r"^([^:/?#]+://[^/?#]*)", 1)
    rows = pages.select(F.col(f"`{id}`").alias("page_id"), site.alias("site"), F.slice(F.array_distinct(own), 1, most).alias("links")).where("site <> ''")
    return rows.select("page_id", F.posexplode("links").alias("pos", "link"), "site").select("page_id", "pos", F.concat("site", "link").alias("link"))
