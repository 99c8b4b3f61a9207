"""Entity resolution: a global entity table, merges of near-equal and partial names, aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id, name_tokens, similarity
from ..plans.written import materialize
from .components import connected_components


def merged_set(c: str) -> Column:
    """All values of an array column in a group, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


def global_entities(mentions: DataFrame) -> DataFrame:
    """One row a (class, name): counts added, urls and aliases merged; one real-world page makes it real-world.

    mentions: entity_class, canonical_text, mention_count, url, aliases (array), entity_label, page_context.
    """
    clean = mentions.withColumn("aliases", F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.trim), lambda a: a != ""))
    return clean.groupBy("entity_class", "canonical_text").agg(
        F.sum("mention_count").alias("total_count"),
        F.array_sort(F.collect_set(F.when(F.trim("url") != "", F.col("url")))).alias("urls"),
        merged_set("aliases").alias("aliases"),
        F.min("entity_label").alias("entity_label"),
        F.when(F.bool_or(F.col("page_context") == "REAL_WORLD"), "REAL_WORLD").otherwise("IN_UNIVERSE").alias("page_context"),
    )


def _keys(names: DataFrame, threshold: float, own: bool) -> DataFrame:
    """Blocks in which every pair of near-equal names meets.

    A ratio of ``threshold`` leaves at most (1 - threshold) * (n + m) characters unmatched in both
    names together; of one piece more than that, one is whole in the other name, moved by
    no more than the unmatched characters of one name: half of them and of the difference in length. A name gives its own pieces under its length, or the
    substrings that could be pieces of a name of each length within three of its own.
    """
    low, n = F.lower("name"), F.length("name")
    size = n if own else F.col("size")
    pieces = F.floor((1 - threshold) * (2 * size + 3)).cast("int") + 1
    begin, end = F.floor(F.col("j") * size / pieces).cast("int"), F.floor((F.col("j") + 1) * size / pieces).cast("int")
    df = names if own else names.withColumn("size", F.explode(F.sequence(F.greatest(n - 3, F.lit(1)), n + 3)))
    df = df.withColumn("pieces", pieces).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    most = F.greatest(F.lit(3), F.floor(((1 - threshold) * (2 * size + 3) + 3) / 2).cast("int"))
    shift = F.lit(0) if own else F.explode(F.sequence(-most, most))
    df = df.withColumn("shift", shift).withColumns({"at": begin + F.col("shift"), "length": end - begin}).where("at >= 0")
    piece = F.substring(low, F.col("at") + 1, F.col("length"))
    return df.select("entity_class", "name", size.alias("size") if own else "size", "j", piece.alias("piece")).where("length(piece) > 0").distinct()


def similar_names(names: DataFrame, threshold: float = 0.94, least: int = 5) -> DataFrame:
    """Pairs (entity_class, a, b), a < b, of names of one class that differ by typos only.

    Names with a parenthesis, and single tokens shorter than ``least``, are left alone.
    """
    one = F.size(name_tokens(F.col("name"))) == 1
    fit = names.where(~F.contains("name", F.lit("("))).where(~(one & (F.length("name") < least)))
    own, others = _keys(fit, threshold, True).withColumnRenamed("name", "a"), _keys(fit, threshold, False).withColumnRenamed("name", "b")
    pairs = own.join(others, ["entity_class", "size", "j", "piece"]).where("a <> b and abs(length(a) - length(b)) <= 3")
    pairs = pairs.select("entity_class", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where(similarity(F.lower("a"), F.lower("b")) >= threshold)


def merge_similar(entities: DataFrame, threshold: float = 0.94) -> DataFrame:
    """(entity_class, canonical_text, rep): each name's cluster is led by its most frequent, then longest, name."""
    names = entities.select("entity_class", F.col("canonical_text").alias("name"))
    node = lambda c: F.xxhash64("entity_class", c)
    links = materialize(similar_names(names, threshold).select(node("a").alias("a"), node("b").alias("b")), "similar")
    labels = connected_components(links)
    rows = entities.withColumn("id", node("canonical_text")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    order = F.struct("total_count", F.size(name_tokens(F.col("canonical_text"))), F.length("canonical_text"), "canonical_text")
    lead = rows.groupBy("entity_class", "label").agg(F.max_by("canonical_text", order).alias("rep"))
    return rows.join(lead, ["entity_class", "label"]).select("entity_class", "canonical_text", "rep")


def merge_partial(entities: DataFrame, ambiguous: Sequence[str] = (), least: int = 2) -> DataFrame:
    """(entity_class, canonical_text, rep): a single token becomes the most frequent full name that begins or ends with it.

    Initialisms, names with a parenthesis and ``ambiguous`` tokens stay, and so do tokens whose
    full name occurs fewer than ``least`` times. A token's full names are met by an equi-join on
    first and last tokens, after each token's best one is chosen by aggregation.
    """
    rows = entities.withColumn("tokens", name_tokens(F.col("canonical_text")))
    full = rows.where(F.size("tokens") >= 2).withColumn("token", F.explode(F.array_distinct(F.array(F.element_at("tokens", 1), F.element_at("tokens", -1)))))
    order = F.struct("total_count", F.size("tokens"), F.length("canonical_text"), "canonical_text")
    best = full.groupBy("entity_class", "token").agg(F.max(order).alias("best")).where(F.col("best.total_count") >= least)
    best = best.select("entity_class", "token", F.col("best.canonical_text").alias("full"))
    name = F.col("canonical_text")
    open_ = (F.size("tokens") == 1) & ~name.rlike("^[A-Z.]{2,5}$") & ~F.contains(name, F.lit("(")) & ~F.element_at("tokens", 1).isin(list(ambiguous) or [""])
    keyed = rows.withColumn("token", F.when(open_, F.element_at("tokens", 1)))
    return keyed.join(best, ["entity_class", "token"], "left").select("entity_class", "canonical_text", F.coalesce("full", "canonical_text").alias("rep"))


def _renamed(entities: DataFrame, reps: DataFrame) -> DataFrame:
    moved = entities.join(reps, ["entity_class", "canonical_text"]).drop("canonical_text").withColumnRenamed("rep", "canonical_text")
    return moved.groupBy("entity_class", "canonical_text").agg(
        F.sum("total_count").alias("total_count"), merged_set("urls").alias("urls"), merged_set("aliases").alias("aliases"), F.min("entity_label").alias("entity_label"),
        F.when(F.bool_or(F.col("page_context") == "REAL_WORLD"), "REAL_WORLD").otherwise("IN_UNIVERSE").alias("page_context"),
    )


def resolve_entities(mentions: DataFrame, threshold: float = 0.94, ambiguous: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The resolved entities with their ids, and the aliases (alias, canonical_text, entity_id, entity_class)."""
    first = materialize(global_entities(mentions), "entities")
    typos = materialize(merge_similar(first, threshold), "typos")
    second = materialize(_renamed(first, typos), "entities")
    partial = materialize(merge_partial(second, ambiguous), "partial")
    resolved = _renamed(second, partial).withColumn("entity_id", entity_id(F.col("entity_class"), F.col("canonical_text")))
    chain = typos.select("entity_class", F.col("canonical_text").alias("alias"), F.col("rep").alias("canonical_text"))
    aliases = chain.join(partial, ["entity_class", "canonical_text"]).select("alias", F.col("rep").alias("canonical_text"), "entity_class")
    return resolved, aliases.withColumn("entity_id", entity_id(F.col("entity_class"), F.col("canonical_text")))


def clean_entities(entities: DataFrame, drop: Sequence[str] = (), rename: dict[str, str] | None = None, reclass: dict[str, str] | None = None) -> DataFrame:
    """Drop names, rename, force classes, then one row a (class, name) with new ids. The maps are hand-written and few."""
    spark = entities.sparkSession
    rows = entities.where(~F.lower(F.trim("canonical_text")).isin([d.lower() for d in drop] or [""]))
    for found, column, key in ((rename, "canonical_text", "canonical_text"), (reclass, "entity_class", "canonical_text")):
        table = spark.createDataFrame([(k, v) for k, v in (found or {}).items()], "old string, new string")
        rows = rows.withColumn("canonical_text", F.trim("canonical_text")).join(table, F.col(key) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")
    out = rows.groupBy("entity_class", "canonical_text").agg(F.sum("total_count").alias("total_count"), merged_set("urls").alias("urls"), merged_set("aliases").alias("aliases"))
    return out.withColumn("entity_id", entity_id(F.col("entity_class"), F.col("canonical_text")))


def clean_relations(relations: DataFrame, entities: DataFrame, drop: Sequence[str] = (), subjects: dict[str, Sequence[str]] | None = None, objects: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Relations with ids and classes of the cleaned entities; noisy names, self-loops, wrong classes and repeats go.

    subjects, objects: relation -> the classes allowed at that end. Of equal relations the most confident stays.
    """
    found = entities.groupBy("canonical_text").agg(F.min("entity_id").alias("id"), F.min_by("entity_class", "entity_id").alias("class"))
    rows = relations.withColumns({c: F.trim(c) for c in ("subject", "object")})
    for side in ("subject", "object"):
        own = found.select(F.col("canonical_text").alias(side), F.col("id").alias(f"new_{side}_id"), F.col("class").alias(f"new_{side}_class"))
        rows = rows.join(own, side, "left")
        rows = rows.withColumns({f"{side}_{c}": F.coalesce(f"new_{side}_{c}", f"{side}_{c}") for c in ("id", "class")}).drop(f"new_{side}_id", f"new_{side}_class")
        rows = rows.where(~F.lower(side).isin([d.lower() for d in drop] or [""]))
    rows = rows.where("subject_id <> object_id")
    for side, allowed in (("subject", subjects), ("object", objects)):
        for relation, kinds in (allowed or {}).items():
            rows = rows.where((F.col("relation") != relation) | F.col(f"{side}_class").isin(list(kinds)))
    turn = Window.partitionBy("subject_id", "relation", "object_id").orderBy(F.desc("confidence"), F.xxhash64(*rows.columns))
    return rows.withColumn("turn", F.row_number().over(turn)).where("turn = 1").drop("turn")
