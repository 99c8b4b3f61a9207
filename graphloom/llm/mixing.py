"""Mixing sources to target weights by Pareto order sampling [native].

A source's target is its weight's share of the total, at most ``max_copies`` times its own
size; what exceeds that is shared again by weight. Within a source a document's expected copies are
in proportion to its weight, and at most ``max_copies`` too, so that the source's words come to its target. A
document's weight is 1 + the number of binary digits of its size in words (``equal`` makes all
weights 1): long documents are repeated before short ones. Both shares are filled in closed form: in
order of cap / weight what reaches its cap at the current level is capped.

Of its expected copies each document gets the whole ones for certain. What is left of them, a number p under 1, is
its inclusion probability in a fixed-size sample: documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``, the
odds of a random number over the odds of being included, and taken in that order until their words
make up the rest of the target, to the nearest document. ``u`` comes from the document's id, so reruns
agree.

A source may hold any share of all rows: its documents are first counted in narrow ranges
of rank, and only the one range in which the target is reached is sorted.

Defined results: a null text has size 0, and takes 0. A null source is a source, the last
in order. Rows with the same id share their ``u``, ordered by rank and size; those without an id take theirs from their
text. Repeated rows are rows of their own. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Up to so many rows the table of sources and weight classes is broadcast.
BROADCAST_ROWS = 100_000


def fill(df: DataFrame, by: Sequence[str], order: Column, total: Column, cap: Column, weight: Column) -> DataFrame:
    """``df`` with share: of each group's total in proportion to weight, none above its cap, what is left shared again.

    Rows are few: one a source, or one a source and weight class. Of equal cap / weight ``order`` decides.
    """
    group = Window.partitionBy(*by)
    by_ratio = group.orderBy("ratio", order)
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({"cap": cap.cast("double"), "part": weight.cast("double"), "total": total.cast("double")})
    df = df.withColumn("ratio", F.col("cap") / F.nullif(F.col("part"), F.lit(0.0)))
    df = df.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.nullif(F.sum("part").over(onward), F.lit(0.0)))
    df = df.withColumn("capped", F.coalesce(F.col("cap") <= F.col("part") * F.col("level"), F.lit(True)))
    final = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("ratio"))).over(group)
    share = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("part") * final)
    return df.withColumn("share", share).drop("cap", "part", "total", "ratio", "level", "capped")


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """``sources`` (key, source_size) with target."""
    turn = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    df = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    return fill(df, [], F.col("key"), total, F.lit(float(max_copies)) * F.col("source_size"), F.col("weight")).withColumnRenamed("share", "target").drop("weight")


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: float = 2.0, seed: str = "mix", carry: Sequence[str] = (), equal: bool = False, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, expected (its expected copies), u.

    The columns in ``carry`` come along, as the struct ``row``.
    """
    source, text = F.col("`source`").cast("string"), F.col("`text`")
    id_ = F.coalesce(F.col("`doc_id`").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), id_)), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    sized = docs.select(
        F.col("`doc_id`").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("~")).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        u.alias("u"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    digits = F.lit(0) if equal else F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    sized = materialize(sized.withColumn("class", digits), "mix-sizes")
    found = sized.groupBy("key", "class").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    found = materialize(found, "mix-classes")
    sources = targets(found.groupBy("key").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")), weights, share, max_copies)
    # about sqrt(n) ranges of rank, of 512 documents at least
    sources = sources.withColumn("ranges", F.ceil(F.col("n_docs") / F.greatest(F.lit(512.0), F.sqrt("n_docs"))).cast("long")).drop("n_docs")
    classes = found.drop("n").join(sources, "key")
    classes = fill(classes, ["key"], F.col("class"), F.col("target"), F.lit(float(max_copies)) * F.col("words"), (1 + F.col("class")) * F.col("words"))
    expected = F.when(F.col("words") > 0, F.col("share") / F.col("words")).otherwise(0.0)
    classes = classes.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("key"))
    classes = materialize(classes.withColumn("rest", rest).drop("share", "words"), "mix-rates")
    small = F.broadcast if classes.count() <= broadcast_rows else (lambda df: df)

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = sized.join(small(classes), ["key", "class"]).withColumn("rank_odds", F.when(F.col("p") > 0, odds))
    ranked = ranked.withColumn("range", F.floor(F.col("rank_odds") / (1 + F.col("rank_odds")) * F.col("ranges")))
    sums = ranked.where("range is not null").groupBy("key", "range").agg(F.sum("size").alias("words"), F.min("rest").alias("rest"))
    upto = Window.partitionBy("key").orderBy("range")
    sums = sums.withColumn("began", F.sum("words").over(upto) - F.col("words"))
    edge = sums.where("began < rest").groupBy("key").agg(F.max("range").alias("edge"), F.max("began").alias("edge_began"))
    edge = materialize(edge, "mix-edges")
    rows = ranked.join(small(edge), "key", "left")
    clear = rows.where("edge is null or range is null or range <> edge").withColumn("more", F.coalesce(F.col("range") < F.col("edge"), F.lit(False)))
    order = Window.partitionBy("key").orderBy("rank_odds", "u", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto_here = F.col("edge_began") + F.sum("size").over(order)
    within = rows.where("range = edge").withColumn("more", upto_here - F.col("size") / 2 <= F.col("rest"))
    out = clear.unionByName(within).withColumn("copies", F.col("whole") + F.col("more").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "expected", "u", *(["row"] if carry else []))
