"""License scans by diagonal voting [native].

The text's rolling word k-grams are hashed and joined with the positions the templates have
them at (the grams themselves are compared too, so hash collisions do no harm). Hits of one
document and template are counted by diagonal (place in the text minus place in the template);
diagonals at most ``slack`` words apart, as an inserted or missing word makes them, merge into
spans. A span counts if it holds enough of the template's grams. Base phrases are templates
of which a single diagonal must hold every gram.

Words: A-Z lower-cased, then runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Defined results: a null text is empty; an empty or unmatched text has no labels, score 0 and
null places. Rows with the same id are kept apart by their text; repeated rows get equal
rows. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    def words(self) -> list[str]:
        return re.findall(TOKEN, self.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


BASE = [Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True)]

#: Notices as licensors publish them (fixed values).
NOTICES = [
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("proprietary", "All rights reserved"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, min_share: float = 0.8, slack: int = 2) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = BASE + NOTICES if templates is None else templates
    spark = docs.sparkSession
    index = [(i, t.label, t.base, p, " ".join(g), len(w) - K + 1) for i, t in enumerate(templates) for w in [t.words()] for p, g in enumerate(zip(*[w[j:] for j in range(K)], strict=False))]
    # as many rows as the templates have words: a bound that no corpus moves, broadcast up to a million
    small = F.broadcast if len(index) <= 1_000_000 else (lambda df: df)
    index = spark.createDataFrame(index, "template int, label string, base boolean, at int, gram string, size int").withColumn("hash", F.xxhash64("gram"))

    text = F.translate(F.coalesce(F.col("`text`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = docs.select(F.col("`doc_id`").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("low"))
    words = keyed.select("doc_id", "print", F.regexp_extract_all("low", F.lit(TOKEN), F.lit(0)).alias("w"))
    grams = F.expr("zip_with(w, slice(w, 2, size(w)), (a, b) -> a || ' ' || b)")
    rolled = words.select("doc_id", "print", F.posexplode(grams).alias("pos", "gram")).where("gram is not null").withColumn("hash", F.xxhash64("gram"))
    hits = rolled.join(small(index), ["hash", "gram"]).select("doc_id", "print", "template", "label", "base", "size", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    hits = materialize(hits.distinct(), "license-hits")  # repeated rows; texts are tokenized once for phrases and notices

    votes = hits.groupBy("doc_id", "print", "template", "label", "base", "size", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats"))
    base = votes.where("base and votes = size")
    # neighbouring diagonals merge, whichever half comes first in the text: a missing word puts the
    # later half on the smaller diagonal. A diagonal's hits lie within size words, so neighbours are near.
    line = Window.partitionBy("doc_id", "print", "template").orderBy("diagonal", "first")
    near = F.col("diagonal") - F.lag("diagonal").over(line) <= slack
    spans = votes.where("not base").withColumn("group", F.sum(F.when(near, 0).otherwise(1)).over(line))
    spans = spans.groupBy("doc_id", "print", "template", "label", "size", "group").agg(F.flatten(F.collect_list("ats")).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.withColumn("share", F.size(F.array_distinct("ats")) / F.col("size")).where((F.col("share") >= min_share) & (F.col("last") - F.col("first") < F.col("size") * 2 + slack))

    found = base.select("doc_id", "print", "label", F.lit(True).alias("base"), F.col("diagonal").alias("pos"), F.lit(1.0).alias("share"))
    found = found.unionByName(spans.select("doc_id", "print", "label", F.lit(False).alias("base"), F.col("first").alias("pos"), "share"))
    own = F.col("base")
    by_doc = found.groupBy("doc_id", "print").agg(
        F.sum(own.cast("long")).alias("n_base"),
        F.min(F.when(own, F.col("pos"))).cast("long").alias("first_word"),
        F.max(F.when(own, F.col("pos"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(own, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.max("share").alias("score"),
    )
    counted = keyed.select("doc_id", "print", F.regexp_count("low", F.lit(TOKEN)).cast("long").alias("n_words"))
    both = counted.alias("d").join(by_doc.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.print = f.print"), "left")
    nothing = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return both.select("d.doc_id", "n_words", *[F.coalesce(c, nothing[c]).alias(c) if c in nothing else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
