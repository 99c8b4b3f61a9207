"""Rules over triples: property axioms, and conjunctive rules to a fixed point."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import materialize
from .triples import TYPE, as_set, triple, union


@dataclass(frozen=True)
class Axioms:
    symmetric: tuple[str, ...] = ()
    inverse: dict[str, str] = field(default_factory=dict)
    sub_property: dict[str, str] = field(default_factory=dict)
    sub_class: dict[str, str] = field(default_factory=dict)
    transitive: tuple[str, ...] = ()


def _reach(start, step) -> set:
    """Everything that ``step`` leads to from ``start``, itself apart unless it comes back to it."""
    seen, todo = set(), [start]
    while todo:
        for x in step(todo.pop()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def entail(triples: DataFrame, axioms: Axioms) -> DataFrame:
    """The triples and what the axioms entail.

    What a triple entails depends on its property (or class) alone, so the axioms are closed before any data is read: a
    property gives pairs of a property and a direction, a class its wider classes. One pass maps each triple to what it
    entails, by a broadcast of these few rows; only transitive properties join triples with each other.
    """
    spark = triples.sparkSession
    turned = {**axioms.inverse, **{v: k for k, v in axioms.inverse.items()}, **{p: p for p in axioms.symmetric}}

    def step(state: tuple[str, bool]) -> list[tuple[str, bool]]:
        p, flip = state
        return [x for x in ((axioms.sub_property.get(p), flip), (turned.get(p), not flip)) if x[0] is not None]

    properties = {*axioms.sub_property, *turned}
    of_property = [(p, q, flip) for p in sorted(properties) for q, flip in sorted(_reach((p, False), step)) if (q, flip) != (p, False)]
    wider = [(c, w) for c in sorted(axioms.sub_class) for w in sorted(_reach(c, lambda x: [axioms.sub_class[x]] if x in axioms.sub_class else []))]
    # as many rows as the axioms' closure has
    maps = F.broadcast(spark.createDataFrame(of_property or [("", "", False)], "p string, q string, flip boolean"))
    classes_ = F.broadcast(spark.createDataFrame(wider or [("", "")], "o string, wide string"))
    base = materialize(as_set(triples.select("s", "p", "o", "o_kind")), "asserted") if axioms.transitive else triples
    by_property = base.join(maps, "p").where("not flip or o_kind = 'iri'")
    flipped = lambda a, b: F.when(F.col("flip"), F.col(a)).otherwise(F.col(b))
    derived = by_property.select(flipped("o", "s").alias("s"), F.col("q").alias("p"), flipped("s", "o").alias("o"), "o_kind")
    typed = base.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).join(classes_, "o").select("s", "p", F.col("wide").alias("o"), "o_kind")
    out = as_set(union(base, derived, typed))
    if axioms.transitive:
        out = materialize(out, "entailed")
        far = [triple(closure(out.where((F.col("p") == p) & (F.col("o_kind") == "iri")).select("s", "o")), F.col("s"), p, F.col("o")) for p in axioms.transitive]
        out = as_set(union(out, *far))
    return out


def closure(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Transitive closure of (s, o), by joining what is new with the edges; every round is a written table."""
    edges = materialize(edges.select("s", "o").distinct(), "edges")
    known = new = edges
    n = 1
    while (rounds is None or n < rounds) and not new.isEmpty():
        step = new.alias("n").join(edges.alias("e"), F.col("n.o") == F.col("e.s")).select("n.s", "e.o").distinct()
        new = materialize(step.join(known, ["s", "o"], "left_anti"), "closure")
        known = known.unionByName(new)
        n += 1
    return known


@dataclass(frozen=True)
class Rule:
    """body atoms (s, p, o) and a head atom; names that begin with '?' are variables."""

    head: tuple[str, str, str]
    body: tuple[tuple[str, str, str], ...]
    differ: tuple[tuple[str, str], ...] = ()

    def apply(self, triples: DataFrame) -> DataFrame:
        bound: DataFrame | None = None
        for s, p, o in self.body:
            atom = triples.where(F.col("p") == p)
            for place, term in (("s", s), ("o", o)):
                if not term.startswith("?"):
                    atom = atom.where(F.col(place) == term)
            if s == o:
                atom = atom.where("s = o")
            names = {s: "s", o: "o"}
            atom = atom.select(*[F.col(place).alias(term) for term, place in names.items() if term.startswith("?")]).distinct()
            shared = [] if bound is None else [c for c in atom.columns if c in bound.columns]
            if bound is not None and not shared:
                raise ValueError(f"the body of {self.head} is not connected")
            bound = atom if bound is None else bound.join(atom, shared)
        for a, b in self.differ:
            bound = bound.where(F.col(f"`{a}`") != F.col(f"`{b}`"))
        s, p, o = (F.col(f"`{t}`") if t.startswith("?") else F.lit(t) for t in self.head)
        return bound.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind")).distinct()


def infer(triples: DataFrame, rules: list[Rule]) -> DataFrame:
    """Only what the rules add, to a fixed point.

    From the second round on, only rules with a body atom whose property a rule of the round before gives can add anything; where
    there is none, that is the fixed point. Before it joins, a round's result meets only known triples of its properties.
    """
    known, added, turn = triples, None, list(rules)
    while True:
        if not turn:
            return added
        gives = {r.head[1] for r in turn}
        old = known if any(p.startswith("?") for p in gives) else known.where(F.col("p").isin(sorted(gives)))
        new = as_set(union(*[r.apply(known) for r in turn])).join(old, ["s", "p", "o"], "left_anti")
        new = materialize(new.select("s", "p", "o", "o_kind"), "inferred")
        if new.isEmpty():
            return new if added is None else added
        added = new if added is None else added.unionByName(new)
        known = union(known, new)
        turn = [r for r in rules if any(p.startswith("?") for p in gives) or any(p in gives for _, p, _ in r.body)]
