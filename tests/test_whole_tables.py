"""Queries take their whole tables."""

from graphloom.operators import kge, triples
from graphloom.plans import queries
from graphloom.plans.graph_tables import graph, table


def test_every_part_is_linked(spark, small_dir):
    parts = table(spark, small_dir, "part")
    rows = queries.queries()["link_best"](spark, small_dir).collect()
    # the catalog is made of the parts' own names, so each part has a candidate
    assert len(rows) == len({r["uri"] for r in rows}) == parts.count()


def test_link_prediction_takes_every_link(spark, small_dir, monkeypatch):
    seen = {}
    own = kge.train

    def train(links, *args, **kw):
        seen["n"], seen["kw"] = links.count(), kw
        return own(links.limit(50), *args, rounds=1)

    monkeypatch.setattr(kge, "train", train)
    queries.queries()["kge_link_prediction"](spark, small_dir)
    assert seen == {"n": triples.split(triples.entity_links(graph(spark, small_dir))).where("part = 'train'").count(), "kw": {}}
