"""Tables are read, and rules applied, no more often than the result needs."""

from graphloom.operators import rules
from graphloom.plans import queries


def test_statements_are_made_in_one_pass(spark, small_dir):
    df = queries.queries()["abox_triples"](spark, small_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey#") and plan.count("Relation [o_orderkey#") == 1


def test_rules_stop_where_nothing_can_follow(spark, small_dir, monkeypatch):
    rounds, own = [], rules.materialize
    monkeypatch.setattr(rules, "materialize", lambda df, name: rounds.append(name) or own(df, name))
    queries.queries()["rules_inference"](spark, small_dir)
    assert rounds == ["inferred"] * 2
