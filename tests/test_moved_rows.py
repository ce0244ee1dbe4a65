"""What queries join and move, seen in their plans."""

from caseflow.plans import graph_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_folded_before_they_are_intersected(spark, sf):
    # the result, and the keys of the lines for each of the two kinds of entities
    assert plan(graph_queries.key_intersection(spark, sf)).count("Aggregate [") == 3


def test_a_union_of_both_ends_joins_the_trades_once(spark, sf):
    # lines, orders and customers, each read once
    assert plan(graph_queries.key_union(spark, sf)).count("Relation [") == 3
