"""Reach in parts whose bit matrix is shared by several tasks."""

import numpy as np
import pytest

from caseflow.operators import graph

from .test_reach import frame, made_edges, plain_reach


def test_a_part_of_many_keys_is_not_joined(spark, monkeypatch):
    """A case of 70,001 connected keys, each leaf with a key of its own: two hops from the hub."""

    def joined(*_):
        raise AssertionError("bit sets of a part were joined")

    monkeypatch.setattr(graph, "_joined_counts", joined)
    leaves = 35_000
    ends = spark.range(leaves).selectExpr("explode(array(named_struct('a', 'HUB', 'b', 'L' || id), named_struct('a', 'L' || id, 'b', 'M' || id))) e").select("e.*")
    both = ends.unionByName(ends.selectExpr("b AS a", "a AS b")).selectExpr("0L AS case_id", "a AS key", "b AS other", "'R' AS relation", "0L AS id")
    got = graph.reach_counts(both, 3).selectExpr("left(key, 1) AS kind", "reach").groupBy("kind", "reach").count().collect()
    # a leaf's own key is two hops from the hub, and so three from the other leaves
    assert {(r.kind, r.reach, r["count"]) for r in got} == {("H", 2 * leaves, 1), ("L", 2 * leaves, leaves), ("M", leaves + 1, leaves)}


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_shares_of_a_part(spark, monkeypatch, hops):
    monkeypatch.setattr(graph, "PART_WORDS", 1)
    monkeypatch.setattr(graph._counted_parts, "__defaults__", (1.0,))
    made = made_edges(hops, 300, 400)
    got = {(r.case_id, r.key): r.reach for r in graph.reach_counts(frame(spark, made), hops).collect()}
    assert got == plain_reach(made, hops)


@pytest.mark.parametrize("hops, gathered", [(1, 2), (2, 3), (3, 2), (4, 2048)])
def test_shares_add_up(monkeypatch, hops, gathered):
    monkeypatch.setattr(graph, "GATHERED", gathered)
    monkeypatch.setattr(graph, "PART_WORDS", 1)
    rng = np.random.default_rng(hops)
    n = 200
    a, b = np.concatenate((np.arange(n - 1), rng.integers(0, n, 90))), np.concatenate((np.arange(1, n), np.minimum(rng.geometric(0.3, 90), n - 1)))
    a, b = a[a != b], b[a != b]
    peers = rng.random(n) < 0.7
    near = np.zeros((n, n), int)
    near[a, b] = near[b, a] = 1
    met, far = np.zeros((n, n), bool), np.eye(n, dtype=int)
    for _ in range(hops):
        far = (far @ near > 0).astype(int)
        met |= far > 0
    np.fill_diagonal(met, False)
    for shares in (1, 2, 5):
        assert (sum(graph._reach_of_part(a, b, peers, hops, s, shares) for s in range(shares)) == (met & peers).sum(axis=1)).all()
