"""Reach by bit sets of merged keys and paths from both ends, against plain searches."""

import random
from collections import defaultdict

import pytest

from caseflow.operators import graph

ADJ = "case_id long, key string, other string, relation string, id long"


def made_edges(seed, keys, edges, cases=3):
    rng = random.Random(seed)
    out = set()
    for _ in range(edges):
        a, b = rng.randrange(keys), rng.randrange(keys)
        if a != b:
            out.add((rng.randrange(cases), f"K{a:04d}", f"K{b:04d}"))
    # leaves of one hub, a group whose members are all linked, and two keys linked with each other alone
    out |= {(0, "HUB", f"LEAF{i}") for i in range(300)} | {(0, "HUB", "K0001")}
    out |= {(1, f"C{i}", f"C{j}") for i in range(9) for j in range(i)} | {(1, "C0", "K0002"), (2, "X", "Y")}
    return sorted(out)


def frame(spark, edges):
    both = [(c, x, y, "R", i) for i, (c, a, b) in enumerate(edges) for x, y in ((a, b), (b, a))]
    return spark.createDataFrame(both + both[:40], ADJ)


def neighbours(edges):
    out = defaultdict(set)
    for c, a, b in edges:
        out[c, a].add(b)
        out[c, b].add(a)
    return out


def plain_reach(edges, hops, peers=None):
    near, out = neighbours(edges), {}
    for c, key in near:
        seen, front = {key}, {key}
        for _ in range(hops):
            front = {n for f in front for n in near[c, f]} - seen
            seen |= front
        out[c, key] = sum(k != key and (peers is None or (c, k) in peers) for k in seen)
    return out


@pytest.mark.parametrize("hops, keys, edges, rows", [(1, 60, 120, 2**32), (2, 60, 90, 2**32), (3, 900, 1000, 2**32), (3, 900, 1000, 2000), (4, 80, 90, 300)])
def test_reach_counts(spark, hops, keys, edges, rows):
    made = made_edges(hops, keys, edges)
    got = {(r.case_id, r.key): r.reach for r in graph.reach_counts(frame(spark, made), hops, rows=rows).collect()}
    assert got == plain_reach(made, hops)


def test_reach_of_peers(spark):
    made = made_edges(7, 200, 260)
    rng = random.Random(1)
    peers = {(c, k) for c, k in neighbours(made) if rng.random() < 0.6} | {(0, "alone")}
    of = spark.createDataFrame([*peers, *list(peers)[:5]], "case_id long, key string")
    got = {(r.case_id, r.key): r.reach for r in graph.reach_counts(frame(spark, made), 3, of).collect()}
    assert got == plain_reach(made, 3, peers)


@pytest.mark.parametrize("part_nodes", [0, 40, 320, 2**16])
def test_reach_of_parts_and_of_the_rest(spark, part_nodes):
    """Whatever part of the keys is counted by parts, the others by joins in tiles: the same counts; a chain has parts that do not come to rest."""
    made = made_edges(9, 400, 330) + [(2, f"L{i:03d}", f"L{i + 1:03d}") for i in range(150)]
    rng = random.Random(2)
    peers = {(c, k) for c, k in neighbours(made) if rng.random() < 0.7}
    want = {(c, k): rng.random() < 0.3 for c, k in sorted(neighbours(made))}
    adj, some = frame(spark, made), spark.createDataFrame([p for p, x in want.items() if x], "case_id long, key string")
    got = graph.reach_counts(adj, 3, spark.createDataFrame([*peers], "case_id long, key string"), rows=3000, part_nodes=part_nodes).collect()
    plain = plain_reach(made, 3, peers)
    assert len(got) == len(plain) and {(r.case_id, r.key): r.reach for r in got} == plain
    few = graph.reach_counts(adj, 3, spark.createDataFrame([*peers], "case_id long, key string"), of=some, part_nodes=part_nodes).collect()
    assert {(r.case_id, r.key): r.reach for r in few} == {p: plain[p] for p, x in want.items() if x}


def test_parts_are_closed(spark):
    made = made_edges(4, 900, 500)
    _, step = graph.numbered(frame(spark, made))
    part = {r.n: r.part for r in graph.closed_parts(step.filter("a < b"), 200).collect()}
    links = [(r.a, r.b) for r in step.collect()]
    assert part and len(part) < len({a for a, _ in links})
    assert all(part.get(a) == part.get(b) for a, b in links)


def test_many_words_and_gathered_links(monkeypatch):
    """A part over several tiles of columns, its links gathered in pieces."""
    import numpy as np

    monkeypatch.setattr(graph, "PART_WORDS", 2)
    monkeypatch.setattr(graph, "GATHERED", 50)
    rng = random.Random(3)
    edges = sorted({(min(p), max(p)) for p in ((rng.randrange(700), rng.randrange(700)) for _ in range(500)) if p[0] != p[1]} | {(i, 700) for i in range(120)})
    ids = sorted({k for e in edges for k in e})
    a, b = (np.array([ids.index(e[i]) for e in edges]) for i in (0, 1))
    peers = np.array([rng.random() < 0.5 for _ in ids])
    want = plain_reach([(0, x, y) for x, y in edges], 3, {(0, k) for k, p in zip(ids, peers) if p})
    assert graph._reach_of_part(a, b, peers, 3).tolist() == [want[0, k] for k in ids]


def test_reach_of_nothing(spark):
    assert graph.reach_counts(spark.createDataFrame([], ADJ)).count() == 0


def test_twins_are_one_node(spark):
    """A star of 20,000 leaves and a group of 60 linked keys are four nodes, so few bits are made; unmerged, the star alone has 20,001 sets of 20,001 bits."""
    star = [(0, "HUB", f"LEAF{i}") for i in range(20_000)]
    group = [(1, f"C{i}", f"C{j}") for i in range(60) for j in range(i)] + [(1, f"C{i}", "OUT") for i in range(60)] + [(1, "OUT", "FAR")]
    adj = frame(spark, star + group)
    nodes, step = graph.numbered(adj)
    classes, links = graph.merge_twins(step)
    assert classes.select("twin").distinct().count() == 5 and classes.count() == nodes.count() == 20_063
    assert sum(t.count() for t in graph.reached_bits(links, 3)) <= 20
    got = {(r.case_id, r.key): r.reach for r in graph.reach_counts(adj).collect()}
    assert set(got.values()) == {20_000, 61} and len(got) == 20_063


def test_tiles_share_the_rows(spark):
    made = made_edges(3, 3000, 4000, cases=1)
    _, step = graph.numbered(frame(spark, made))
    _, links = graph.merge_twins(step)
    tiles = [t.count() for t in graph.reached_bits(links, 2, rows=5000)]
    whole = [t.count() for t in graph.reached_bits(links, 2)]
    assert len(whole) == 1 and len(tiles) > 3 and sum(tiles) == whole[0] and max(tiles) < whole[0] / 2


def plain_path(near, c, a, b, hops):
    best = {a: [a]}
    if a == b:
        return best[a]
    front = dict(best)
    for _ in range(hops):
        step = {}
        for node, path in front.items():
            for n in near[c, node] if (c, node) in near else ():
                if n not in best and (n not in step or path + [n] < step[n]):
                    step[n] = path + [n]
        best |= step
        front = step
        if b in best:
            return best[b]
    return None


@pytest.mark.parametrize("hops", [1, 4, 5])
def test_paths_from_both_ends(spark, hops):
    made = made_edges(11, 120, 210)
    near, rng = neighbours(made), random.Random(5)
    keys = sorted({k for _, k in near}) + ["nobody"]
    pairs = [(i, rng.randrange(3), rng.choice(keys), rng.choice(keys)) for i in range(150)] + [(900, 0, "HUB", "HUB"), (901, 0, "LEAF3", "K0005"), (902, 2, "X", "Y")]
    names = ["S", "T"]
    rels = spark.createDataFrame([(c, a, b, names[(i + k) % 2], 1000 * k + i) for i, (c, a, b) in enumerate(made) for k in (1, 0)], "case_id long, source string, target string, relation string, id long")
    by = {(c, *e): names[i % 2] for i, (c, a, b) in enumerate(made) for e in ((a, b), (b, a))}
    # of links that are there both ways round, the least id
    for i, (c, a, b) in reversed(list(enumerate(made))):
        by[c, a, b] = by[c, b, a] = names[i % 2]
    got = {r.pair_id: r for r in graph.shortest_paths(spark.createDataFrame(pairs, "pair_id long, case_id long, source string, target string"), rels, hops).collect()}
    want = {i: p for i, c, a, b in pairs if (p := plain_path(near, c, a, b, hops)) is not None}
    assert {i: r.path for i, r in got.items()} == want
    case = {i: c for i, c, _, _ in pairs}
    assert all(r.hops == len(r.path) - 1 and r.relations == [by[case[i], x, y] for x, y in zip(r.path, r.path[1:])] for i, r in got.items())
