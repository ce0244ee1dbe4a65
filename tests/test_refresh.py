"""Risk after arrival against a full run."""

import random

from caseflow.operators import graph, risk

EDGE = "case_id long, source string, target string, relation string, timestamp string, amount double, id long"
PEER = "case_id long, key string"


def plain(df):
    return sorted(((r.case_id, r.key, r.peers, r.degree, r.counterparties, r.repeats, r.relation_types, r.reach, r.exposure, r.peak, r.score, r.band) for r in df.collect()), key=repr)


def test_refresh_equals_a_full_run(spark):
    rng = random.Random(2)
    made = []
    for i in range(420):
        c = rng.randrange(4)
        # long chains, so that most keys are far from a change
        a = rng.randrange(90)
        b = a + 1 if rng.random() < 0.9 else rng.randrange(90)
        made.append((c, f"K{a}", f"K{b}", rng.choice(["R", "S", "PART_OF_CASE"]), "", rng.choice([None, 5.0, -70.5, 900.0]), i))
    made.append((0, "K1", "CASE:x", "R", "", 10_000.0, 1000))
    rest, one = made[:370] + made[420:], [e for e in made[370:420] if e[0] in (0, 1)]
    # later: edges of case 2, an edge that goes, a new entity without an edge, another one gone
    two, gone = [(2, "K5", "NEW", "R", "", 99_999.0, 2000), (9, "A", "B", "R", "", 1.0, 2001)], rest[10]
    states = [(rest, []), (rest + one, one), ([e for e in rest + one + two if e != gone], two + [gone])]
    before = None
    for step, (rows, changed) in enumerate(states):
        rels = spark.createDataFrame(rows, EDGE)
        own = spark.createDataFrame([(0, "OWN0"), *([(3, "OWN3")] if step < 2 else [(1, "OWN1")])], PEER)
        peers = graph.members(rels).unionByName(own)
        full = risk.entity_risk(rels, peers)
        if before is None:
            before = full
            continue
        before = risk.refresh(before, rels, peers, spark.createDataFrame(changed, EDGE))
        assert before.columns == full.columns and plain(before) == plain(full)


def test_only_what_is_near_is_counted_anew(spark, monkeypatch):
    line = [(1, f"K{i:03d}", f"K{i + 1:03d}", "R", "", 1.0, i) for i in range(200)] + [(2, f"K{i}", f"K{i + 1}", "R", "", 1.0, 1000 + i) for i in range(50)]
    new = [(1, "K100", "NEW", "R", "", 1.0, 5000)]
    old, rels, added = (spark.createDataFrame(x, EDGE) for x in (line, line + new, new))
    before = risk.entity_risk(old, graph.members(old))
    asked, counts = [], graph.reach_counts

    def watched(adj, hops, peers=None, **more):
        if more.get("of") is not None:
            asked.append((adj.select("case_id").distinct().count(), more["of"].count()))
        return counts(adj, hops, peers, **more)

    monkeypatch.setattr(graph, "reach_counts", watched)
    after = risk.refresh(before, rels, graph.members(rels), added)
    # three keys on each side of K100, K100 and NEW
    assert asked == [(1, 8)]
    assert plain(after) == plain(risk.entity_risk(rels, graph.members(rels)))
