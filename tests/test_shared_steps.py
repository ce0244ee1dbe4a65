"""Steps that many queries share: cutting of lineage, trades, connectivity."""

import glob

import pytest
from pyspark.sql import functions as F

from caseflow.functions import text as t
from caseflow.operators import graph
from caseflow.operators.work import cut, once
from caseflow.plans import adapters as a
from caseflow.plans import extract_queries, ledger_queries
from caseflow.sources import files


def test_a_cut_computes_its_rows_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    out = cut(spark.range(1000).mapInArrow(seen, "id long"))
    assert out.count() == 1000 and rows.value == 1000
    # what comes from a table is not written again
    assert once(out, "id").inputFiles() == out.inputFiles()
    assert cut(spark.range(0)).count() == 0


def test_lines_travel_once(spark, sf):
    """Orders meet their customers below the join with the lines."""
    plan = a.relationships(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda key: next(line.index("Join") for line in plan if "Join" in line and key in line)
    assert depth("c_custkey") > depth("l_orderkey")


def test_connectivity_with_parallel_edges_loops_and_spellings(spark):
    rels = spark.createDataFrame([(1, "a", "b", "CALLED"), (1, "b", "a", "called"), (1, "a", "b", "PAID TO"), (1, "a", "a", "CALLED"), (1, "a", "c", "PAID_TO"), (1, "", "a", "CALLED"), (2, "a", "b", "CALLED"), (1, "d", "a", None)], "case_id long, source string, target string, relation string")
    adj = graph.adjacency(rels)
    rows = adj.select("case_id", "key", "other", t.canonical_relation(F.col("relation")).alias("kind")).collect()
    want = {}
    for r in rows:
        d = want.setdefault((r.case_id, r.key), [0, set(), set()])
        d[0] += 1
        d[1].add(r.other)
        d[2].add(r.kind)
    want = {k: (n, len(o), len(kinds), n - len(o)) for k, (n, o, kinds) in want.items()}
    assert want[(1, "a")][:2] == (5, 3)
    assert {(r.case_id, r.key): (r.degree, r.counterparties, r.relation_types, r.repeats) for r in graph.connectivity(adj).collect()} == want
    reach, both = graph.reach_and_connectivity(adj, 3, graph.members(rels))
    assert {(r.case_id, r.key): (r.degree, r.counterparties, r.relation_types, r.repeats) for r in both.collect()} == want
    assert sorted(map(tuple, reach.collect())) == sorted(map(tuple, graph.reach_counts(adj, 3, graph.members(rels)).collect()))


@pytest.fixture
def folders(monkeypatch):
    """The work folders that a query makes."""
    made, make = [], files.work_dir
    monkeypatch.setattr(files, "work_dir", lambda *args: made.append(make(*args)) or made[-1])
    return made


def test_a_table_that_is_streamed_is_written_by_all_its_tasks(spark, folders):
    rows = spark.range(0, 1200, 1, 12)
    assert ledger_queries._streamed(spark, rows, "few", lambda stream: stream).count() == 1200
    assert len(glob.glob(f"{folders[0].removeprefix('file://')}/in/*.parquet")) == 12


def test_records_are_written_where_they_are_read(spark, sf, folders, monkeypatch):
    calls = extract_queries._calls
    monkeypatch.setattr(extract_queries, "_calls", lambda *args: calls(*args).repartition(7))
    assert extract_queries.header_roles(spark, sf).filter("kind = 'CDR'").count() == 3
    assert len(glob.glob(f"{folders[0].removeprefix('file://')}/*.csv")) == 7
