import json

import pytest
from pyspark.sql import functions as F

from caseflow.functions import roles
from caseflow.operators import cascade, graph, ledger, portfolio, retrieval, risk
from caseflow.sources import files


def test_columns_by_rank():
    assert roles.find_column(["To Number", "Caller", "From"], roles.CALL_SOURCE) == "Caller"
    assert roles.find_column(["my_sender_account_no", "x"], roles.TRANSFER_SOURCE) == "my_sender_account_no"
    assert roles.find_column(["b", "A"], ("a",)) == "A" and roles.find_column([], ("a",)) is None and roles.find_column(["zzz"], ("a",)) is None
    # of columns with one name the last is meant
    assert roles.find_column(["Amount ", "amount"], ("amount",)) == "amount"


def test_reach_counts_equal_the_pairs(spark):
    edges = [(c, f"K{(i * 7 + c) % 90}", f"K{(i * i + 3) % 90}", "KNOWS", str(i)) for c in (1, 2, 70) for i in range(60 + c)]
    rels = spark.createDataFrame(edges, "case_id long, source string, target string, relation string, id string")
    adj = graph.adjacency(rels)
    for hops in (1, 2, 3, 4):
        want = {(r.case_id, r.key): r.n for r in graph.reach_pairs(adj, hops).groupBy("case_id", "key").agg(F.count("*").alias("n")).collect()}
        assert {(r.case_id, r.key): r.reach for r in graph.reach_counts(adj, hops).collect()} == want
    peers = adj.select("case_id", "key").distinct().filter("key like '%1' or key like '%2'")
    want = {(r.case_id, r.key): r.n for r in graph.reach_pairs(adj, 3).join(peers.withColumnRenamed("key", "reached"), ["case_id", "reached"]).groupBy("case_id", "key").agg(F.count("*").alias("n")).collect()}
    got = {(r.case_id, r.key): r.reach for r in graph.reach_counts(adj, 3, peers).collect() if r.reach}
    assert got == want
    assert graph.reach_counts(adj.limit(0)).count() == 0


def test_containers_at_any_depth(spark):
    deep = {"records": [{"a": 1}, {"a": 2}]}
    for name in ("data", "items", "results", "data", "entries"):
        deep = {name: deep, "other": 1}
    texts = [json.dumps(deep), '{"a": {"records": [{"b": 1}]}}', "[1]", "{", '[{"z": 1, "b": 2}, {"c": 3}]', '{"items": []}', "[]", None]
    f = spark.createDataFrame(list(enumerate(texts)), "file long, content string")
    good, bad = files.json_records(f)
    assert {r.file: r["n"] for r in good.groupBy("file").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1, 4: 2, 5: 1}
    assert {r.file: r.fields for r in files.field_union(good).collect()}[4] == ["b", "z", "c"]
    assert {r.file for r in bad.collect()} == {2, 3, 6, 7}
    report = {r.file: r for r in files.ingest_report(f, good, bad).collect()}
    assert report[0].ok and report[0].records == 2 and not report[3].ok and report[3].error == "not JSON" and len(report[0].sha256) == 64


def test_cascades(spark):
    rels = spark.createDataFrame([(1, "A", "B", "R"), (2, "B", "C", "R"), (1, "D", "CASE:X", "PART_OF_CASE")], "case_id long, source string, target string, relation string")
    ents = spark.createDataFrame([(1, "A", 1), (2, "B", 1), (3, "C", 2), (4, "D", None), (5, "CASE:X", 1), (6, "E", None), (7, "F", 1)], "id long, key string, case_id long")
    docs = spark.createDataFrame([(10, 1), (11, 2)], "document_id long, case_id long")
    left = cascade.delete_cases({"relationships": rels, "entities": ents, "documents": docs}, spark.createDataFrame([(1,)], "case_id long"))
    assert {r.key for r in left["entities"].collect()} == {"B", "C", "E"}
    assert [r.document_id for r in left["documents"].collect()] == [11] and left["relationships"].count() == 1
    asked = spark.createDataFrame([(10, 2), (11, None), (99, 1)], "document_id long, case_id long")
    chunks = spark.createDataFrame([(10, 0), (11, 0), (11, 1)], "document_id long, chunk_index int")
    report, d, i, c = cascade.delete_documents(asked, docs, docs, chunks)
    assert {(r.document_id, r.verdict, r.integrity_rows, r.chunks) for r in report.collect()} == {(10, "MISMATCH", 0, 0), (11, "DELETED", 1, 2), (99, "NOT_FOUND", 0, 0)}
    assert (d.count(), i.count(), c.count()) == (1, 1, 1)


def test_references_are_filled_until_unique(spark):
    rows = [(1, " "), (2, "CL-LEGACY-001"), (3, "CL-LEGACY-001X"), (4, None), (5, "CL-LEGACY-001XXX"), (6, "R")]
    got = {r.case_id: r.reference_id for r in portfolio.backfill_references(spark.createDataFrame(rows, "case_id long, reference_id string")).collect()}
    assert got == {1: "CL-LEGACY-001XX", 2: "CL-LEGACY-001", 3: "CL-LEGACY-001X", 4: "CL-LEGACY-004", 5: "CL-LEGACY-001XXX", 6: "R"}


def test_mention_rule_and_its_fallback(spark):
    q = spark.createDataFrame([(1, 7, "Where is Al Ba?"), (2, 7, "and now?"), (3, 8, "Al Ba"), (4, 7, "x P:12 y")], "question_id long, case_id long, question string")
    e = spark.createDataFrame([(7, "P:1", "Al Ba"), (7, "P:12", "Cy"), (7, "P:123", "Dana")], "case_id long, key string, name string")
    c = spark.createDataFrame([(2, 1, "saw dana"), (2, 3, "al ba"), (1, 1, "dana")], "question_id long, rank int, chunk string")
    got = {(r.question_id, r.key) for r in retrieval.assistant_mentions(q, e, c).collect()}
    assert got == {(1, "P:1"), (2, "P:123"), (4, "P:12")}


@pytest.mark.parametrize("sort,want", [("riskDesc", ["c", "b", "a"]), ("riskAsc", ["a", "b", "c"]), ("relsDesc", ["a", "c", "b"]), ("nameAsc", ["b", "c", "a"])])
def test_leaderboard_sorts(spark, sort, want):
    s = spark.createDataFrame([(1, "a", "Z", 10.0, 9), (1, "b", "k", 50.0, 1), (1, "c", "M", 90.0, 5)], "case_id long, key string, name string, score double, degree long")
    assert [r.key for r in sorted(risk.leaderboard(s, sort).collect(), key=lambda r: r.rank)] == want
    assert [r.key for r in risk.leaderboard(s, sort, "MODERATE").collect()] == ["b"]


def test_fingerprints_are_filled_and_traced(spark):
    docs = spark.createDataFrame([(1, 4, "a.txt"), (2, None, "b.txt"), (3, 4, "c.txt")], "document_id long, case_id long, filename string")
    integ = spark.createDataFrame([(1, "h", "VERIFIED", "s/1")], "document_id long, sha256 string, status string, stored_path string")
    stored = spark.createDataFrame([(2, "s/2", bytearray(b"x"))], "document_id long, path string, content binary")
    got = {r.document_id: (r.status, r.size) for r in ledger.backfill_fingerprints(docs, integ, stored).collect()}
    assert got == {2: ("VERIFIED", 1), 3: ("MISSING", None)}
    trail = spark.createDataFrame([(1, 5)], "document_id long, audit_id long")
    steps = {r.document_id: [(s.step, s.status) for s in r.steps] for r in ledger.provenance(docs, integ, trail).collect()}
    assert steps[1] == [(n, "VERIFIED" if n == "INTEGRITY" else "OK") for n in ("CASE", "DOCUMENT", "STORAGE", "HASH", "INTEGRITY", "AUDIT")]
    assert dict(steps[2]) == {"CASE": "MISSING", "DOCUMENT": "OK", "STORAGE": "MISSING", "HASH": "MISSING", "INTEGRITY": "NOT_CHECKED", "AUDIT": "MISSING"}
