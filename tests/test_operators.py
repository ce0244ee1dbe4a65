"""Hand-made cases of the operators: resolution, extraction, risk, paths, ledgers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseflow.functions import roles
from caseflow.functions import text as t
from caseflow.operators import extract, graph, ledger, resolve, retrieval, risk

PERSON = "case_id long, id long, key string, label string, name string, phone string, email string, account string, vehicle string, identifier string"


def person(i, name="", phone="", email="", account="", vehicle="", identifier="", label="Person", case=1):
    return (case, i, f"{label}:{i}", label, name, phone, email, account, vehicle, identifier)


MATRIX = [
    ("name alone", [person(1, "Ravi Kumar")], person(9, "Ravi Kumar"), "AMBIGUOUS", None),
    ("same phone", [person(1, "Ravi Kumar", "9000000001")], person(9, "Ravi Kumar", "9000000001"), "EXACT_MATCH", 1),
    ("other phone", [person(1, "Ravi Kumar", "9000000001")], person(9, "Ravi Kumar", "9000000002"), "NEW_ENTITY", None),
    ("formats", [person(1, "  ravi   kumar  ", "9876543210")], person(9, "RAVI KUMAR", "+91-98765-43210"), "EXACT_MATCH", 1),
    ("account", [person(1, "ACC-ALPHA-001", label="BankAccount")], person(9, "acc-alpha-001", label="BankAccount"), "EXACT_MATCH", 1),
    ("vehicle", [person(1, "KA-01-AB-1234", label="Vehicle")], person(9, "ka 01 ab 1234", label="Vehicle"), "EXACT_MATCH", 1),
    ("email", [person(1, "Ravi", email="Ravi.Kumar@Example.COM")], person(9, "R K", email="   ravi.kumar@example.com "), "EXACT_MATCH", 1),
    ("nothing shared", [person(1, "Suresh Raina")], person(9, "Ravi Sharma", "9111111111"), "NEW_ENTITY", None),
    ("enriched", [person(1, "Vikram Singh", "9222222222")], person(9, "VIKRAM SINGH", "+91 9222222222", "v@x.org"), "EXACT_MATCH", 1),
    ("other case", [person(1, "Ravi", "8111111111", case=2)], person(9, "Ravi", "8111111111"), "NEW_ENTITY", None),
    ("two conflicts", [person(1, "Ravi", "9000000001", account="ACC-001")], person(9, "Ravi", "9000000002", account="ACC-002"), "NEW_ENTITY", None),
    ("location", [person(1, "Warehouse Sector x", label="Location")], person(9, "warehouse sector X", label="Location"), "EXACT_MATCH", 1),
    ("first of two", [person(2, "Ravi", "9000000001"), person(1, "Other", email="a@b.c")], person(9, "Ravi", "9000000001", "a@b.c"), "EXACT_MATCH", 1),
]


def test_resolution_matrix(spark):
    for i, (_, old, new, _, _) in enumerate(MATRIX):
        assert all(r[0] in (1, 2) for r in [*old, new]), i
    old = spark.createDataFrame([(c[0] + 10 * i, c[1] + 100 * i, *c[2:]) for i, m in enumerate(MATRIX) for c in m[1]], PERSON)
    new = spark.createDataFrame([(m[2][0] + 10 * i, m[2][1] + 100 * i, *m[2][2:]) for i, m in enumerate(MATRIX)], PERSON)
    got = {r.id: (r.verdict, r.candidate_id) for r in resolve.resolve(old, new).collect()}
    for i, (name, _, _, verdict, cand) in enumerate(MATRIX):
        assert got[9 + 100 * i] == (verdict, None if cand is None else cand + 100 * i), name


def test_edges_give_identifiers(spark):
    old = spark.createDataFrame([person(1, "Ravi"), person(2, "Anil")], PERSON)
    new = spark.createDataFrame([person(9, "R. Kumar")], PERSON)
    edges = "case_id long, source string, target string, id long"
    got = resolve.resolve(old, new, spark.createDataFrame([(1, "Person:1", "PHONE:9000000001", 1)], edges), spark.createDataFrame([(1, "PHONE:+91 9000000001", "Person:9", 1)], edges)).collect()
    assert [(r.verdict, r.candidate_id, r.detail) for r in got] == [("EXACT_MATCH", 1, "phone")]


def test_batch_groups_follow_chains(spark):
    rows = [person(1, phone="9000000001"), person(2, phone="9000000001", email="a@b"), person(3, email="A@b", account="X1"), person(4, account="x-1"), person(5), person(6, phone="9000000001", case=2)]
    got = {r.id: r.group_id for r in resolve.batch_groups(spark.createDataFrame(rows, PERSON)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


EDGE = "case_id long, source string, target string, relation string, timestamp string, amount double, id long"


def sample_case():
    p, a = lambda n: f"PHONE:900000000{n}", lambda n: f"ACCOUNT:ACC{n}001"
    calls = [(1, 2), (2, 1), (1, 3), (3, 4), (4, 2)]
    moves = [(1, 2, 85000.0), (2, 3, 25000.0), (3, 1, 15000.0), (1, 2, 40000.0)]
    rows = [(1, p(s), p(d), "CALL_MADE_TO", f"t{i}", None, i) for i, (s, d) in enumerate(calls)]
    return rows + [(1, a(s), a(d), "TRANSFERRED_FUNDS_TO", f"m{i}", v, 10 + i) for i, (s, d, v) in enumerate(moves)]


def test_risk_of_the_sample_case(spark):
    rels = spark.createDataFrame(sample_case(), EDGE)
    scored = risk.entity_risk(rels, graph.members(rels))
    got = {r.key: (r.degree, r.counterparties, r.repeats, r.reach, round(r.score, 2), r.band) for r in scored.collect()}
    assert got["ACCOUNT:ACC3001"] == (2, 2, 0, 2, 31.42, "LOW")
    assert got["ACCOUNT:ACC2001"] == (3, 2, 1, 2, 44.74, "MODERATE")
    assert got["PHONE:9000000001"] == (3, 2, 1, 3, 40.3, "MODERATE")
    case = risk.case_risk(rels, scored).first()
    assert (round(case.score, 2), case.band, case.internal_edges) == (68.65, "MODERATE", 9)


def test_cases_do_not_mix(spark):
    one = sample_case()
    two = one + [(2, s, d, r, ts, v and v * 3, i + 100) for _, s, d, r, ts, v, i in one]
    scores = []
    for rows in (one, two):
        rels = spark.createDataFrame(rows, EDGE)
        scores.append(sorted((r.key, r.score) for r in risk.entity_risk(rels, graph.members(rels)).filter("case_id = 1").collect()))
    assert scores[0] == scores[1]


def test_reach_and_paths_on_a_line(spark):
    rows = [(1, f"K{i}", f"K{i + 1}", "R", "", None, i) for i in range(7)] + [(1, "K0", "K0", "R", "", None, 99), (1, "K0", "CASE:x", "PART_OF_CASE", "", None, 98), (1, "K7", "CASE:x", "PART_OF_CASE", "", None, 97)]
    rels = spark.createDataFrame(rows, EDGE)
    reach = graph.reach_pairs(graph.adjacency(rels)).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in reach}["K0"] == 3 and {r.key: r["count"] for r in reach}["K3"] == 6
    pairs = spark.createDataFrame([(1, 1, "K0", "K7"), (2, 1, "K1", "K1"), (3, 1, "K0", "K5"), (4, 1, "K0", "nobody")], "pair_id long, case_id long, source string, target string")
    got = {r.pair_id: r.path for r in graph.shortest_paths(pairs, rels, 5).collect()}
    assert got == {1: ["K0", "CASE:x", "K7"], 2: ["K1"], 3: ["K0", "CASE:x", "K7", "K6", "K5"]}
    alone = {r.pair_id for r in graph.shortest_paths(pairs, rels, 5, exclude=["PART_OF_CASE"]).collect()}
    assert alone == {2, 3}


def test_statement_extraction(spark):
    text = "Rahul Mehta met me. Arjun Rao spoke to Rahul Mehta on 9000000001. The car KA01AB1234 left. It was seen near Central Market. Rahul Mehta was seen at Central Market."
    docs = spark.createDataFrame([(1, 1, text)], "file long, case_id long, content string")
    names = spark.createDataFrame([(1, 1, "PERSON:P1", "Person", "Rahul Mehta"), (1, 2, "PERSON:P2", "Person", "Arjun Rao"), (1, 3, "LOCATION:L2", "Location", "Central Market")], "case_id long, id long, key string, label string, name string")
    sents = extract.sentences(docs)
    got = {(r.source, r.relation, r.target) for r in extract.text_edges(sents, extract.sentence_mentions(sents, names), names).collect()}
    assert got == {
        ("PERSON:P2", "CONTACTED", "PERSON:P1"),
        ("PERSON:P1", "USES_PHONE", "PHONE:9000000001"),
        ("PERSON:P2", "USES_PHONE", "PHONE:9000000001"),
        ("VEHICLE:KA01AB1234", "SIGHTED_AT", "LOCATION:L2"),
        ("PERSON:P1", "SIGHTED_AT", "LOCATION:L2"),
    }


@pytest.mark.parametrize("chars", [3, 1 << 20])
def test_dictionary_of_any_size(spark, chars):
    docs = spark.createDataFrame([(1, 1, "The Raocorp WAREHOUSE seven"), (2, 1, "nothing"), (3, 2, "warehouse Seven"), (4, 1, None)], "file long, case_id long, content string")
    names = spark.createDataFrame([(1, "a", "Rao"), (1, "b", "Warehouse Seven"), (2, "c", "zzzzzzz")], "case_id long, key string, name string")
    assert sorted((r.file, r.key) for r in extract.dictionary_mentions(docs, names, shard_chars=chars, block_chars=chars).collect()) == [(1, "a"), (1, "b")]


def test_header_roles():
    columns = ["Call_ID", "Caller", "Receiver", "Date", "Time"]
    r = roles.call_roles(columns)
    assert (r.source, r.target, r.time) == ("Caller", "Receiver", "Time")
    assert roles.record_kind(columns) == "CDR" and roles.record_kind(["Sender Account"]) == "FINANCIAL" and roles.record_kind(["x"]) == "ENTITY_MASTER"
    assert roles.find_column(["Full Name (en)"], ["name"]) == "Full Name (en)" and roles.find_column(["q"], ["name"]) is None


def test_ledger_finds_the_first_bad_block(spark):
    rows = [("a", i, "2024-01-01 00:00:00.000001", "E", '{"n":%d}' % i) for i in range(5)]
    events = spark.createDataFrame(rows, "chain_id string, id long, ts string, event_type string, payload string").withColumn("ts", F.col("ts").cast("timestamp"))
    blocks = ledger.append_blocks(events).cache()
    assert [tuple(r) for r in ledger.verify_chains(blocks).collect()] == [("a", True, 5, None)]
    for change in ({"payload": F.lit("{}")}, {"previous_hash": F.lit("x")}, {"created_at": F.lit("now")}):
        bad = blocks.withColumns({k: F.when(F.col("block_index") == 2, v).otherwise(F.col(k)) for k, v in change.items()})
        assert [tuple(r) for r in ledger.verify_chains(bad).collect()] == [("a", False, 3, 2)]
    assert ledger.verify_chains(blocks.filter("block_index <> 1")).first().valid is False


def test_paragraph_packing_matches_a_plain_loop(spark):
    def plain(text, size):
        out, cur, n = [], [], 0
        for p in [x.strip() for x in text.strip().split("\n\n") if x.strip()]:
            if n + len(p) > size and cur:
                out.append("\n\n".join(cur))
                cur, n = [p], len(p)
            else:
                cur.append(p)
                n += len(p) + 2
        return out + (["\n\n".join(cur)] if cur else [])

    texts = ["a" * 10 + "\n\n" + "b" * 12 + "\n\n" + "c" * 9 + "\n\n\n\nd", "", "one", "x" * 50 + "\n\n" + "y"]
    docs = spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], "document_id long, case_id long, content string")
    got = {}
    for r in retrieval.paragraph_chunks(docs, 25).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r.chunk)
    assert got == {i: plain(x, 25) for i, x in enumerate(texts) if plain(x, 25)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_normalisers_are_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for f in (t.name, t.phone, t.email, t.account, t.clean, t.squeeze):
        once = df.select(f(F.col("v")).alias("v"))
        # an eight-digit rest of 91... can lose its prefix twice only if it had twelve digits again, which ten digits never have
        assert once.select(f(F.col("v")).alias("v")).collect() == once.collect()


def test_strip_takes_all_white_space_of_unicode_and_nothing_else(spark):
    """Every character at both ends and inside, against the pattern; no pattern is matched for it."""
    points = spark.range(1, 0x10000).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    rows = points.select(F.explode(F.array("c", F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c"), F.concat(F.lit(" \n"), "c", F.lit("　x \r\n")))).alias("s"))
    out = rows.select(t.strip(F.col("s")).alias("got"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("want"))
    assert out.filter("NOT got <=> want").count() == 0 and rows.count() > 190_000
    assert "regexp" not in out.select("got")._jdf.queryExecution().executedPlan().toString()
