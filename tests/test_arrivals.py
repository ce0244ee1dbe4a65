"""Arriving evidence: batches against one batch, repeated batches, and what is read."""

import random

from caseflow.functions import roles
from caseflow.streaming import arrivals

CALLS = "case_id long, file long, ordinal long, Caller string, Receiver string, Date string, Time string"
MASTER = "case_id long, file long, ordinal long, entity_id string, entity_type string, name string, phone string, account string, email string, relationship string, related_entity_id string"


def master(rng, n, file):
    who = lambda: f"P{rng.randrange(40)}"
    return [(file % 2, file, i, who(), rng.choice(["person", "", "location"]), rng.choice(["A. Rao", "B", "C", "D", None]), rng.choice(["", "", f"90000000{rng.randrange(12):02d}"]), rng.choice(["", "", f"ACC{rng.randrange(9)}"]), rng.choice(["", "", f"m{rng.randrange(9)}@x.org"]), rng.choice(["", "knows"]), who()) for i in range(n)]


def tables(ev, batches):
    e = {(r.case_id, r.key, r.label, r.name, r.email) for r in ev.entities(batches).collect()}
    rows = [(r.case_id, r.source, r.target, r.relation, r.timestamp) for r in ev.edges(batches).collect()]
    assert len(rows) == len(set(rows))
    return e, set(rows)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    rows = [(1, 1, 0, "9000000001", "9000000002", "2024-01-01", "10:00"), (1, 1, 1, "9000000001", "9000000002", "2024-01-01", "10:00"), (2, 2, 0, "9000000001", "9000000003", "2024-01-01", "11:00"), (None, 3, 0, "9000000001", "9000000003", None, None)]
    df = spark.createDataFrame(rows, CALLS)
    ev = arrivals.Evidence(spark, str(tmp_path), buckets=4)
    handle = ev.handler(arrivals.call_batch(roles.call_roles(df.columns), "Date"))
    handle(df.filter("case_id = 1"), 0)
    assert [len(x) for x in tables(ev, 1)] == [2, 1]
    handle(df, 1)
    once = tables(ev, 2)
    handle(df, 1)
    assert tables(ev, 2) == once and [len(x) for x in once] == [6, 3]
    handle(df.limit(0), 2)
    assert tables(ev, 3) == once
    assert {k[1] for k in once[0] if k[0] == 2} == {"PHONE:9000000001", "PHONE:9000000003"}


def test_masters_batch_by_batch_equal_a_plain_run(spark, tmp_path):
    """Every row of a master resolved against the batches before: the same persons as by ``arrive`` over all earlier tables read whole."""
    rng = random.Random(3)
    ev = arrivals.Evidence(spark, f"{tmp_path}/looked", buckets=8, fan=3)
    whole = arrivals.Evidence(spark, f"{tmp_path}/whole", buckets=1, fan=3)
    for store in (whole._entities, whole._edges):
        store.find = lambda words, n, s=store: s.rows(n).drop("word", "batch", "bucket").distinct()
    frames = [spark.createDataFrame(master(rng, 30, n), MASTER) for n in range(3)]
    kind = arrivals.master_batch(roles.master_roles(frames[0].columns))
    for n, df in enumerate(frames):
        ev.handler(kind)(df, n)
        whole.handler(kind)(df, n)
    got, want = tables(ev, 3), tables(whole, 3)
    assert got == want
    assert any("_" in k for _, k, *_ in got[0]) and len(got[0]) < 3 * 30 * 3


def test_files_read_do_not_grow_with_batches(spark, tmp_path):
    store = arrivals.Store(spark, str(tmp_path), "n long", buckets=2, fan=3)
    for n in range(9):
        store.add(spark.range(n * 200, n * 200 + 200).selectExpr("concat('w', id) AS word", "id AS n"), n)
        # words of the newest batch alone, and absent ones
        found = store.find(spark.range(n * 200, n * 200 + 20).selectExpr("concat('w', id) AS word").union(spark.range(20).selectExpr("concat('x', id)")), n + 1)
        assert sorted(r.n for r in found.collect()) == list(range(n * 200, n * 200 + 20))
    assert max(store.files_read) <= 3  # the newest run of both buckets, and a false hit at most
    assert len(store._live(9)) <= 2 * 2 * 3 and store.rows(9).count() == 1800
    assert sorted(r.n for r in store.find(spark.sql("SELECT 'w3' AS word UNION ALL SELECT NULL UNION ALL SELECT 'w1799'"), 9).collect()) == [3, 1799]


def test_hot_words_and_many_words_of_a_run(spark, tmp_path):
    """A third of all rows under one word; a run of more words than a filter takes."""
    store = arrivals.Store(spark, str(tmp_path), "n long", buckets=2)
    store.add(spark.range(30000).selectExpr("if(id % 3 = 0, 'hot', concat('w', id)) AS word", "id AS n"), 0)
    assert all(3 <= cells <= 6 for *_, cells in store._live(1))
    assert store.find(spark.sql("SELECT 'hot' AS word"), 1).count() == 10000
    store.find(spark.range(400).selectExpr("concat('absent', id) AS word"), 1)
    assert store.find(spark.sql("SELECT 'w1' AS word"), 1).collect()[0].n == 1


def test_texts_and_transfers_share_accounts(spark, tmp_path):
    ev = arrivals.Evidence(spark, str(tmp_path), buckets=4)
    log = spark.createDataFrame([(1, "f", 0, "ACC12345", "ACC999", "10", "2024")], "case_id long, file string, ordinal long, Sender_Account string, Receiver_Account string, Amount string, Date string")
    ev.handler(arrivals.transfer_batch(roles.transfer_roles(log.columns)))(log, 0)
    texts = spark.createDataFrame([(1, "t", 0, "Paid by ACC12345, call 9876543210."), (1, "u", 0, None)], "case_id long, file string, ordinal long, content string")
    ev.handler(arrivals.text_batch())(texts, 1)
    entities, edges = tables(ev, 2)
    assert sorted(k for _, k, *_ in entities) == ["ACCOUNT:ACC12345", "ACCOUNT:ACC999", "PHONE:9876543210"] and len(edges) == 1


def test_a_batch_of_few_files_is_dealt_and_asks_for_no_edges_of_accounts(spark, tmp_path):
    """Batches without persons: rows of one file are extracted by all cores, and edges are looked for only to leave out those that are there."""
    rows = [(1, 1, i, f"ACC{i % 7:03d}", f"ACC{i % 5:03d}", "10", "2024") for i in range(70)]
    log = spark.createDataFrame(rows, "case_id long, file long, ordinal long, Sender_Account string, Receiver_Account string, Amount string, Date string").coalesce(1)
    kind, tasks = arrivals.transfer_batch(roles.transfer_roles(log.columns)), []

    def extracted(batch):
        tasks.append(len(batch.inputFiles()))
        return kind(batch)

    ev = arrivals.Evidence(spark, str(tmp_path), buckets=2)
    for n in (0, 1):
        ev.handler(extracted)(log, n)
    assert min(tasks) > 1
    # values, edges that give them, edges of persons: nothing is asked; edges that are there: both buckets
    assert ev._edges.files_read[-3:] == [0, 0, 2]
    entities, edges = tables(ev, 2)
    assert len(entities) == 7 and len(edges) == len({(r[3], r[4]) for r in rows if r[3] != r[4]})
