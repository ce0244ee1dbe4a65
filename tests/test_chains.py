import hashlib

import pytest
from pyspark.sql import functions as F

from caseflow.operators import ledger


def test_a_long_chain_is_not_gathered_into_a_cell(spark, capsys):
    rows = [("a" if i % 4 else "b", i, '"x\\' if i % 7 == 0 else "e", f'{{"n":{i}}}') for i in range(30_000)]
    events = spark.createDataFrame(rows, "chain_id string, id long, event_type string, payload string").selectExpr("chain_id", "id", "timestamp_seconds(id) AS ts", "event_type", "payload")
    blocks = ledger.append_blocks(events)
    blocks.explain()
    assert "collect_list" not in capsys.readouterr().out
    assert sorted(tuple(r) for r in ledger.verify_chains(blocks).collect()) == [("a", True, 22_500, None), ("b", True, 7_500, None)]


def plain_root(leaves, fan):
    levels = 0
    while len(leaves) > 1:
        leaves = [hashlib.sha256("".join(leaves[i : i + fan]).encode()).hexdigest() for i in range(0, len(leaves), fan)]
        levels += 1
    return leaves[0], levels


HEAD = "chain_id string, block_index int, block_hash string"


@pytest.mark.parametrize("n, fan", [(1, 16), (2, 2), (16, 16), (17, 16), (300, 16), (77, 3)])
def test_seal(spark, n, fan):
    heads = [(f"user{i}", i % 5, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
    root, proofs = ledger.seal(spark.createDataFrame([*heads, (None, 1, "x"), ("no hash", 1, None)], HEAD), fan)
    names = sorted(c for c, _, _ in heads)
    of = {c: hashlib.sha256(f'{{"block_hash":"{h}","block_index":{i},"chain_id":"{c}"}}'.encode()).hexdigest() for c, i, h in heads}
    want, levels = plain_root([of[c] for c in names], fan)
    assert [tuple(r) for r in root.collect()] == [(n, levels, want)]
    assert sorted((r.place, r.chain_id, r.leaf) for r in proofs.collect()) == [(i, c, of[c]) for i, c in enumerate(names)]
    # every other chain has another head, one has none any more, one is new
    now = [(c, i + (k % 2), h) for k, (c, i, h) in enumerate(heads)][: max(1, n - 1)] + [("new", 1, "x"), ("broken", None, None)]
    got = {r.chain_id: r.sealed for r in ledger.check_seal(spark.createDataFrame(now, HEAD), proofs, root, fan).collect()}
    assert got == {**{c: k % 2 == 0 and (n == 1 or k < n - 1) for k, (c, _, _) in enumerate(heads)}, "new": False, "broken": False}


def test_forged_proofs(spark):
    heads = spark.createDataFrame([(f"c{i}", 1, f"h{i}") for i in range(40)], HEAD)
    root, proofs = ledger.seal(heads, 4)
    other, forged = ledger.seal(heads.withColumn("block_hash", F.concat("block_hash", F.lit("!"))), 4)
    assert not any(r.sealed for r in ledger.check_seal(heads, forged, root, 4).collect())
    assert not any(r.sealed for r in ledger.check_seal(heads, proofs, other, 4).collect())
    moved = proofs.withColumn("place", F.col("place") + 1)
    assert not any(r.sealed for r in ledger.check_seal(heads, moved, root, 4).collect())
    short = proofs.withColumn("path", F.slice("path", 1, 1))
    assert not any(r.sealed for r in ledger.check_seal(heads, short, root, 4).collect())
    nothing, none = ledger.seal(heads.filter("false"))
    assert nothing.count() == 0 and none.count() == 0
    assert [r.sealed for r in ledger.check_seal(heads, proofs, nothing, 4).collect()] == [False] * 40
