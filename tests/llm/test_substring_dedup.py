import hashlib
import random

import duckdb
import pytest

from caseflow.llm import substring_dedup as sd


def brute(rows, window):
    """rows: (doc_id, text); ids distinct."""
    first, out = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if first.setdefault(w, (doc, i)) != (doc, i):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table_against_brute_force_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 20)
    assert rows_of(sd.op2_substring_dedup(spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({sd.ORACLE_SQL['op2_substring_dedup']})").fetchall()) == want


@pytest.mark.parametrize("bucket", [1, 3, 4000])
def test_random_repeats_in_small_and_large_buckets(spark, bucket):
    rng = random.Random(bucket)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice([" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))), rng.choice(shared), "x " * rng.randint(0, 30)]) for _ in range(4)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(sd.remove_repeats(spark, docs, window=8, gram=3, bucket=bucket)) == brute(rows, 8)


def test_nulls_repeats_long_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(None, long, 1), (7, long + "\xa0tail", 2), (7, None, 3), (8, "", 4), (9, "a b", 5), (9, "a b", 6), (10, " ".join("k" * 30), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in sd.remove_repeats(spark, docs).collect()), key=str)
    assert got == sorted([(None, 60000, 0), (7, 60000, 59999), (7, 0, 0), (8, 0, 0), (9, 2, 0), (9, 2, 0), (10, 30, 29)], key=str)
    assert sd.remove_repeats(spark, docs.limit(0)).count() == 0


def test_repeated_rows_cost_a_row_each(spark, monkeypatch):
    """Rows of one id and one text: what is packed for the buckets does not grow with their number, and every row has its result."""
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefgh") for _ in range(600))
    other = " ".join(rng.choice("abcdefgh") for _ in range(300)) + " " + text[:200]
    packed, save = [], sd.Workspace.save

    def counting(self, df, name):
        out = save(self, df, name)
        if name == "packed":
            packed.append(out.count())
        return out

    monkeypatch.setattr(sd.Workspace, "save", counting)
    for doc in (None, 3):
        for n in (1, 20, 200):
            docs = spark.createDataFrame([(doc, text)] * n + [(9, other)], "doc_id long, text string")
            got = rows_of(sd.remove_repeats(spark, docs.repartition(4), window=8, gram=3).fillna(-1, ["doc_id"]))
            assert got == sorted(brute([(-1 if doc is None else doc, text), (9, other)], 8) + brute([(-1 if doc is None else doc, text)], 8) * (n - 1))
    assert len(set(packed)) == 1
