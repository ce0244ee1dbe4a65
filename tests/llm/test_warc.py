import base64
import hashlib
import io

import duckdb

from caseflow.llm import warc
from caseflow.llm.common import Workspace

COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_whole_table_against_sql(spark, sf):
    got = sorted(map(tuple, warc.op3_warc(spark, sf).select(COLS).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert got == sorted(con.execute(f"select {', '.join(COLS)} from ({warc.ORACLE_SQL['op3_warc']})").fetchall()) and got


def test_records_read_back_and_files_roll(spark):
    rows = [(i, f"http://x/{i}", ["same", "é" * 300, None, f"own {i}"][i % 4] if i % 5 else "") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    want = sorted((i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    got = warc.warc_round_trip(spark, pages, shard_bytes=20000, file_bytes=3000)
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, got.select(COLS).collect()), key=key) == sorted(want, key=key)


def test_files_are_the_same_for_other_partitions(spark, tmp_path):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(cast(id % 7 as string), 200) as html")
    seen = []
    for n, df in enumerate((pages, pages.repartition(9))):
        folder = f"file://{tmp_path}/{n}"
        warc.write_warc(Workspace(spark, "t"), df, folder, shard_bytes=30000, file_bytes=2000)[0].count()
        files = sorted((tmp_path / str(n)).iterdir())
        assert not [f for f in files if f.name.endswith(".tmp")]
        seen.append([(f.name, f.read_bytes()) for f in files])
    assert seen[0] == seen[1] and len(seen[0]) > 3


def test_archives_are_read_by_as_many_tasks_as_shards(spark, tmp_path):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(cast(id as string), 200) as html")
    manifest, folder, shards = warc.write_warc(Workspace(spark, "t"), pages, f"file://{tmp_path}", shard_bytes=30000)
    read = warc.read_warc(manifest, folder, shards)
    assert shards > 4 and read.rdd.getNumPartitions() == shards
    assert read.selectExpr("spark_partition_id() as p").distinct().count() > 2


def test_rows_of_one_page_id_are_dealt_over_shards(spark, tmp_path):
    pages = spark.range(400).selectExpr("if(id % 2 = 0, null, 7L) as page_id", "'u' as url", "repeat(cast(id % 50 as string), 100) as html")
    manifest, folder, shards = warc.write_warc(Workspace(spark, "t"), pages, f"file://{tmp_path}", shard_bytes=8000)
    rows = warc.read_warc(manifest, folder, shards).collect()
    assert shards >= 20 and manifest.count() >= 20
    # null ids hold the even payloads, 7 the odd ones; each of the 50 payloads has one response
    assert len(rows) == 400 and sum(r.record_type == "response" for r in rows) == 50
    assert {r.payload_digest for r in rows} == {digest(str(k) * 100) for k in range(50)}


def test_one_record_by_hand():
    raw = warc.gzip_member(warc.warc_record(5, "http://x/\r\ny z", b"<p>")) + warc.gzip_member(warc.warc_record(6, None, b"<p>", 5, True))
    (h, block), (r, empty) = warc.read_records(io.BytesIO(raw))
    assert h["warc-target-uri"] == "http://x/%0D%0Ay%20z" and block.endswith(b"\r\n\r\n<p>")
    assert r["warc-type"] == "revisit" and r["warc-refers-to"] == h["warc-record-id"] and empty.endswith(b"Content-Length: 3\r\n\r\n")


def test_nulls_repeats_long_and_empty(spark):
    rows = [(None, None, "a", 1), (None, "u", "a", 2), (7, "u", "a", 3), (7, "v", "a", 4), (3, "u", None, 5), (9, "u", "", 6), (2, "u", "z" * 3_000_000, 7), (None, "w", "only", 8), (None, "w", "only", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark, pages).collect()), key=str)
    want = [("None", 1, "revisit", 7), ("None", 1, "revisit", 7), ("7", 1, "response", None), ("7", 1, "revisit", 7), ("3", 0, "response", None), ("9", 0, "revisit", 3), ("2", 3_000_000, "response", None), ("None", 4, "response", None), ("None", 4, "revisit", None)]
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0
