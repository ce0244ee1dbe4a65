"""Scans of a whole table written as files, when the files of a part do not fit one file."""

import pytest

from caseflow.plans import ledger_queries
from caseflow.sources import files


@pytest.fixture
def folder(spark, tmp_path):
    def make(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_size_limit_is_one_of_files_and_not_of_the_table(spark, folder):
    sf = folder("documents", [(i, "x" * 500) for i in range(80)], "doc_id long, text string")
    assert tuple(ledger_queries.size_limit(spark, sf, max_bytes=1000).first()) == (8, 8)


def test_a_file_over_the_limit_is_told(spark, folder):
    sf = folder("documents", [(i, "x" * (2000 if i == 3 else 500)) for i in range(16)], "doc_id long, text string")
    assert tuple(ledger_queries.size_limit(spark, sf, max_bytes=1000).first()) == (8, 7)


def test_text_scan_reads_files_of_bounded_size(spark, folder, monkeypatch):
    sf = folder("conversations", [(i, "a  b") for i in range(120)], "conv_id long, text string")
    sizes, read = [], files.read_text
    monkeypatch.setattr(ledger_queries, "LINES", 5, raising=False)
    monkeypatch.setattr(files, "read_text", lambda *x: (df := read(*x), sizes.extend(len(r.content.splitlines()) for r in df.collect()))[0])
    assert sorted(map(tuple, ledger_queries.text_scan(spark, sf).collect())) == [(p, 60) for p in range(6)]
    assert max(sizes) <= 5 and sum(sizes) == 120


def test_size_limit_writes_few_files_and_keeps_each_under_the_limit(spark, folder, monkeypatch):
    """Files of many documents; a document over the limit has one of its own, and only its part is without."""
    sf = folder("documents", [(i, None if i == 9 else "é" * (60_000 if i == 3 else 9_000 if i % 5 == 0 else 40)) for i in range(800)], "doc_id long, text string")
    seen, read, over = [], files.read_binary, files.oversized
    monkeypatch.setattr(files, "read_binary", lambda s, p, n: (df := read(s, p, n), seen.extend(r.length for r in df.collect()))[0])
    monkeypatch.setattr(files, "oversized", lambda s, p, n: (df := over(s, p, n), seen.extend(r.length for r in df.collect()))[0])
    assert tuple(ledger_queries.size_limit(spark, sf, max_bytes=100_000).first()) == (8, 7)
    assert len(seen) < 300 and sum(n > 100_000 for n in seen) == 1
    assert sum(seen) == 800 + 2 * (60_000 + 9_000 * 160 + 40 * 638)
