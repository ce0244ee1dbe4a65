import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseflow.llm import encoding, packing, sharding, token_store
from caseflow.llm.common import slices_of
from caseflow.llm.encoding import PieceEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(file, texts):
    t = Tokenizer.from_file(file)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("file,spaces", [(BYTE, True), (WORD, False)])
def test_pieces_give_the_library_ids(spark, sf, file, spaces):
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\xa0", "　", "a", "B", "é", "é", "'s", "'", "1", "22", "!", "<|endoftext|>", "̈", "中", "😀", "\r\n", "\x1c", "ß", "İ", "~", "~~", "Σ", "J̌", "\x01", "a.", "b,c", ".\n", "\nx", "\n\n", "<|endoftext|>", "<|STARTOFTEXT|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [None, "", " ", "   x", "x   "]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    encoder = PieceEncoder(file, spaces)
    for at in range(0, len(texts), 997):
        ids, bounds = encoder.encode(pa.array(texts[at : at + 997], pa.string()), 7)
        got = [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        for text, a, z in zip(texts[at : at + 997], got, plain(file, texts[at : at + 997]), strict=True):
            assert a == [*z, 7], repr(text)[:200]


@pytest.mark.parametrize("file,spaces,text,special", [(BYTE, True, "hello <|endoftext|> world<|endoftext|>x <|ENDOFTEXT|>", 50256), (WORD, False, "hello <|startoftext|> World<|endoftext|>x <|ENDOFTEXT|>", 49407)])
def test_strings_of_special_tokens_have_the_ids_that_the_library_gives(file, spaces, text, special):
    ids, _ = PieceEncoder(file, spaces).encode(pa.array([text]))
    assert ids.tolist() == plain(file, [text])[0] and special in ids


def test_a_full_table_keeps_what_is_used():
    table = encoding.Recent(limit=5000)
    for k in range(500):
        assert table.fill(["often", f"w{k}"], lambda new: [p.encode() for p in new]) == [b"often", f"w{k}".encode()]
    assert len(table) + len(table.older) < 80 and ("often" in table or "often" in table.older)


def test_perfect_hash_is_minimal_and_tells_foreign_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    null = np.zeros(len(keys), bool)
    keys, null = np.append(keys, 0), np.append(null, True)
    mph = token_store.PerfectHash.build(keys, null)
    assert sorted(mph.slots(keys, null)) == list(range(len(keys)))
    assert token_store.PerfectHash.build(keys[:0], null[:0]).slots(keys[:2], null[:2]).tolist() == [-1, -1]


def test_store_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    want, at = [], 0
    for (i, _), ids in zip(rows, plain(BYTE, [t for _, t in rows]), strict=True):
        ids = ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    cols = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, token_store.op7_token_binary(spark, sf).select(cols).collect())) == want
    assert sorted(map(tuple, token_store.token_store(spark, docs, BYTE, shard_chars=20000).select(cols).collect())) == want


def test_store_nulls_repeats_and_unknown_keys(spark):
    rows = [(None, "a", 1), (5, "b b", 2), (5, None, 3), (5, "b b", 4), (-9, "c " * 40000, 5), (2**60, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = token_store.token_store(spark, docs, BYTE, shard_chars=10).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted([("None", 2), ("5", 3), ("5", 3), ("5", 1), ("-9", 40001 + 1), (str(2**60), 1)])
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.concatenate(([0], np.cumsum([r.n_tokens for r in by_start])[:-1])).tolist()
    assert [r.doc_id for r in by_start] == [None, -9, 5, 5, 5, 2**60]
    assert token_store.token_store(spark, docs.limit(0), BYTE).count() == 0


def test_cuts_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id * id * id as doc_id", "10 as size").union(spark.range(1).selectExpr("9000000000000000000", "10"))
    a = sharding.range_cuts(df, "doc_id", "size", 500)
    assert a == sharding.range_cuts(df.repartition(7), "doc_id", "size", 500) and 20 <= a.shards <= 45


def jobs_of(spark, call):
    spark.sparkContext.setJobGroup("cuts", "cuts")
    call()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cuts"))
    spark.sparkContext.setJobGroup("", "")
    return n


def test_cuts_take_as_many_jobs_for_many_shards_as_for_few(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 16)
    df = spark.range(20000).selectExpr("id * 3 as doc_id", "10 as size")
    found = {}
    for shards in (40, 400, 2000):
        n = jobs_of(spark, lambda: found.__setitem__(shards, sharding.range_cuts(df, "doc_id", "size", 200000 // shards)))  # noqa: B023
        assert n <= 40, (shards, n)
        sizes = sharding.with_shard(df.withColumn("h", F.xxhash64("doc_id")), "doc_id", "h", found[shards]).groupBy("shard").count().collect()
        assert shards <= found[shards].shards <= 3 * shards and max(r["count"] for r in sizes) * 10 <= 200000 // shards


def test_shards_are_bounded_by_number(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_SHARDS", 10)
    df = spark.range(5000).selectExpr("id as doc_id", "100 as size")
    assert sharding.range_cuts(df, "doc_id", "size", 100).shards <= 30


def test_one_id_and_null_ids_are_dealt_over_shards(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5L, id)) as doc_id", "10 as size", "xxhash64(id) as h")
    cuts = sharding.range_cuts(df, "doc_id", "size", 1000)
    assert cuts.null_parts == 10 and 11 in cuts.parts
    rows = sharding.with_shard(df, "doc_id", "h", cuts).collect()
    by = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r.shard for r in by] == sorted(r.shard for r in rows) and max(r.shard for r in rows) < cuts.shards


def test_store_of_hot_keys(spark):
    docs = spark.range(300).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5L, id)) as doc_id", "concat('word ', id) as text")
    rows = sorted(token_store.token_store(spark, docs, BYTE, shard_chars=100).collect(), key=lambda r: r.start)
    assert len(rows) == 300 and [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])[:-1])).tolist()
    assert [r.doc_id for r in rows] == [None] * 100 + sorted(r.doc_id for r in docs.filter("doc_id is not null").collect())


def test_ids_that_do_not_fit_their_width_raise(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert token_store.token_store(spark, docs, BYTE, end_id=70000).collect()[0].n_tokens == 2
    with pytest.raises(ValueError):
        token_store.token_store(spark, docs, BYTE, end_id=70000, width=2)


def slow_bfd(lengths, cap):
    rooms, out = [], []
    for n in lengths:
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            r, i = min(fit, key=lambda x: x[0])
        else:
            rooms.append(cap)
            r, i = cap, len(rooms) - 1
        out.append(r)
        rooms[i] -= n
    return out, len(rooms)


def test_best_fit_against_the_plain_rule():
    rng = random.Random(9)
    for _ in range(40):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 200))), reverse=True)
        windows, offsets = packing.best_fit_decreasing(lengths, 50)
        rooms, n = slow_bfd(lengths, 50)
        assert [50 - o for o in offsets] == rooms and len(set(windows)) == n


def check_packing(rows, want_ids, window):
    """rows: result rows; want_ids: sorted list of documents' ids with the end id."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    waste = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        assert {r.padded_length for r in parts} == {at if at & (at - 1) == 0 else window}
        waste += window - at
    assert sum(r.length for r in rows) == sum(map(len, want_ids))
    return waste


def test_whole_table_packs_every_id_once(spark, sf):
    rows = packing.op5_packing(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(docs, plain(WORD, list(docs.values())), strict=True))
    waste = check_packing(rows, [x + [1] for x in ids.values()], 2048)
    assert waste < 0.02 * sum(r.length for r in rows)
    seen = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        whole = ids[r.doc_id] + [1]
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] = r.start + r.length
    assert seen == {d: len(x) + 1 for d, x in ids.items()}


def test_packing_nulls_repeats_long_and_empty(spark):
    rows = [(None, None, 1), (None, None, 2), (1, "word " * 9000, 3), (1, "", 4), (2, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(spark, docs, WORD, group=2).collect()
    check_packing(got, [[1], [1], [0] * 9001, [1], [0] * 3], 2048)
    assert packing.pack(spark, docs.limit(0), WORD).count() == 0


def test_a_table_is_full_in_the_middle_of_many_new_pieces_and_texts_are_encoded_a_megabyte_at_a_time():
    table, names = encoding.Recent(limit=1 << 20), [f"w{k}" for k in range(100_000)]
    assert table.fill(names, lambda new: [p.encode() for p in new]) == [p.encode() for p in names]
    assert len(table) + len(table.older) < 20_000
    texts = pa.array(["a b " * 20_000] * 40)
    assert max(80_000 * (z - a) for a, z in slices_of(texts, encoding.SLICE)) <= 1 << 20
