import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from caseflow.llm import sentencepiece_fst as fst

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def ids(t, text):
    return np.frombuffer(t.encode(text), "<u4").tolist()


def test_encoding_and_decoding_equal_the_library():
    t, sp = fst.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(11)
    alphabet = [" ", "  ", "\n", "\t", "\xa0", "▁", "a", "the", "ing", "aaaa", "é", "́", "ß", "中", "\U0001f600", "<s>", "<unk>", "<0x41>", "1", "!!", "�", "İ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "a" * 500, " " * 40, "ab" * 300]
    for text in texts:
        assert ids(t, text) == sp.encode(text), repr(text)
        assert t.decode(ids(t, text)) == sp.decode(sp.encode(text)), repr(text)


def test_whole_table_against_the_library(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in fst.op6_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        want = sp.encode(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert g.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest() and g.round_trip


def test_nulls_repeats_long_and_empty(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "x ▁y", 3), (2, "word " * 60000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens, r.round_trip) for r in fst.encode_decode(docs, MODEL).collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == sorted([("None", 0, True), ("1", 0, True), ("1", len(sp.encode("x ▁y")), False), ("2", len(sp.encode("word " * 60000)), True)])
    assert fst.encode_decode(docs.limit(0), MODEL).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, v):
    return varint(n << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(n << 3) + varint(v)


def unigram_model(path, scores):
    """A model file by hand: unknown, control and byte pieces, then those with scores."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in scores.items()]]
    raw = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    raw += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path.write_bytes(raw)
    return str(path)


def test_weights_decide_in_a_unigram_model(tmp_path):
    """The same pieces with other scores are cut elsewhere, as by the library; without weights both would be cut alike."""
    rng = random.Random(3)
    pieces = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    seen = set()
    for k in range(4):
        file = unigram_model(tmp_path / f"m{k}", {p: -rng.uniform(1, 9) for p in pieces})
        t, sp = fst.Transducer(file), sentencepiece.SentencePieceProcessor(model_file=file)
        texts = ["".join(rng.choice(["a", "b", "c", "c", " ", "  ", "é", "x"]) for _ in range(rng.randint(0, 14))) for _ in range(500)] + ["abcabcab ab", ""]
        for text in texts:
            assert ids(t, text) == sp.encode(text), (k, text)
        got, bounds = t.encode_texts(pa.array(texts))
        assert [got[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)] == [sp.encode(x) for x in texts]
        seen.add(tuple(ids(t, "abcabcab ab")))
    assert len(seen) > 1


def test_weights_decide_in_a_merge_model():
    t, sp = fst.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = ["".join(p) for p in itertools.product(["the", "in", "er", "ation"], ["est", "or", "ing"], ["s", "ed", "le"], ["re", "nd"])]
    assert all(ids(t, w) == sp.encode(w) for w in words)
    path = t.shortest_path("▁tokenization")
    assert sum(t.weight(a, b) for a, b in zip([None, *path], path)) == 0 and t.weight("▁tok", "en") >= fst.BREAK
    t.arcs.clear()
    t.parts.clear()
    t.weight = lambda before, piece: 0.0
    assert any(ids(t, w) != sp.encode(w) for w in words)


def test_many_texts_at_once_equal_the_library(spark, sf):
    t, sp = fst.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", " ", "a", " a", "a ", "a  b", "▁", "x▁y", "\x01 q", "\x01", "é\n\tb c"] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got, bounds = t.encode_texts(pa.array(texts))
    for x, a, z in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert got[a:z].tolist() == sp.encode(x or ""), repr(x)[:80]
