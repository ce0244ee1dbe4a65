import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import periodic_runs as pr


def brute_runs(x):
    """All runs by comparing the words q apart, for every q; a stretch counts under its smallest period alone."""
    n, out, seen = len(x), [], set()
    x = np.asarray(x)
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0]))
        edge = np.flatnonzero(np.diff(same))
        for s, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = z - s + q
            if length >= max(6, 4 * q) and (s, length) not in seen:
                seen.add((s, length))
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 12)), max_size=8))
def test_random_powers_against_brute_force(parts):
    x = np.array([w for part, times in parts for w in part * times], np.int64)
    assert pr.runs(x) == brute_runs(x)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words_against_brute_force(letters):
    rng = np.random.default_rng(letters)
    for n in [*range(40), 257, 700]:
        x = rng.integers(0, letters, n)
        assert pr.runs(x) == brute_runs(x), n


def test_long_periods_nested_runs_and_one_word():
    rng = np.random.default_rng(6)
    for p in (5, 64, 127, 128, 129, 1000):
        body = rng.integers(0, 5000, p)
        body[: p // 2] = 7  # a run inside each period
        x = np.concatenate((rng.integers(0, 5000, 77), np.tile(body, 5)[: int(4.3 * p) + 1], rng.integers(0, 5000, 50)))
        assert pr.runs(x) == brute_runs(x), p
    assert pr.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    x = np.tile(np.concatenate((np.zeros(500, np.int64), [1])), 60)
    assert (0, len(x), 501) in (got := pr.runs(x)) and len(got) == 61


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, pr.PRIME, (2, 16)).astype(np.uint64) for _ in range(2))
    c = pr.transform(pr.transform(a) * pr.transform(b) % np.uint64(pr.PRIME), inverse=True)
    for r in range(2):
        assert [sum(int(a[r, i]) * int(b[r, (k - i) % 16]) for i in range(16)) % pr.PRIME for k in range(16)] == c[r].tolist()
    x = rng.integers(0, 3, 400).astype(np.uint64)
    starts = np.arange(0, 300, 8)
    got = pr.zero_mismatch(x, starts, 8)
    assert got.tolist() == [[np.array_equal(x[s : s + 8], x[s + 8 + i : s + 16 + i]) for i in range(8)] for s in starts]


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    ids = {}
    found = brute_runs([ids.setdefault(w, len(ids)) for w in words])
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(found), *(best or (None, None, None)), None if best is None else 1000 * best[1] // best[2], *digests)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_whole_table_against_brute_force(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    got = sorted(tuple(r) for r in pr.op11_periodic_runs(spark, sf).select(*COLUMNS).collect())
    want = sorted(expected(i, x) for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    assert got == want and sum(r[1] > 0 for r in got) > 5


def test_nulls_empty_long_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, 4), (2, "", 5), (3, " \t\n", 6), (None, "a a a a a a b", 7), (4, "x " * 5, 8), (4, "x " * 6, 9), (4, "x " * 6, 9), (5, "\x0ba\x0cb\ra b\ta\nb a b", 1), (6, "a a " * 6 + "é", 2), (7, "one two three " * 60_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in pr.periodic_runs(df).collect())
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (0, 7, [(0, 6, 1)], "a b"), (4, 5, [], "x x x x x"), (4, 6, [(0, 6, 1)], "x"), (4, 6, [(0, 6, 1)], "x"),
        (5, 8, [(0, 8, 2)], "a b"), (6, 7, [(0, 6, 1)], "a a é"), (7, 180_000, [(0, 180_000, 3)], "one two three")])
    assert pr.periodic_runs(df.limit(0)).count() == 0
