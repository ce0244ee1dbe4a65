"""Periodic runs of words: repetitions with an exponent of four or more, found by block convolution at dyadic scales.

At scale B (a power of two) the periods B to 2B - 1 are sought. The words are cut into blocks of B; the sum of squared differences between a block
and the words at every distance in that range comes from one cyclic convolution, a number-theoretic transform
over the integers modulo a prime. Where it is zero for two neighbouring blocks at one distance, the pair seeds an extension to both
sides, word by word, which alone decides. A run of period q in the range has four periods at least, so it holds two whole
blocks with their copies: none is missed. Blocks are convolved only if every word in them occurs again within 2B words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_one, slices_of, table, tidy

#: A run has at least MIN_WORDS words and MIN_PERIODS periods; with fewer than four periods the search would need other blocks.
MIN_WORDS, MIN_PERIODS = 6, 4
#: A prime with 2**23 as divisor of its predecessor, and a primitive root of it.
PRIME, ROOT = 998244353, 3
#: Bytes of text that a task looks at in one go (a longer text alone), and numbers in one go of transforms.
TEXT_BYTES = 1 << 22
_POINTS = 1 << 20
_ROOTS: dict[tuple[int, bool], list[np.ndarray]] = {}


def _twiddles(n: int, inverse: bool) -> list[np.ndarray]:
    """The powers of the roots of unity for each stage of a transform of n points."""
    if (n, inverse) not in _ROOTS:
        stages, m = [], 2
        while m <= n:
            w = pow(ROOT, (PRIME - 1) // m, PRIME)
            w = pow(w, PRIME - 2, PRIME) if inverse else w
            powers = np.ones(m // 2, np.uint64)
            step = 1
            while step < m // 2:
                powers[step : 2 * step] = powers[:step] * np.uint64(pow(w, step, PRIME)) % np.uint64(PRIME)
                step *= 2
            stages.append(powers)
            m *= 2
        _ROOTS[n, inverse] = stages
    return _ROOTS[n, inverse]


def transform(a: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two of residues), or its inverse."""
    p, n = np.uint64(PRIME), a.shape[1]
    if n >= 1 << 24:
        raise ValueError("a transform has at most 2**23 points")
    bits = n.bit_length() - 1
    order = np.zeros(n, np.int64)
    for i in range(bits):
        order |= ((np.arange(n) >> i) & 1) << (bits - 1 - i)
    a = a[:, order]
    for w in _twiddles(n, inverse):
        half = len(w)
        parts = a.reshape(len(a), -1, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1] * w % p
        a = np.stack(((low + high) % p, (low + p - high) % p), axis=2).reshape(len(a), n)
    return a * np.uint64(pow(n, PRIME - 2, PRIME)) % p if inverse else a


def zero_mismatch(x: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """Whether the ``block`` numbers at each start equal those at distance block + i, for i in 0 .. block - 1, as far as sums modulo the prime tell: equal ones always do.

    x: residues; every start + 3 * block must lie within it.
    """
    p = np.uint64(PRIME)
    here = x[starts[:, None] + np.arange(block)]
    window = x[starts[:, None] + block + np.arange(2 * block)]
    squares = window * window % p
    sums = np.concatenate((np.zeros((len(x) and len(starts), 1), np.uint64), np.cumsum(squares, axis=1)), axis=1)
    there = (sums[:, block : 2 * block] - sums[:, :block]) % p
    own = (here * here % p).sum(axis=1, dtype=np.uint64)[:, None] % p
    # a cyclic convolution of 2 * block points with the reversed block; the places used see no wrapping
    reverse = np.concatenate((here[:, ::-1], np.zeros_like(here)), axis=1)
    product = transform(transform(window) * transform(reverse) % p, inverse=True)
    both = np.concatenate((product[:, block - 1 :], product[:, : block - 1]), axis=1)[:, :block]
    return (own + there + 2 * (p - both)) % p == 0


def _equal_ahead(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    n, step, done = len(x) - j, 16, 0
    while done < n:
        m = min(step, n - done)
        differ = x[i + done : i + done + m] != x[j + done : j + done + m]
        if differ.any():
            return done + int(differ.argmax())
        done += m
        step *= 2
    return n


def _equal_behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j (i < j), going back."""
    step, done = 16, 0
    while done < i:
        m = min(step, i - done)
        differ = (x[i - done - m : i - done] != x[j - done - m : j - done])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += m
        step *= 2
    return i


def _primitive(x: np.ndarray, start: int, period: int) -> bool:
    """Whether the first ``period`` words are no power of a shorter stretch."""
    left, r = period, 2
    divisors = []
    while r * r <= left:
        if left % r == 0:
            divisors.append(r)
            while left % r == 0:
                left //= r
        r += 1
    if left > 1:
        divisors.append(left)
    return not any(np.array_equal(x[start : start + period - period // r], x[start + period // r : start + period]) for r in divisors)


def runs(x: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in an array of word numbers, by start and period.

    A run is a maximal stretch of smallest period q with max(min_words, min_periods * q) words or more; min_periods is 4 at least.
    """
    if min_periods < 4:
        raise ValueError("runs need four periods at least")
    n = len(x)
    if n < max(min_words, min_periods):
        return []
    again = np.full(n, n, np.int64)  # distance to the next place of the same word
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    # spread-out residues, so that sums of squares vanish by chance about once in PRIME times; extension decides
    residue = ((x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(PRIME)
    found: list[tuple[int, int, int]] = []
    # first and last word and period of runs found so far, at the words they cover: what later blocks ask for
    run_end, run_period = np.zeros(n, np.int64), np.zeros(n, np.int64)
    farthest, block = again, 1
    while min_periods * block <= n:
        whole = n // block
        most = farthest[: whole * block].reshape(whole, -1).max(axis=1) if block > 1 else farthest
        near = most < 2 * block
        # the words compared with the second block of a pair end 4 * block after the pair's start
        pairs = np.flatnonzero(near[:-1] & near[1:])
        pairs = pairs[pairs * block + 4 * block <= n + block - 1]
        _search_scale(x, residue, pairs * block, block, min_words, min_periods, found, run_end, run_period)
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _search_scale(x, residue, starts, block, min_words, min_periods, found, run_end, run_period):
    """Adds the runs of periods block .. 2 * block - 1 to ``found``; starts: of pairs of neighbouring blocks that may lie in one."""
    n = len(x)
    # numbers past the end equal nothing
    padded = np.concatenate((residue, np.arange(1, 3 * block + 1, dtype=np.uint64) * np.uint64(7919) % np.uint64(PRIME)))
    done: dict[int, int] = {}
    step = max(1, _POINTS // (2 * block))
    for a in range(0, len(starts), step):
        part = starts[a : a + step]
        # pairs that lie whole, with their copies at any distance in range, in a run of smaller period show its multiples only
        inside = (run_period[part] > 0) & (run_end[part] >= part + 4 * block)
        part = part[~inside]
        if not len(part):
            continue
        asked = np.unique(np.concatenate((part, part + block)))
        zero = zero_mismatch(padded, asked, block)
        at = np.searchsorted(asked, part)
        hit, distance = np.nonzero(zero[at] & zero[np.searchsorted(asked, part + block)])
        for i, q in zip(part[hit].tolist(), (distance + block).tolist(), strict=True):
            if done.get(q, -1) >= i + 2 * block + q:
                continue
            small, end = int(run_period[i]), int(run_end[i])
            if small and end >= i + 2 * block and i + q <= end - small:
                continue  # the pair lies in a run of smaller period and so does its copy's beginning: a multiple of that period
            if i + q >= n or not np.array_equal(x[i : i + 2 * block], x[i + q : i + q + 2 * block]):
                continue
            start = i - _equal_behind(x, i, i + q)
            end = i + q + _equal_ahead(x, i, i + q)
            done[q] = max(done.get(q, -1), end)
            length = end - start
            if length >= max(min_words, min_periods * q) and _primitive(x, start, q):
                found.append((start, length, q))
                longer = np.arange(start, end)
                longer = longer[run_end[start:end] < end]
                run_end[longer], run_period[longer] = end, q


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of each text: what blanks and the characters 9 to 13 part. Null: none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(counts[offsets], pa.int32()), flat.filter(some))


def _look(texts: pa.Array, min_words: int, min_periods: int):
    """(runs, kept text, number of words) of each text. All texts are searched at once, parted by numbers that occur nowhere else."""
    lists = _words(texts)
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    sizes = np.diff(ends)
    codes = flat.dictionary_encode()
    ids = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.insert(ids, ends[1:], len(codes.dictionary) + np.arange(len(sizes)))
    first = ends[:-1] + np.arange(len(sizes))
    found = [[] for _ in sizes]
    kept = np.zeros(len(flat) + 1, np.int64)
    for start, length, period in runs(x, min_words, min_periods):
        d = int(np.searchsorted(first, start, side="right")) - 1
        found[d].append({"start": start - int(first[d]), "length": length, "period": period})
        kept[start - d + period] += 1
        kept[start - d + length] -= 1
    keep = np.cumsum(kept[:-1]) == 0
    before = np.concatenate(([0], np.cumsum(keep)))
    left = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), flat.filter(pa.array(keep)))
    return found, pc.binary_join(left, " "), sizes


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(``id_col``, n_words long, runs array<struct<start, length, period>>, kept_text) of every row of ``docs``.

    Words are what blanks and the characters 9 to 13 part. A run is a stretch of words with smallest period q and max(``min_words``, ``min_periods`` * q)
    words or more that no neighbouring word extends; runs come by start and period. kept_text: the words that no run
    holds after its first q words, joined by single blanks. Null, empty and blank texts have no word, no run and an empty kept_text. Ids may
    be null or repeat; each row has its row. Other columns are not read. A task holds some megabytes of text, or one longer text with
    about 80 bytes a word.
    """

    def run(batches):
        keep_one("periodic_runs", dict)
        for b in tidy(batches):
            for a, z in slices_of(b.column(1), TEXT_BYTES):
                found, left, sizes = _look(b.column(1).slice(a, z - a), min_words, min_periods)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.record_batch([b.column(0).slice(a, z - a), pa.array(sizes, pa.int64()), pa.array(found, kind), left.cast(pa.string())], names=[id_col, "n_words", "runs", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string")


#: The words of a text, as an array.
_SPLIT = r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"
#: A document of hash 0 modulo 10 repeats a stretch of its words from some word to its end.
_PLANTED = f"""CASE WHEN crc32(cast(doc_id AS string)) % 10 = 0 THEN element_at(transform(array({_SPLIT}), w ->
  element_at(transform(array(named_struct('g', crc32(cast(doc_id AS string)) div 10, 'n', size(w))), s ->
    IF(s.n = 0, '', element_at(transform(array(named_struct('a', s.g % s.n, 'p', 1 + (s.n - s.g % s.n) div (3 + s.g % 8))), t ->
      array_join(transform(w, (v, i) -> IF(i < t.a, v, w[int(t.a + (i - t.a) % t.p)])), ' ')), 1))), 1)), 1) ELSE text END"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which about a tenth have a planted one (see the contract's rule in ``_PLANTED``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PLANTED).alias("text"))
    # exponents are compared exactly: lengths times periods stay far below 2**63
    better = "r.length * b.period > b.length * r.period OR (r.length * b.period = b.length * r.period AND (r.start < b.start OR (r.start = b.start AND r.period < b.period)))"
    best = f"aggregate(runs, element_at(runs, 1), (b, r) -> IF({better}, r, b))"
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    out = periodic_runs(docs).withColumn("best", F.expr(f"IF(size(runs) = 0, NULL, {best})"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(F.expr(listed), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"), "n_words")


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
