"""Removal of repeated passages: windows of consecutive words that occurred earlier in the corpus.

Windows are grouped by super-k-mers. Every window has a minimiser, the word m-gram of least
hash inside it, and a maximal run of consecutive windows with one minimiser travels as one packed string. Equal windows
have equal minimisers, so only runs whose minimiser occurs more than once can hold a repeated window: minimisers
are counted first (8 bytes a run), and only the runs that are left are packed with their words and sent to their
bucket, where the exact word sequences decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Workspace, keep_one, null_safe, table, text_slices, tidy

WINDOW = 20
GRAM = 6
#: Runs of one minimiser that are sorted in one task; the windows of more frequent minimisers are grouped one by one.
BUCKET = 4000
#: Length of a span that stands for all windows of a text.
WHOLE = 1 << 30
_SLICE = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def super_kmers(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Arrays (text number, first word, windows, minimiser) of the runs of all texts, in order; words as in bytes.split()."""
    big = b"\n".join(texts) + b"\n"
    b = np.frombuffer(big, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    empty = np.zeros(0, np.int64)
    if len(starts) < window:
        return empty, empty, empty, empty
    n = len(b)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), dtype=np.uint64)))
    words = _mix((sums[ends] - sums[starts]) * _powers(_PINV, n)[starts] + (ends - starts).astype(np.uint64))
    del sums
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(grams)]
    grams = _mix(grams)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_start = np.cumsum(lengths) - lengths
    of = np.searchsorted(text_start, starts, side="right") - 1
    first_word = np.searchsorted(starts, text_start)
    at = np.arange(len(starts) - window + 1)
    least = at + np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1)
    whole = of[: len(at)] == of[window - 1 :]
    at, least = at[whole], least[whole]
    if not len(at):
        return empty, empty, empty, empty
    new = np.concatenate(([True], (np.diff(least) != 0) | (np.diff(at) != 1)))
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate((head, [len(at)])))
    text = of[at[head]]
    return text, at[head] - first_word[text], count, grams[least[head]].view(np.int64)


def _bytes(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint (first word, words) from any spans."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(a, z - a) for a, z in out]


_KEY = ["doc_id", "th"]
_MARK = "doc_id long, th long, spans array<struct<s:int,n:int>>"
_MARK_T = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())]))


def _mark_batch(ids, ths, spans):
    rows = [[{"s": s, "n": n} for s, n in x] for x in spans]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(rows, _MARK_T)], names=["doc_id", "th", "spans"])


def _find_runs(window: int, gram: int):
    def run(batches):
        keep_one("substring_dedup", dict)
        for b in tidy(batches):
            texts = _bytes(b.column(2))
            for a, z in text_slices([len(t) for t in texts], _SLICE):
                text, start, count, key = super_kmers(texts[a:z], window, gram)
                at = pa.array(text + a)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(key), pa.array(start.astype(np.int64) << 8 | count)], names=["doc_id", "th", "key", "run"])

    return run


def _halves(packed: bytes) -> tuple[int, int]:
    """A 128-bit digest as two signed longs."""
    h = xxhash.xxh3_128_intdigest(packed)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


_PACKED = "doc_id long, th long, start long, n int, key long, low long, packed binary"


def _packed_batch(out):
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "th", "start", "n", "key", "low", "packed"])


def _pack(window: int):
    """Rows of (doc_id, th, text, runs [(key, run, many)]) -> packed strings; the key of ``many`` runs is a digest of all their words (low is set)."""

    def run(batches):
        for b in tidy(batches):
            out = [[] for _ in range(7)]
            size = 0
            texts = b.column(2)
            lists = b.column(3)
            ends, items = lists.offsets.to_numpy(), lists.values
            keys, places, many = (items.field(n).to_numpy(zero_copy_only=False) for n in ("key", "run", "many"))
            for i, (doc, th) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                for j in range(ends[i], ends[i + 1]):
                    start, n = int(places[j]) >> 8, (int(places[j]) & 255) + window - 1
                    packed = b" ".join(words[start : start + n])
                    size += len(packed)
                    key, low = _halves(packed) if many[j] else (int(keys[j]), None)
                    for c, v in zip(out, (doc, th, start, n, key, low, packed), strict=True):
                        c.append(v)
                if len(out[0]) > 20000 or size > 1 << 23:
                    yield _packed_batch(out)
                    out, size = [[] for _ in range(7)], 0
            yield _packed_batch(out)

    return run


def _windows(window: int):
    """(first occurrence, packed) of distinct runs -> a row for each window, with its digest."""

    def run(batches):
        for b in tidy(batches):
            out = [[] for _ in range(7)]
            for doc, th, start, packed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = packed.split(b" ")
                for j in range(len(words) - window + 1):
                    row = (doc, th, start + j, window, *_halves(b" ".join(words[j : j + window])), None)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield _packed_batch(out)

    return run


def _count_bucket(window: int):
    """Rows sorted by (key, doc_id, th, start): the spans of all windows that a row before, of the same key, has."""

    def run(batches):
        key, seen, whole = None, set(), set()
        for b in tidy(batches):
            ids, ths, spans = [], [], []
            for doc, th, start, k, packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if k != key:
                    key, seen, whole = k, set(), set()
                words = packed.split(b" ")
                n = len(words) - window + 1
                if packed in whole:
                    found = [(start, len(words))]
                else:
                    whole.add(packed)
                    found = []
                    for j in range(n):
                        w = b" ".join(words[j : j + window])
                        if w in seen:
                            found.append((start + j, window))
                        else:
                            seen.add(w)
                    found = _merged(found)
                if found:
                    ids.append(doc)
                    ths.append(th)
                    spans.append(found)
            if ids:
                yield _mark_batch(ids, ths, spans)

    return run


def distinct_rows(ws: Workspace, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``docs`` with rows of equal doc_id and text once. texts: (doc_id, th, digest) of every row; only rows that repeat are moved."""
    again = ws.save(texts.groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th"), "repeated-rows")
    if again.isEmpty():
        return docs
    match = null_safe(docs, again, _KEY)
    once = ws.save(docs.join(again, match, "left_semi").dropDuplicates(_KEY), "once")
    return docs.join(again, match, "left_anti").unionByName(once)


def later_copies(ws: Workspace, texts: DataFrame) -> DataFrame:
    """(doc_id, th) of the documents (doc_id, th, digest) whose whole text another document before them has."""
    first = texts.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    first = ws.save(first.select("digest", F.col("f.doc_id").alias("first_id")), "first-texts")
    return ws.save(texts.join(first, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "th").distinct(), "copies")


def repeated_spans(ws: Workspace, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, spans) per document with repeated windows; ``docs``: doc_id long, th long, text. Spans may overlap.

    Rows of equal doc_id and text are one document. Later copies of whole texts are marked at once, from their digests, and their runs are left out of the rest.
    """
    texts = ws.save(docs.select("doc_id", "th", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")), "texts")
    docs = distinct_rows(ws, docs, texts)
    copies = later_copies(ws, texts)
    runs = ws.save(docs.mapInArrow(_find_runs(window, gram), "doc_id long, th long, key long, run long"), "runs")
    often = ws.save(runs.groupBy("key").count().filter("count > 1").select("key"), "often")
    left = runs.join(often, "key")
    left = ws.save(left.join(copies, null_safe(left, copies, _KEY), "left_anti").select("doc_id", "th", "key", "run"), "left")
    ws.drop(runs, often)
    often = ws.save(left.groupBy("key").count().filter("count > 1"), "often")
    left = left.join(often, "key").select("doc_id", "th", F.struct("key", "run", (F.col("count") > bucket).alias("many")).alias("r"))
    left = left.groupBy("doc_id", "th").agg(F.collect_list("r").alias("runs"))
    packed = docs.join(left, null_safe(docs, left, _KEY)).select(docs.doc_id, docs.th, docs.text, left.runs)
    packed = ws.save(packed.mapInArrow(_pack(window), _PACKED), "packed")
    order = ["doc_id", "th", "start"]
    few = packed.filter("low is null").select(*order, "key", "packed").repartition("key").sortWithinPartitions("key", *order)
    marks = few.mapInArrow(_count_bucket(window), _MARK)
    marks = marks.union(copies.select("doc_id", "th", F.array(F.struct(F.lit(0).alias("s"), F.lit(WHOLE).alias("n"))).alias("spans")))

    # frequent minimisers: equal runs first, then the windows of the distinct runs that are left. A document's runs (or windows)
    # without those that come first of their kind are found by document, so that common runs are not joined one by one
    many = packed.filter("low is not null")
    place = F.struct(*order, "n")
    distinct = ws.save(many.groupBy("key", "low").agg(F.min(place).alias("f"), F.first("packed").alias("packed")), "distinct")
    single = ws.save(distinct.select("f.doc_id", "f.th", "f.start", "packed").mapInArrow(_windows(window), _PACKED), "windows")
    for rows, first in ((many, distinct), (single, single.groupBy("key", "low").agg(F.min(place).alias("f")))):
        span = F.struct(F.col("start").cast("int").alias("s"), "n")
        listed = lambda df, name: df.groupBy("doc_id", "th").agg(F.collect_list(span).alias(name))  # noqa: E731, B023
        own, kept = listed(rows, "own"), ws.save(listed(first.select("f.*"), "kept"), "kept")
        own = own.join(kept, null_safe(own, kept, _KEY), "left").select(own.doc_id, own.th, F.when(kept.kept.isNull(), own.own).otherwise(F.array_except(own.own, kept.kept)).alias("spans"))
        marks = marks.union(own.filter("size(spans) > 0"))
    return marks.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(window: int, keep_text: bool):
    """(doc_id, text, spans, more ...) -> counts, digest and text of what is left."""

    def run(batches):
        for b in tidy(batches):
            texts, spans, at = b.column(1), b.column(2), 0
            while at < b.num_rows:
                total, removed, sha, kept, size, first = [], [], [], [], 0, at
                while at < b.num_rows and size < 1 << 23:
                    text = texts[at].as_py()
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    left, word, gone = [], 0, 0
                    marked = [(x["s"], min(x["n"], len(words))) for x in spans[at].as_py() or ()]
                    for s, n in _merged(marked) if len(words) >= window else ():
                        left += words[word:s]
                        word, gone = s + n, gone + n
                    left += words[word:]
                    out = b" ".join(left)
                    total.append(len(words))
                    removed.append(gone)
                    sha.append(hashlib.sha256(out).hexdigest())
                    if keep_text:
                        # untouched texts keep their white space
                        kept.append(out.decode("utf-8", "surrogatepass") if gone else text)
                        size += len(out)
                    at += 1
                part = b.slice(first, at - first)
                cols = {"doc_id": part.column(0), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
                if keep_text:
                    cols["kept_text"] = pa.array(kept, pa.string())
                cols |= dict(zip(b.schema.names[3:], part.columns[3:], strict=True))
                yield pa.record_batch(list(cols.values()), names=list(cols))

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET, keep_text: bool = True, columns=()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text], columns...) of every row: the text without the words of repeated windows.

    A window repeats if its words also start earlier: in a smaller doc_id, or earlier in the same document. kept_text
    is the text itself where nothing was removed, else the words left, joined by one space. Null texts have no words (kept_text stays null),
    and documents shorter than a window lose nothing. A null doc_id comes before all others; of rows that share a doc_id, the text of smaller xxhash64 comes
    first, and rows equal in both are one document that is listed again, so their results are equal. Empty tables give no rows; of
    other columns only ``columns`` are read and passed on (their names must differ from those of the result).
    """
    ws = Workspace(spark, "substring")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans = ws.save(repeated_spans(ws, keyed, window, gram, bucket), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", *columns)
    joined = rows.join(spans, null_safe(rows, spans, _KEY), "left").select(rows.doc_id, rows.text, spans.spans, *[rows[c] for c in columns])
    kept = [StructField("kept_text", StringType())] if keep_text else []
    more = [docs.schema[c] for c in columns]
    schema = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), *kept, *more])
    return joined.mapInArrow(_cut(window, keep_text), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM s),
f AS (SELECT win, min((doc_id, i)) AS first FROM w GROUP BY win HAVING count(*) > 1),
r AS (SELECT w.doc_id, list(DISTINCT p) AS gone FROM (SELECT w.doc_id, unnest(range(i, i + 20)) AS p FROM w JOIN f USING (win) WHERE (w.doc_id, w.i) <> f.first) w GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
}
