"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits. ``covering_masks`` gives 2**(r+1)-1 bit masks such that any two
fingerprints within r bits agree under at least one mask in all its bits (R. Pagh, "CoveringLSH",
2016): bit i has a vector phi(i) of r+1 bits, mask v keeps the bits whose phi(i) has odd overlap with
v, and for at most r differing bits some v is orthogonal to all of their vectors. So no
pair in the radius is missed, whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components, keep_one, table

BITS = 64
SEED = 42
#: Members of a bucket that one task compares in memory; larger buckets go through midpoints.
BUCKET = 4096
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> bytes:
    """SimHash of the lower-cased (A-Z) words' shingles, 8 bytes, most significant bit first; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, ones, digest = len(starts), np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for k in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[a:z], SEED) for a, z in zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, th, fp long) of every row, th a hash of the text; the text is read once and not shuffled."""

    def run(batches):
        keep_one("simhash", dict)
        for b in batches:
            fps = [int.from_bytes(fingerprint(t.as_py(), shingle), "big", signed=True) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "th", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def covering_masks(radius: int, copies: int = 1) -> list[int]:
    """Masks (signed 64-bit) of a covering family. ``copies`` > 1 treats each bit as that many equal bits
    (radius x copies): more tables, each keeping more bits, for corpora beyond some 2**33 distinct texts."""
    width = radius * copies + 1
    top = (1 << width) - 1
    phi = [[1 + (i * copies + c) % top for c in range(copies)] for i in range(BITS)]
    out = []
    for v in range(1, top + 1):
        m = sum(1 << i for i in range(BITS) if any((v & p).bit_count() & 1 for p in phi[i]))
        out.append(m - (1 << 64) if m >> 63 else m)
    return sorted(set(out))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (later, earlier) of a spanning forest of the graph 'within radius' over distinct fingerprints."""
    n, parent, out = len(fps), list(range(len(fps))), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        part = fps[a : a + step]
        near = np.bitwise_count(part[:, None] ^ fps[None, :]) <= radius
        for i, j in zip(*np.nonzero(near), strict=True):
            i = int(i) + a
            if j < i and (x := root(i)) != (y := root(int(j))):
                parent[max(x, y)] = min(x, y)
                out.append((i, int(j)))
    return out


def links(ws: Workspace, fps: DataFrame, radius: int = 4, copies: int = 1, bucket: int = BUCKET) -> DataFrame:
    """Edges (a long, b long) between distinct fingerprints (column fp) that connect exactly the pairs within ``radius``.

    Every fingerprint gets one row per mask; a key is (mask, kept bits). Keys met once are dropped after a
    combined count. Buckets of up to ``bucket`` members are compared in one task, which
    returns a spanning forest (fewer edges than members), not pairs. The members of larger buckets are linked through midpoints
    instead: two values within r bits share a value within ceil(r/2) of both, and a group that shares a
    midpoint has a bounded size; consecutive members of such a group give the edges (checked against the radius).
    """
    masks = covering_masks(radius, copies)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    met = ws.save(keyed.groupBy("t", "key").count().filter("count > 1"), "buckets")
    members = keyed.join(met, ["t", "key"])

    def run(batches):
        key, held = None, []

        def close():
            rows = np.array(sorted(set(held)), np.int64)
            return [(int(rows[i]), int(rows[j])) for i, j in _forest(rows.view(np.uint64), radius)] if len(rows) > 1 else []

        for b in batches:
            out = []
            for t, k, fp in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (t, k) != key:
                    out += close()
                    key, held = (t, k), []
                held.append(fp)
            if out:
                yield pa.record_batch([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])
        if out := close():
            yield pa.record_batch([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])

    small = members.filter(F.col("count") <= bucket).select("t", "key", "fp")
    small = small.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long")

    large = members.filter(F.col("count") > bucket).select("fp").distinct()
    half = (radius + 1) // 2
    flips = [0]
    for _ in range(half):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(BITS)} | set(flips))
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    # (radius+1)//2 bits from each side can overshoot an odd radius by one, so the near side uses radius//2
    mids = large.select("fp", F.explode(F.array(*[F.lit(f) for f in flips])).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("mid"), F.bit_count("f").alias("d"))
    group = "PARTITION BY mid ORDER BY d, fp"
    chained = mids.select(F.col("fp").alias("a"), F.expr(f"first(fp) OVER ({group})").alias("b"), "mid")
    chained = chained.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return small.union(chained.select("a", "b"))


def _groups(ws: Workspace, docs: DataFrame, shingle: int, radius: int, copies: int, bucket: int) -> DataFrame:
    """(doc_id, th, fp, component_id) of every row."""
    fps = ws.save(fingerprints(docs, shingle), "fingerprints")
    nodes = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = ws.save(connected_components(ws, links(ws, nodes.select("fp"), radius, copies, bucket)), "components")
    linked = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    linked = ws.save(linked, "linked")
    least = ws.save(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    of = ws.save(linked.join(least, "component").select("fp", "component", "component_id"), "labels")
    return fps.join(of, "fp")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4, copies: int = 1, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): groups of documents joined by chains of fingerprints within ``radius`` bits.

    Null or wordless texts have fingerprint zero and link like any other. Equal fingerprints are one node,
    so repeated rows and copies never become pairs; every input row gives one row. A null doc_id gets its row and
    never becomes a component_id unless its group has no other. An empty table gives no rows; other columns are not read.
    """
    out = _groups(Workspace(spark, "simhash"), docs, shingle, radius, copies, bucket)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(ws: Workspace, docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least of their component; groups: (doc_id, th, component) of every row."""
    groups = ws.save(groups, "groups")
    rows = groups.groupBy("component", F.col("doc_id").isNull().alias("no_id"), "doc_id", "th").agg(F.count("*").alias("n"))
    kept = rows.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "th", "n")).alias("k"))
    kept = ws.save(kept.select(F.col("k.doc_id").alias("k_id"), F.col("k.th").alias("k_th"), F.col("k.n").alias("k_n")), "kept")
    match = docs["doc_id"].eqNullSafe(kept["k_id"]) & (F.xxhash64(docs["text"]) == kept["k_th"])
    out = docs.join(kept, match, "left_semi")
    return out if kept.filter("k_n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def deduplicate(spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4, copies: int = 1, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` (all columns), one of each group: that of the smallest doc_id (null last), then of the smallest hash of its text.

    Of rows that share both, one stays.
    """
    ws = Workspace(spark, "simhash")
    return keep_least(ws, docs, _groups(ws, docs, shingle, radius, copies, bucket))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
