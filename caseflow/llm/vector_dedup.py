"""Near duplicates of vectors by iterative quantisation: balanced binary codes, multi-index Hamming tables, cosines of the original vectors.

A rotation of the principal components is learned on a bounded sample so that signs quantise centred unit vectors with little error (Gong and
Lazebnik, "Iterative quantization", 2011); the signs are a vector's code. A code is cut into parts, a table for each. Two unit vectors at
cosine c are sqrt(2 - 2c) apart, so some part holds no more than its share of that squared distance; where their signs differ in the part, one of the two
coordinates is no more than half the difference. So each vector enters a table under its own part of the code and under those that differ
in coordinates whose squares stay within a quarter of the share, and every linked pair meets in a bucket: no link is lost to the tables. Coordinates are
rounded to integers once, so that all tasks agree on the one bucket in which a pair counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components, table

SIMILARITY = 0.98
BITS = 64
#: Vectors that a rotation is fitted on, rounds of the fit, and lengths of vectors that get a fitted one (others take the first rotation of the fit).
SAMPLE, ROUNDS, LENGTHS = 8192, 40, 16
#: Keys of a vector in one table, on average over the sample, at most: parts are made shorter until this holds.
KEYS = 12
#: Entries of a bucket that one task looks at by code; in larger buckets all are compared by cosine.
BUCKET = 4096
#: Members of a block, for comparison by cosine.
BLOCK = 1024
#: Of codes at the limit of similarity, differing bits above their mean that are still looked at, in deviations.
DEVIATIONS = 6
_Q = 1 << 13
_ROWS = 128


@dataclass
class Rotation:
    """Mean, map to coordinates, the parts that coordinates are dealt into, and the integers that bound keys and codes."""

    mean: np.ndarray
    axes: np.ndarray
    parts: list[np.ndarray]
    budget: int
    bits_apart: int

    def rounded(self, unit: np.ndarray) -> np.ndarray:
        return np.rint((unit - self.mean) @ self.axes * _Q).astype(np.int16)

    def keys(self, z: np.ndarray):
        """(row, table, key) of every row of rounded coordinates: its own part of the code, and those with small coordinates flipped."""
        rows, tables, keys = [], [], []
        for t, part in enumerate(self.parts):
            at = z[:, part].astype(np.int64)
            own = ((at >= 0) << np.arange(len(part))).sum(axis=1)
            order = np.argsort(at * at, axis=1, kind="stable")
            cost = np.take_along_axis(at * at, order, 1)
            row, flips, spent = np.arange(len(z)), np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
            for i in range(len(part)):
                more = spent + cost[row, i]
                ok = more <= self.budget
                if not ok.any():
                    break
                row, flips, spent = np.concatenate((row, row[ok])), np.concatenate((flips, flips[ok] | (1 << order[row[ok], i]))), np.concatenate((spent, more[ok]))
            rows.append(row)
            tables.append(np.full(len(row), t, np.int32))
            keys.append(own[row] ^ flips)
        return np.concatenate(rows), np.concatenate(tables), np.concatenate(keys)

    def codes(self, z: np.ndarray) -> np.ndarray:
        return ((z >= 0).astype(np.uint64) << np.arange(z.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_rotation(sample: np.ndarray, n: int, similarity: float = SIMILARITY, bits: int = BITS, rounds: int = ROUNDS) -> Rotation:
    """The rotation for vectors like ``sample`` (rows of one length), of which there are ``n``."""
    unit = _unit(sample)
    dim = unit.shape[1]
    b = min(bits, dim)
    mean = unit.mean(axis=0)
    _, v = np.linalg.eigh((unit - mean).T @ (unit - mean))
    axes = v[:, ::-1][:, :b]
    y = (unit - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(b).normal(size=(b, b)))[0]
    for _ in range(rounds):
        p, _, q = np.linalg.svd(y.T @ np.where(y @ turn >= 0, 1.0, -1.0))
        turn = p @ q
    axes = axes @ turn
    share = np.arccos(similarity) / np.pi
    apart = int(np.ceil(b * share + DEVIATIONS * np.sqrt(b * share * (1 - share))))
    length = min(b, max(4, round(np.log2(max(n, 2)))), 30)
    while True:
        parts = np.array_split(np.arange(b), max(1, b // length))
        chord = np.sqrt(2 - 2 * similarity) * _Q + np.sqrt(b) + 1
        found = Rotation(mean, axes, parts, int(chord**2 / (4 * len(parts))) + 1, apart)
        z = found.rounded(unit)
        met = sum(len(found.keys(z[a : a + _ROWS])[0]) for a in range(0, min(len(z), 1024), _ROWS)) / max(1, min(len(z), 1024))
        if length <= 4 or met <= KEYS * len(parts):
            return found
        length -= 1


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def distinct_vectors(ws: Workspace, rows: DataFrame) -> DataFrame:
    """(node, h1, h2, label, v, copies, least): the distinct (label, v) of ``rows`` (id, label, v, h1, h2), told apart by 128 bits of digests."""
    one = rows.filter("v IS NOT NULL").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("least"))
    return ws.save(one.withColumn("node", F.monotonically_increasing_id()), "vectors")


def rotations(nodes: DataFrame, similarity: float = SIMILARITY, sample: int = SAMPLE) -> dict[int, Rotation]:
    """A rotation for each of the LENGTHS most frequent lengths."""
    sizes = {r.dim: r.n for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    out = {}
    for dim, n in sizes.items():
        rows = nodes.filter(F.size("v") == dim).orderBy("h1", "h2").limit(sample).select("v").collect()
        out[dim] = fit_rotation(np.array([r.v for r in rows], float), n, similarity)
    return out


def _plain(dim: int, similarity: float) -> Rotation:
    """The rotation of lengths that are too rare for a fit."""
    return fit_rotation(np.concatenate([np.eye(dim), -np.eye(dim)])[: 2 * BITS], 16, similarity, rounds=0)


def with_coordinates(ws: Workspace, nodes: DataFrame, fitted: dict[int, Rotation], similarity: float) -> DataFrame:
    """``nodes`` (node, label, v, copies) with dim and z, the rounded coordinates."""
    sent = nodes.sparkSession.sparkContext.broadcast(fitted)  # LENGTHS matrices of a vector's length by BITS

    def run(batches):
        plain = {}
        for b in batches:
            lists = b.column(2)
            dims = lists.value_lengths().to_numpy()
            z = [None] * b.num_rows
            for dim in np.unique(dims):
                of = sent.value.get(int(dim)) or plain.setdefault(int(dim), _plain(int(dim), similarity))
                at = np.flatnonzero(dims == dim)
                for i, row in zip(at.tolist(), of.rounded(_unit(_matrix(lists.take(pa.array(at))))), strict=True):
                    z[i] = row
            yield pa.record_batch([*b.columns, pa.array(dims, pa.int32()), pa.array(z, pa.list_(pa.int16()))], names=[*b.schema.names, "dim", "z"])

    cols = nodes.select("node", "label", "v", "copies")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema.fields)
    return ws.save(cols.mapInArrow(run, f"{kinds}, dim int, z array<smallint>"), "coordinates")


def entries(nodes: DataFrame, fitted: dict[int, Rotation], similarity: float) -> DataFrame:
    """(label, dim, t, key, code, node): every vector's keys in every table."""
    sent = nodes.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        plain = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                of = sent.value.get(int(dim)) or plain.setdefault(int(dim), _plain(int(dim), similarity))
                at = np.flatnonzero(dims == dim)
                for a in range(0, len(at), _ROWS):
                    part = at[a : a + _ROWS]
                    z = b.column(3).take(pa.array(part)).flatten().to_numpy().reshape(len(part), -1)
                    row, t, key = of.keys(z)
                    node, label = (b.column(c).take(pa.array(part[row])) for c in (0, 1))
                    yield pa.record_batch([label, pa.array(np.full(len(row), dim, np.int32)), pa.array(t), pa.array(key), pa.array(of.codes(z)[row]), node], names=["label", "dim", "t", "key", "code", "node"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "dim", "z").mapInArrow(run, f"label {kind}, dim int, t int, key long, code long, node long")


_BUCKETS = ["label", "dim", "t", "key"]


def candidates(ws: Workspace, found: DataFrame, apart: dict[int, int], bucket: int = BUCKET) -> DataFrame:
    """(label, dim, t, key, node): the entries of ``found`` that have another one in their bucket with a code at most ``apart`` bits away (by length). Buckets of over ``bucket`` entries stay whole."""
    sizes = ws.save(found.groupBy(*_BUCKETS).agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = found.join(sizes, _BUCKETS)

    def near(t: pa.Table) -> pa.Table:
        """Of whole buckets, in order: the entries with another one near. Entries a place, two places, ... apart are compared at once, while any bucket is so large."""
        edge = np.zeros(t.num_rows, bool)
        for c in _BUCKETS:
            col = t.column(c).combine_chunks()
            edge[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(edge)
        code, limit = t.column("code").to_numpy().view(np.uint64), np.full(t.num_rows, BITS)
        dims = t.column("dim").to_numpy()
        for dim in np.unique(dims):
            limit[dims == dim] = apart.get(int(dim), BITS)
        some, at, d = np.zeros(t.num_rows, bool), np.arange(t.num_rows), 1
        while len(at := at[at + d < t.num_rows]) and len(at := at[group[at] == group[at + d]]):
            ok = at[np.bitwise_count(code[at] ^ code[at + d]) <= limit[at]]
            some[ok] = some[ok + d] = True
            d += 1
        return t.drop_columns("code").filter(pa.array(some))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            last = [b.column(c)[-1] for c in _BUCKETS]
            if held and all(held[0].column(c)[0] == x for c, x in zip(_BUCKETS, last, strict=True)):
                held.append(b)  # one bucket still
                continue
            # where the last bucket of the batch begins
            same = np.ones(b.num_rows, bool)
            for c, x in zip(_BUCKETS, last, strict=True):
                same &= pc.equal(b.column(c), x).to_numpy(zero_copy_only=False)
            start = int(same.argmax())
            yield from near(pa.Table.from_batches([*held, b.slice(0, start)])).to_batches()
            held = [b.slice(start)]
        if held:
            yield from near(pa.Table.from_batches(held)).to_batches()

    kind = found.schema["label"].dataType.simpleString()
    small = met.filter(F.col("n") <= bucket).select(*_BUCKETS, "code", "node").repartition(*_BUCKETS).sortWithinPartitions(*_BUCKETS)
    small = small.mapInArrow(run, f"label {kind}, dim int, t int, key long, node long")
    return ws.save(small.unionByName(met.filter(F.col("n") > bucket).select(*_BUCKETS, "node")), "candidates")


class _Group:
    """Members of two blocks of a bucket (or of one with itself), to be compared."""

    def __init__(self, t: int, key: int, parts: list[np.ndarray]):
        self.t, self.key, self.parts = t, key, parts

    def links(self, node, v, z, a: np.ndarray, b: np.ndarray | None, similarity: float):
        """Positions (i, j) of the linked pairs that count in this bucket: between rows ``a`` and ``b``, or among ``a``."""
        unit = _unit(v)
        other = a if b is None else b
        hit = unit[a] @ unit[other].T >= similarity
        if b is None:
            hit &= np.arange(len(a))[:, None] < np.arange(len(a))[None, :]
        ra, rb = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(ra):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # squared distances by part, whole numbers far below 2**53, so exact whatever the order of sums; the least decides, the first of equal ones
        least, best = None, None
        for t, part in enumerate(self.parts):
            x, y = z[a[ra]][:, part].astype(float), z[other[rb]][:, part].astype(float)
            d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
            best = np.zeros(d.shape, np.int8) if least is None else np.where(d < least, t, best)
            least = d if least is None else np.minimum(d, least)
        i, j = np.nonzero(hit[np.ix_(ra, rb)] & (best == self.t))
        i, j = a[ra[i]], other[rb[j]]
        keep = np.zeros(len(i), bool)
        part = self.parts[self.t]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            x, y = z[p][:, part].astype(np.int32), z[q][:, part].astype(np.int32)
            # where signs differ, the smaller coordinate is flipped, of equal ones that of the smaller node
            mine = (np.abs(x) < np.abs(y)) | ((np.abs(x) == np.abs(y)) & (node[p] < node[q])[:, None])
            sign = np.where((x >= 0) != (y >= 0), np.where(mine, y >= 0, x >= 0), x >= 0)
            keep[k : k + (1 << 16)] = (sign.astype(np.int64) << np.arange(len(part))).sum(axis=1) == self.key
        return i[keep], j[keep]


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place it is linked to through pairs (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def links(ws: Workspace, nodes: DataFrame, near: DataFrame, fitted: dict[int, Rotation], similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b, n): with n > 0, a node and a number of vectors linked to it; with n = 0, two nodes of one component.

    A bucket of over ``block`` members is dealt into blocks, and every pair of blocks is a group of its own; a group returns a row or two a member and no
    pairs. Each linked pair counts in one bucket only, that of its nearest part.
    """
    sizes = near.groupBy(*_BUCKETS).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).withColumn("some", F.lit(1))
    dealt = near.join(sizes, _BUCKETS).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = [*_BUCKETS, "i", "j"]
    dealt = dealt.select(*_BUCKETS, F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "node")
    rows = dealt.join(nodes.select("node", "v", "z", "copies"), "node").select(*groups, "own", "node", "copies", "v", "z")
    sent = nodes.sparkSession.sparkContext.broadcast({dim: r.parts for dim, r in fitted.items()})

    def close(group, batches, plain):
        held = pa.Table.from_batches(batches).combine_chunks()
        if held.num_rows < 2:
            return None
        _, dim, t, key, i, j = group
        own, node, copies = (held.column(n).to_numpy() for n in ("own", "node", "copies"))
        v, z = (_matrix(held.column(n).combine_chunks()) for n in ("v", "z"))
        parts = sent.value.get(dim) or plain.setdefault(dim, _plain(dim, similarity).parts)
        sides = (np.arange(len(node)), None) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        p, q = _Group(t, key, parts).links(node, v, z, *sides, similarity)
        if not len(p):
            return None
        n = (np.bincount(p, copies[q], len(node)) + np.bincount(q, copies[p], len(node))).astype(np.int64)
        root = _stars(len(node), p, q)
        some, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(node)))
        zero = np.zeros(len(moved), np.int64)
        return pa.record_batch([pa.array(np.concatenate((node[some], node[moved]))), pa.array(np.concatenate((node[some], node[root[moved]]))), pa.array(np.concatenate((n[some], zero)))], names=["a", "b", "n"])

    def run(batches):
        plain, group, held = {}, None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if keys[start] != group:
                        if held and (out := close(group, held, plain)) is not None:
                            yield out
                        group, held = keys[start], []
                    held.append(b.slice(start, k - start))
                    start = k
        if held and (out := close(group, held, plain)) is not None:
            yield out

    return ws.save(rows.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, "a long, b long, n long"), "links")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links long, component_id, kept boolean) of every row of ``df``.

    Rows of one label whose vectors have a cosine of ``similarity`` or more (in double precision) are linked; n_links counts the other rows that a row is linked to. component_id is the least
    id that links lead to, the row's own included; kept: whether that is the row's own. Null vectors, empty and zero ones, those with a null or non-finite
    entry, and rows without a label link with nothing: no links, their own component. Vectors of different lengths are not compared.
    Equal vectors of a label are one node with a number of copies, so copies are linked to each other without becoming pairs. Repeated ids are
    rows of their own. A null id gets its row, is no component_id unless its component has no other, and is not kept. An empty table gives no rows;
    other columns are not read.

    Codes that differ by DEVIATIONS deviations more bits than the mean at the limit of similarity are not looked at
    (about one linked pair in 10**8, if bits were independent).
    """
    ws = Workspace(spark, "vector-dedup")
    x = F.col("v")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)), x))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v", "label"))})
    distinct = distinct_vectors(ws, rows)
    fitted = rotations(distinct, similarity)
    nodes = with_coordinates(ws, distinct, fitted, similarity)
    near = candidates(ws, ws.save(entries(nodes, fitted, similarity), "entries"), {dim: r.bits_apart for dim, r in fitted.items()}, bucket)
    found = links(ws, nodes, near, fitted, similarity, block)
    groups = ws.save(connected_components(ws, found.filter("n = 0").select("a", "b")), "components")
    counted = ws.save(found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("others")), "counts")
    of = distinct.select("node", "h1", "h2", "copies", "least").join(counted, F.col("node") == F.col("a"), "left").drop("a")
    of = of.join(groups.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left").withColumn("component", F.coalesce("component", "node"))
    of = ws.save(of.select("h1", "h2", "component", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "nodes")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = ws.save(of.join(least, "component").select("h1", "h2", "n_links", "component_id"), "labels")
    out = rows.select("id", "h1", "h2").join(of, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_embedding_near_dedup": op12_embedding_near_dedup}
ORACLE_SQL: dict[str, str] = {}
