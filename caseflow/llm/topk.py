"""Exact top-k search by inner product with cover trees over queries and data.

Data and queries are cut into blocks of neighbours with a centre and a radius. A task holds one data block, builds its cover tree, and
takes the query blocks one after the other: pairs of a query node and a data node are pruned when even the best
product that their covering radii allow is below the worst kth score of the query group. The same bound prunes whole pairs of blocks, once the
blocks of the highest bounds have given every query a kth score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table

BLOCK = 16384
QUERY_BLOCK = 1024
LEAF = 256
QUERY_LEAF = 64
#: A child's radius is at most this part of its parent's, unless the parent has FAN children: far from any
#: centre most rows of many dimensions would else become centres of their own.
SHRINK = 0.7
FAN = 12
#: Rows of the sample that centres of blocks are fitted on, and centres at most; lengths of vectors that get centres (others have one cell).
SAMPLE, CENTRES, LENGTHS = 8192, 256, 16
BLOCKS_OF_A_CELL = 1 << 40
#: Data blocks that a query block meets first; query trees that a task keeps.
SEEDS = 2
QUERY_TREES = 16


class CoverTree:
    """Nodes over rows of ``x``: a centre (a data row), the distance to its farthest row, children or a slice of ``order``.

    Level by level, centres are chosen greedily, the farthest row first, while one is farther than SHRINK x radius from all centres
    so far and there are fewer than FAN; every row goes to its nearest centre, so siblings are separated and each child is
    covered by its radius. Equal rows end in one leaf, whatever their number.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.norm: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        if len(x):
            todo = [(self._node(np.arange(len(x)), int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())))]
            while todo:
                node = todo.pop()
                rows = self.rows[node]
                if len(rows) <= leaf or self.radius[node] == 0:
                    continue
                self.rows[node] = None
                self.children[node] = [self._node(part, c) for c, part in self._split(rows, self.centre[node], self.radius[node] * shrink, leaf)]
                todo += self.children[node]

    def _node(self, rows: np.ndarray, centre: int) -> int:
        far = np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(axis=1).max())
        self.centre.append(centre)
        self.radius.append(float(far))
        self.norm.append(float(np.sqrt((self.x[centre] ** 2).sum())))
        self.children.append([])
        self.rows.append(rows)
        return len(self.rows) - 1

    def _split(self, rows, centre, reach, leaf):
        part = self.x[rows]
        near = np.sqrt(((part - self.x[centre]) ** 2).sum(axis=1))
        owner = np.zeros(len(rows), np.int64)
        centres = [centre]
        while near.max() > reach and len(centres) < FAN:
            k = int(near.argmax())
            d = np.sqrt(((part - part[k]) ** 2).sum(axis=1))
            closer = d < near
            owner[closer] = len(centres)
            near = np.where(closer, d, near)
            centres.append(int(rows[k]))
        return [(c, rows[owner == i]) for i, c in enumerate(centres) if (owner == i).any()]


class BestScores:
    """The k best (score, id) of every query so far; equal scores prefer the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        # equal scores stay in: they may win by a smaller id
        hope = scores >= self.score[queries, -1:]
        some = hope.any(axis=1)
        if not some.any():
            return
        queries, scores = queries[some], scores[some]
        useful = hope.any(axis=0)
        scores, ids = scores[:, useful], ids[:, useful]
        score = np.concatenate((self.score[queries], scores), axis=1)
        ident = np.concatenate((self.id[queries], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((ident, -score), axis=1)[:, : self.k]
        self.score[queries] = np.take_along_axis(score, order, 1)
        self.id[queries] = np.take_along_axis(ident, order, 1)


def dual_search(queries: CoverTree, data: CoverTree, query_ids: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> BestScores:
    """Best k data rows of every query, a row of the query's own id left out; ``floor``: kth scores that are known already."""
    best = BestScores(len(query_ids), k)
    if not len(query_ids) or not len(data_ids):
        return best
    low = np.full(len(query_ids), -np.inf) if floor is None else floor.astype(float)
    member = {}

    def rows_of(q):
        if q not in member:
            member[q] = queries.rows[q] if queries.rows[q] is not None else np.concatenate([rows_of(c) for c in queries.children[q]])
        return member[q]

    def worst(q):
        r = rows_of(q)
        return float(np.maximum(best.score[r, -1], low[r]).min())

    def bound(q, p):
        c = float(queries.x[queries.centre[q]] @ data.x[data.centre[p]])
        return c + queries.radius[q] * data.norm[p] + data.radius[p] * queries.norm[q] + queries.radius[q] * data.radius[p]

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        b, q, p = heapq.heappop(heap)
        # rounding of the bound is far below one half; scores are integers and equal scores may win by id
        if -b + 0.5 < worst(q):
            continue
        qrows, prows = queries.rows[q], data.rows[p]
        if qrows is not None and prows is not None:
            for a in range(0, len(prows), 1024):
                part = prows[a : a + 1024]
                scores = queries.x[qrows] @ data.x[part].T
                scores[query_ids[qrows][:, None] == data_ids[part][None, :]] = -np.inf
                best.add(qrows, scores, data_ids[part][None, :])
        elif qrows is None and (prows is not None or queries.radius[q] > data.radius[p]):
            for c in queries.children[q]:
                heapq.heappush(heap, (-bound(c, p), c, p))
        else:
            for c in data.children[p]:
                heapq.heappush(heap, (-bound(q, c), q, c))
    return best


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component; rows that are null, empty, or hold a null or non-finite component are left out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # CASE, so that floor never meets a component that is not finite
    scaled = F.when(F.coalesce(finite, F.lit(False)) & (F.size(x) > 0), F.transform(x, lambda c: F.floor(c.cast("double") * scale)))
    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), scaled.alias("v")).filter("v is not null")


def fit_centres(vectors: DataFrame, dim: int, blocks: int, sample: int = SAMPLE, most: int = CENTRES) -> np.ndarray:
    """Centres of the vectors of a length, as far from each other as a bounded sample of ``sample`` rows (by a hash of their ids) allows; the greedy choice of a cover tree's level."""
    rows = vectors.filter(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    x = np.array([r.v for r in rows], float).reshape(len(rows), dim)
    if blocks <= 1 or len(x) <= 1:
        return x.mean(axis=0, keepdims=True) if len(x) else np.zeros((1, dim))
    chosen = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(blocks, most) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    # three rounds of means make the cells more even
    centres = x[chosen]
    for _ in range(3):
        owner = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * centres.size < 1 << 27 else _nearest(x, centres)
        centres = np.array([x[owner == c].mean(axis=0) if (owner == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, norms = np.empty(len(x), np.int64), (centres**2).sum(axis=1)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (norms[None] - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1)
    return out


def _with_cell(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with cell: the nearest centre of their length."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            sizes, cell = pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int64)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)].astype(float)
                cell[at] = _nearest(x, sent.value[int(dim)]) if int(dim) in sent.value else 0
            yield pa.record_batch([b.column(0), lists, pa.array(cell)], names=["vec_id", "v", "cell"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<bigint>, cell long")


def _packed(ws: Workspace, vectors: DataFrame, limit: int, name: str) -> DataFrame:
    """(block, dim, ids, x, centre, radius, norm) rows: blocks of about ``limit`` vectors of one cell; ids and x are binary. A cell of more vectors has several blocks, dealt by a hash of the ids."""
    sizes = vectors.groupBy("cell", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    # one row a cell and length, and cells are bounded (CENTRES)
    parts = ws.save(sizes.select("cell", "dim", F.ceil(F.col("n") / limit).alias("parts")), f"{name}-cells")
    rows = vectors.withColumn("dim", F.size("v")).join(parts, ["cell", "dim"]).withColumn("block", F.col("cell") * BLOCKS_OF_A_CELL + F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def run(key, t):
        dim, ids = key[1].as_py(), t.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)[order].astype(np.int64)
        if float(np.abs(x).max(initial=0)) ** 2 * dim >= 2**53:
            raise ValueError("inner products of these vectors may pass 2**53, beyond which they are not exact")
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        cols = {"block": [key[0].as_py()], "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())}
        return pa.table({**cols, "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], "norm": [float(np.sqrt((centre**2).sum()))]})

    return rows.groupBy("block", "dim").applyInArrow(run, "block long, dim int, ids binary, x binary, centre array<double>, radius double, norm double")


_HITS = "query_id long, vec_id long, score long"


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """The hits of pairs (block, dim, ids, x, qblock, qids, qx, floors) of a query block and a data block. floors: known kth scores of the queries, or null."""

    def run(batches):
        last, tree, ids, asked = None, None, None, {}
        for b in batches:
            out = ([], [], [])
            for r in b.to_pylist():
                dim = r["dim"]
                if (r["block"], dim) != last:
                    last = (r["block"], dim)
                    ids = np.frombuffer(r["ids"], np.int64)
                    tree = CoverTree(np.frombuffer(r["x"], np.int64).reshape(len(ids), dim).astype(float))
                qids = np.frombuffer(r["qids"], np.int64)
                if (r["qblock"], dim) not in asked:
                    if len(asked) >= QUERY_TREES:
                        asked.clear()
                    asked[r["qblock"], dim] = CoverTree(np.frombuffer(r["qx"], np.int64).reshape(len(qids), dim).astype(float), QUERY_LEAF)
                floor = None if r["floors"] is None else np.array([-np.inf if f is None else f for f in r["floors"]])
                best = dual_search(asked[r["qblock"], dim], tree, qids, ids, k, floor)
                i, j = np.nonzero(np.isfinite(best.score) if floor is None else np.isfinite(best.score) & (best.score >= floor[:, None]))
                out[0].append(qids[i])
                out[1].append(best.id[i, j])
                out[2].append(best.score[i, j].astype(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], names=["query_id", "vec_id", "score"])

    return pairs.select("block", "dim", "ids", "x", "qblock", "qids", "qx", "floors").mapInArrow(run, _HITS)


def block_pairs(asked: DataFrame, data: DataFrame) -> DataFrame:
    """(qblock, block, dim, bound) of every query block and data block of its length: the stated queries against all rows, block by block. bound: no product of the two is larger."""
    meta = data.select("block", "dim", F.col("centre").alias("c"), F.col("radius").alias("r"), F.col("norm").alias("n"))
    numbers = meta.groupBy("dim").agg(F.collect_set("block").alias("blocks"))
    met = asked.select("qblock", "dim", "centre", "radius", "norm").join(numbers, "dim").withColumn("block", F.explode("blocks")).drop("blocks").join(meta, ["block", "dim"])
    product = F.aggregate(F.zip_with("centre", "c", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    bound = product + F.col("radius") * F.col("n") + F.col("r") * F.col("norm") + F.col("radius") * F.col("r")
    return met.select("qblock", "block", "dim", bound.alias("bound"))


def open_pairs(bounds: DataFrame, kth: DataFrame) -> DataFrame:
    """Pairs whose bound reaches the worst kth score (column worst of ``kth``, null where it isn't known) of their query block."""
    # rounding of the bound is far below one half; scores are integers, and equal ones may win by id
    return bounds.join(kth, ["qblock", "dim"]).filter(F.col("worst").isNull() | (F.col("bound") + 0.5 >= F.col("worst")))


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank int, vec_id, score long): each query's k highest integer inner products, ties to the smaller vec_id.

    Both inputs: (vec_id long, v array<long>), as ``integer_vectors`` makes them. A row with the query's own id is no candidate; a query and
    a vector of different lengths are not compared; a repeated id is taken as often as it occurs, one result row for each of its vectors.
    Queries without a candidate give no row. Vectors whose products could pass 2**53 raise an error. Queries that repeat an id share one result (the best of all).

    Blocks hold neighbours. A query block first meets the SEEDS data blocks of the highest bounds; the kth scores found there are floors for all
    others, and a pair of blocks whose bound lies below them is never made.
    """
    ws = Workspace(spark, "topk")
    sizes = {r.dim: r.n for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(LENGTHS).collect()}
    centres = {dim: fit_centres(vectors, dim, -(-n // block)) for dim, n in sizes.items()}
    data = ws.save(_packed(ws, _with_cell(vectors, centres), block, "data"), "data")
    asked = _packed(ws, _with_cell(queries, centres), query_block, "queries")
    asked = ws.save(asked.withColumnsRenamed({"block": "qblock", "ids": "qids", "x": "qx"}), "queries")
    bounds = ws.save(block_pairs(asked, data), "bounds")
    order = Window.partitionBy("qblock", "dim").orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SEEDS).select("qblock", "block", "dim")
    body = lambda pairs, floors: data.select("block", "dim", "ids", "x").join(pairs, ["block", "dim"]).join(asked.select("qblock", "dim", "qids", "qx"), ["qblock", "dim"]).withColumn("floors", floors).repartition("block", "dim").sortWithinPartitions("block", "dim", "qblock")
    first = ws.save(_search(body(seeds, F.lit(None).cast("array<double>")), k), "seeds")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if all(n <= block for n in sizes.values()) and len(sizes) < LENGTHS:
        # one data block a length, which every query block has met
        return first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    known = first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    # a query block's floors in the order of its ids
    ids = _blocks_of(asked).join(known, F.col("vec_id") == F.col("query_id"), "left")
    kth = ids.groupBy("qblock", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "floor"))), lambda x: x["floor"]).alias("floors"), F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("worst"))
    kth = ws.save(kth, "floors")
    rest = open_pairs(bounds.join(seeds, ["qblock", "block", "dim"], "left_anti"), kth).select("qblock", "block", "dim", "floors")
    more = _search(body(ws.save(rest, "pairs"), F.col("floors")), k)
    hits = first.unionByName(more)
    return hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks_of(asked: DataFrame) -> DataFrame:
    """(vec_id, dim, qblock, place) of every row of the query blocks."""

    def run(batches):
        for b in batches:
            for qblock, dim, raw in zip(*(b.column(n).to_pylist() for n in ("qblock", "dim", "qids")), strict=True):
                ids = np.frombuffer(raw, np.int64)
                n = len(ids)
                yield pa.record_batch([pa.array(ids), pa.array([dim] * n, pa.int32()), pa.array([qblock] * n), pa.array(np.arange(n))], names=["vec_id", "dim", "qblock", "place"])

    return asked.select("qblock", "dim", "qids").mapInArrow(run, "vec_id long, dim int, qblock long, place long")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(spark, vectors, vectors.filter(F.pmod("vec_id", F.lit(100)) == 0))


QUERIES = {"op9_exact_topk": op9_exact_topk}
ORACLE_SQL = {
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
}
