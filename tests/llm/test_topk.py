import duckdb
import numpy as np
import pytest

from caseflow.llm import topk


def brute(ids, x, qids, k):
    out = []
    for q in qids:
        v = x[np.flatnonzero(ids == q)[0]]
        s = sorted((-int(v @ w), int(i)) for i, w in zip(ids, x, strict=True) if i != q)[:k]
        out += [(int(q), r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def test_whole_table_against_sql(spark, sf):
    got = sorted(tuple(r) for r in topk.op9_exact_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(topk.ORACLE_SQL["op9_exact_topk"]).fetchall()) and got


@pytest.mark.parametrize("kind", ["clusters", "copies", "line"])
def test_dual_search_against_brute_force(kind):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        x = (rng.normal(size=(8, 16)) * 300)[rng.integers(0, 8, 700)] + rng.normal(size=(700, 16)) * 20
    elif kind == "copies":
        x = np.repeat(rng.normal(size=(3, 16)) * 50, [600, 90, 10], axis=0)
    else:
        x = np.arange(700)[:, None] * np.ones((1, 16)) - 300
    x = np.floor(x)
    ids = rng.permutation(700).astype(np.int64)
    for k in (1, 10):
        best = topk.dual_search(topk.CoverTree(x[:70], leaf=8), topk.CoverTree(x, leaf=8), ids[:70], ids, k)
        got = sorted((int(q), r + 1, int(best.id[i, r]), int(best.score[i, r])) for i, q in enumerate(ids[:70]) for r in range(k))
        assert got == brute(ids, x, ids[:70], k)


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(500, 8))
    t = topk.CoverTree(x, leaf=10)

    def rows(n):
        return t.rows[n] if t.rows[n] is not None else np.concatenate([rows(c) for c in t.children[n]])

    assert sorted(rows(0)) == list(range(500))
    for n in range(len(t.rows)):
        assert np.sqrt(((x[rows(n)] - x[t.centre[n]]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        for c in t.children[n]:
            assert t.radius[c] <= t.radius[n] * topk.SHRINK + 1e-9 or len(t.children[n]) == topk.FAN


def test_nulls_ties_small_and_clashing_columns(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [0.5, 9.0], 2), (2, [0.5, -3.0], 3), (3, None, 4), (4, [float("nan"), 1.0], 5), (5, [None, 1.0], 6), (6, [float("inf"), 1.0], 7), (None, [1.0, 1.0], 8), (7, [], 9), (8, [1.0], 10), (200, [-1.0, 0.0], 11), (2, [0.5, 7.0], 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = topk.integer_vectors(df)
    got = sorted(tuple(r) for r in topk.top_k(spark, v, v.filter("vec_id % 100 = 0"), k=3, block=2).select("query_id", "rank", "vec_id", "score").collect())
    half, one = 512 * 1024, 1024 * 1024
    assert got == [(100, 1, 1, half), (100, 2, 2, half), (100, 3, 2, half), (200, 1, 1, -half), (200, 2, 2, -half), (200, 3, 2, -half)] and one
    assert topk.top_k(spark, v.limit(0), v.limit(0)).count() == 0


def test_blocks_are_pruned_by_floors_and_results_stay_whole(spark):
    """Far clusters: most pairs of blocks are never searched, and the result equals brute force."""
    rng = np.random.default_rng(8)
    centres = np.eye(16) * 900
    x = np.floor((centres[rng.integers(0, 16, 1600)] + rng.normal(size=(1600, 16)) * 5)).astype(int)
    df = spark.createDataFrame([(int(i), [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<long>").repartition(5)
    queries = df.filter("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in topk.top_k(spark, df, queries, k=10, block=100, query_block=20).collect())
    assert got == brute(np.arange(1600), x, np.arange(0, 1600, 20), 10)
    ws = topk.Workspace(spark, "t")
    of = {16: topk.fit_centres(df, 16, 16)}
    data = topk._packed(ws, topk._with_cell(df, of), 100, "d")
    asked = topk._packed(ws, topk._with_cell(queries, of), 20, "q").withColumnsRenamed({"block": "qblock", "ids": "qids", "x": "qx"})
    bounds = topk.block_pairs(asked, data).cache()
    kth = {q: min(s for i, r, _, s in got if r == 10 and i == q) for q in range(0, 1600, 20)}
    worst = [(r.qblock, 16, float(min(kth[int(i)] for i in np.frombuffer(r.qids, np.int64)))) for r in asked.collect()]
    left = topk.open_pairs(bounds, spark.createDataFrame(worst, "qblock long, dim int, worst double")).count()
    assert left < 0.3 * bounds.count()


def test_products_that_are_not_exact_raise(spark):
    df = spark.createDataFrame([(0, [10**9, 1]), (1, [10**9, 2])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="2\\*\\*53"):
        topk.top_k(spark, df, df).collect()
