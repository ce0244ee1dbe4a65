import numpy as np
import pyarrow.parquet as pq
import pytest

from caseflow.llm import vector_dedup as vd


def brute(ids, vectors, labels, similarity=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    usable = [v is not None and len(v) > 0 and lab is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for v, lab in zip(vectors, labels, strict=True)]
    n, links = len(ids), [[] for _ in ids]
    groups = {}
    for i in range(n):
        if usable[i]:
            groups.setdefault((labels[i], len(vectors[i])), []).append(i)
    for g in groups.values():
        x = np.array([vectors[i] for i in g], float)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for p, q in zip(*np.nonzero(x @ x.T >= similarity), strict=True):
            if p != q:
                links[g[p]].append(g[q])
    root = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min((ids[j] for j in seen if ids[j] is not None), default=None)
    return sorted(((ids[i], len(links[i]), root[i], ids[i] is not None and ids[i] == root[i]) for i in range(n)), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted((tuple(r) for r in vd.near_duplicates(spark, df, **how).collect()), key=repr)


def near(rng, centre, n, noise):
    x = centre + rng.normal(size=(n, len(centre))) * noise / np.sqrt(len(centre))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def test_whole_tables_against_all_pairs(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet", columns=["vec_id", "embedding", "label"]).to_pydict()
    got = sorted((tuple(r) for r in vd.op12_embedding_near_dedup(spark, sf).collect()), key=repr)
    assert got == brute(t["vec_id"], t["embedding"], t["label"])


@pytest.mark.parametrize("dim", [3, 20, 64, 100])
def test_groups_at_the_limit_against_all_pairs(spark, dim):
    """Groups whose pairs lie on both sides of the limit, exact copies, multiples, and buckets that are dealt into blocks."""
    rng = np.random.default_rng(dim)
    x = [rng.normal(size=(120, dim))]
    for _ in range(6):
        x.append(near(rng, near(rng, np.zeros(dim), 1, 1)[0], 25, rng.uniform(0.05, 0.2)))
    x.append(np.repeat(x[1][:2], 9, axis=0))
    x.append(x[1][3:6] * 2.5)
    x = np.concatenate(x)
    rows = [(int(i), [float(c) for c in v], int(lab)) for i, v, lab in zip(rng.permutation(len(x)), x, np.arange(len(x)) % 40 // 30, strict=True)]
    want = brute(*zip(*rows, strict=True))
    assert run(spark, rows) == want == run(spark, rows, bucket=8, block=6)
    assert sum(r[1] > 0 for r in want) > 30


def test_every_linked_pair_meets_in_its_bucket_once(spark):
    """What the tables promise, on vectors at exactly the limit: recall of the search is one, and counts are of pairs."""
    rng = np.random.default_rng(9)
    base = near(rng, np.zeros(64), 300, 1)
    side = near(rng, np.zeros(64), 300, 1)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.sqrt((side * side).sum(axis=1, keepdims=True))
    c = 0.98 + 1e-9
    x = np.concatenate((base, c * base + np.sqrt(1 - c * c) * side))
    got = run(spark, [(i, [float(v) for v in r], 1) for i, r in enumerate(x)])
    assert [r[:3] for r in sorted(got)] == [(i, 1, i % 300) for i in range(600)]


def test_nulls_repeated_ids_lengths_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (2, [1.0, 0.0], None), (1, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (None, [1.0, 0.001], 1), (None, [0.0, 1.0], 3), (5, [1.0, 0.0], 1), (5, [-1.0, 0.0], 1), (11, [1.0], 1), (12, [3.0], 1), (13, [1e-200, 0.0], 1), (14, [1e300, 0.0], 1)]
    want = brute(*zip(*[(i, v if v is None or i not in (13, 14) else [1.0, 0.0], lab) for i, v, lab in rows], strict=True))
    assert run(spark, rows) == want
    assert run(spark, []) == []


def test_recall_on_the_largest_given_table(spark):
    """Recall of links against all pairs, made near copies among the rows of sf0.1: at least 0.9 is asked, all are found."""
    rng = np.random.default_rng(1)
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding", "label"]).to_pydict()
    x, labels = [np.array(v, float) for v in t["embedding"]], list(t["label"])
    for i in range(0, 300, 3):
        for _ in range(int(rng.integers(1, 6))):
            x.append(near(rng, x[i], 1, rng.uniform(0.05, 0.25))[0])
            labels.append(labels[i])
    rows = [(i, [float(c) for c in v], lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    assert run(spark, rows) == brute(*zip(*rows, strict=True))
