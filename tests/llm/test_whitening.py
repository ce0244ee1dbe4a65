import numpy as np
import pyarrow.parquet as pq
import pytest

from caseflow.llm import whitening


def brute(vectors, top=8):
    """Integer vectors, then covariance, its eigenvectors and whitened rows by a dense solver."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    keep = e > 1e-13 * e[0]
    deviation = [sum(int(a) ** 2 for a in r) for r in n * x - s]
    return n, deviation, (y @ v / np.sqrt(np.maximum(e, 1e-300)))[:, keep], (e / np.trace(y.T @ y / n))[keep]


def check(got, ids, vectors, top=8, close=1e-9):
    n, deviation, whitened, explained = brute(vectors, top)
    by = {(r.vec_id, r.component): r for r in got}
    k = len(explained)
    assert len(got) == len(by) == len(ids) * k
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for c in range(k):
        w = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(w @ whitened[:, c])
        assert np.abs(w * sign - whitened[:, c]).max() < close
        assert all(abs(by[i, c + 1].explained - explained[c]) < 1e-12 for i in ids)
        assert [int(by[i, c + 1].deviation) for i in ids] == deviation


def test_whole_table_against_a_dense_solver(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet", columns=["vec_id", "embedding"])
    got = whitening.op13_whitening(spark, sf).collect()
    check(got, t["vec_id"].to_pylist(), t["embedding"].to_pylist())
    assert all(int(r.deviation_exact) == r.deviation for r in got)


@pytest.mark.parametrize("kind", ["falling", "rank 3", "equal values", "wide"])
def test_spectra(spark, kind):
    rng = np.random.default_rng(4)
    n, d = (300, 20) if kind != "wide" else (12, 40)
    x = rng.normal(size=(n, d))
    if kind == "falling":
        x *= 2.0 ** -np.arange(d)
        x *= 1000
    elif kind == "rank 3":
        x = np.repeat(rng.integers(-9, 9, (n, 3)), [5, 5, 10], axis=1).astype(float)
    elif kind == "equal values":
        x = np.concatenate([np.eye(d), -np.eye(d)])
    got = whitening.whiten(spark, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    if kind == "equal values":
        w = np.zeros((len(x), 8))
        for r in got:
            w[r.vec_id, r.component - 1] = r.whitened
        assert np.abs(w.T @ w / len(x) - np.eye(8)).max() < 1e-9 and all(abs(r.explained - 1 / d) < 1e-12 for r in got) and len(got) == 8 * len(x)
    else:
        check(got, range(len(x)), x, close=1e-7)


def test_stops_before_all_dimensions_when_nothing_can_hide(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 60)) * np.where(np.arange(60) < 9, 2.0 ** (10 - np.arange(60)), 1e-3)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    steps, step = [], whitening.CentredRows.step
    monkeypatch.setattr(whitening.CentredRows, "step", lambda self, *a: steps.append(1) or step(self, *a))
    check(whitening.whiten(spark, df).collect(), range(400), x, close=1e-7)
    assert 8 < len(steps) < 45


def test_nulls_lengths_ties_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 5), (2, None, 6), (3, [], 7), (4, [1.0, None], 8), (5, [nan, 1.0], 9), (6, [1.0, inf], 1), (7, [3.0, -2.0], 2), (None, [0.5, 0.5], 3), (8, [9.0], 4), (8, [7.0], 4), (9, [1.0, 2.0, 3.0], 4), (1, [1.0, 2.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    got = whitening.whiten(spark, df).collect()
    pairs = [r for r in got if r.n == 4]
    assert sorted((r.vec_id or 0, r.component) for r in pairs) == sorted((i, c) for i in (1, 1, 7, 0) for c in (1, 2))
    ones = [r for r in got if r.n == 2]
    assert [(r.vec_id, r.component, int(r.deviation)) for r in ones] == [(8, 1, 2048**2)] * 2 and {round(r.whitened) for r in ones} == {-1, 1}
    assert len(got) == len(pairs) + len(ones)  # a vector alone has no component
    assert whitening.whiten(spark, df.limit(0)).count() == 0
    assert whitening.whiten(spark, spark.createDataFrame([(i, [5.0, 5.0]) for i in range(4)], "vec_id long, embedding array<double>")).count() == 0


def test_deviations_past_a_long_stay_exact():
    t = np.array([[1 << 40, -3, (1 << 35) + 7], [5, -(1 << 50) - 1, 2]], np.int64)
    assert whitening._squared_deviation(t) == [sum(int(a) ** 2 for a in r) for r in t]
