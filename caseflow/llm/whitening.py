"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The centred rows X are never held anywhere as a whole. A step is one job: every task takes packed blocks of rows, makes its part of the next left vector
u = (X v - beta u') / alpha and returns only sums over its rows: the squares of u, its products with all earlier left vectors (for full
reorthogonalisation) and X^T u. Left vectors are as long as the table and are not stored: each is X z for a z as short as a row, so a task makes
its part of all of them from its own rows, and a lost executor costs a block and no state. Right vectors, the bidiagonal matrix
and its SVD are as small as a row and stay on the driver.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

SCALE, OFFSET, TOP = 1024, 100_000, 8
#: A Ritz value counts as exact when its residual is below this part of the greatest singular value.
TOLERANCE = 4 * np.finfo(float).eps
#: Components whose eigenvalue is below this part of the greatest one are rounding, not data.
FLOOR = 1e-13
#: Entries of rows that a task turns into doubles at a time.
_CHUNK = 1 << 19


def _valid(vectors: pa.Array, scale: int, offset: int):
    """For each length above 0 in a column of vectors: the rows of whole finite vectors, and these as a matrix of longs."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten()
    flat = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
        whole = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            fits = np.abs(np.where(np.isfinite(x), x, 0)).max(axis=1) * scale < 2.0**62
        if (whole & ~fits).any():
            raise ValueError("entries of these vectors are too large for longs")
        yield at[whole], np.floor(scale * x[whole]).astype(np.int64) + offset


def packed(ws: Workspace, df: DataFrame, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(dim, n, top, kind, x): the integer vectors of ``df`` as blocks of rows, each a matrix of the narrowest integers that hold it (less ``offset``)."""

    def run(batches):
        for b in batches:
            for _, x in _valid(b.column(0), scale, offset):
                for a in range(0, len(x), 4096):
                    part = x[a : a + 4096] - offset
                    top = int(np.abs(part).max(initial=0))
                    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
                    yield pa.record_batch([pa.array([x.shape[1]], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([top], pa.int64()), pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["dim", "n", "top", "kind", "x"])

    return ws.save(df.select(F.col(vector_col).alias("v")).mapInArrow(run, "dim int, n long, top long, kind string, x binary"), "blocks")


def _matrices(b: pa.RecordBatch, dim: int, offset: int):
    """Blocks (dim, kind, x) of a batch as matrices of longs, a bounded number of rows at a time."""
    for d, kind, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
        if d == dim:
            x = np.frombuffer(raw.as_buffer(), kind).reshape(-1, dim)
            step = max(1, _CHUNK // dim)
            for a in range(0, len(x), step):
                yield x[a : a + step].astype(np.int64) + offset


class CentredRows:
    """Rows of one length, less their mean; knows n and the exact sums, and runs products over all rows as jobs."""

    def __init__(self, blocks: DataFrame, dim: int, offset: int):
        self.blocks, self.dim, self.offset = blocks.filter(F.col("dim") == dim).select("dim", "kind", "x"), dim, offset
        self.n, top = blocks.filter(F.col("dim") == dim).agg(F.sum("n"), F.max("top")).first()
        # n x - S stays exact
        if 2 * self.n * (top + abs(offset)) >= 1 << 63:
            raise ValueError("sums of these vectors are too large for longs")
        self.sums = np.array(self._sums("long", lambda x: x.sum(axis=0)), np.int64)

    def _sums(self, kind: str, f) -> list:
        """The sums over all blocks of what ``f`` gives for a block of integer rows: an array, summed entry by entry. A task returns a row an entry."""
        dim, offset, what = self.dim, self.offset, np.int64 if kind == "long" else np.float64

        def run(batches):
            total = 0
            for b in batches:
                for x in _matrices(b, dim, offset):
                    total = total + np.asarray(f(x), what)
            if not np.isscalar(total):
                yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "s"])

        rows = self.blocks.mapInArrow(run, f"i long, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).collect()
        return [s for _, s in sorted((r.i, r.s) for r in rows)]

    def centred(self):
        """A function that takes integer rows to rows less the mean; n x - S is exact, so only the division rounds."""
        n, s = self.n, self.sums
        return lambda x: (n * x - s) / n

    def step(self, z: np.ndarray, earlier: np.ndarray):
        """Of r = X z: its squares, its products with the columns of U = X ``earlier``, and X^T r."""
        centre = self.centred()
        whole = np.column_stack([z, earlier])

        def f(x):
            y = centre(x)
            p = y @ whole
            return np.concatenate(([p[:, 0] @ p[:, 0]], p[:, 1:].T @ p[:, 0], y.T @ p[:, 0]))

        got = np.array(self._sums("double", f))
        k = earlier.shape[1]
        return got[0], got[1 : 1 + k], got[1 + k :]

    def squares(self) -> float:
        """The sum of all squared entries."""
        centre = self.centred()
        return float(self._sums("double", lambda x: [(centre(x) ** 2).sum()])[0])

    def second_moments(self, basis: np.ndarray):
        """Mean and second moments of the rows' coordinates in ``basis``."""
        centre, k = self.centred(), basis.shape[1]

        def f(x):
            w = centre(x) @ basis
            return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

        got = np.array(self._sums("double", f)) / self.n
        return got[:k], got[k:].reshape(k, k)


def _across(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``others`` (orthonormal), taken off twice."""
    if others:
        q = np.column_stack(others)
        for _ in range(2):
            v = v - q @ (q.T @ v)
    return v


def bidiagonalise(rows: CentredRows, top: int = TOP, tolerance: float = TOLERANCE):
    """(eigenvalues of X^T X, unit right singular vectors as columns), the ``top`` greatest.

    Steps go on until the ``top`` Ritz pairs have residuals below ``tolerance`` and what the others leave of the trace is too little to hide another
    value among them, or until the right vectors span all dimensions. Where the process breaks off (alpha or beta zero)
    it goes on with a vector across all earlier ones, so values of any multiplicity are found.
    """
    dim, rng = rows.dim, np.random.default_rng(rows.dim)
    trace = rows.squares()
    tiny = np.sqrt(max(trace, 0.0)) * dim * np.finfo(float).eps
    alphas: list[float] = []
    betas: list[float] = []  # betas[j]: between step j and j + 1
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # z of the left vectors: u = X z; zero where X v vanishes
    image: list[np.ndarray] = []  # X^T u of the left vectors
    v = rng.normal(size=dim)
    v /= np.sqrt(v @ v)
    while True:
        right.append(v)
        earlier = np.column_stack(left) if left else np.zeros((dim, 0))
        z = v - betas[-1] * left[-1] if left else v
        squares, overlap, down = rows.step(z, earlier)
        # u = (r - U c) / alpha with c = U^T r, and X^T u from the known X^T U
        z = z - earlier @ overlap
        alpha2 = squares - overlap @ overlap
        alpha = float(np.sqrt(alpha2)) if alpha2 > 0 else 0.0
        if alpha <= tiny:
            alpha, z, w = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            down = down - (np.column_stack(image) @ overlap if image else 0)
            z, w = z / alpha, down / alpha
        alphas.append(alpha)
        left.append(z)
        image.append(w)
        w = _across(w - alpha * v, right)
        beta = float(np.sqrt(w @ w))
        k = len(right)
        b = np.diag(alphas) + np.diag(betas, 1) if k > 1 else np.diag(alphas)
        p, s, qt = np.linalg.svd(b)
        done = k == dim
        if not done and k > top and s[0] > 0:
            residual = beta * np.abs(p[-1, :top])
            hidden = max(0.0, trace - float((s**2).sum())) + beta * s[0]
            done = bool((residual <= tolerance * s[0]).all()) and hidden < s[top - 1] ** 2
        if done:
            keep = min(top, k)
            return s[:keep] ** 2, np.column_stack(right) @ qt[:keep].T
        if beta <= tiny:
            beta, w = 0.0, _across(rng.normal(size=dim), right)
        betas.append(beta)
        v = w / np.sqrt(w @ w)


def _squared_deviation(t: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of integers."""
    if float(np.abs(t).max(initial=0)) ** 2 * t.shape[1] < 2.0**62:
        return (t * t).sum(axis=1).tolist()
    hi, lo = t >> 31, t & ((1 << 31) - 1)
    parts = [[sum(map(int, r)) for r in m.astype(object)] for m in (hi.astype(object) ** 2, hi.astype(object) * lo, lo.astype(object) ** 2)]
    return [(a << 62) + (b << 32) + c for a, b, c in zip(*parts, strict=True)]


_OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(``id_col``, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Entries become floor(``scale`` * entry) + ``offset``. Components are unit eigenvectors of the covariance (divisor n), by falling eigenvalue e.
    whitened: the centred vector along the component, over sqrt(e). deviation: the exact sum over dimensions of (n x - S)**2. explained:
    e over the trace. identity_error: the largest entry of whitened's own covariance less the identity, measured over all rows.

    Rows whose vector is null, empty, or holds a null or non-finite entry give no rows; their ids may be null or repeat. Vectors of different lengths
    cannot be compared: each length is a list of its own with its own n. Components of eigenvalue zero are left out, so equal vectors, or one
    alone, give no rows. Of equal eigenvalues any orthonormal vectors may come. Entries beyond 2**62 / ``scale`` raise an error.
    Lengths are taken one after the other. Other columns are not read.
    """
    ws = Workspace(spark, "whitening")
    blocks = packed(ws, df, vector_col, scale, offset)
    fits = {}
    for dim in sorted(r.dim for r in blocks.select("dim").distinct().collect()):
        rows = CentredRows(blocks, dim, offset)
        trace = rows.squares()
        if trace <= 0:
            continue
        values, vectors = bidiagonalise(rows, top)
        some = values > FLOOR * values[0]
        values, vectors = values[some], vectors[:, some]
        basis = vectors / np.sqrt(values / rows.n)
        mean, moments = rows.second_moments(basis)
        error = float(np.abs(moments - np.outer(mean, mean) - np.eye(len(values))).max())
        fits[dim] = rows.n, rows.sums, basis, values / trace, error

    def run(batches):
        for b in batches:
            for at, x in _valid(b.column(1), scale, offset):
                if x.shape[1] not in fits or not len(at):
                    continue
                n, s, basis, share, error = fits[x.shape[1]]
                k = basis.shape[1]
                for a in range(0, len(at), 4096):
                    part = n * x[a : a + 4096] - s
                    m = len(part)
                    deviation = [decimal.Decimal(d) for d in _squared_deviation(part) for _ in range(k)]
                    ids = b.column(0).take(pa.array(np.repeat(at[a : a + 4096], k)))
                    yield pa.record_batch([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.decimal128(38, 0)), pa.array(((part / n) @ basis).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {kind}, {_OUT}")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` of ``embeddings``; deviation is null where it passes a long, deviation_exact never is."""
    out = whiten(spark, table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
