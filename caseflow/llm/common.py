"""Shared helpers of the corpus operators: the shared work folder and null-safe inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local[N] session without it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-caseflow-")
    return _LOCAL[app]


_WORKER: dict = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def keep_one(key, make):
    """What ``make`` gives, kept by this Python worker for later tasks; what another operator had it keep is let go, back to the system."""
    if key not in _WORKER:
        if _WORKER:
            _WORKER.clear()
            give_back()
        _WORKER[key] = make()
    return _WORKER[key]


def give_back() -> None:
    """Return freed memory of this worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(batches):
    """The batches one by one; memory that the work on one took goes back to the system before the next comes."""
    for b in batches:
        yield b
        give_back()


class Workspace:
    """Intermediate tables of one run, written under the shared folder so that lost executors cost no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by ``save`` that nothing reads any more."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._work_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe(left, right, names: list[str]):
    """Join condition: all ``names`` equal, null equal to null."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def text_slices(sizes: list[int], limit: int):
    """Consecutive (start, stop) ranges whose sizes sum to at most ``limit``; a larger single entry stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices_of(texts: pa.Array, limit: int):
    """``text_slices`` of a column of texts, by their bytes."""
    return text_slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), limit)


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (a long, b long); component is the least node.

    Alternating large-star and small-star rounds: every round is one aggregation and one join on
    tables in the shared folder, so a hub's rows can be split by adaptive skew handling, and only whether the edges
    are stars reaches the driver. Self edges are ignored, repeated edges count once.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        both = e.select("a", "b").union(e.select(b.alias("a"), a.alias("b"))) if large else e
        least = ws.save(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")), "least")
        joined = both.join(least, "a")
        if large:
            out = joined.filter(b > a).select(b.alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        out = ws.save(out.filter("a <> b").distinct(), "edges")
        ws.drop(least)
        return out

    def settled(e: DataFrame) -> bool:
        """Whether every node has one edge to a smaller one, or is such a smaller one that has none itself: stars around least nodes."""
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(e.select("b", F.lit(0)))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).filter("up > 1 OR (up = 1 AND low = 0)").isEmpty()

    cur = ws.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not settled(cur):
        big = star(cur, True)
        ws.drop(cur)
        cur = star(big, False)
        ws.drop(big)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
