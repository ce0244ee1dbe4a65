"""Cutting of lineage between the steps of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table in the folder of spark.checkpoint.dir; a local session without it gets a folder of its own.

    Written once, compressed and by columns: a checkpoint would compute the last stage twice and store whole rows as they are.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-caseflow-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``df``, from a table: its own, if ``cut`` made it."""
    return df.select(*columns) if hasattr(df, "_cut_path") else cut(df.select(*columns))


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows dealt over all cores, where the scan itself has fewer tasks than these (a file of one row group)."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
