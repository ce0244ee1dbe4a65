"""Ranges of ids with bounded size, the same for the same rows whatever the partitions; and files in the shared folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the first histogram. Shards at most, about: beyond it they grow with the input, so what the driver holds doesn't.
BINS = 4096
MAX_SHARDS = 1 << 16


@dataclass
class Cuts:
    """Shards by id: range i begins at starts[i - 1] (range 0 is open below) and has parts[i] shards; null ids have ``null_parts`` of their own, before all others.

    A range of several shards holds one id; its rows are dealt by a hash of theirs, in ascending order.
    """

    starts: list[int] = field(default_factory=list)
    parts: list[int] = field(default_factory=lambda: [1])
    null_parts: int = 0

    @property
    def first(self) -> np.ndarray:
        return self.null_parts + np.concatenate(([0], np.cumsum(self.parts)[:-1]))

    @property
    def shards(self) -> int:
        return max(1, self.null_parts + sum(self.parts))


def range_cuts(sizes: DataFrame, id_col: str, size_col: str, target: int) -> Cuts:
    """Ranges of ids that hold about ``target`` of summed size each.

    Level by level, all ranges that are too heavy are cut into finer bins by one job, until they are light or one id wide: seven jobs or
    fewer for any number of shards, and the driver meets a few sums for each shard. ``sizes`` is read once a level.
    """
    none = F.col(id_col).isNull()
    lo, hi, total, null_total, nulls = sizes.agg(F.min(id_col), F.max(id_col), F.sum(F.col(size_col).cast("double")), F.sum(F.when(none, F.col(size_col)).cast("double")), F.count_if(none)).first()
    target = max(target, (total or 0) / MAX_SHARDS)
    # no more than there are rows: a row stays whole
    pieces = lambda s, rows: max(1, min(rows, int(-(-s // target))))
    cuts = Cuts(null_parts=pieces(null_total or 0, nulls) if nulls else 0)
    if lo is None or total <= target:
        return cuts
    light: list[tuple[int, int, float, int]] = []  # (first id, first id after it, size, rows)
    offset = lambda start, width: F.floor((F.col("i").cast("decimal(38,0)") - start) / width).cast("long")
    wide = -(-(hi - lo + 1) // BINS)
    todo = [(lo, hi, wide)]
    rows = sizes.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(size_col).cast("double").alias("s"), F.lit(0).cast("long").alias("range"))
    rows = rows.withColumn("bin", offset(F.lit(lo), F.lit(wide)))
    while todo:
        heavy, after = [], []
        for r in rows.groupBy("range", "bin").agg(F.sum("s").alias("s"), F.count("*").alias("n")).collect():
            a, z, width = todo[r.range]
            start = a + r.bin * width
            stop = min(z, start + width - 1)
            if r.s > target and stop > start:
                finer = -(-(stop - start + 1) // min(BINS, max(4, 4 * pieces(r.s, r.n))))
                heavy.append((r.range, r.bin, len(after), start, str(finer)))
                after.append((start, stop, finer))
            else:
                light.append((start, stop + 1, r.s, r.n))
        todo = after
        if heavy:
            # a heavy bin holds over one target's worth, so these are MAX_SHARDS rows or fewer
            known = sizes.sparkSession.createDataFrame(heavy, "range long, bin long, finer_range long, start long, width string")
            rows = rows.join(F.broadcast(known), ["range", "bin"]).select("i", "s", F.col("finer_range").alias("range"), offset(F.col("start"), F.col("width").cast("decimal(38,0)")).alias("bin"))
    held, starts, parts = 0.0, [], [1]
    for k, (start, stop, s, n) in enumerate(sorted(light)):
        alone = s > target
        if k and (alone or parts[-1] > 1 or held + s > target):
            starts.append(start)
            parts.append(1)
            held = 0.0
        if alone:
            parts[-1] = pieces(s, n)
        held += s
    return Cuts(starts, parts, cuts.null_parts)


def part_of(hashed: Column, parts: Column) -> Column:
    """Which of ``parts`` equal stretches of the signed 64-bit numbers a hash lies in."""
    return F.least(parts - 1, F.floor((hashed.cast("double") / F.lit(2.0**64) + 0.5) * parts)).cast("int")


def with_place(df: DataFrame, id_col: str, cuts: Cuts) -> DataFrame:
    """``df`` with column place: the number of the id's first shard and how many it has."""
    if not cuts.starts and not cuts.null_parts:
        return df.withColumn("place", F.struct(F.lit(0).alias("first"), F.lit(cuts.parts[0]).alias("parts")))
    sent = df.sparkSession.sparkContext.broadcast((np.array(cuts.starts, np.int64), cuts.first.astype(np.int32), np.array(cuts.parts, np.int32)))

    @F.pandas_udf("first int, parts int")
    def place(ids):
        import pandas as pd

        starts, first, parts = sent.value
        at = np.searchsorted(starts, ids.to_numpy().astype(np.int64), side="right")
        return pd.DataFrame({"first": first[at], "parts": parts[at]})

    # a long goes to pandas as a double where nulls are among the values, so nulls are sent as 0 and set back
    known = place(F.coalesce(F.col(id_col), F.lit(0).cast("long")))
    none = F.struct(F.lit(0).alias("first"), F.lit(max(1, cuts.null_parts)).alias("parts"))
    return df.withColumn("place", known).withColumn("place", F.when(F.col(id_col).isNull(), none).otherwise(F.col("place")))


def with_shard(df: DataFrame, id_col: str, hash_col: str, cuts: Cuts) -> DataFrame:
    """``df`` with column shard. Ascending shards hold ascending (null first, id, hash)."""
    return with_place(df, id_col, cuts).withColumn("shard", F.col("place.first") + part_of(F.col(hash_col), F.col("place.parts"))).drop("place")


def by_shard(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """One partition a shard, sorted by the given columns."""
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *order)


class SharedFile:
    """A file written under a temporary name and renamed when it is complete; a repeated task replaces it by equal bytes."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.temp = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.temp, compression=None), 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += pa.py_buffer(data).size

    def commit(self) -> int:
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.size


def open_shared(folder: str, name: str):
    """(open random-access file) of a committed file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    return fs.open_input_file(f"{root}/{name}")
