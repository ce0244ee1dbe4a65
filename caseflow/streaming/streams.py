"""Arrival-driven forms: ingest of new files, deduplication, failure alerts and activity windows; what evidence adds is in ``arrivals``."""

from __future__ import annotations

import bisect
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_edges(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of every edge within the watermark; ts is its event time."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["case_id", "source", "target", "relation", "timestamp"])


def failure_alerts(stream: DataFrame, limit: int = 5, window: str = "300 seconds", slide: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sliding windows in which an ip failed ``limit`` times or more."""
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "ip").agg(F.count("*").alias("failures"))
    return counts.filter(F.col("failures") >= limit).select(F.col("window.start").alias("start"), "ip", "failures")


def trailing_alerts(stream: DataFrame, limit: int = 5, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """(id, ip, recent): every failure (ip, ts, id) that is the ``limit``-th or a later one of its ip in less than ``seconds``, as ``ledger.rate_limited`` gives them.

    Failures may come in any order within ``delay``. One is decided when the watermark has passed it, so all that count for it are there; until then it waits in its
    ip's state, with the times of the last ``seconds`` before. Rows without an ip or a time, and those that come later than the watermark, give none.
    """
    span = seconds * 1_000_000

    def decide(key, frames, state):
        # done: times that are decided and may still count; waiting: (time, id)
        done, waiting = json.loads(state.get[0]) if state.exists else ([], [])
        waiting = [tuple(x) for x in waiting]
        for f in frames:
            waiting += zip((f["ts"].astype("datetime64[us]").astype("int64")).tolist(), f["id"].tolist(), strict=True)
        waiting.sort()
        now = state.getCurrentWatermarkMs() * 1000
        ready = [x for x in waiting if x[0] < now]
        waiting = waiting[len(ready) :]
        times, out = [*done, *(x[0] for x in ready)], []
        for ts, event in ready:
            recent = bisect.bisect_right(times, ts) - bisect.bisect_right(times, ts - span)
            if recent >= limit:
                out.append((event, key[0], recent))
        done = [x for x in times if x > now - span - 1]
        if waiting or done:
            state.update((json.dumps([done, waiting]),))
            # called again when the first that waits can be decided, or the last that is kept counts for nothing
            state.setTimeoutTimestamp(max((waiting[0][0] if waiting else done[-1] + span) // 1000 + 1, now // 1000 + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "ip", "recent"])

    rows = stream.filter("ip IS NOT NULL AND ts IS NOT NULL").select("ip", "ts", "id").withWatermark("ts", delay)
    return rows.groupBy("ip").applyInPandasWithState(decide, "id long, ip string, recent long", "held string", "append", "EventTimeTimeout")


def tumbling_activity(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by window and action; works on streams and tables."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "action").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "action", "events")


def session_activity(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "username").agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), "username", "events")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, write Parquet, and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:
    """Hand every micro-batch to ``handle(frame, batch_id)``: batch operators on what arrived. Handlers must be idempotent for a batch id."""
    q = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
