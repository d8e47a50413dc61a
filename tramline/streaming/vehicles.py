"""Vehicle state over Structured Streaming.

The latest state of each vehicle is keyed state with a timeout; messages that
are no newer than it are late and dropped.  What changes is given as events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "ts_us long, kind string, value double, k long"
CHANGES = "vehicle long, event_id long, change string"


def changes_of(before: tuple | None, after: tuple) -> list[str]:
    """Events between two states (kind, value, k)."""
    if before is None:
        return ["Created"]
    if after[0] == "error" and before[0] != "error":
        return ["Cancelled"]
    out = []
    if after[0] == "view" and before[0] != "view":
        out.append("ActivelyTracked")
    if after[2] != before[2]:
        out.append("NextStopChanged")
    if after[1] >= before[1] + 5:
        out.append("DelayIncreased")
    return out


def track(messages: DataFrame, ttl_ms: int | None = 90 * 60 * 1000) -> DataFrame:
    """Change events of a stream (vehicle, event_id, ts, kind, value, k).

    State goes after ``ttl_ms`` of processing time without a message; with None
    it stays, for runs over what is there (a timeout asks for batches without end).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts, kind, value, k in zip(rows.event_id, rows.ts, rows.kind, rows.value, rows.k, strict=True):
            at = int(pd.Timestamp(ts).value // 1000)
            if held is not None and at <= held[0]:
                continue
            out += [(key[0], event_id, c) for c in changes_of(held and held[1:], (kind, value, k))]
            held = (at, kind, value, k)
        if held is not None:
            state.update(held)
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=["vehicle", "event_id", "change"])

    return messages.groupBy("vehicle").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def rates(messages: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Messages of each kind by windows of event time; what is later than the watermark is dropped."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", span).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def match_alerts(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A stream of alerts against subscriptions as they stand when a batch begins."""
    return alerts.join(subscriptions, "kind").where("value > threshold").select("sub_id", "event_id")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that :func:`upsert` keeps: of its complete versions the last, None before the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    # a version is complete when its writer has left the mark
    names = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
    done = sorted(p.toString() for p in names if p.getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return spark.read.parquet(done[-1]) if done else None


def upsert(batch: DataFrame, path: str, key: str, order: str, keep: int = 2) -> None:
    """A sink for foreachBatch: a table with the newest row of each key, read by :func:`current`.

    Each batch writes a version beside the last one, which stays as it is, so readers
    see either and a failure leaves the one before; a batch that is repeated gives the
    same rows.  Of the versions the last ``keep`` stay.
    """
    spark = batch.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    held = current(spark, path)
    rows = batch if held is None else held.unionByName(batch)
    cols = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    versions = sorted(s.getPath().getName() for s in fs.listStatus(where(path))) if fs.exists(where(path)) else []
    n = max((int(v[1:]) for v in versions if v.startswith("v")), default=0) + 1
    last.select(batch.columns).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v{n:012d}")
    for old in [v for v in versions if v.startswith("v")][: max(0, len(versions) + 1 - keep)]:
        fs.delete(where(f"{path}/{old}"), True)
