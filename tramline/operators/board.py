"""Departure boards: calls of journeys at a set of stops, with what realtime says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.calendar import match_date


def window(calls: DataFrame, stops: DataFrame, after: int) -> DataFrame:
    """Earliest call of each journey at the stops, not before a second of the day."""
    at = calls.join(stops.select("stop_id"), "stop_id", "left_semi").where(F.col("dep") >= after)
    return at.groupBy("journey_id").agg(F.min(F.struct("dep", "idx", "stop_id")).alias("c")).select("journey_id", "c.dep", "c.idx", "c.stop_id")


def running(journeys: DataFrame, date: str) -> DataFrame:
    """Journeys whose calendar (column availability) holds on a date."""
    return journeys.where(match_date(F.col("availability"), F.lit(date).cast("date")))


def candidate_limit(count: int) -> int:
    """How many rows to look at for a board of ``count``."""
    return max(128, min(20_000, 8 * count))


def unavailable(activities: Column, arrivals: bool = False) -> Column:
    """A call that nobody may board (departures) or leave at (arrivals)."""
    return (F.size(activities) == 1) & (activities[0] == ("Pickup" if arrivals else "Setdown"))


def estimates(rows: DataFrame, runs: DataFrame, now: int, ahead: int = 45 * 60) -> DataFrame:
    """Rows with a column ``estimate``: seconds that a scheduled call is late, after the newest earlier run of its block.

    rows: (block, journey_id, start, time, scheduled); runs: (block, journey_id,
    start, offset) of journeys that realtime knows.  A row counts if it is scheduled,
    has a block and calls at most ``ahead`` seconds from now.  Of the runs of its block
    that start before its own the newest counts; a delay is passed on, running early
    is not: then the estimate is 0.  Rows without such a run have none.

    Only rows that count and runs of realtime are dealt out by block.
    """
    counts = F.col("scheduled") & (F.coalesce("block", F.lit("")) != "") & F.col("time").between(now, now + ahead)
    known = F.col("offset").isNotNull()
    asked = rows.where(counts).select("block", "start", F.lit(0).alias("ran"), "journey_id", F.lit(None).cast("long").alias("offset")).distinct()
    held = runs.where(F.coalesce("block", F.lit("")) != "").where(known).select("block", "start", F.lit(1).alias("ran"), "journey_id", F.col("offset").cast("long").alias("offset"))
    # at equal starts those that ask come first: only earlier runs count
    w = Window.partitionBy("block").orderBy("start", "ran", "journey_id").rowsBetween(Window.unboundedPreceding, -1)
    both = asked.unionByName(held).withColumn("late", F.last("offset", ignorenulls=True).over(w)).where("ran = 0 and late is not null")
    told = both.select("block", "start", "journey_id", F.greatest("late", F.lit(0)).alias("estimate")).withColumn("counts", F.lit(True))
    return rows.withColumn("counts", F.coalesce(counts, F.lit(False))).join(told, ["block", "start", "journey_id", "counts"], "left").drop("counts")


def generate(calls: DataFrame, journeys: DataFrame, realtime: DataFrame, stops: DataFrame, date: str, after: int, count: int | None = 25) -> DataFrame:
    """The board.

    journeys: (journey_id, service_id, block, start, availability); realtime:
    (journey_id, offset, cancelled, suppressed).  Journeys off their calendar or
    suppressed are dropped, cancelled ones stay and say so; times take the realtime
    offset, else an estimate from the block's earlier runs, whatever their calendar;
    rows before ``after`` are dropped; first rows by time, then journey.
    """
    rows = running(journeys, date).select("journey_id", "service_id", "block", "start").join(window(calls, stops, after), "journey_id")
    rows = rows.join(realtime, "journey_id", "left").where("not coalesce(suppressed, false)")
    rows = rows.withColumns({"time": F.col("dep"), "scheduled": F.col("offset").isNull() & ~F.coalesce("cancelled", F.lit(False))})
    runs = journeys.select("journey_id", "block", "start").join(realtime.select("journey_id", "offset"), "journey_id")
    rows = estimates(rows, runs, after)
    kind = F.when(F.col("cancelled"), "Cancelled").when(F.col("offset").isNotNull(), "RealtimeTracked").when(F.col("estimate").isNotNull(), "Estimated").otherwise("Scheduled")
    time = F.col("dep") + F.coalesce("offset", "estimate", F.lit(0))
    out = rows.select("journey_id", "service_id", "stop_id", "dep", time.alias("time"), kind.alias("type")).where(F.col("time") >= after)
    return out if count is None else out.orderBy("time", "journey_id").limit(count)


def destination_shown(legs: DataFrame, arrivals: bool = False) -> DataFrame:
    """What a board shows for a call: legs (journey_id, idx, origin, destination, cancelled) give the journey's first origin
    on arrivals, else its last destination that is not cancelled; a journey cancelled in whole keeps its own."""
    if arrivals:
        return legs.groupBy("journey_id").agg(F.min_by("origin", "idx").alias("shown"))
    open_ = F.max_by(F.when(~F.coalesce("cancelled", F.lit(False)), F.col("destination")), F.when(~F.coalesce("cancelled", F.lit(False)), F.col("idx")))
    return legs.groupBy("journey_id").agg(F.coalesce(open_, F.max_by("destination", "idx")).alias("shown"))


def suppressed_on(suppressed: Column, dates: Column, day: Column) -> Column:
    """Whether realtime takes a journey off the board of a day: on its listed days, or on all where none is listed."""
    listed = F.coalesce(dates, F.array().cast("array<string>"))
    return F.coalesce(suppressed, F.lit(False)) & ((F.size(listed) == 0) | F.array_contains(listed, day.cast("date").cast("string")))


def dedupe(rows: DataFrame) -> DataFrame:
    """First row of each journey by source rank and time; rows without a journey all stay."""
    w = Window.partitionBy("journey_id").orderBy("rank", "time", "row_id")
    named = rows.where("journey_id is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return named.unionByName(rows.where("journey_id is null"))


def fill(today: DataFrame, tomorrow: DataFrame, count: int) -> DataFrame:
    """Today's rows, and tomorrow's a day later where today has fewer than asked for: one plan, no look ahead."""
    short = F.broadcast(today.limit(count).agg(F.count("*").alias("_n")).where(F.col("_n") < count))  # one row or none
    later = tomorrow.withColumn("time", F.col("time") + 86_400).crossJoin(short).drop("_n")
    return today.unionByName(later)
