"""Service times: whole seconds since the start of a service day, which may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def parse_clock(text: Column) -> Column:
    """``H+:MM:SS`` to seconds, hours without bound; null where malformed."""
    part = F.split(F.trim(text), ":")
    number = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("int")
    good = (F.size(part) == 3) & F.trim(text).rlike(r"^\d+:\d{1,2}:\d{1,2}$") & (number(1) < 60) & (number(2) < 60)
    return F.when(good, number(0) * 3600 + number(1) * 60 + number(2))


def format_clock(seconds: Column) -> Column:
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    s = seconds.cast("long")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def on_date(date: Column, seconds: Column) -> Column:
    """The moment ``seconds`` after the midnight of a date, as a timestamp without zone."""
    return F.timestamp_seconds(F.unix_date(date).cast("long") * DAY + seconds).cast("timestamp_ntz")


def window_threshold(date: Column, moment: Column) -> Column:
    """Seconds from the date's midnight to a moment, not below zero."""
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(moment.cast("timestamp")) - F.unix_date(date).cast("long") * DAY)


def rolling_dates(today: Column, behind: int, ahead: int) -> Column:
    return F.sequence(F.date_sub(today, behind), F.date_add(today, ahead))


def nearest_day(scheduled: Column, actual: Column) -> Column:
    """A clock without date, moved a day back or on where that is strictly nearer to the schedule (both in seconds)."""
    same, before, after = (F.abs(actual + k * DAY - scheduled) for k in (0, -1, 1))
    return F.when((before < same) & (before <= after), actual - DAY).when((after < same) & (after < before), actual + DAY).otherwise(actual)


def monday_first(date: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(date)


def expand_frequency(start: Column, end: Column, headway: Column) -> Column:
    """Departures of one window: start, then each headway, before the end."""
    good = (headway > 0) & (start < end)
    return F.when(good, F.sequence(start, end - 1, F.greatest(headway, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def fold_delay(scheduled_arrivals: Column, scheduled_departures: Column, offset: Column) -> Column:
    """Arrivals of later calls under an offset that dwell times absorb.

    At each call the train leaves at its scheduled time or when it has come,
    whichever is later; what is left of the offset goes on to the next one.
    Arrivals are rounded to minutes, halves away from zero.
    """
    calls = F.arrays_zip(scheduled_arrivals.alias("a"), scheduled_departures.alias("d"))
    zero = F.struct(offset.cast("long").alias("o"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, call: Column) -> Column:
        come = call["a"] + state["o"]
        rounded = (F.round(come / 60.0) * 60).cast("long")
        left = F.greatest(rounded, call["d"]) - call["d"]
        return F.struct(left.cast("long").alias("o"), F.concat(state["out"], F.array(rounded)).alias("out"))

    return F.aggregate(calls, zero, step)["out"]
