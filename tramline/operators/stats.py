"""Counts and rates over records and realtime events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(F.coalesce(key, F.lit("Unknown")).alias("key")).agg(F.count("*").alias("n"))


def conditional_counts(df: DataFrame, by: list[str], named: dict[str, Column]) -> DataFrame:
    """The total of each group, and how many of it meet each condition, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in named.items()])


def identification_rates(events: DataFrame, success: Column, today: str, quiet: bool = False) -> DataFrame:
    """(operator, day, week, month): shares of success over 1, 7 and 31 whole days before ``today``; null without events.

    One scan: the longest span is pushed down to it, the others are conditions.
    ``quiet`` adds operators without an event in the longest span, for a scan of names.
    """
    end = F.lit(f"{today} 00:00:00").cast("timestamp_ntz")
    known = events.select("operator").distinct()
    events = events.where((F.col("ts") >= end - F.expr("interval 31 days")) & (F.col("ts") < end))

    def share(days: int) -> Column:
        inside = (F.col("ts") >= end - F.expr(f"interval {days} days")) & (F.col("ts") < end)
        return F.try_divide(F.count_if(inside & success).cast("double"), F.count_if(inside).cast("double"))

    rates = events.groupBy("operator").agg(share(1).alias("day"), share(7).alias("week"), share(31).alias("month"))
    return known.join(rates, "operator", "left") if quiet else rates


def rating(day: Column, week: Column) -> Column:
    """The first that holds; nothing known is poor."""
    return F.when(day >= 0.95, "PERFECT").when(day >= 0.75, "EXCELLENT").when((day <= 0.5) & (week >= 0.75), "TEMPORARY-ISSUES").when(day >= 0.53, "GOOD").otherwise("POOR")
