"""Availability calendars: a struct of four arrays of rules (type, value, description).

A journey runs on a date if some Match rule holds, some MatchSecondary rule holds
or there is none, every Condition holds and no Exclude does.  Without a Match
rule it never runs; without a calendar neither.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = "array<struct<type: string, value: string, description: string>>"
AVAILABILITY = f"struct<match: {RULES}, match_secondary: {RULES}, condition: {RULES}, exclude: {RULES}>"


def check_rule(rule: Column, date: Column) -> Column:
    """One rule on a date.  Ranges include both ends and may be open; an unknown type or no value never holds."""
    kind, value = rule["type"], rule["value"]
    ends = F.split(value, ":")
    first, last = F.try_element_at(ends, F.lit(1)).try_cast("date"), F.try_element_at(ends, F.lit(2)).try_cast("date")
    held = (
        F.when(kind == "MatchAll", True)
        .when(F.coalesce(value, F.lit("")) == "", False)
        .when(kind == "DayOfWeek", F.date_format(date, "EEEE") == value)
        .when(kind == "Date", value.try_cast("date") == date)
        .when(kind == "DateRange", F.coalesce(date >= first, F.lit(True)) & F.coalesce(date <= last, F.lit(True)))
    )
    return F.coalesce(held, F.lit(False))


def match_date(availability: Column, date: Column) -> Column:
    rules = lambda name: F.coalesce(availability[name], F.array().cast(RULES))
    holds = lambda r: check_rule(r, date)
    second = rules("match_secondary")
    runs = F.exists(rules("match"), holds) & ((F.size(second) == 0) | F.exists(second, holds)) & F.forall(rules("condition"), holds) & ~F.exists(rules("exclude"), holds)
    return F.coalesce(runs, F.lit(False))


def running_days(*flags: Column) -> Column:
    """Names of the days whose flag (Monday first) is 1, in order."""
    names = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    return F.array_compact(F.array(*[F.when(f == 1, n) for f, n in zip(flags, names, strict=True)]))
