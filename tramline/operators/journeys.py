"""Journeys as ordered calls and legs.  calls: (journey_id, idx, stop_id, arr, dep), times in service seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leg_pairs(calls: DataFrame) -> DataFrame:
    """Consecutive calls as legs: n calls give n - 1 legs."""
    w = Window.partitionBy("journey_id").orderBy("idx")
    return calls.select("journey_id", "idx", F.col("stop_id").alias("origin"), F.lead("stop_id").over(w).alias("destination"), "dep", F.lead("arr").over(w).alias("arr")).where("destination is not null")


def flatten_stops(calls: DataFrame) -> DataFrame:
    """First call at each stop of a journey, the last call of all left out, as boards expect."""
    w = Window.partitionBy("journey_id")
    first = Window.partitionBy("journey_id", "stop_id").orderBy("idx")
    inner = calls.withColumn("final", F.max("idx").over(w)).where("idx < final")
    return inner.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("journey_id", "stop_id", "idx", "arr", "dep")


def stop_visits(calls: DataFrame) -> DataFrame:
    """Each call with how often its journey has been at the stop, this time included."""
    return calls.withColumn("visit", F.row_number().over(Window.partitionBy("journey_id", "stop_id").orderBy("idx")))


def patterns(calls: DataFrame, journeys: DataFrame) -> DataFrame:
    """Distinct ordered stop sequences of each service, with the number of journeys on them."""
    path = calls.groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", "stop_id"))).alias("p"))
    path = path.select("journey_id", F.array_join(F.transform("p", lambda x: x["stop_id"].cast("string")), ">").alias("pattern"))
    return path.join(journeys.select("journey_id", "service_id"), "journey_id").groupBy("service_id", "pattern").agg(F.count("*").alias("n"))


def functional_hash(calls: DataFrame, journeys: DataFrame) -> DataFrame:
    """A hash of what a passenger would tell journeys apart by: service, kind, start and calls."""
    path = calls.groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", "stop_id", "dep"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["stop_id"].cast("string"), x["dep"].cast("string"))), ",")
    rows = path.select("journey_id", text.alias("path")).join(journeys, "journey_id")
    return rows.select("journey_id", F.sha2(F.concat_ws("|", F.col("service_id").cast("string"), "kind", "path"), 256).alias("hash"))


def first_identical(hashes: DataFrame) -> DataFrame:
    """The least journey of each hash."""
    return hashes.groupBy("hash").agg(F.min("journey_id").alias("journey_id"))


def best_row(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order that ties cannot share."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
