"""Realtime state from messages, in batch form: (vehicle, ts, event_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_state(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last message of each key.  An aggregate, so messages combine before they shuffle, whatever a key's share."""
    cols = [x for x in messages.columns if x != key and x not in order]
    last = messages.groupBy(key).agg(F.max(F.struct(*order, *cols)).alias("_m"))
    return last.select(key, *[F.col(f"_m.{x}").alias(x) for x in messages.columns if x != key])


def increasing_only(messages: DataFrame) -> DataFrame:
    """The late-data guard: by order of arrival (event_id), only messages newer than all before them."""
    w = Window.partitionBy("vehicle").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("seen", F.max("ts").over(w)).where("seen is null or ts > seen").drop("seen")


def with_previous(messages: DataFrame) -> DataFrame:
    w = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    return messages.withColumns({"was": F.lag("kind").over(w), "was_value": F.lag("value").over(w), "was_k": F.lag("k").over(w)})


def diff_events(messages: DataFrame) -> DataFrame:
    """Change events between consecutive states; the first state of a vehicle only says that it is new.

    A cancellation hides what else changed; delays count from five units more.
    """
    p = with_previous(messages)
    kinds = F.when(F.col("was").isNull(), F.array(F.lit("Created"))).when(
        (F.col("kind") == "error") & (F.col("was") != "error"), F.array(F.lit("Cancelled"))
    ).otherwise(
        F.array_compact(F.array(
            F.when((F.col("kind") == "view") & (F.col("was") != "view"), F.lit("ActivelyTracked")),
            F.when(F.col("k") != F.col("was_k"), F.lit("NextStopChanged")),
            F.when(F.col("value") >= F.col("was_value") + 5, F.lit("DelayIncreased")),
        ))
    )
    return p.select("vehicle", "event_id", "ts", F.explode(kinds).alias("change"))


def live(messages: DataFrame, now: str, minutes: int) -> DataFrame:
    return messages.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes"))


def identify(messages: DataFrame, trips: DataFrame, places: DataFrame) -> DataFrame:
    """Messages with the journey that they are about, and how it was found.

    messages have trip and place, either null; trips is (trip, found), places (place,
    found), each key once.  The trip counts first, then the place, where one is given;
    else the code is NONE, which callers may remember so as not to ask again.
    """
    by_trip = trips.select("trip", F.col("found").alias("of_trip"))
    by_place = places.select("place", F.col("found").alias("of_place"))
    got = messages.join(by_trip, "trip", "left").join(by_place, "place", "left")
    code = F.when(F.col("of_trip").isNotNull(), "TRIP").when(F.col("of_place").isNotNull(), "LOCATION").otherwise("NONE")
    return got.select(*messages.columns, F.coalesce("of_trip", "of_place").alias("found"), code.alias("code"))
