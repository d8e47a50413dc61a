"""Railway feeds: short-notice changes, activations, train consists, loading and door sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What names a vehicle without seats as a power car.
LOCOMOTIVES = ("l", "loco", "locomotive")
POWER_TYPES = ("pc", "pp", "pwr", "powercar", "power-car", "powerpack", "power-pack", "power module", "power-module")
#: Classes whose short vehicles without seats are power cars, and the length in mm that they stay under.
SHORT_POWER_CLASSES, SHORT_POWER_MM = ("755", "756"), 10_000


def run_days(schedules: DataFrame) -> DataFrame:
    """(uid, first, last, days) to one row for each date on a run day; days holds seven characters from Monday, 1 where it runs."""
    dated = schedules.where("first <= last").withColumn("date", F.explode(F.sequence("first", "last")))
    return dated.where(F.expr("substring(days, weekday(date) + 1, 1) = '1'"))


def deleted(schedules: DataFrame) -> DataFrame:
    """One cancellation alert a schedule, whose identifiers are the instances of all its run days, in order."""
    each = run_days(schedules).withColumn("instance", F.concat_ws(":", F.lit("DAYINSTANCEOF"), F.col("date").cast("string"), F.col("uid").cast("string")))
    return each.groupBy("uid").agg(F.sort_array(F.collect_set("instance")).alias("identifiers"))


def cancelled(schedules: DataFrame, journeys: DataFrame, now: str) -> DataFrame:
    """Cancelled states of a train's timetable journeys that run in the range, kept to 48 hours past its end; expired ones are left out."""
    until = F.date_add("last", 2).cast("timestamp_ntz")
    runs = run_days(schedules).withColumn("until", until).where(F.col("until") > F.lit(now).cast("timestamp_ntz"))
    return runs.join(journeys, ["uid", "date"]).select("journey_id", "date", "until").distinct()


def activated(activations: DataFrame, journeys: DataFrame) -> DataFrame:
    """(train_id, uid, date) linked to the journey of that day, the smallest id where several run; one state a train, by its last message."""
    last = activations.groupBy("train_id").agg(F.max_by(F.struct("uid", "date"), F.struct("ts", "uid", "date")).alias("m")).select("train_id", "m.uid", "m.date")
    return last.join(journeys.groupBy("uid", "date").agg(F.min("journey_id").alias("journey_id")), ["uid", "date"])


def train_identifier(core: Column) -> Column:
    """Headcode, uid and hour of the working timetable in a core id of at least 12 characters."""
    part = lambda at, n: F.when(F.length(core) >= 12, F.substring(core, at, n)).otherwise("")
    return F.struct(part(1, 4).alias("headcode"), part(5, 6).alias("uid"), part(11, 2).alias("hour"))


def power_car(kind: Column, specific: Column, seats: Column, fleet: Column, length_mm: Column) -> Column:
    """Whether a vehicle is a power car; kinds in lower case, nulls as if absent."""
    kind, specific, fleet = (F.coalesce(c, F.lit("")) for c in (kind, specific, fleet))
    empty = F.coalesce(seats, F.lit(0)) == 0
    named = kind.contains("power") | specific.contains("power")
    short = F.regexp_extract(fleet, r"^\d+", 0).isin(*SHORT_POWER_CLASSES) & F.coalesce((length_mm > 0) & (length_mm < SHORT_POWER_MM), F.lit(False))
    return named | (empty & (kind.isin(*LOCOMOTIVES) | specific.isin(*POWER_TYPES) | short))


def merged_loading(carriages: DataFrame, loading: DataFrame) -> DataFrame:
    """Loading set on carriages of the same train and id; what matches none is a carriage of its own, for passengers."""
    load = loading.groupBy("train", "id").agg(F.max_by("occupancy", "seq").alias("new"))
    both = carriages.join(load, ["train", "id"], "full")
    return both.select("train", "id", F.coalesce("role", F.lit("Passenger")).alias("role"), F.coalesce("new", "occupancy").alias("occupancy"))


def inferred(trains: DataFrame, carriages: DataFrame, classes: DataFrame) -> DataFrame:
    """Length and vehicle type of trains that lack them: carriages that count, the class of the fleet, else of the first carriage with one."""
    known = classes.select("class", "vehicle_type")
    typed = carriages.join(known, "class", "left")
    seen = typed.groupBy("train").agg(F.count_if("counts").alias("n"), F.min_by("vehicle_type", F.when(F.col("vehicle_type").isNotNull(), F.col("position"))).alias("carriage_type"), (F.count_if("counts") < F.count("*")).alias("some_do_not_count"))
    fleet = known.select(F.col("class").alias("fleet"), F.col("vehicle_type").alias("fleet_type"))
    got = trains.join(seen, "train", "left").join(fleet, "fleet", "left")
    length = F.when((F.col("length") == 0) | F.coalesce("some_do_not_count", F.lit(False)), F.coalesce("n", F.lit(0))).otherwise(F.col("length"))
    return got.select("train", length.cast("long").alias("length"), F.coalesce("given_type", "fleet_type", "carriage_type").alias("vehicle_type"))


def door_side(track_x: Column, track_y: Column, travel_x: Column, travel_y: Column, platform_x: Column, platform_y: Column, from_stop_position: Column) -> Column:
    """Side and confidence of a platform seen along the journey; all vectors in metres, the platform's from the track.

    Unknown beyond 30 m (unless the track came from a stop position), where track
    and journey hardly agree, or where the platform lies on the track or along it.
    """
    dot = track_x * travel_x + track_y * travel_y
    size = F.sqrt(track_x * track_x + track_y * track_y) * F.sqrt(travel_x * travel_x + travel_y * travel_y)
    aligned = F.when(size > 0, F.abs(dot) / size)
    away = F.sqrt(platform_x * platform_x + platform_y * platform_y)
    cross = F.when(dot < 0, -1).otherwise(1) * (track_x * platform_y - track_y * platform_x)
    known = (aligned >= 0.15) & (away >= 0.25) & (F.abs(cross) >= 0.01) & ((away <= 30) | from_stop_position)
    side = F.when(~F.coalesce(known, F.lit(False)), "Unknown").when(cross > 0, "Left").otherwise("Right")
    return F.struct(side.alias("side"), F.when(F.coalesce(known, F.lit(False)), F.round(F.least(F.lit(0.98), 0.72 + 0.2 * aligned), 2)).alias("confidence"))
