"""GTFS schedules: CSV tables of one folder to the domain's frames.

Schemas are declared, so a read takes one pass; columns that a file lacks are
null, a byte order mark before the header is skipped by Spark's reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions import calendar, text, times

#: Columns of the tables of a GTFS feed (fixed by the format).
TABLES = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string, agency_phone string, agency_fare_url string, agency_email string, agency_noc string",
    "stops": "stop_id string, stop_code string, stop_name string, stop_desc string, stop_lat double, stop_lon double, zone_id string, stop_url string, location_type string, parent_station string, stop_timezone string, wheelchair_boarding string, level_id string, platform_code string",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_desc string, route_url string, route_color string, route_text_color string, network_id string, route_type int, route_sort_order int, continuous_pickup int, continuous_drop_off int",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, trip_short_name string, block_id string, shape_id string, wheelchair_accessible int, bikes_allowed int, direction_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_headsign string, stop_sequence int, pickup_type int, drop_off_type int, continuous_pickup int, continuous_drop_off int, shape_dist_traveled double, timepoint int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int, exact_times string",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int, from_route_id string, to_route_id string, from_trip_id string, to_trip_id string",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int, shape_dist_traveled double",
    "translations": "table_name string, field_name string, language string, translation string, record_id string, record_sub_id string, field_value string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table; a file that is not there is an empty table."""
    schema = TABLES[table]
    names = [part.split(" ")[0] for part in schema.split(", ")]
    kinds = dict(part.split(" ") for part in schema.split(", "))
    path = f"{folder.rstrip('/')}/{table}.txt"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    # by header, as feeds order and choose their columns freely
    raw = spark.read.csv(path, header=True, enforceSchema=False, mode="PERMISSIVE")
    have = {c.strip().lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[(F.trim(F.col(f"`{have[n]}`")).try_cast(kinds[n]) if n in have else F.lit(None).cast(kinds[n])).alias(n) for n in names])


def operators(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    a = read(spark, folder, "agency")
    return a.select(F.concat(F.lit(f"{dataset}-operator-"), F.coalesce("agency_id", F.lit(""))).alias("operator_id"), F.col("agency_name").alias("name"), F.col("agency_url").alias("website"), F.col("agency_timezone").alias("timezone"))


def stops(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """Stations and single stops, each with its platforms; parts of a station are not stops of their own."""
    s = read(spark, folder, "stops")
    ref = lambda c: F.concat(F.lit(f"{dataset}-stop-"), c)
    child = s.where("coalesce(location_type, '') in ('', '0') and coalesce(parent_station, '') <> ''")
    platforms = child.groupBy(F.col("parent_station").alias("stop_id")).agg(F.sort_array(F.collect_list(F.struct(ref(F.col("stop_id")).alias("id"), F.coalesce("platform_code", "stop_name").alias("name"), F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat")))).alias("platforms"))
    own = s.where("coalesce(parent_station, '') = ''").join(platforms, "stop_id", "left")
    return own.select(ref(F.col("stop_id")).alias("stop_id"), F.array_compact(F.array(F.when(F.col("stop_code") != "", F.concat(F.lit("gtfs-stop-"), "stop_code")))).alias("other_ids"), F.col("stop_name").alias("name"), F.col("stop_timezone").alias("timezone"), F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"), F.coalesce("platforms", F.array().cast("array<struct<id: string, name: string, lon: double, lat: double>>")).alias("platforms"))


def services(spark: SparkSession, folder: str, dataset: str, language: str = "en") -> DataFrame:
    r = read(spark, folder, "routes")
    tr = read(spark, folder, "translations").where(F.col("table_name") == "routes").where(F.col("language") == language).where(F.col("field_name") == "route_short_name")
    tr = tr.groupBy(F.col("field_value").alias("route_short_name")).agg(F.min("translation").alias("translated"))
    name = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("translated", "route_short_name", "route_long_name")])
    return r.join(tr, "route_short_name", "left").select(F.concat(F.lit(f"{dataset}-service-"), "route_id").alias("service_id"), F.array(F.concat(F.lit("gtfs-route-"), "route_id")).alias("other_ids"), name.alias("name"), F.concat(F.lit(f"{dataset}-operator-"), F.coalesce("agency_id", F.lit(""))).alias("operator_id"), text.transport_type(F.col("route_type")).alias("transport_type"), F.col("route_color").alias("colour"))


def availability(spark: SparkSession, folder: str) -> DataFrame:
    """(service_id, availability) from calendars and their exceptions: added dates match, removed ones exclude."""
    date = lambda c: F.to_date(c, "yyyyMMdd").cast("string")
    rule = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(None).cast("string").alias("description"))
    none = F.array().cast(calendar.RULES)
    week = read(spark, folder, "calendar").select(
        "service_id",
        F.transform(calendar.running_days(*[F.col(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]), lambda d: rule("DayOfWeek", d)).alias("days"),
        F.array(rule("DateRange", F.concat_ws(":", date("start_date"), date("end_date")))).alias("range"),
    )
    extra = read(spark, folder, "calendar_dates").groupBy("service_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("exception_type") == 1, rule("Date", date("date"))))).alias("added"),
        F.sort_array(F.collect_set(F.when(F.col("exception_type") == 2, rule("Date", date("date"))))).alias("removed"),
    )
    both = week.join(extra, "service_id", "full_outer")
    added = F.coalesce("added", none)
    # an added date runs outside the range too: the range binds the days of the week only
    span = F.col("range")[0]["value"]
    bound = F.concat(F.coalesce("range", none), F.transform(added, lambda r: rule("Date", r["value"])))
    return both.select("service_id", F.struct(F.concat(F.coalesce("days", none), added).alias("match"), F.when(span.isNull(), none).otherwise(bound).alias("match_secondary"), none.alias("condition"), F.coalesce("removed", none).alias("exclude")).alias("availability"))


def calls(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """(journey_id, idx, stop_id, arr, dep, activities) of each trip, by sequence; the shuffle by trip spills by itself."""
    s = read(spark, folder, "stop_times")
    arr, dep = times.parse_clock(F.col("arrival_time")), times.parse_clock(F.col("departure_time"))
    acts = F.array_compact(F.array(F.when(F.coalesce("pickup_type", F.lit(0)) != 1, F.lit("Pickup")), F.when(F.coalesce("drop_off_type", F.lit(0)) != 1, F.lit("Setdown"))))
    w = Window.partitionBy("trip_id").orderBy("stop_sequence", "stop_id")
    return s.select(F.concat(F.lit(f"{dataset}-journey-"), "trip_id").alias("journey_id"), F.row_number().over(w).alias("idx"), F.concat(F.lit(f"{dataset}-stop-"), "stop_id").alias("stop_id"), F.coalesce(arr, dep).alias("arr"), F.coalesce(dep, arr).alias("dep"), acts.alias("activities"))


def journeys(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """Trips with their calendar and first departure; a trip with frequencies is one journey for each departure.

    Later windows of a trip that overlap an earlier one are dropped.
    """
    t = read(spark, folder, "trips").join(availability(spark, folder), "service_id", "left")
    first = calls(spark, folder, dataset).groupBy("journey_id").agg(F.min_by("dep", "idx").alias("start"))
    base = t.withColumn("journey_id", F.concat(F.lit(f"{dataset}-journey-"), "trip_id")).join(first, "journey_id")
    q = read(spark, folder, "frequencies").select("trip_id", times.parse_clock(F.col("start_time")).alias("from_s"), times.parse_clock(F.col("end_time")).alias("to_s"), "headway_secs").where("from_s < to_s and headway_secs > 0 and coalesce(trip_id, '') <> ''")
    kind = "array<struct<from_s: int, to_s: int, headway_secs: int>>"
    kept = F.aggregate(
        F.sort_array(F.collect_list(F.struct("from_s", "to_s", "headway_secs"))),
        F.struct(F.lit(-1).alias("busy"), F.array().cast(kind).alias("out")),
        lambda held, w: F.when(w["from_s"] >= held["busy"], F.struct(w["to_s"].alias("busy"), F.concat(held["out"], F.array(w)).alias("out"))).otherwise(held),
    )
    q = q.groupBy("trip_id").agg(kept["out"].alias("w")).select("trip_id", F.inline("w"))
    q = q.select("trip_id", F.explode(times.expand_frequency(F.col("from_s"), F.col("to_s"), F.col("headway_secs"))).alias("at"))
    out = base.join(q, "trip_id", "left")
    moved = F.when(F.col("at").isNull(), F.col("journey_id")).otherwise(F.concat_ws("-", "journey_id", F.col("at").cast("string")))
    return out.select(moved.alias("journey_id"), F.col("journey_id").alias("base_id"), F.concat(F.lit(f"{dataset}-service-"), "route_id").alias("service_id"), F.col("trip_headsign").alias("display"), F.col("block_id").alias("block"), F.coalesce("at", "start").alias("start"), (F.coalesce("at", "start") - F.col("start")).alias("shift"), "availability", F.create_map(F.lit("GTFS-TripID"), F.col("trip_id")).alias("other_ids"))


def transfers(spark: SparkSession, folder: str, dataset: str, as_written: bool = False) -> DataFrame:
    """Transfers; empty route and trip references are null (no restriction) unless ``as_written``."""
    t = read(spark, folder, "transfers")

    def ref(kind: str, c: str):
        full = F.concat(F.lit(f"{dataset}-{kind}-"), F.coalesce(c, F.lit("")))
        return full if as_written else F.when(F.coalesce(c, F.lit("")) != "", full)

    return t.select(ref("stop", "from_stop_id").alias("from_id"), ref("stop", "to_stop_id").alias("to_id"), ref("service", "from_route_id").alias("from_route"), ref("service", "to_route_id").alias("to_route"), ref("journey", "from_trip_id").alias("from_trip"), ref("journey", "to_trip_id").alias("to_trip"), text.transfer_type(F.col("transfer_type")).alias("type"), F.coalesce("min_transfer_time", F.lit(0)).alias("total_s"))


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """(track_id, points) of each shape, in order of sequence."""
    s = read(spark, folder, "shapes").where("shape_id is not null")
    path = s.groupBy("shape_id").agg(F.sort_array(F.collect_list(F.struct("shape_pt_sequence", F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat")))).alias("p"))
    return path.select(F.concat(F.lit("shape:"), "shape_id").alias("track_id"), F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))
