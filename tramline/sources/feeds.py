"""Other feeds: fixed-width timetables, XML and JSON, each to a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.text import passenger_journey

#: Fields of timetable records (fixed by the format): name, first column from 1, width.
BASIC = (("transaction", 3, 1), ("train_uid", 4, 6), ("runs_from", 10, 6), ("runs_to", 16, 6), ("days_run", 22, 7), ("status", 30, 1), ("category", 31, 2), ("identity", 33, 4), ("headcode", 37, 4), ("power", 51, 3), ("speed", 58, 3), ("seating", 67, 1), ("sleepers", 68, 1), ("catering", 71, 4), ("stp", 80, 1))
ORIGIN = (("location", 3, 8), ("departure", 11, 5), ("public_departure", 16, 4), ("platform", 20, 3), ("activity", 30, 12))
CALL = (("location", 3, 8), ("arrival", 11, 5), ("departure", 16, 5), ("public_arrival", 26, 4), ("public_departure", 30, 4), ("platform", 34, 3), ("activity", 43, 12))
END = (("location", 3, 8), ("arrival", 11, 5), ("public_arrival", 16, 4), ("platform", 20, 3), ("activity", 26, 12))
STATION = (("name", 6, 30), ("interchange", 36, 1), ("tiploc", 37, 7), ("crs", 50, 3), ("east", 53, 5), ("north", 59, 5), ("change_minutes", 64, 2))


def fields(line, spec):
    return [F.trim(F.substring(line, at, n)).alias(name) for name, at, n in spec]


def cif_records(spark: SparkSession, path: str) -> DataFrame:
    """(train, place, line): each schedule's lines in file order.

    Schedules are told apart by the count of BS records before a line.  The
    running count is over one file's lines, which the format keeps in order, so
    it goes by file; within large files the count of each stretch is summed first.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("stretch"), F.monotonically_increasing_id().alias("n"))
    lines = lines.withColumn("new", (F.substring("line", 1, 2) == "BS").cast("int"))
    sums = lines.groupBy("file", "stretch").agg(F.sum("new").alias("k"))
    base = sums.withColumn("base", F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    at = lines.join(base, ["file", "stretch"]).withColumn("own", F.sum("new").over(Window.partitionBy("file", "stretch").orderBy("n")))
    rows = at.where("base + own > 0").select("file", (F.col("base") + F.col("own")).alias("train"), "n", "line")
    return rows.where(F.substring("line", 1, 2).isin("BS", "BX", "LO", "LI", "LT"))


def cif_schedules(spark: SparkSession, path: str) -> DataFrame:
    """One row for each schedule: its basic record, operator code, and calls as an array in order."""
    r = cif_records(spark, path)
    kind = F.substring("line", 1, 2)
    call = lambda spec, k: F.when(kind == k, F.struct(*[F.trim(F.substring("line", at, n)).alias(name) if (name, at, n) else None for name, at, n in [next((s for s in spec if s[0] == name), (name, 1, 0)) for name, _, _ in CALL]]))
    calls = F.coalesce(call(ORIGIN, "LO"), call(CALL, "LI"), call(END, "LT"))
    grouped = r.withColumn("call", calls).groupBy("file", "train").agg(
        F.max(F.when(kind == "BS", F.col("line"))).alias("bs"),
        F.max(F.when(kind == "BX", F.trim(F.substring("line", 12, 2)))).alias("operator"),
        F.sort_array(F.collect_list(F.when(F.col("call").isNotNull(), F.struct("n", "call")))).alias("c"),
    )
    return grouped.select(*fields(F.col("bs"), BASIC), F.coalesce("operator", F.lit("")).alias("operator"), F.transform("c", lambda x: x["call"]).alias("calls"))


def cif_resolved(schedules: DataFrame) -> DataFrame:
    """Short-term changes applied: permanent rows with the date ranges that cancellations and overlays take from them.

    Cancelled or overlaid ranges of a train go to every permanent or new schedule
    of it; overlays and new schedules stand as schedules of their own.
    """
    span = F.concat_ws(":", *[F.to_date(c, "yyMMdd").cast("string") for c in ("runs_from", "runs_to")])
    gone = schedules.where("transaction = 'N' and stp in ('C', 'O')").groupBy("train_uid").agg(F.sort_array(F.collect_set(span)).alias("ranges"))
    kept = schedules.where("transaction = 'N' and stp in ('P', 'N', 'O')").where(passenger_journey(F.col("category"), F.col("operator")))
    both = kept.join(gone, "train_uid", "left")
    return both.withColumn("exclude", F.when(F.col("stp") == "O", F.array().cast("array<string>")).otherwise(F.coalesce("ranges", F.array().cast("array<string>")))).drop("ranges")


def cif_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("substring(value, 1, 1) = 'A' and substring(value, 31, 4) <> 'FILE'").select(*fields(F.col("value"), STATION))


def siri_vm(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Vehicle positions that are at most 20 minutes old, with the local id their journey is tracked by."""
    schema = "RecordedAtTime string, MonitoredVehicleJourney struct<LineRef: string, OperatorRef: string, VehicleRef: string, VehicleJourneyRef: string, OriginRef: string, DestinationRef: string, OriginAimedDepartureTime: string, Bearing: double, Occupancy: string, VehicleLocation: struct<Longitude: double, Latitude: double>, FramedVehicleJourneyRef: struct<DataFrameRef: string, DatedVehicleJourneyRef: string>>"
    v = spark.read.format("xml").option("rowTag", "VehicleActivity").schema(schema).load(path)
    m = F.col("MonitoredVehicleJourney")
    at, present = F.col("RecordedAtTime").try_cast("timestamp"), F.lit(now).cast("timestamp")
    ref = F.coalesce(m["FramedVehicleJourneyRef"]["DatedVehicleJourneyRef"], m["VehicleJourneyRef"], F.lit(""))
    day = F.coalesce(m["FramedVehicleJourneyRef"]["DataFrameRef"], F.date_format(present, "yyyy-MM-dd"))
    local = F.concat_ws(":", F.lit("SIRI-VM"), *[F.coalesce(x, F.lit("")) for x in (m["OperatorRef"], m["LineRef"], m["OriginRef"], day, m["VehicleRef"], ref, m["OriginAimedDepartureTime"])])
    fresh = at.isNull() | (at >= present - F.expr("interval 20 minutes"))
    return v.where(fresh).select(local.alias("local_id"), at.alias("ts"), m["OperatorRef"].alias("operator"), m["LineRef"].alias("line"), m["VehicleRef"].alias("vehicle"), ref.alias("journey_ref"), m["VehicleLocation"]["Longitude"].alias("lon"), m["VehicleLocation"]["Latitude"].alias("lat"), m["Bearing"].alias("bearing"), m["Occupancy"].alias("occupancy"))


def naptan_stops(spark: SparkSession, path: str) -> DataFrame:
    """Stop points with their identifiers and areas."""
    schema = "_Status string, AtcoCode string, NaptanCode string, Descriptor struct<CommonName: string, Indicator: string, Street: string>, Place struct<Location: struct<Translation: struct<Longitude: double, Latitude: double>>>, StopClassification struct<StopType: string, OffStreet: struct<Rail: struct<AnnotatedRailRef: struct<TiplocRef: string, CrsRef: string>>>>, StopAreas struct<StopAreaRef: array<string>>"
    s = spark.read.format("xml").option("rowTag", "StopPoint").schema(schema).load(path)
    rail = F.col("StopClassification.OffStreet.Rail.AnnotatedRailRef")
    named = lambda prefix, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(prefix), c))
    place = F.col("Place.Location.Translation")
    return s.select(F.concat(F.lit("gb-atco-"), "AtcoCode").alias("stop_id"), F.array_compact(F.array(named("gb-atco-", F.col("AtcoCode")), named("gb-naptan-", F.col("NaptanCode")), named("gb-tiploc-", rail["TiplocRef"]), named("gb-crs-", rail["CrsRef"]))).alias("other_ids"), F.concat_ws(" ", "Descriptor.CommonName", F.when(~F.lower(F.coalesce("Descriptor.Indicator", F.lit(""))).isin("", "-", "--", "unknown"), F.concat(F.lit("("), "Descriptor.Indicator", F.lit(")")))).alias("name"), place["Longitude"].alias("lon"), place["Latitude"].alias("lat"), F.col("StopClassification.StopType").alias("stop_type"), F.coalesce("StopAreas.StopAreaRef", F.array().cast("array<string>")).alias("areas"), (F.coalesce("_Status", F.lit("active")) == "active").alias("active"))


def corpus(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Railway locations as records that only merge others; those without a code or number are left out."""
    row = "struct<NLC: bigint, STANOX: string, TIPLOC: string, `3ALPHA`: string, UIC: string, NLCDESC: string, NLCDESC16: string>"
    d = spark.read.option("multiLine", True).schema(f"TIPLOCDATA array<{row}>").json(path).select(F.explode("TIPLOCDATA").alias("d"))
    tip, num, crs = (F.trim(F.coalesce(F.col(f"d.{x}"), F.lit(""))) for x in ("TIPLOC", "STANOX", "`3ALPHA`"))
    d = d.select(tip.alias("tiploc"), num.alias("stanox"), crs.alias("crs")).where("tiploc <> '' and stanox <> ''")
    return d.select(F.concat_ws("-", F.lit("internalmerge"), F.lit(dataset), "tiploc", "stanox").alias("stop_id"), F.array_compact(F.array(F.concat(F.lit("gb-stanox-"), "stanox"), F.concat(F.lit("gb-tiploc-"), "tiploc"), F.when(F.col("crs") != "", F.concat(F.lit("gb-crs-"), "crs")))).alias("other_ids"))


def gtfs_rt(messages: DataFrame, now: str) -> DataFrame:
    """Positions of a realtime feed that was decoded to JSON (column value), at most 20 minutes old."""
    schema = "id string, vehicle struct<trip: struct<tripId: string, routeId: string, startDate: string>, position: struct<latitude: double, longitude: double, bearing: double>, timestamp: bigint, occupancyStatus: string>"
    v = messages.select(F.from_json("value", schema).alias("m")).where("m.vehicle is not null").select("m.id", "m.vehicle.*")
    at = F.timestamp_seconds("timestamp")
    filled = F.create_map(*[F.lit(x) for pair in (("EMPTY", 0), ("MANY_SEATS_AVAILABLE", 25), ("FEW_SEATS_AVAILABLE", 50), ("STANDING_ROOM_ONLY", 75), ("CRUSHED_STANDING_ROOM_ONLY", 90), ("FULL", 100)) for x in pair])
    fresh = v.where(F.col("timestamp").isNull() | (at >= F.lit(now).cast("timestamp") - F.expr("interval 20 minutes")))
    return fresh.select("id", F.col("trip.tripId").alias("trip"), F.col("trip.routeId").alias("route"), at.alias("ts"), F.col("position.longitude").alias("lon"), F.col("position.latitude").alias("lat"), F.col("position.bearing").alias("bearing"), filled[F.col("occupancyStatus")].alias("occupancy"))


def gtfs_rt_updates(messages: DataFrame) -> DataFrame:
    """(id, trip, route, start_date, relationship, ts, idx, stop_id, arrival, departure, delay_s, skipped): each stop time of the trip updates
    of a realtime feed that was decoded to JSON (column value); a cancelled trip without stop times is one row."""
    event = "struct<time: bigint, delay: int>"
    schema = f"id string, tripUpdate struct<trip: struct<tripId: string, routeId: string, startDate: string, scheduleRelationship: string>, timestamp: bigint, stopTimeUpdate: array<struct<stopSequence: int, stopId: string, arrival: {event}, departure: {event}, scheduleRelationship: string>>>"
    u = messages.select(F.from_json("value", schema).alias("m")).where("m.tripUpdate is not null").select("m.id", "m.tripUpdate.*")
    u = u.select("id", "trip", "timestamp", F.explode_outer("stopTimeUpdate").alias("s"))
    kind = F.coalesce("trip.scheduleRelationship", F.lit("SCHEDULED"))
    return u.select("id", F.col("trip.tripId").alias("trip"), F.col("trip.routeId").alias("route"), F.col("trip.startDate").alias("start_date"), kind.alias("relationship"), F.timestamp_seconds("timestamp").alias("ts"), F.col("s.stopSequence").alias("idx"), F.col("s.stopId").alias("stop_id"), F.timestamp_seconds("s.arrival.time").alias("arrival"), F.timestamp_seconds("s.departure.time").alias("departure"), F.coalesce("s.departure.delay", "s.arrival.delay").alias("delay_s"), (F.coalesce("s.scheduleRelationship", F.lit("")) == "SKIPPED").alias("skipped"))


#: Effects of alerts and the types they become; others inform.
EFFECTS = {"NO_SERVICE": "ServiceSuspended", "REDUCED_SERVICE": "Delays", "SIGNIFICANT_DELAYS": "SevereDelays", "DETOUR": "Warning", "STOP_MOVED": "Warning", "MODIFIED_SERVICE": "Warning"}


def gtfs_rt_alerts(messages: DataFrame) -> DataFrame:
    """(id, type, title, text, valid_from, valid_until, routes, stops, trips) of the alerts of such a feed, first translation."""
    words = "struct<translation: array<struct<text: string, language: string>>>"
    schema = f"id string, alert struct<activePeriod: array<struct<start: bigint, end: bigint>>, informedEntity: array<struct<routeId: string, stopId: string, trip: struct<tripId: string>>>, effect: string, headerText: {words}, descriptionText: {words}>"
    a = messages.select(F.from_json("value", schema).alias("m")).where("m.alert is not null").select("m.id", "m.alert.*")
    kind = F.lit("Information")
    for effect, name in EFFECTS.items():
        kind = F.when(F.col("effect") == effect, name).otherwise(kind)
    of = lambda field: F.array_distinct(F.array_compact(F.transform(F.coalesce("informedEntity", F.array().cast("array<struct<routeId: string, stopId: string, trip: struct<tripId: string>>>")), field)))
    first = lambda c: F.get(F.col(f"{c}.translation"), F.lit(0))["text"]
    return a.select("id", kind.alias("type"), first("headerText").alias("title"), first("descriptionText").alias("text"), F.timestamp_seconds(F.array_min("activePeriod.start")).alias("valid_from"), F.timestamp_seconds(F.array_max("activePeriod.end")).alias("valid_until"), of(lambda x: x["routeId"]).alias("routes"), of(lambda x: x["stopId"]).alias("stops"), of(lambda x: x["trip"]["tripId"]).alias("trips"))


def naptan_areas(spark: SparkSession, path: str) -> DataFrame:
    """Stop areas as stop groups."""
    s = spark.read.format("xml").option("rowTag", "StopArea").schema("_Status string, StopAreaCode string, Name string, StopAreaType string, Location struct<Translation: struct<Longitude: double, Latitude: double>>").load(path)
    return s.where("StopAreaCode is not null").select(F.concat(F.lit("gb-stopgroup-"), "StopAreaCode").alias("group_id"), F.col("Name").alias("name"), F.col("StopAreaType").alias("type"), F.col("Location.Translation.Longitude").alias("lon"), F.col("Location.Translation.Latitude").alias("lat"), (F.coalesce("_Status", F.lit("active")) == "active").alias("active"))
