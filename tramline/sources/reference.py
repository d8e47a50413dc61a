"""Reference data and alerts in XML: operators, train companies, situations, TransXChange journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions import calendar, times

#: Region columns of the operator code tables.
REGIONS = {"LO": "London", "SW": "SouthWest", "WM": "WestMidlands", "WA": "Wales", "YO": "Yorkshire", "NW": "NorthWest", "NE": "NorthEast", "SC": "Scotland", "SE": "SouthEast", "EA": "EastAnglia", "EM": "EastMidlands", "NI": "NorthernIreland"}
WEEK = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: Names of groups of days; the misspelt one is in use.
DAY_GROUPS = {"MondayToFriday": WEEK[:5], "MondayToSaturday": WEEK[:6], "MondayToSatuday": WEEK[:6], "MondayToSunday": WEEK, "Weekend": WEEK[5:]}


def xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def filled(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def noc_operators(spark: SparkSession, path: str) -> DataFrame:
    """Operators of the national code list: five record tables joined by their ids, region flags as an array."""
    table = xml(spark, path, "NOCTableRecord", "NOCCODE string, OperatorPublicName string, VOSA_PSVLicenseName string, OpId string, PubNmId string")
    lines = xml(spark, path, "NOCLinesRecord", "NOCCODE string, PubNm string, RefNm string, Licence string, Mode string, " + ", ".join(f"{k} string" for k in REGIONS))
    owners = xml(spark, path, "OperatorsRecord", "OpId string, OpNm string, ManDivId string")
    divisions = xml(spark, path, "ManagementDivisionsRecord", "ManDivId string, ManDivNm string, GpId string")
    public = xml(spark, path, "PublicNameRecord", "PubNmId string, Website string, Twitter string, Facebook string")
    region = F.array_compact(F.array(*[F.when(filled(k).isNotNull(), F.lit(name)) for k, name in REGIONS.items()]))
    # a code may have several lines: the regions of all of them
    lines = lines.groupBy("NOCCODE").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(region)))).alias("regions"), F.min("Mode").alias("mode"))
    got = table.join(lines, "NOCCODE", "left").join(owners, "OpId", "left").join(divisions, "ManDivId", "left").join(public, "PubNmId", "left")
    code = F.concat(F.lit("gb-noc-"), "NOCCODE")
    names = F.array_compact(F.array(filled("VOSA_PSVLicenseName"), filled("OpNm")))
    return got.select(code.alias("operator_id"), F.array(code).alias("other_ids"), F.col("OperatorPublicName").alias("name"), F.array_distinct(names).alias("other_names"), F.when(filled("GpId").isNotNull(), F.concat(F.lit("gb-nocgroup-"), "GpId")).alias("group_id"), F.coalesce("regions", F.array().cast("array<string>")).alias("regions"), F.regexp_extract(F.coalesce("Website", F.lit("")), r"(https?://[^#\s]+)", 1).alias("website"), "mode")


def noc_groups(spark: SparkSession, path: str) -> DataFrame:
    return xml(spark, path, "GroupsRecord", "GpId string, GpNme string").select(F.concat(F.lit("gb-nocgroup-"), "GpId").alias("group_id"), F.col("GpNme").alias("name"))


def train_companies(spark: SparkSession, path: str) -> DataFrame:
    """Train companies as operators; each is a service of the same id as well."""
    c = xml(spark, path, "TrainOperatingCompany", "AtocCode string, Name string, LegalName string, CompanyWebsite string, CustomerService struct<EmailAddress: string, PostalAddress: struct<Line: array<string>, PostCode: string>>")
    address = F.concat_ws(", ", F.concat_ws(", ", "CustomerService.PostalAddress.Line"), "CustomerService.PostalAddress.PostCode")
    return c.select(F.concat(F.lit("gb-toc-"), "AtocCode").alias("operator_id"), F.col("Name").alias("name"), F.col("LegalName").alias("legal_name"), F.col("CompanyWebsite").alias("website"), F.col("CustomerService.EmailAddress").alias("email"), address.alias("address"))


def siri_sx(spark: SparkSession, path: str, dataset: str, now: str, as_written: bool = False) -> DataFrame:
    """Situations as alerts, with what they concern: (line, operator) or a stop.

    Ended situations are dropped and open ones kept; with ``as_written`` those
    without a readable end are dropped and ended ones kept.
    """
    affects = "struct<Networks: struct<AffectedNetwork: array<struct<AffectedLine: array<struct<AffectedOperator: struct<OperatorRef: string>, LineRef: string, PublishedLineRef: string>>>>>, StopPoints: struct<AffectedStopPoint: array<struct<StopPointRef: string>>>>"
    s = xml(spark, path, "PtSituationElement", f"SituationNumber string, VersionedAtTime string, ValidityPeriod struct<StartTime: string, EndTime: string>, Summary string, Description string, Consequences struct<Consequence: array<struct<Severity: string, Affects: {affects}>>>")
    first, last = F.col("ValidityPeriod.StartTime").try_cast("timestamp"), F.col("ValidityPeriod.EndTime").try_cast("timestamp")
    held = last.isNotNull() if as_written else last.isNull() | (last >= F.lit(now).cast("timestamp"))
    each = F.coalesce("Consequences.Consequence", F.array().cast(f"array<struct<Severity: string, Affects: {affects}>>"))
    none_l, none_s = F.array().cast("array<struct<AffectedOperator: struct<OperatorRef: string>, LineRef: string, PublishedLineRef: string>>"), F.array().cast("array<struct<StopPointRef: string>>")
    nets = F.flatten(F.transform(each, lambda x: F.flatten(F.transform(F.coalesce(x["Affects"]["Networks"]["AffectedNetwork"], F.array().cast("array<struct<AffectedLine: array<struct<AffectedOperator: struct<OperatorRef: string>, LineRef: string, PublishedLineRef: string>>>>")), lambda n: F.coalesce(n["AffectedLine"], none_l)))))
    stops = F.flatten(F.transform(each, lambda x: F.coalesce(x["Affects"]["StopPoints"]["AffectedStopPoint"], none_s)))
    lines = F.transform(nets, lambda x: F.struct(F.coalesce(x["LineRef"], x["PublishedLineRef"]).alias("line"), x["AffectedOperator"]["OperatorRef"].alias("operator"), F.lit(None).cast("string").alias("stop")))
    places = F.transform(stops, lambda x: F.struct(F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("operator"), x["StopPointRef"].alias("stop")))
    kind = F.when(F.element_at(F.concat(F.transform(each, lambda x: F.coalesce(x["Severity"], F.lit(""))), F.array(F.lit(""))), 1) == "severe", "Warning").otherwise("Information")
    # an opaque id: equal alerts of a dataset have equal ones
    key = F.concat_ws("-", F.lit(dataset), F.lit("servicealert"), F.unix_micros(first).cast("string"), F.unix_micros(last).cast("string"), F.hex(F.xxhash64(kind, F.col("Summary"), F.col("Description"))))
    return s.where(held).select(key.alias("alert_id"), kind.alias("type"), F.col("Summary").alias("title"), F.col("Description").alias("text"), first.alias("valid_from"), last.alias("valid_until"), F.concat(lines, places).alias("concerns"))


def txc_availability(days: Column, operate: Column, rest: Column, first: Column, last: Column) -> Column:
    """A calendar from day names, date ranges of extra and missing days (each "from:to") and the period of the service.

    Names that are not days, or groups of days, match nothing; without a day
    name a journey runs on its extra days only.
    """
    rule = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(None).cast("string").alias("description"))
    names = F.create_map(*[x for k, v in {**{d: (d,) for d in WEEK}, **DAY_GROUPS}.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none, empty = F.array().cast(calendar.RULES), F.array().cast("array<string>")
    week = F.array_distinct(F.flatten(F.transform(F.coalesce(days, empty), lambda d: F.coalesce(names[d], empty))))
    extra = F.transform(F.coalesce(operate, empty), lambda r: rule("DateRange", r))
    period = F.array(rule("DateRange", F.concat_ws(":", F.coalesce(first.cast("string"), F.lit("")), F.coalesce(last.cast("string"), F.lit("")))))
    return F.struct(F.concat(F.transform(week, lambda d: rule("DayOfWeek", d)), extra).alias("match"), none.alias("match_secondary"), period.alias("condition"), F.transform(F.coalesce(rest, empty), lambda r: rule("DateRange", r)).alias("exclude"))


def seconds_of(duration: Column) -> Column:
    """Seconds of an ISO 8601 duration of hours, minutes and seconds; 0 where there is none."""
    part = lambda u: F.coalesce(F.regexp_extract(duration, rf"(\d+){u}", 1).try_cast("int"), F.lit(0))
    return F.coalesce(part("H") * 3600 + part("M") * 60 + part("S"), F.lit(0))


def txc_calls(links: DataFrame, journeys: DataFrame) -> DataFrame:
    """Calls of journeys from the timed links of their pattern.

    links: (pattern_id, seq, from_stop, to_stop, run, from_wait, to_wait), durations
    as text; journeys: (journey_id, pattern_id, departure).  Run and wait times add
    up along the pattern, so a pattern is summed once, however many journeys use it.
    """
    w = Window.partitionBy("pattern_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the wait at a stop is that of the link that leads to it and of the one that leaves it
    wait = seconds_of(F.col("to_wait")) + F.coalesce(F.lead(seconds_of(F.col("from_wait"))).over(w), F.lit(0))
    timed = links.withColumns({"go": seconds_of(F.col("run")), "stay": wait, "at_start": F.when(F.row_number().over(w) == 1, seconds_of(F.col("from_wait"))).otherwise(0)})
    timed = timed.withColumn("left", F.sum(F.col("go") + F.col("stay") + F.col("at_start")).over(upto))
    n = F.row_number().over(w)
    ends = timed.select("pattern_id", (n + 1).alias("idx"), F.col("to_stop").alias("stop_id"), (F.col("left") - F.col("stay")).alias("arr_off"), F.col("left").alias("dep_off"))
    starts = timed.withColumn("n", n).where("n = 1").select("pattern_id", F.lit(1).alias("idx"), F.col("from_stop").alias("stop_id"), F.lit(0).cast("long").alias("arr_off"), F.col("at_start").cast("long").alias("dep_off"))
    start = times.parse_clock(F.col("departure"))
    return journeys.join(starts.unionByName(ends), "pattern_id").select("journey_id", "idx", "stop_id", (start + F.col("arr_off")).alias("arr"), (start + F.col("dep_off")).alias("dep"))


def insert_records(table: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records from configuration take the place of those with the same key."""
    return table.join(records.select(key), key, "left_anti").unionByName(records, allowMissingColumns=True)
