
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo, text
from tramline.operators import board, journeys
from tramline.operators.realtime import live
from tramline.plans.base import NOW, TODAY, Tables, query, with_

HAV = "2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
RUNS = "dayname(day) = dayname(DATE '1998-03-02')"


def hav(a: str, c: str, b: str, d: str, r: float = geo.EQUATOR_M) -> str:
    return HAV.format(a=a, b=b, c=c, d=d, r=r)


def alias(t: Tables) -> DataFrame:
    """(alias, stop_id): each stop's own key and its name."""
    s = t.stops()
    return s.select(F.concat(F.lit("stop-"), F.col("stop_id").cast("string")).alias("alias"), "stop_id").unionByName(s.select(F.col("name").alias("alias"), "stop_id"))


@query(with_("stops", "SELECT stop_id, name, group_id FROM stops WHERE name = 'Supplier#000000003' OR stop_id = 3"))
def q_stop(t):
    return alias(t).where(F.col("alias").isin("stop-3", "Supplier#000000003")).select("stop_id").distinct().join(t.stops(), "stop_id").select("stop_id", "name", "group_id")


@query(with_("stops", "SELECT n_nationkey AS group_id, n_name AS group_name, stop_id, name FROM nation JOIN stops ON group_id = n_nationkey WHERE n_nationkey = 7"))
def q_stop_group(t):
    n = t.nation.where("n_nationkey = 7").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name"))
    return n.join(t.stops(), "group_id").select("group_id", "group_name", "stop_id", "name")


@query("SELECT n_nationkey AS operator_id, n_name AS name FROM nation WHERE n_nationkey = 4 OR n_name = 'NATION_9'")
def q_operator(t):
    return t.nation.where("n_nationkey = 4 or n_name = 'NATION_9'").select(F.col("n_nationkey").alias("operator_id"), F.col("n_name").alias("name"))


@query("SELECT r_regionkey AS group_id, r_name AS name FROM region WHERE r_name = 'ASIA' OR r_regionkey = 1")
def q_operator_group(t):
    return t.region.where("r_name = 'ASIA' or r_regionkey = 1").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("name"))


@query(with_("services", "SELECT * FROM services WHERE service_id = 42"))
def q_service(t):
    return t.services().where("service_id = 42")


@query(with_("journeys", "SELECT * FROM journeys WHERE journey_id = 77"))
def q_journey(t):
    return t.journeys().where("journey_id = 77")


@query(with_("legs journeys services", "SELECT DISTINCT s.* FROM services s JOIN journeys j ON j.service_id = s.service_id JOIN legs l ON l.journey_id = j.journey_id WHERE l.origin IN (3, 5) OR l.destination IN (3, 5)"))
def q_services_by_stop(t):
    touched = t.legs().where(F.col("origin").isin(3, 5) | F.col("destination").isin(3, 5)).select("journey_id")
    ids = t.journeys().join(touched, "journey_id", "left_semi").select("service_id")
    return t.services().join(ids, "service_id", "left_semi")


ALERTS = "SELECT event_id AS alert_id, event_type AS type, user_id % 10 AS stop_id, 'text ' || (user_id % 3) AS body, ts AS valid_from, ts + INTERVAL 2 DAY AS valid_until FROM events"


def alerts(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("alert_id"), F.col("event_type").alias("type"), (F.col("user_id") % 10).alias("stop_id"), F.concat(F.lit("text "), (F.col("user_id") % 3).cast("string")).alias("body"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("interval 2 days")).alias("valid_until"))


def now(value: str = NOW):
    return F.lit(value).cast("timestamp_ntz")


@query(f"WITH a AS ({ALERTS}) SELECT alert_id, type, stop_id FROM a WHERE stop_id IN (2, 4) AND valid_from < TIMESTAMP '{NOW}' AND valid_until > TIMESTAMP '{NOW}'")
def q_alerts_for(t):
    return alerts(t).where(F.col("stop_id").isin(2, 4) & (F.col("valid_from") < now()) & (F.col("valid_until") > now())).select("alert_id", "type", "stop_id")


@query(f"WITH a AS ({ALERTS}) SELECT type, body, CAST(min(alert_id) AS BIGINT) AS alert_id FROM a GROUP BY type, body")
def q_alert_dedupe(t):
    # the first of each (type, body): an aggregate, as one text may be a third of all alerts
    return alerts(t).groupBy("type", "body").agg(F.min("alert_id").alias("alert_id"))


@query(f"WITH a AS ({ALERTS}) SELECT alert_id, valid_from < TIMESTAMP '{NOW}' AND valid_until > TIMESTAMP '{NOW}' AS valid FROM a")
def q_alert_valid(t):
    return alerts(t).select("alert_id", ((F.col("valid_from") < now()) & (F.col("valid_until") > now())).alias("valid"))


@query(with_("legs journeys", f"WITH a AS ({ALERTS}), ids AS (SELECT 3 AS id UNION SELECT DISTINCT j.service_id % 10 FROM journeys j JOIN legs l ON l.journey_id = j.journey_id WHERE l.origin = 3) SELECT alert_id, type FROM a WHERE stop_id IN (SELECT id FROM ids) AND type = 'error'"))
def q_stop_alerts(t):
    at = t.legs().where("origin = 3").select("journey_id")
    ids = t.journeys().join(at, "journey_id", "left_semi").select((F.col("service_id") % 10).alias("stop_id"))
    ids = ids.unionByName(t.spark.range(3, 4).select(F.col("id").alias("stop_id"))).distinct()
    return alerts(t).where("type = 'error'").join(ids, "stop_id", "left_semi").select("alert_id", "type")


CANCEL = "SELECT CASE WHEN user_id % 2 = 0 THEN 'DAYINSTANCEOF:' || CAST(CAST(ts AS DATE) AS VARCHAR) || ':' || event_id ELSE CAST(event_id AS VARCHAR) END AS identifier FROM events WHERE event_type = 'error'"


@query(f"WITH a AS ({CANCEL}) SELECT DISTINCT CAST(regexp_replace(identifier, '^DAYINSTANCEOF:[0-9-]+:', '') AS BIGINT) AS journey_id FROM a WHERE identifier NOT LIKE 'DAYINSTANCEOF:%' OR identifier LIKE 'DAYINSTANCEOF:2024-01-20:%'")
def q_cancelled_by_alert(t):
    e = t.events.where("event_type = 'error'")
    name = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("DAYINSTANCEOF:"), F.col("ts").cast("date").cast("string"), F.lit(":"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    day, journey = text.day_instance(F.col("identifier"))
    return e.select(name.alias("identifier")).where(day.isNull() | (day == F.lit("2024-01-20").cast("date"))).select(journey.cast("long").alias("journey_id")).distinct()


@query(with_("stops", "SELECT stop_id FROM stops WHERE lon BETWEEN -0.8 AND -0.3 AND lat BETWEEN 50.2 AND 50.7"))
def q_bounds(t):
    return t.stops().where(F.col("lon").between(-0.8, -0.3) & F.col("lat").between(50.2, 50.7)).select("stop_id")


@query(with_("stops", f"SELECT stop_id, round({hav('50.5', '-0.5', 'lat', 'lon')}, 3) AS metres FROM stops WHERE {hav('50.5', '-0.5', 'lat', 'lon')} <= 20000"))
def q_near(t):
    d = geo.haversine(F.lit(50.5), F.lit(-0.5), F.col("lat"), F.col("lon"))
    # a box first, so that a sorted or partitioned layout is pruned
    box = t.stops().where(F.col("lat").between(50.3, 50.7) & F.col("lon").between(-0.8, -0.2))
    return box.withColumn("m", d).where("m <= 20000").orderBy("m", "stop_id").select("stop_id", F.round("m", 3).alias("metres"))


@query(with_("services", "SELECT service_id, kind FROM services WHERE kind IN ('BUILDING', 'MACHINERY')"))
def q_transport_filter(t):
    wanted = text.distinct_strings(F.transform(F.split(F.lit("BUILDING, MACHINERY,,BUILDING"), ","), lambda x: F.trim(x)))
    return t.services().where(F.arrays_overlap(F.array("kind"), wanted)).select("service_id", "kind")


@query("SELECT DISTINCT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^| )wid') ORDER BY p_name, p_partkey LIMIT 10")
def q_stop_search(t):
    return t.part.where(F.lower("p_name").rlike("(^| )wid")).select("p_partkey", "p_name").distinct().orderBy("p_name", "p_partkey").limit(10)


@query("SELECT r_name AS region, n_name AS operator FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def q_operators_by_region(t):
    served = t.customer.select(F.col("c_nationkey").alias("n_nationkey"))
    return t.nation.join(served, "n_nationkey", "left_semi").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("operator")).orderBy("region", "operator")


@query(with_("services", "SELECT s.* FROM services s WHERE operator_id IN (2, 3)"))
def q_operator_services(t):
    return t.services().where(F.col("operator_id").isin(2, 3))


@query(with_("latest", f"SELECT vehicle, ts FROM latest WHERE k BETWEEN 20 AND 60 AND ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 4 HOUR"))
def q_realtime_bounds(t):
    return live(t.latest(), "2024-01-30 00:00:00", 240).where(F.col("k").between(20, 60)).select("vehicle", "ts")


@query(with_("latest", "SELECT vehicle, NOT (kind = 'error' OR (value < 150 AND k > 80)) AS active FROM latest"))
def q_realtime_active(t):
    # timed out, or close to the end and past it
    return t.latest().select("vehicle", (~((F.col("kind") == "error") | ((F.col("value") < 150) & (F.col("k") > 80)))).alias("active"))


@query(with_("latest", "SELECT vehicle, event_id, kind FROM latest WHERE vehicle IN (1, 5, 9) AND ts > TIMESTAMP '2024-01-29 00:00:00'"))
def q_realtime_for_journeys(t):
    return t.latest().where(F.col("vehicle").isin(1, 5, 9) & (F.col("ts") > now("2024-01-29 00:00:00"))).select("vehicle", "event_id", "kind")


@query(with_("latest", "SELECT vehicle, event_id FROM latest WHERE 'block-' || (vehicle % 7) = 'block-3'"))
def q_realtime_by_mapping(t):
    mapping = t.latest().select(F.concat(F.lit("block-"), (F.col("vehicle") % 7).cast("string")).alias("other_id"), "vehicle")
    return mapping.where("other_id = 'block-3'").join(t.latest(), "vehicle").select("vehicle", "event_id")


@query(with_("latest journeys", "SELECT j.journey_id, min(p.pos) AS pos FROM journeys j CROSS JOIN (VALUES (0), (1), (2)) p(pos) JOIN latest l ON l.vehicle = (j.journey_id * 3 + p.pos * 11) % 400 GROUP BY j.journey_id"))
def q_first_ref_wins(t):
    refs = t.journeys().select("journey_id", F.posexplode(F.array(*[(F.col("journey_id") * 3 + p * 11) % 400 for p in range(3)])).alias("pos", "vehicle"))
    return refs.join(t.latest().select("vehicle"), "vehicle").groupBy("journey_id").agg(F.min("pos").alias("pos"))


@query(with_("messages", "SELECT event_id FROM messages WHERE kind = 'signup' AND (k % 3 = 0 OR CAST(ts AS DATE) = DATE '2024-01-20')"))
def q_suppressed(t):
    dates = F.when(F.col("k") % 3 == 0, F.array().cast("array<date>")).otherwise(F.array(F.lit("2024-01-20").cast("date")))
    m = t.messages().where("kind = 'signup'").withColumn("dates", dates)
    return m.where((F.size("dates") == 0) | F.array_contains("dates", F.col("ts").cast("date"))).select("event_id")


@query("SELECT event_type AS dataset, max(ts) AS latest, CAST(arg_max(event_id, ts) AS BIGINT) AS event_id FROM events GROUP BY event_type")
def q_import_report(t):
    return t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.max("ts").alias("latest"), F.max_by("event_id", "ts").alias("event_id"))


@query("SELECT event_id, ts FROM events WHERE user_id = 8 AND event_type = 'purchase'", name="q_saved")
def q_saved(t):
    return t.events.where("user_id = 8 and event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").select("event_id", "ts")


@query("SELECT user_id, count(*) AS n, count(*) >= 10 AS over_quota FROM events WHERE event_type = 'signup' GROUP BY user_id", name="q_subs")
def q_subs(t):
    return t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("over_quota", F.col("n") >= 10)


@query(with_("journeys", "SELECT journey_id, start % 3600 = 0 OR service_id < 100 AS bad FROM journeys"))
def q_commute_validate(t):
    return t.journeys().select("journey_id", ((F.col("start") % 3600 == 0) | (F.col("service_id") < 100)).alias("bad"))


@query(with_("journeys services latest", "SELECT j.journey_id, s.name AS service, l.kind AS realtime FROM journeys j LEFT JOIN services s ON s.service_id = j.service_id LEFT JOIN latest l ON l.vehicle = j.journey_id % 400"))
def q_journey_detail(t):
    rt = t.latest().select(F.col("vehicle").alias("v"), F.col("kind").alias("realtime"))
    s = t.services().select("service_id", F.col("name").alias("service"))
    return t.journeys().join(s, "service_id", "left").join(rt, F.col("journey_id") % 400 == F.col("v"), "left").select("journey_id", "service", "realtime")


#: Columns that each view shows.
VIEWS = {"basic": ["service_id", "name"], "detailed": ["service_id", "name", "kind", "operator_id"]}


@query(with_("services", "SELECT service_id, name FROM services"))
def q_view(t):
    return t.services().select(*VIEWS["basic"])


@query(with_("messages", "SELECT vehicle, bool_or(kind = 'error') OR bool_or(k = 13) AS cancelled FROM messages GROUP BY vehicle"))
def q_api_cancel_flag(t):
    return t.messages().groupBy("vehicle").agg(F.bool_or((F.col("kind") == "error") | F.coalesce(F.col("k") == 13, F.lit(False))).alias("cancelled"))


@query(with_("calls", "SELECT journey_id, idx, idx % 3 = 1 AS unavailable FROM calls"))
def q_board_unavailable(t):
    acts = F.when(F.col("idx") % 3 == 1, F.array(F.lit("Setdown"))).when(F.col("idx") % 3 == 2, F.array(F.lit("Setdown"), F.lit("Pickup"))).otherwise(F.array(F.lit("Pickup")))
    return t.calls().select("journey_id", "idx", board.unavailable(acts).alias("unavailable"))


@query(with_("calls stops journeys", f"SELECT journey_id, service_id, stop_id, dep FROM (SELECT j.journey_id, j.service_id, c.stop_id, c.dep, row_number() OVER (PARTITION BY j.journey_id ORDER BY c.dep, c.idx, c.stop_id) AS rn FROM journeys j JOIN calls c ON c.journey_id = j.journey_id JOIN stops s ON s.stop_id = c.stop_id WHERE s.group_id IN (SELECT group_id FROM stops WHERE stop_id = 1) AND c.dep >= 30000 AND {RUNS}) WHERE rn = 1 ORDER BY dep, journey_id LIMIT 25"))
def top_board(t):
    """The flagship: journeys that run today, their first call at a group's stops from now on, in order of time."""
    rule = F.struct(F.lit("DayOfWeek").alias("type"), F.date_format("day", "EEEE").alias("value"), F.lit(None).cast("string").alias("description"))
    none = F.array().cast("array<struct<type: string, value: string, description: string>>")
    j = t.journeys().withColumn("availability", F.struct(F.array(rule).alias("match"), none.alias("match_secondary"), none.alias("condition"), none.alias("exclude")))
    group = t.stops().where("stop_id = 1").select("group_id")
    at = board.window(t.calls(), t.stops().join(F.broadcast(group), "group_id", "left_semi"), 30000)  # one row
    return board.running(j, TODAY).join(at, "journey_id").orderBy("dep", "journey_id").limit(25).select("journey_id", "service_id", "stop_id", "dep")


@query(with_("calls", "SELECT journey_id, min(dep) AS dep FROM calls WHERE stop_id IN (1, 2, 3) AND dep >= 40000 GROUP BY journey_id ORDER BY dep, journey_id LIMIT 50"))
def top_window(t):
    stops = t.spark.range(1, 4).select(F.col("id").alias("stop_id"))
    return board.window(t.calls(), stops, 40000).select("journey_id", "dep").orderBy("dep", "journey_id").limit(50)


@query(with_("calls", "SELECT journey_id, min(dep) AS dep FROM calls WHERE stop_id IN (4, 5) AND dep >= 20000 GROUP BY journey_id ORDER BY dep, journey_id LIMIT 20"))
def top_window_loaded(t):
    stops = t.spark.range(4, 6).select(F.col("id").alias("stop_id"))
    return board.window(t.calls(), stops, 20000).select("journey_id", "dep").orderBy("dep", "journey_id").limit(20)


@query(with_("calls", "SELECT stop_id, journey_id, dep FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY dep, journey_id, idx) AS rn FROM calls WHERE dep BETWEEN 30000 AND 60000) WHERE rn <= 3"))
def top_tfl_range(t):
    w = Window.partitionBy("stop_id").orderBy("dep", "journey_id", "idx")
    return t.calls().where(F.col("dep").between(30000, 60000)).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("stop_id", "journey_id", "dep")


@query(with_("calls", "SELECT journey_id, count(*) AS extra, min(stop_id) AS key FROM calls GROUP BY journey_id ORDER BY extra, key, journey_id LIMIT 30"))
def sort_routes(t):
    return t.calls().groupBy("journey_id").agg(F.count("*").alias("extra"), F.min("stop_id").alias("key")).orderBy("extra", "key", "journey_id").limit(30)


@query(with_("calls", "SELECT journey_id, string_agg(CAST(stop_id AS VARCHAR), '>' ORDER BY arr, stop_id) AS stops FROM calls GROUP BY journey_id"))
def sort_stops_rt(t):
    got = t.calls().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("arr", "stop_id"))).alias("p"))
    return got.select("journey_id", F.array_join(F.transform("p", lambda x: x["stop_id"].cast("string")), ">").alias("stops"))


@query(with_("calls", "SELECT stop_id, journey_id, idx, dep, row_number() OVER (PARTITION BY stop_id ORDER BY dep, journey_id, idx) AS place FROM calls"))
def sort_buckets(t):
    return t.calls().select("stop_id", "journey_id", "idx", "dep", F.row_number().over(Window.partitionBy("stop_id").orderBy("dep", "journey_id", "idx")).cast("long").alias("place"))


@query(with_("journeys", "SELECT journey_id, start AS start_s, start + journey_id % 5000 AS arrival_s FROM journeys ORDER BY start_s, arrival_s, journey_id LIMIT 40"))
def sort_plans_graph(t):
    return t.journeys().select("journey_id", F.col("start").alias("start_s"), (F.col("start") + F.col("journey_id") % 5000).alias("arrival_s")).orderBy("start_s", "arrival_s", "journey_id").limit(40)


@query(with_("journeys", "SELECT journey_id, start AS start_s, start + journey_id % 5000 AS arrival_s FROM journeys ORDER BY arrival_s, start_s, journey_id LIMIT 40"))
def sort_plans_api(t):
    return t.journeys().select("journey_id", F.col("start").alias("start_s"), (F.col("start") + F.col("journey_id") % 5000).alias("arrival_s")).orderBy("arrival_s", "start_s", "journey_id").limit(40)


@query(with_("calls", "SELECT journey_id, stop_id, idx, row_number() OVER (PARTITION BY journey_id, stop_id ORDER BY idx) AS visit FROM calls"))
def w_stop_visit(t):
    return journeys.stop_visits(t.calls()).select("journey_id", "stop_id", "idx", F.col("visit").cast("long").alias("visit"))
