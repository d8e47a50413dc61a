
from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import calendar, geo, text, times
from tramline.plans.base import query, with_
from tramline.plans.lookups import hav


def rules(*items):
    return F.array(*[F.struct(F.lit(k).alias("type"), v.alias("value"), F.lit(None).cast("string").alias("description")) for k, v in items])


@query(with_("journeys", "SELECT journey_id, (dayname(day) = dayname(DATE '1998-03-02') OR day = DATE '1998-03-02') AND day <= DATE '2000-12-31' AND journey_id % 7 <> 0 AS runs FROM journeys"))
def fn_match_date(t):
    today = F.lit("1998-03-02").cast("date")
    empty = F.array().cast(calendar.RULES)
    # an upper end as a range with an open start, an exclusion only for some
    a = F.struct(
        rules(("DayOfWeek", F.date_format("day", "EEEE")), ("Date", F.col("day").cast("string"))).alias("match"),
        empty.alias("match_secondary"),
        rules(("DateRange", F.when(F.col("day") <= F.lit("2000-12-31").cast("date"), F.lit(":2000-12-31")).otherwise("2001-01-01:"))).alias("condition"),
        F.when(F.col("journey_id") % 7 == 0, rules(("MatchAll", F.lit("")))).otherwise(empty).alias("exclude"),
    )
    return t.journeys().select("journey_id", calendar.match_date(a, today).alias("runs"))


@query(with_("journeys", "SELECT journey_id, DATE '1998-03-02' BETWEEN day AND day + 30 AS in_range FROM journeys"))
def fn_check_rule(t):
    value = F.concat(F.col("day").cast("string"), F.lit(":"), F.date_add("day", 30).cast("string"))
    rule = F.struct(F.lit("DateRange").alias("type"), value.alias("value"))
    return t.journeys().select("journey_id", calendar.check_rule(rule, F.lit("1998-03-02").cast("date")).alias("in_range"))


@query(with_("journeys", "SELECT journey_id, CAST(day AS TIMESTAMP) + to_seconds(start + 30000) AS at FROM journeys"))
def fn_service_time(t):
    return t.journeys().select("journey_id", times.on_date(F.col("day"), F.col("start") + 30000).alias("at"))


@query("SELECT event_id, greatest(0, CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-10 00:00:00') AS BIGINT)) AS s FROM events")
def fn_window_threshold(t):
    return t.events.select("event_id", times.window_threshold(F.lit("2024-01-10").cast("date"), F.col("ts")).alias("s"))


@query("SELECT e.event_id, CAST(d AS DATE) AS day FROM events e, generate_series(CAST(e.ts AS DATE) - 1, CAST(e.ts AS DATE) + 1, INTERVAL 1 DAY) g(d)")
def fn_rolling_dates(t):
    return t.events.select("event_id", F.explode(times.rolling_dates(F.col("ts").cast("date"), 1, 1)).alias("day"))


@query(with_("calls", "SELECT journey_id, idx, CASE WHEN idx % 5 = 0 THEN NULL ELSE dep END AS seconds FROM calls"))
def fn_gtfs_time(t):
    clock = F.when(F.col("idx") % 5 == 0, F.lit("7:61:00")).otherwise(times.format_clock(F.col("dep")))
    return t.calls().select("journey_id", "idx", times.parse_clock(clock).cast("long").alias("seconds"))


@query(with_("calls", "SELECT journey_id, idx, CASE WHEN dep < 36000 THEN '0' ELSE '' END || (dep // 3600) || ':' || lpad(CAST(dep // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(dep % 60 AS VARCHAR), 2, '0') AS clock FROM calls"))
def fn_gtfs_format(t):
    return t.calls().select("journey_id", "idx", times.format_clock(F.col("dep")).alias("clock"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 1 THEN 'Monday' END, CASE WHEN p_size % 3 = 1 THEN 'Tuesday' END, CASE WHEN p_size % 5 = 1 THEN 'Wednesday' END, CASE WHEN p_size > 20 THEN 'Sunday' END], lambda x: x IS NOT NULL), ',') AS days FROM part")
def fn_running_days(t):
    s = F.col("p_size")
    flag = lambda c: c.cast("int")
    days = calendar.running_days(flag(s % 2 == 1), flag(s % 3 == 1), flag(s % 5 == 1), F.lit(0), F.lit(0), F.lit(0), flag(s > 20))
    return t.part.select("p_partkey", F.array_join(days, ",").alias("days"))


@query("SELECT p_partkey, CAST(d AS BIGINT) AS dep FROM part, generate_series(CAST(p_size * 60 AS BIGINT), CAST(p_size * 60 + 1799 AS BIGINT), CAST(400 + p_partkey % 100 AS BIGINT)) g(d)")
def fn_frequency_expand(t):
    start = F.col("p_size").cast("long") * 60
    return t.part.select("p_partkey", F.explode(times.expand_frequency(start, start + 1800, 400 + F.col("p_partkey") % 100)).alias("dep"))


@query(with_("calls", "SELECT journey_id, idx, arr + 900 AS arr FROM calls"))
def fn_time_shift(t):
    return t.calls().select("journey_id", "idx", (F.col("arr") + 900).alias("arr"))


@query(with_("messages", "SELECT event_id, value > 50 AND kind <> 'error' AS delayed FROM messages"))
def fn_delayed(t):
    return t.messages().select("event_id", ((F.col("value") > 50) & (F.col("kind") != "error")).alias("delayed"))


@query(with_("journeys", "SELECT journey_id, CAST(isodow(day) - 1 AS INTEGER) AS weekday FROM journeys"))
def fn_weekday_mon0(t):
    return t.journeys().select("journey_id", times.monday_first(F.col("day")).alias("weekday"))


@query(with_("journeys", "SELECT j.journey_id, CAST(d AS DATE) AS day FROM journeys j, generate_series(j.day, j.day + 6, INTERVAL 1 DAY) g(d) WHERE isodow(CAST(d AS DATE)) IN (1, 6)"))
def fn_vstp_dates(t):
    days = F.filter(F.sequence("day", F.date_add("day", 6)), lambda d: F.weekday(d).isin(0, 5))
    return t.journeys().select("journey_id", F.explode(days).alias("day"))


@query("SELECT event_id, CAST(86400 - (epoch(date_trunc('second', ts)) - epoch(date_trunc('day', ts))) AS BIGINT) AS left_s FROM events")
def fn_until_next_day(t):
    return t.events.select("event_id", (86400 - times.window_threshold(F.col("ts").cast("date"), F.col("ts"))).alias("left_s"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CAST(ts AS DATE) END AS day FROM events")
def fn_day_instance_date(t):
    name = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("DAYINSTANCEOF:"), F.col("ts").cast("date").cast("string"), F.lit(":j"))).otherwise("j1")
    return t.events.select("event_id", text.day_instance(name)[0].alias("day"))


@query("SELECT c_custkey, 'CUSTOMER#' || substr(c_name, 10) AS key FROM customer")
def fn_same_service_name(t):
    return t.customer.select("c_custkey", text.service_key(F.concat(F.lit(" cust-"), F.lit("omer #"), F.substring("c_name", 10, 20))).alias("key"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_brand || 'SmallBox', '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), 'x', 'x') AS words FROM part")
def fn_camel_split(t):
    return t.part.select("p_partkey", text.camel_words(F.concat("p_brand", F.lit("SmallBox"))).alias("words"))


@query("SELECT p_partkey, substr(p_name, 1, 5) AS short FROM part")
def fn_trim_len(t):
    return t.part.select("p_partkey", text.trimmed(F.col("p_name"), 5).alias("short"))


@query("SELECT p_partkey, CASE WHEN r IN (0, 5, 11) THEN 'Tram' WHEN r = 1 THEN 'Metro' WHEN r IN (2, 12) THEN 'Rail' WHEN r = 3 THEN 'Bus' WHEN r = 4 THEN 'Ferry' WHEN r IN (6, 7) THEN 'CableCar' WHEN r BETWEEN 100 AND 117 THEN 'Rail' WHEN r BETWEEN 200 AND 209 THEN 'Coach' WHEN r BETWEEN 400 AND 405 THEN 'Metro' WHEN r BETWEEN 700 AND 716 THEN 'Bus' WHEN r BETWEEN 900 AND 906 THEN 'Tram' WHEN r BETWEEN 1300 AND 1307 THEN 'CableCar' WHEN r BETWEEN 1500 AND 1507 THEN 'Taxi' ELSE 'Unknown' END AS kind FROM (SELECT p_partkey, p_partkey % 1600 AS r FROM part)")
def fn_transport_type(t):
    return t.part.select("p_partkey", text.transport_type(F.col("p_partkey") % 1600).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Recommended' WHEN 1 THEN 'Timed' WHEN 2 THEN 'MinimumTime' WHEN 3 THEN 'Forbidden' WHEN 4 THEN 'InSeat' WHEN 5 THEN 'InSeatForbidden' ELSE 'Unknown' END AS kind FROM part")
def fn_transfer_type(t):
    return t.part.select("p_partkey", text.transfer_type(F.col("p_partkey") % 8).alias("kind"))


@query("SELECT p.p_partkey, coalesce(n.n_name, p.p_name) AS name FROM part p LEFT JOIN nation n ON n.n_nationkey = p.p_partkey % 50")
def fn_translation(t):
    n = t.nation.select("n_nationkey", "n_name")
    return t.part.join(n, F.col("p_partkey") % 50 == F.col("n_nationkey"), "left").select("p_partkey", F.coalesce("n_name", "p_name").alias("name"))


@query("SELECT c_custkey, sha256(c_name || chr(31) || c_mktsegment || chr(31) || c_nationkey) AS id FROM customer")
def fn_operator_hash(t):
    return t.customer.select("c_custkey", text.hashed(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("id"))


@query(with_("journeys", "SELECT journey_id, CASE WHEN block = 0 THEN NULL WHEN service_id % 2 = 0 THEN 'dataset' || chr(31) || 'd' || chr(31) || block ELSE 'service' || chr(31) || service_id || chr(31) || block END AS key FROM journeys"))
def fn_block_key(t):
    block = F.when(F.col("block") != 0, F.col("block").cast("string"))
    return t.journeys().select("journey_id", text.block_key(F.when(F.col("service_id") % 2 == 0, "d"), F.col("service_id").cast("string"), block).alias("key"))


@query("SELECT event_id, coalesce(CASE WHEN user_id % 3 = 0 THEN event_type END, CASE WHEN user_id % 5 = 0 THEN 'stop ' || user_id END, 'See Vehicle') AS destination FROM events")
def fn_dest_fallback(t):
    u = F.col("user_id")
    return t.events.select("event_id", F.coalesce(F.when(u % 3 == 0, F.col("event_type")), F.when(u % 5 == 0, F.concat(F.lit("stop "), u.cast("string"))), F.lit("See Vehicle")).alias("destination"))


@query(with_("legs", "SELECT journey_id, idx, CASE WHEN idx % 2 = 0 THEN origin ELSE destination END AS shown FROM legs"))
def fn_board_dest(t):
    return t.legs().select("journey_id", "idx", F.when(F.col("idx") % 2 == 0, F.col("origin")).otherwise(F.col("destination")).alias("shown"))


@query("SELECT p_partkey, split_part('gb-' || p_brand, '-', 1) AS country FROM part")
def fn_country(t):
    return t.part.select("p_partkey", text.country(F.concat(F.lit("gb-"), "p_brand")).alias("country"))


def _pairs(t):
    s = t.stops().select("stop_id", "group_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = t.stops().select((F.col("stop_id") + 1).alias("stop_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return s.join(b, "stop_id")


NEXT = "stops a JOIN stops b ON a.stop_id = b.stop_id + 1"


def _distance(radius):
    return with_("stops", f"SELECT a.stop_id, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon', radius)}, 4) AS metres FROM {NEXT}")


@query(_distance(geo.EQUATOR_M))
def fn_haversine(t):
    return _pairs(t).select("stop_id", F.round(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 4).alias("metres"))


@query(_distance(geo.EQUATOR_M))
def fn_haversine_graph(t):
    return fn_haversine(t)


@query(_distance(geo.MEAN_M))
def fn_haversine_osm(t):
    return _pairs(t).select("stop_id", F.round(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), geo.MEAN_M), 4).alias("metres"))


@query(with_("stops", f"SELECT a.stop_id, round(sqrt(pow((b.lat - a.lat) * 111320.0, 2) + pow((b.lon - a.lon) * 111320.0 * cos(radians(a.lat)), 2)), 4) AS metres FROM {NEXT}"))
def fn_equirect(t):
    return _pairs(t).select("stop_id", F.round(geo.equirect(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 4).alias("metres"))


@query(with_("stops", "SELECT stop_id, CAST(floor(lat / 0.005) AS BIGINT) AS cy, CAST(floor(lon / 0.005) AS BIGINT) AS cx FROM stops"))
def fn_grid(t):
    return t.stops().select("stop_id", geo.cell(F.col("lat"), 0.005).alias("cy"), geo.cell(F.col("lon"), 0.005).alias("cx"))


@query(with_("stops", "SELECT CAST(floor(lat / 0.01) AS BIGINT) AS cy, CAST(floor(lon / 0.01) AS BIGINT) AS cx, count(*) AS n FROM stops GROUP BY 1, 2"))
def fn_cell(t):
    return t.stops().groupBy(geo.cell(F.col("lat"), 0.01).alias("cy"), geo.cell(F.col("lon"), 0.01).alias("cx")).agg(F.count("*").alias("n"))


SEG = "least(1.0, greatest(0.0, ((-0.5 - a.lon) * (b.lon - a.lon) + (50.5 - a.lat) * (b.lat - a.lat)) / ((b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat))))"


@query(with_("stops", f"SELECT a.stop_id, round({SEG}, 8) AS t FROM {NEXT}"))
def fn_project_segment(t):
    return _pairs(t).select("stop_id", F.round(geo.along(F.lit(-0.5), F.lit(50.5), F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 8).alias("t"))


@query(with_("stops", f"SELECT a.stop_id, round(sqrt(pow(-0.5 - (a.lon + {SEG} * (b.lon - a.lon)), 2) + pow(50.5 - (a.lat + {SEG} * (b.lat - a.lat)), 2)), 8) AS degrees FROM {NEXT}"))
def fn_line_distance(t):
    return _pairs(t).select("stop_id", F.round(geo.line_distance(F.lit(-0.5), F.lit(50.5), F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 8).alias("degrees"))


@query(with_("stops", f"SELECT a.group_id, round(sum({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 2) AS metres FROM {NEXT} GROUP BY 1"))
def fn_track_length(t):
    return _pairs(t).groupBy("group_id").agg(F.round(F.sum(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))), 2).alias("metres"))


@query(with_("stops", f"SELECT group_id, arg_min(stop_id, (d, stop_id)) AS stop_id FROM (SELECT a.group_id, a.stop_id, round(pow(-0.5 - (a.lon + {SEG} * (b.lon - a.lon)), 2) + pow(50.5 - (a.lat + {SEG} * (b.lat - a.lat)), 2), 10) AS d FROM {NEXT}) GROUP BY 1"))
def fn_track_match(t):
    d = geo.line_distance(F.lit(-0.5), F.lit(50.5), F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    rows = _pairs(t).select("group_id", "stop_id", F.round(d * d, 10).alias("d"))
    return rows.groupBy("group_id").agg(F.min(F.struct("d", "stop_id")).alias("m")).select("group_id", "m.stop_id")


@query(with_("stops", "SELECT stop_id, lat > 50.2 AND lat < 50.8 AND lon > -0.9 AND lon < -0.4 AS inside FROM stops"))
def fn_point_in_polygon(t):
    """Ray casting: edges of the ring that a ray to the east crosses, odd inside.  Test points lie on no edge."""
    ring = [(50.2, -0.9), (50.8, -0.9), (50.8, -0.4), (50.2, -0.4), (50.2, -0.9)]
    edges = F.array(*[F.struct(F.lit(a).alias("y1"), F.lit(b).alias("x1"), F.lit(c).alias("y2"), F.lit(d).alias("x2")) for (a, b), (c, d) in zip(ring, ring[1:], strict=False)])
    crossed = F.filter(edges, lambda e: ((e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat"))) & (F.col("lon") < (e["x2"] - e["x1"]) * (F.col("lat") - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"]))
    inner = (F.col("lat") != 50.2) & (F.col("lat") != 50.8) & (F.col("lon") != -0.9) & (F.col("lon") != -0.4)
    return t.stops().select("stop_id", (inner & (F.size(crossed) % 2 == 1)).alias("inside"))


@query(with_("stops", "SELECT group_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM stops GROUP BY 1"))
def fn_centroid(t):
    return t.stops().groupBy("group_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS priority FROM part")
def fn_transfer_priority(t):
    kind = F.when(F.col("p_partkey") % 3 == 0, "PlatformAlias").when(F.col("p_partkey") % 3 == 1, "SameStopGroup").otherwise("Nearby")
    return t.part.select("p_partkey", text.transfer_priority(kind).alias("priority"))


@query("SELECT p_partkey FROM part WHERE p_size * 4.0 <= 90")
def fn_valid_location(t):
    return t.part.where(geo.valid(F.col("p_size") * 4.0, F.lit(10.0))).select("p_partkey")


@query(with_("stops", "SELECT stop_id, 'stop-' || stop_id || ',' || name AS ids FROM stops"))
def fn_all_stop_ids(t):
    key = F.concat(F.lit("stop-"), F.col("stop_id").cast("string"))
    return t.stops().select("stop_id", F.array_join(text.distinct_strings(F.array(key, F.col("name"), key)), ",").alias("ids"))


@query(with_("calls", "SELECT journey_id, string_agg(CAST(stop_id AS VARCHAR), ',' ORDER BY idx) AS stops FROM calls GROUP BY journey_id HAVING count(*) > 1"))
def fn_journey_stops(t):
    l = t.legs().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", "origin", "destination"))).alias("l"))  # noqa: E741
    stops = F.concat(F.array(F.col("l")[0]["origin"]), F.transform("l", lambda x: x["destination"]))
    return l.select("journey_id", F.array_join(stops.cast("array<string>"), ",").alias("stops"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS mask FROM part")
def fn_pack_activities(t):
    acts = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "Pickup"), F.when(F.col("p_size") % 3 == 0, "Setdown")))
    return t.part.select("p_partkey", text.activity_mask(acts).alias("mask"))


@query(with_("calls", "SELECT journey_id, max(n) AS most FROM (SELECT journey_id, stop_id, count(*) AS n FROM calls GROUP BY 1, 2) GROUP BY 1"))
def fn_route_occurrence(t):
    return t.calls().groupBy("journey_id", "stop_id").agg(F.count("*").alias("n")).groupBy("journey_id").agg(F.max("n").alias("most"))


@query(with_("stops", "SELECT a.stop_id, count(*) AS near FROM stops a JOIN stops b ON a.stop_id <> b.stop_id AND sqrt(pow((b.lat - a.lat) * 111320.0, 2) + pow((b.lon - a.lon) * 111320.0 * cos(radians(a.lat)), 2)) <= 2500 GROUP BY 1"))
def fn_rail_nearest(t):
    p = t.stops().select(F.col("stop_id").alias("id"), "lat", "lon")
    return geo.neighbours(p, p, 2500.0).groupBy(F.col("from_id").alias("stop_id")).agg(F.count("*").alias("near"))


@query(with_("calls", "SELECT DISTINCT CAST(p.p_partkey AS BIGINT) AS p_partkey, regexp_extract(p_name, '^[a-z]') AS token FROM part p"), name="fn_split_trim")
def fn_split_trim(t):
    return t.part.select("p_partkey", F.substring(F.trim(F.split(F.concat(F.lit(" "), "p_name"), ",")[0]), 1, 1).alias("token")).distinct()


@query("SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P', '') AS passenger FROM orders")
def src_cif_passenger_filter(t):
    cat = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "XX").otherwise("EE")
    return t.orders.select("o_orderkey", text.passenger_journey(cat, F.when(F.col("o_orderstatus") == "P", "ZZ").otherwise("GW")).alias("passenger"))
