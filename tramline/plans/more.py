"""Further queries: transforms, sinks, codes, realtime sinks, tracks, planner steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.functions import geo, text, times
from tramline.operators import board, planner, tracks, transfers
from tramline.operators.journeys import best_row
from tramline.operators.linking import identifier_groups
from tramline.operators.realtime import latest_state
from tramline.operators.transform import apply_rules
from tramline.plans.base import query, with_
from tramline.plans.joins import FLAT, records

RULES = [
    {"Group": "g", "Match": {"kind": "BUILDING"}, "Data": {"name": "builders", "kind": "works"}},
    {"Group": "g", "Match": {"operator_id": 3, "kind": "works"}, "Data": {"name": "third"}},
    {"Group": "other", "Match": {}, "Data": {"name": "never"}},
    {"Group": "g", "Match": {"nothing": "x"}, "Data": {"name": "never"}},
]


@query(with_("services", "SELECT service_id, CASE WHEN kind = 'BUILDING' AND operator_id = 3 THEN 'third' WHEN kind = 'BUILDING' THEN 'builders' ELSE name END AS name, CASE WHEN kind = 'BUILDING' THEN 'works' ELSE kind END AS kind FROM services"))
def udf_transform_yaml(t):
    return apply_rules(t.services(), RULES, "g").select("service_id", "name", "kind")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN p_type || ',added' ELSE p_type END AS tags FROM part")
def fn_transform_rule(t):
    p = t.part.select("p_partkey", "p_brand", F.array("p_type").alias("tags"))
    return apply_rules(p, [{"Match": {"p_brand": "Brand#2"}, "Data": {"tags": ["added"]}}]).select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Special ' || p_brand ELSE p_name END AS name FROM part")
def fn_display_name(t):
    names = F.when(F.col("p_size") % 4 == 0, F.create_map("p_type", F.concat(F.lit("Special "), "p_brand")))
    return t.part.select("p_partkey", F.coalesce(names[F.col("p_type")], F.col("p_name")).alias("name"))


@query("SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS class FROM part")
def fn_rail_class(t):
    return t.part.select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).alias("class"))


@query(with_("legs", "SELECT journey_id, string_agg(journey_id || '/' || origin || '/' || destination || '/' || dep, '|' ORDER BY idx) AS key FROM legs GROUP BY journey_id"))
def fn_plan_key(t):
    leg = F.concat_ws("/", *[F.col(c).cast("string") for c in ("journey_id", "origin", "destination", "dep")])
    got = t.legs().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", leg.alias("leg")))).alias("l"))
    return got.select("journey_id", F.array_join(F.transform("l", lambda x: x["leg"]), "|").alias("key"))


@query(with_("legs journeys", "WITH s AS (SELECT l.journey_id, string_agg(l.origin || '>' || l.destination, '|' ORDER BY idx) AS route FROM legs l GROUP BY l.journey_id) SELECT route, count(*) AS n FROM s GROUP BY route"))
def fn_plan_signature(t):
    pair = F.concat_ws(">", F.col("origin").cast("string"), F.col("destination").cast("string"))
    got = t.legs().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", pair.alias("p")))).alias("l"))
    return got.groupBy(F.array_join(F.transform("l", lambda x: x["p"]), "|").alias("route")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Pickup,Setdown' WHEN 1 THEN 'Pickup' WHEN 2 THEN 'Setdown' ELSE '' END AS activity FROM part")
def fn_cif_activity(t):
    """Two-letter codes in a row: T stops for both, U takes up, D sets down, others neither."""
    code = F.when(F.col("p_size") % 4 == 0, "T -A").when(F.col("p_size") % 4 == 1, "U ").when(F.col("p_size") % 4 == 2, "D -B").otherwise("-C")
    parts = F.transform(F.regexp_extract_all(F.rpad(code, 12, " "), F.lit("(..)")), lambda x: F.trim(x))
    both = F.array_contains(parts, "T")
    acts = F.array_compact(F.array(F.when(both | F.array_contains(parts, "U"), F.lit("Pickup")), F.when(both | F.array_contains(parts, "D"), F.lit("Setdown"))))
    return t.part.select("p_partkey", F.array_join(acts, ",").alias("activity"))


@query("SELECT p_partkey, substr(upper(p_name), 1, 7) AS tiploc FROM part WHERE length(p_name) >= 7 AND substr(p_name, 7, 1) <> ' '")
def fn_tiploc(t):
    p = t.part.where("length(p_name) >= 7 and substring(p_name, 7, 1) <> ' '")
    return p.select("p_partkey", F.trim(F.substring(F.upper("p_name"), 1, 7)).alias("tiploc"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS exact FROM part")
def fn_exact_times(t):
    value = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "1").otherwise("x")
    return t.part.select("p_partkey", F.when(value.isin("", "0"), False).when(value == "1", True).alias("exact"))


@query("SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS seconds FROM events")
def fn_service_seconds(t):
    return t.events.select("event_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("seconds"))


@query(with_("calls journeys", "SELECT c.journey_id, c.idx, CAST(j.day AS TIMESTAMP) + to_seconds(c.arr) AS at FROM calls c JOIN journeys j ON j.journey_id = c.journey_id"))
def fn_occurrence_time(t):
    return t.calls().join(t.journeys().select("journey_id", "day"), "journey_id").select("journey_id", "idx", times.on_date(F.col("day"), F.col("arr")).alias("at"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR + INTERVAL 15 MINUTE AS at FROM events")
def fn_commute_time(t):
    return t.events.select("event_id", times.on_date(F.col("ts").cast("date"), times.parse_clock(F.lit("08:15:00"))).alias("at"))


@query("SELECT event_id, make_timestamp(year(ts), month(ts), day(ts), user_id % 24, 30, 0.0) AS at FROM events")
def fn_add_time_to_date(t):
    return t.events.select("event_id", times.on_date(F.col("ts").cast("date"), (F.col("user_id") % 24) * 3600 + 1800).alias("at"))


@query("SELECT event_id, ts + INTERVAL 9 HOUR AS local FROM events")
def fn_tz_cache(t):
    return t.events.select("event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Tokyo").cast("timestamp_ntz").alias("local"))


@query("SELECT p_partkey, p_name AS text FROM part")
def fn_utf8_reader(t):
    """Bytes that are no UTF-8 are dropped."""
    raw = F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("FF")))
    return t.part.select("p_partkey", F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�", "").alias("text"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END AS tokens FROM part")
def fn_platform_tokens(t):
    said = F.concat(F.lit("Platform "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "a").otherwise(""))
    return t.part.select("p_partkey", F.array_join(text.platform_tokens(said), ",").alias("tokens"))


@query(with_("calls", "WITH f AS (SELECT journey_id, min(idx) AS a FROM calls WHERE stop_id = 3 GROUP BY journey_id) SELECT c.journey_id, CAST(min(c.idx) AS INTEGER) AS second FROM f JOIN calls c ON c.journey_id = f.journey_id AND c.idx > f.a AND c.stop_id = 5 GROUP BY 1"))
def fn_match_stops(t):
    """Journeys that call at stop 3 and later at 5, with the place of the later call."""
    p = t.calls().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", "stop_id"))).alias("p"))
    seen = F.transform("p", lambda x: x["stop_id"])
    at = text.match_stops(F.array(F.lit(3).cast("long"), F.lit(5).cast("long")), seen)
    return p.withColumn("at", at).where("at is not null").select("journey_id", F.col("p")[F.col("at")[1] - 1]["idx"].alias("second"))


@query(with_("calls", "SELECT journey_id, min(idx) AS idx FROM calls WHERE stop_id = journey_id % 10 GROUP BY journey_id HAVING count(*) = 1"))
def fn_stop_occurrence(t):
    """A record without an index stands for a stop that the journey calls at once."""
    c = t.calls().where("stop_id = journey_id % 10").groupBy("journey_id").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    return c.where("n = 1").select("journey_id", "idx")


@query(with_("calls", "SELECT journey_id * 16777216 + idx * 1048576 + dep % 1048576 AS packed FROM calls"))
def fn_pack_departure(t):
    return t.calls().select((F.col("journey_id") * (1 << 24) + F.col("idx") * (1 << 20) + F.col("dep") % (1 << 20)).alias("packed"))


@query(with_("calls", "SELECT journey_id, string_agg(CAST(stop_id AS VARCHAR), ',' ORDER BY CASE WHEN journey_id % 2 = 1 THEN -idx ELSE idx END) AS cars FROM calls GROUP BY 1"))
def fn_build_trains(t):
    got = t.calls().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", "stop_id"))).alias("p"))
    cars = F.transform("p", lambda x: x["stop_id"].cast("string"))
    return got.select("journey_id", F.array_join(F.when(F.col("journey_id") % 2 == 1, F.reverse(cars)).otherwise(cars), ",").alias("cars"))


@query("SELECT p_partkey, 'coach-1:' || (p_size % 3) || ',coach-2:' || (p_size % 5) AS carriages FROM part")
def fn_darwin_trains(t):
    coaches = F.array(F.struct(F.lit(1).alias("n"), (F.col("p_size") % 3).alias("load")), F.struct(F.lit(2).alias("n"), (F.col("p_size") % 5).alias("load")))
    return t.part.select("p_partkey", F.array_join(F.transform(coaches, lambda x: F.concat_ws(":", F.concat(F.lit("coach-"), x["n"].cast("string")), x["load"].cast("string"))), ",").alias("carriages"))


@query("SELECT event_id, sha256(event_type || chr(31) || user_id) AS id FROM events")
def fn_alert_hash(t):
    return t.events.select("event_id", text.hashed(F.col("event_type"), F.col("user_id")).alias("id"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS lon, CAST(p_size + 1 AS DOUBLE) AS lat FROM part")
def fn_decode_linestring(t):
    line = F.concat(F.lit("[[["), F.col("p_size").cast("string"), F.lit(".0,"), (F.col("p_size") + 1).cast("string"), F.lit(".0]]]"))
    got = t.part.select("p_partkey", F.from_json(line, "array<array<array<double>>>").alias("l"))
    return got.select("p_partkey", F.col("l")[0][0][0].alias("lon"), F.col("l")[0][0][1].alias("lat"))


@query(with_("calls stops", f"SELECT journey_id, arg_min(stop_id, (round(m, 6), stop_id)) AS stop_id FROM (SELECT c.journey_id, a.stop_id, {FLAT.replace('b.lat', '50.5').replace('b.lon', '-0.5')} AS m FROM calls c JOIN stops a ON a.stop_id = c.stop_id) GROUP BY 1"))
def fn_position_fallback(t):
    """Without geometry a vehicle is at the nearest call of its journey."""
    c = t.calls().join(t.stops().select("stop_id", "lat", "lon"), "stop_id")
    m = F.round(geo.equirect(F.col("lat"), F.col("lon"), F.lit(50.5), F.lit(-0.5)), 6)
    return c.groupBy("journey_id").agg(F.min(F.struct(m.alias("m"), "stop_id")).alias("b")).select("journey_id", "b.stop_id")


@query()
def fn_douglas_peucker(t):
    """Tracks of the stops of each group, simplified; tests hold it against the tolerance."""
    p = t.stops().groupBy(F.col("group_id").alias("track_id")).agg(F.sort_array(F.collect_list(F.struct("stop_id", "lon", "lat"))).alias("p"))
    return tracks.simplify(p.select("track_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points")), 20_000.0)


# lookups and identification
@query("SELECT p_type AS kind, count(*) AS n, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') GROUP BY 1")
def q_stop_detailed(t):
    return t.part.where(F.col("p_brand").isin("Brand#1", "Brand#3")).groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("inside"))


@query("SELECT r_name AS source, n_name AS dataset FROM region JOIN nation ON n_regionkey = r_regionkey")
def q_datasets(t):
    return t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("dataset"))


@query()
def j_linker_primary(t):
    """Records of the linked groups, with their rows."""
    return identifier_groups(records(t)).join(t.orders.select(F.col("o_orderkey").alias("record"), "o_totalprice"), "record")


@query(with_("legs", "SELECT DISTINCT a.journey_id, b.origin * 1000 + b.destination AS route FROM legs a JOIN legs b ON b.origin = a.origin AND b.destination = a.destination"))
def j_track_candidate(t):
    routes = t.legs().select("origin", "destination", (F.col("origin") * 1000 + F.col("destination")).alias("route")).distinct()
    return t.legs().join(routes, ["origin", "destination"]).select("journey_id", "route").distinct()


@query("SELECT c_custkey AS service_id, n_nationkey AS route FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT c_custkey, n_nationkey FROM customer JOIN nation ON n_nationkey = c_custkey % 25")
def j_track_service(t):
    n = t.nation.select(F.col("n_nationkey").alias("route"))
    a = t.customer.join(n, F.col("c_nationkey") == F.col("route")).select(F.col("c_custkey").alias("service_id"), "route")
    b = t.customer.join(n, F.col("c_custkey") % 25 == F.col("route")).select(F.col("c_custkey").alias("service_id"), "route")
    return a.unionByName(b).distinct()


ONE_SERVICE = "SELECT e.event_id, s.service_id FROM events e JOIN (SELECT {key} AS key, min(service_id) AS service_id FROM services GROUP BY 1 HAVING count(*) = 1) s ON s.key = {other}"


def _unique(t, key, other):
    one = t.services().groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("service_id").alias("service_id")).where("n = 1").select("key", "service_id")
    return t.events.select("event_id", other.alias("key")).join(one, "key").select("event_id", "service_id")


@query(with_("services", ONE_SERVICE.format(key="name", other="'Customer#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0')")))
def j_identify_gtfs_service(t):
    return _unique(t, F.col("name"), F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))


@query(with_("services", ONE_SERVICE.format(key="operator_id || '/' || name", other="(e.user_id % 25) || '/Customer#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0')")))
def j_identify_sirisx_service(t):
    return _unique(t, F.concat_ws("/", F.col("operator_id").cast("string"), "name"), F.concat((F.col("user_id") % 25).cast("string"), F.lit("/Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))


@query(with_("stops", "SELECT e.event_id, s.stop_id FROM events e JOIN stops s ON s.name = 'Supplier#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0')"))
def j_identify_sirisx_stop(t):
    s = t.stops().groupBy("name").agg(F.count("*").alias("n"), F.min("stop_id").alias("stop_id")).where("n = 1")
    return t.events.select("event_id", F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("name")).join(s, "name").select("event_id", "stop_id")


@query(with_("stops", f"SELECT from_id, to_id FROM (SELECT from_id, to_id, m, lead(m) OVER w AS second, row_number() OVER w AS rn FROM (SELECT a.stop_id AS from_id, b.stop_id AS to_id, {FLAT} AS m FROM stops a JOIN stops b ON a.stop_id <> b.stop_id AND {FLAT} <= 15000) WINDOW w AS (PARTITION BY from_id ORDER BY m, to_id)) WHERE rn = 1 AND (second IS NULL OR second - m >= 30)"))
def j_identify_location(t):
    """The nearest candidate, unless the next is less than 30 m farther."""
    p = t.stops().select(F.col("stop_id").alias("id"), "lat", "lon")
    w = Window.partitionBy("from_id").orderBy("distance_m", "to_id")
    got = geo.neighbours(p, p, 15000.0).select("from_id", "to_id", "distance_m", F.lead("distance_m").over(w).alias("second"), F.row_number().over(w).alias("rn"))
    return got.where("rn = 1 and (second is null or second - distance_m >= 30)").select("from_id", "to_id")


@query(with_("journeys latest services", "SELECT DISTINCT s.service_id, s.name FROM services s WHERE service_id IN (SELECT j.service_id FROM journeys j JOIN latest l ON l.vehicle = j.journey_id) OR service_id < 10"))
def j_tfl_services(t):
    live = t.journeys().join(t.latest().select(F.col("vehicle").alias("journey_id")), "journey_id", "left_semi").select("service_id")
    ids = live.unionByName(t.services().where("service_id < 10").select("service_id")).distinct()
    return t.services().join(ids, "service_id", "left_semi").select("service_id", "name")


@query("SELECT p_partkey, CAST(greatest(128, least(20000, 8 * p_partkey)) AS BIGINT) AS rows FROM part")
def top_candidate_limit(t):
    limit = F.greatest(F.lit(board.candidate_limit(0)), F.least(F.lit(board.candidate_limit(1 << 30)), 8 * F.col("p_partkey")))
    return t.part.select("p_partkey", limit.cast("long").alias("rows"))


@query(with_("calls", "SELECT journey_id, idx, stop_id FROM calls"))
def sort_external(t):
    return t.calls().repartition("journey_id").sortWithinPartitions("journey_id", "idx").select("journey_id", "idx", "stop_id")


# sinks as the rows they leave
@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM customer")
def sink_batch_upsert(t):
    """A batch upserted into a table: the newest row of each key."""
    old = t.customer.select(F.col("c_custkey").alias("id"), F.lit(0).alias("at"), F.lit("old").alias("version"))
    new = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("at"), F.lit("new").alias("version"))
    return latest_state(old.unionByName(new), "id", ["at"]).select("id", "version")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 20 <> 4 OR o_orderkey % 3 = 1")
def sink_generation_cleanup(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("dataset"), (F.col("o_orderkey") % 3).alias("generation"))
    return rows.where((F.col("dataset") != 4) | (F.col("generation") == 1)).select("id")


@query("SELECT s_suppkey, s_name FROM supplier")
def sink_collection_copy(t):
    return t.supplier.select("s_suppkey", "s_name")


@query("SELECT event_type AS dataset, max(ts) AS last_modified FROM events GROUP BY 1")
def sink_version_upsert(t):
    return t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.max("ts").alias("last_modified"))


@query(with_("latest", "SELECT vehicle, ts + INTERVAL 10 MINUTE AS expires, kind, k FROM latest"))
def sink_realtime_save(t):
    return t.latest().select("vehicle", (F.col("ts") + F.expr("interval 10 minutes")).alias("expires"), "kind", "k")


@query(with_("latest", "SELECT vehicle, k // 10 AS cell FROM latest"))
def sink_location(t):
    return t.latest().select("vehicle", F.floor(F.col("k") / 10).alias("cell"))


# realtime
@query(with_("messages", "SELECT kind, k % 10 AS id, max(event_id) AS last FROM messages WHERE kind IN ('error', 'signup') GROUP BY 1, 2"))
def st_alert_upsert(t):
    m = t.messages().where(F.col("kind").isin("error", "signup"))
    return m.groupBy("kind", (F.col("k") % 10).alias("id")).agg(F.max("event_id").alias("last"))


@query(with_("messages", "SELECT vehicle, arg_max(k, (ts, event_id)) AS k FROM messages WHERE kind IN ('view', 'click') GROUP BY 1"))
def st_location_only(t):
    return latest_state(t.messages().where(F.col("kind").isin("view", "click")), "vehicle", ["ts", "event_id"]).select("vehicle", "k")


@query(with_("messages", "SELECT event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 15 HOUR THEN lag(k) OVER w END AS progress FROM messages WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)"))
def st_history(t):
    w = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr("interval 15 hours")
    return t.messages().select("event_id", F.when(near, F.lag("k").over(w)).alias("progress"))


@query(with_("messages", "SELECT vehicle, kind, count(*) AS n, max(ts) AS last FROM messages GROUP BY 1, 2"))
def st_tfl_group(t):
    return t.messages().groupBy("vehicle", "kind").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query(with_("calls latest", "SELECT c.journey_id, c.idx, coalesce(l.kind = 'error' AND l.k % 7 = c.idx, FALSE) AS cancelled FROM calls c LEFT JOIN latest l ON l.vehicle = c.journey_id"))
def st_darwin_cancel(t):
    """A schedule snapshot: calls it does not cancel are not cancelled, whatever was said before."""
    lt = t.latest().select(F.col("vehicle").alias("journey_id"), "kind", "k")
    c = F.coalesce((F.col("kind") == "error") & (F.col("k") % 7 == F.col("idx")), F.lit(False))
    return t.calls().join(lt, "journey_id", "left").select("journey_id", "idx", c.alias("cancelled"))


@query(with_("messages", "SELECT vehicle, k % 4 AS carriage, arg_max(value, (ts, event_id)) AS loading FROM messages GROUP BY 1, 2"))
def st_rail_loading(t):
    return best_row(t.messages().withColumn("carriage", F.col("k") % 4), ["vehicle", "carriage"], [F.desc("ts"), F.desc("event_id")]).select("vehicle", "carriage", F.col("value").alias("loading"))


@query(with_("calls", "SELECT journey_id, min(idx) AS idx FROM calls WHERE stop_id % 10 = journey_id % 10 AND idx > journey_id % 3 GROUP BY 1"))
def st_trust_movement(t):
    """The first matching call that is not history yet."""
    return t.calls().where("stop_id % 10 = journey_id % 10 and idx > journey_id % 3").groupBy("journey_id").agg(F.min("idx").alias("idx"))


@query(with_("messages", "SELECT vehicle, event_id FROM messages WHERE kind = 'purchase' AND vehicle IN (SELECT vehicle FROM messages WHERE kind = 'error')"))
def st_trust_reinstate(t):
    gone = t.messages().where("kind = 'error'").select("vehicle")
    return t.messages().where("kind = 'purchase'").join(gone, "vehicle", "left_semi").select("vehicle", "event_id")


@query(with_("journeys", "SELECT b.journey_id, min(o.journey_id) AS overlay FROM journeys b JOIN journeys o ON o.block = b.block AND o.day = b.day AND o.kind = 'O' AND b.kind = 'F' GROUP BY 1"))
def st_vstp_overlay(t):
    o = t.journeys().where("kind = 'O'").groupBy("block", "day").agg(F.min("journey_id").alias("overlay"))
    return t.journeys().where("kind = 'F'").join(o, ["block", "day"]).select("journey_id", "overlay")


# planner and boards
@query(with_("stops calls", f"SELECT b.stop_id, CAST(ceil({FLAT} / 1.2) AS BIGINT) + 60 AS time FROM stops a JOIN stops b ON a.stop_id <> b.stop_id WHERE a.stop_id = 3 AND ({FLAT} <= 5000 OR (a.group_id = b.group_id AND {FLAT} <= 10000)) UNION ALL SELECT 3, 0"))
def pl_round(t):
    """The labels a search starts from: the origin, and stops in walking reach."""
    one = planner.start(planner.ends(t.calls(), 3), 0)
    walks = transfers.generate(t.stops(), 5000.0, None, 1.2, origins=one)
    return planner.seeds(one, walks).select("stop_id", "time")


@query(with_("calls", "SELECT stop_id, min(arr) AS time FROM calls GROUP BY 1"))
def pl_push(t):
    labels = t.calls().select("stop_id", F.col("arr").alias("time"), F.array("journey_id").alias("path"))
    return planner.undominated(labels).select("stop_id", "time")


@query(with_("calls", "SELECT max(a.dep) AS depart FROM calls a JOIN calls b ON a.journey_id = b.journey_id AND b.idx > a.idx WHERE a.stop_id = 3 AND b.stop_id = 9 AND b.arr <= 70000 HAVING max(a.dep) IS NOT NULL"))
def pl_arrive_by(t):
    """The last departure of one ride that arrives in time."""
    a = t.calls().where("stop_id = 3").select("journey_id", F.col("idx").alias("i"), "dep")
    b = t.calls().where("stop_id = 9 and arr <= 70000").select("journey_id", F.col("idx").alias("k"))
    return a.join(b, "journey_id").where("k > i").agg(F.max("dep").alias("depart")).where("depart is not null")


@query(with_("calls latest", "WITH r AS (SELECT c.journey_id, c.stop_id, c.dep + l.k AS time FROM calls c JOIN latest l ON l.vehicle = c.journey_id), m AS (SELECT stop_id, max(time) AS mark FROM r GROUP BY 1) SELECT journey_id, stop_id, time FROM r UNION ALL SELECT c.journey_id, c.stop_id, c.dep FROM calls c LEFT JOIN m ON m.stop_id = c.stop_id WHERE c.journey_id NOT IN (SELECT vehicle FROM latest) AND (m.mark IS NULL OR c.dep > m.mark)"))
def bd_tfl(t):
    """Realtime rows first; scheduled ones only after the last realtime row of their stop."""
    lt = t.latest().select(F.col("vehicle").alias("journey_id"), "k")
    rt = t.calls().join(lt, "journey_id").select("journey_id", "stop_id", (F.col("dep") + F.col("k")).alias("time"))
    mark = rt.groupBy("stop_id").agg(F.max("time").alias("mark"))
    rest = t.calls().join(lt, "journey_id", "left_anti").join(mark, "stop_id", "left").where("mark is null or dep > mark")
    return rt.unionByName(rest.select("journey_id", "stop_id", F.col("dep").alias("time")))


@query(with_("calls journeys", "WITH c AS (SELECT c.journey_id, j.service_id % 20 AS route, count(*) AS extra FROM calls c JOIN journeys j ON j.journey_id = c.journey_id GROUP BY 1, 2) SELECT journey_id, route FROM c"))
def lk_tracks(t):
    c = t.calls().groupBy("journey_id").agg(F.count("*").alias("extra")).join(t.journeys().select("journey_id", (F.col("service_id") % 20).alias("route")), "journey_id")
    return tracks.best_routes(c).select("journey_id", "route")


@query(with_("journeys", "SELECT journey_id, CASE WHEN service_id % 4 <> 0 THEN service_id END AS track FROM journeys"))
def lk_tracks_clear(t):
    return t.journeys().select("journey_id", F.when(F.col("service_id") % 4 != 0, F.col("service_id")).alias("track"))
