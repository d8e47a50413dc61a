"""Supporting operators: railway feeds, places, alerts, boards, tracks, and tables that are kept up to date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.operators import alerts, linking, places, railway
from tramline.plans.base import query, with_

SCHEDULES = "s AS (SELECT o_orderkey AS uid, CAST(o_orderdate AS DATE) AS d0, CASE o_orderpriority WHEN '1-URGENT' THEN '1111100' WHEN '2-HIGH' THEN '0000011' ELSE '1111111' END AS days FROM orders), e AS (SELECT uid, d0 + CAST(i AS INTEGER) AS d, d0 + 9 AS last, days FROM s, generate_series(0, 9) g(i) WHERE substr(days, isodow(d0 + CAST(i AS INTEGER)), 1) = '1')"


def schedules(t):
    days = F.when(F.col("o_orderpriority") == "1-URGENT", "1111100").when(F.col("o_orderpriority") == "2-HIGH", "0000011").otherwise("1111111")
    first = F.col("o_orderdate").cast("date")
    return t.orders.select(F.col("o_orderkey").alias("uid"), first.alias("first"), F.date_add(first, 9).alias("last"), days.alias("days"))


@query(f"WITH {SCHEDULES} SELECT uid, string_agg('DAYINSTANCEOF:' || d || ':' || uid, ',' ORDER BY d) AS identifiers FROM e GROUP BY uid")
def x_vstp_delete(t):
    return railway.deleted(schedules(t)).select("uid", F.array_join("identifiers", ",").alias("identifiers"))


@query(f"WITH {SCHEDULES} SELECT DISTINCT l_orderkey * 10 + l_linenumber AS journey_id, d AS date, CAST(last + 2 AS TIMESTAMP) AS until FROM e JOIN lineitem ON l_orderkey = uid AND CAST(l_shipdate AS DATE) = d WHERE CAST(last + 2 AS TIMESTAMP) > TIMESTAMP '1996-01-01 00:00:00'")
def x_vstp_cancel(t):
    runs = t.lineitem.select(F.col("l_orderkey").alias("uid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("journey_id"), F.col("l_shipdate").cast("date").alias("date"))
    return railway.cancelled(schedules(t), runs, "1996-01-01 00:00:00")


@query(with_("journeys", "WITH n AS (SELECT journey_id + 1000000000 AS journey_id, service_id, day, start + 60 AS start FROM journeys WHERE kind = 'P') SELECT journey_id, service_id, day, start FROM journeys UNION ALL SELECT * FROM n"))
def x_vstp_create(t):
    j = t.journeys().select("journey_id", "service_id", "day", "start")
    new = t.journeys().where("kind = 'P'").select((F.col("journey_id") + 1000000000).alias("journey_id"), "service_id", "day", (F.col("start") + 60).alias("start"))
    return j.join(new.select("journey_id"), "journey_id", "left_anti").unionByName(new)


@query(with_("messages journeys", "WITH a AS (SELECT vehicle, max_by({'u': k, 'd': CAST(ts AS DATE)}, {'t': ts, 'u': k, 'd': CAST(ts AS DATE)}) AS m FROM messages GROUP BY vehicle), j AS (SELECT journey_id % 97 AS uid, DATE '2024-01-01' + CAST(journey_id % 30 AS INTEGER) AS date, min(journey_id) AS journey_id FROM journeys GROUP BY ALL) SELECT vehicle AS train_id, uid, date, journey_id FROM a JOIN j ON m.u = uid AND m.d = date"))
def st_trust_activation(t):
    a = t.messages().select(F.col("vehicle").alias("train_id"), F.col("k").alias("uid"), F.col("ts").cast("date").alias("date"), "ts")
    j = t.journeys().select((F.col("journey_id") % 97).alias("uid"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("journey_id") % 30).cast("int")).alias("date"), "journey_id")
    return railway.activated(a, j).select("train_id", "uid", "date", "journey_id")


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 12 THEN substr(p_name, 1, 4) ELSE '' END AS headcode, CASE WHEN length(p_name) >= 12 THEN substr(p_name, 5, 6) ELSE '' END AS uid, CASE WHEN length(p_name) >= 12 THEN substr(p_name, 11, 2) ELSE '' END AS hour FROM part")
def x_linx_identifier(t):
    return t.part.select("p_partkey", railway.train_identifier(F.col("p_name")).alias("i")).select("p_partkey", "i.*")


@query("SELECT p_partkey, p_size % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 2 = 0 OR (p_partkey % 5 = 0 AND p_size > 0 AND p_size * 500 < 10000)) OR p_partkey % 11 = 0 AS power FROM part")
def x_power_car(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 11 == 0, "a power unit").when(k % 3 == 0, "loco").otherwise("coach")
    specific = F.when(k % 2 == 0, "pc").otherwise("x")
    return t.part.select("p_partkey", railway.power_car(kind, specific, size % 2, F.when(k % 5 == 0, "755/1").otherwise("800"), size * 500).alias("power"))


LOADED = "c AS (SELECT l_orderkey AS train, l_linenumber AS id, 'Buffet' AS role, CAST(min(l_quantity) AS BIGINT) AS occupancy FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), n AS (SELECT l_orderkey AS train, l_linenumber AS id, max_by(l_partkey % 101, l_partkey) AS new FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)"


def loaded(t):
    c = t.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("train"), F.col("l_linenumber").alias("id")).agg(F.lit("Buffet").alias("role"), F.min("l_quantity").cast("long").alias("occupancy"))
    n = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("train"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("seq"), (F.col("l_partkey") % 101).alias("occupancy"))
    return railway.merged_loading(c, n)


@query(f"WITH {LOADED} SELECT train, id, coalesce(role, 'Passenger') AS role, coalesce(new, occupancy) AS occupancy FROM c FULL JOIN n USING (train, id)")
def x_carriage_merge(t):
    return loaded(t)


@query(f"WITH {LOADED} SELECT train, count(*) AS carriages, CAST(sum(coalesce(new, occupancy)) AS BIGINT) // count(*) AS occupancy FROM c FULL JOIN n USING (train, id) GROUP BY train")
def x_darwin_loading(t):
    got = loaded(t).groupBy("train").agg(F.count("*").alias("carriages"), F.sum("occupancy").alias("s"))
    return got.select("train", "carriages", F.expr("s div carriages").alias("occupancy"))


@query("WITH c AS (SELECT l_orderkey AS train, count(*) FILTER (WHERE l_returnflag <> 'R') AS n, min(l_linenumber) FILTER (WHERE p_size % 3 > 0) AS first, arg_min(p_size % 3, l_linenumber * 1000000 + l_partkey) FILTER (WHERE p_size % 3 > 0) AS k, count(*) AS all_n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT o_orderkey AS train, CASE WHEN o_orderkey % 4 = 0 OR coalesce(n < all_n, FALSE) THEN coalesce(n, 0) ELSE o_orderkey % 4 END AS length, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'Given' END, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'Type' || (o_orderkey % 5) END, 'Type' || k) AS vehicle_type FROM orders LEFT JOIN c ON train = o_orderkey")
def x_rail_infer(t):
    k = F.col("o_orderkey")
    trains = t.orders.select(k.alias("train"), (k % 4).alias("length"), F.when(F.col("o_orderstatus") == "P", "Given").alias("given_type"), (k % 5).alias("fleet"))
    cars = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("train"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"), (F.col("p_size") % 3).cast("long").alias("class"), (F.col("l_returnflag") != "R").alias("counts"))
    classes = t.spark.range(1, 3).select(F.col("id").alias("class"), F.concat(F.lit("Type"), F.col("id").cast("string")).alias("vehicle_type"))
    return railway.inferred(trains, cars, classes)


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END, CASE WHEN p_size % 2 = 0 THEN p_name END, '00:00') AS timing FROM part")
def x_darwin_timing(t):
    """The first present of the four times, minutes of arrivals before others."""
    size = F.col("p_size")
    return t.part.select("p_partkey", F.coalesce(F.when(size % 5 == 0, F.col("p_brand")), F.when(size % 3 == 0, F.col("p_type")), F.when(size % 2 == 0, F.col("p_name")), F.lit("00:00")).alias("timing"))


@query("WITH v AS (SELECT s_suppkey, CAST(s_suppkey % 7 - 3 AS DOUBLE) AS tx, CAST(s_suppkey % 5 - 2 AS DOUBLE) AS ty, CAST(s_suppkey % 11 - 5 AS DOUBLE) AS dx, 1.0::DOUBLE AS dy, CAST(s_suppkey % 13 - 6 AS DOUBLE) * 4 AS px, CAST(s_suppkey % 3 - 1 AS DOUBLE) AS py, s_nationkey % 2 = 0 AS at_stop FROM supplier), w AS (SELECT *, tx * dx + ty * dy AS dot, sqrt(tx * tx + ty * ty) * sqrt(dx * dx + dy * dy) AS size, sqrt(px * px + py * py) AS away FROM v), x AS (SELECT *, CASE WHEN size > 0 THEN abs(dot) / size END AS al, (CASE WHEN dot < 0 THEN -1 ELSE 1 END) * (tx * py - ty * px) AS cr FROM w), y AS (SELECT *, coalesce(al >= 0.15::DOUBLE AND away >= 0.25::DOUBLE AND abs(cr) >= 0.01::DOUBLE AND (away <= 30 OR at_stop), FALSE) AS known FROM x) SELECT s_suppkey, CASE WHEN NOT known THEN 'Unknown' WHEN cr > 0 THEN 'Left' ELSE 'Right' END AS side, CASE WHEN known THEN round(least(0.98::DOUBLE, 0.72::DOUBLE + 0.2::DOUBLE * al), 2) END AS confidence FROM y")
def fn_door_side(t):
    k = F.col("s_suppkey")
    d = lambda c: c.cast("double")
    got = railway.door_side(d(k % 7 - 3), d(k % 5 - 2), d(k % 11 - 5), F.lit(1.0), d(k % 13 - 6) * 4, d(k % 3 - 1), F.col("s_nationkey") % 2 == 0)
    return t.supplier.select("s_suppkey", got.alias("g")).select("s_suppkey", "g.*")


@query("WITH s AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END - CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END - CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS score FROM part) SELECT p_partkey, score, CASE WHEN score >= 7 THEN 'Official' WHEN score >= 4 THEN 'Likely' WHEN score >= 0 THEN 'Nearby' ELSE 'Unrelated' END AS kind, CAST(CASE WHEN score >= 7 THEN 0.95 WHEN score >= 4 THEN 0.8 WHEN score >= 0 THEN 0.55 ELSE 0.2 END AS DOUBLE) AS confidence FROM s")
def q_osm_stop(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    got = places.parking(role=size % 2 == 0, station=size % 3 == 0, rail_operator=size % 5 == 0, nearby=size % 7 == 0, unrelated=k % 3 == 0, restricted=k % 2 == 0)
    return t.part.select("p_partkey", got.alias("g")).select("p_partkey", "g.*")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 5 = 0) OR p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def x_osm_other_area(t):
    m = t.lineitem.select(F.col("l_partkey").alias("element"), F.col("l_suppkey").alias("area"))
    area = t.supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("area"))
    return places.of_area(t.part.select(F.col("p_partkey").alias("element")), m, area).select(F.col("element").alias("p_partkey"))


@query(with_("calls", "WITH e AS (SELECT stop_id AS f, lead(stop_id) OVER (PARTITION BY journey_id ORDER BY idx) AS t, 1 + journey_id % 4 AS cost FROM calls) SELECT least(f, t) AS a, greatest(f, t) AS b, min(cost) AS cost FROM e WHERE t IS NOT NULL AND f <> t GROUP BY ALL"))
def x_osm_build_graph(t):
    return places.rail_edges(t.calls().select(F.col("journey_id").alias("way"), F.col("idx").alias("seq"), F.col("stop_id").alias("node"), (1 + F.col("journey_id") % 4).alias("cost")))


@query(with_("calls journeys", "SELECT DISTINCT string_agg(stop_id, '>' ORDER BY idx) AS route FROM calls JOIN journeys USING (journey_id) WHERE kind = 'F' GROUP BY journey_id"))
def x_osm_routes(t):
    got = t.calls().join(t.journeys().where("kind = 'F'").select("journey_id"), "journey_id").groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", "stop_id"))).alias("c"))
    return got.select(F.array_join(F.transform("c", lambda x: x["stop_id"].cast("string")), ">").alias("route")).distinct()


@query(with_("legs services journeys", "SELECT service_id, string_agg(origin || '-' || destination, ',' ORDER BY journey_id, idx) AS route FROM legs JOIN journeys USING (journey_id) GROUP BY service_id"))
def x_routes_load(t):
    """Legs of a service in order; the list is that of one route, so it is as long as the route."""
    legs = t.legs().join(t.journeys().select("journey_id", "service_id"), "journey_id")
    pair = F.concat_ws("-", F.col("origin").cast("string"), F.col("destination").cast("string"))
    got = legs.groupBy("service_id").agg(F.sort_array(F.collect_list(F.struct("journey_id", "idx", pair.alias("p")))).alias("l"))
    return got.select("service_id", F.array_join(F.transform("l", lambda x: x["p"]), ",").alias("route"))


@query(with_("calls", "SELECT journey_id, string_agg(stop_id, ',' ORDER BY idx) AS track FROM calls WHERE idx BETWEEN 2 AND 4 GROUP BY journey_id"))
def x_track_combine(t):
    """Points of the legs from the second to the fourth, one after another."""
    got = t.calls().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.array(F.col("stop_id").cast("string")).alias("points")))).alias("l"))
    parts = F.filter("l", lambda x: x["idx"].between(2, 4))
    return got.select("journey_id", F.array_join(F.flatten(F.transform(parts, lambda x: x["points"])), ",").alias("track")).where("track <> ''")


@query(with_("journeys", "SELECT service_id, max(CASE WHEN kind = 'O' THEN DATE '2024-01-01' ELSE day END) AS stamp FROM journeys GROUP BY service_id"))
def x_track_preserve(t):
    """Rows of routes that failed get the new stamp, so that a cleanup by generation keeps them."""
    stamp = F.when(F.col("kind") == "O", F.lit("2024-01-01").cast("date")).otherwise(F.col("day"))
    return t.journeys().groupBy("service_id").agg(F.max(stamp).alias("stamp"))


@query(with_("legs", "WITH n AS (SELECT origin, destination, min(arr - dep) AS total FROM legs WHERE journey_id % 2 = 0 GROUP BY ALL), o AS (SELECT origin, destination, max(arr - dep) AS total FROM legs WHERE journey_id % 3 = 0 GROUP BY ALL) SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (origin, destination) WHERE o.origin % 4 <> 0"))
def x_transfer_write(t):
    """New edges, and old ones of stops that did not change."""
    cost = F.col("arr") - F.col("dep")
    new = t.legs().where("journey_id % 2 = 0").groupBy("origin", "destination").agg(F.min(cost).alias("total"))
    old = t.legs().where("journey_id % 3 = 0").groupBy("origin", "destination").agg(F.max(cost).alias("total"))
    return new.unionByName(old.where("origin % 4 <> 0").join(new.select("origin", "destination"), ["origin", "destination"], "left_anti"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 1")
def x_transfer_load(t):
    """Stops that are active or do not say."""
    active = F.when(F.col("s_suppkey") % 3 == 0, True).when(F.col("s_suppkey") % 3 == 1, False)
    return t.supplier.where(F.coalesce(active, F.lit(True))).select("s_suppkey", "s_name")


@query(with_("stops calls journeys services", "SELECT s.stop_id, s.name, string_agg(DISTINCT v.service_id::VARCHAR, ',' ORDER BY v.service_id::VARCHAR) AS services FROM stops s LEFT JOIN calls c USING (stop_id) LEFT JOIN journeys j USING (journey_id) LEFT JOIN services v ON v.service_id = j.service_id AND v.kind = 'BUILDING' WHERE s.stop_id % 4 <> 0 GROUP BY ALL"))
def x_index_stops(t):
    slim = t.services().where("kind = 'BUILDING'").select("service_id")
    pairs = t.calls().select("stop_id", "journey_id").join(t.journeys().select("journey_id", "service_id"), "journey_id").join(slim, "service_id").select("stop_id", "service_id").distinct()
    each = pairs.groupBy("stop_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("service_id").cast("string"))), ",").alias("services"))
    return t.stops().where("stop_id % 4 <> 0").join(each, "stop_id", "left").select("stop_id", "name", "services")


@query("SELECT o_orderkey, c_name AS service, upper(n_name) AS operator FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def x_board_refs(t):
    """Services and operators of a board; each is transformed once before it is joined."""
    op = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("operator"))
    service = t.customer.join(op, "c_nationkey", "left").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("service"), "operator")
    return t.orders.where("o_orderstatus = 'P'").join(service, "o_custkey", "left").select("o_orderkey", "service", "operator")


@query(with_("legs", "SELECT journey_id, arg_min(destination, abs(dep - 43200) * 100 + idx) AS next_stop FROM legs WHERE origin % 3 = 0 GROUP BY journey_id"))
def x_board_direction(t):
    return t.legs().where("origin % 3 = 0").groupBy("journey_id").agg(F.min_by("destination", F.abs(F.col("dep") - 43200) * 100 + F.col("idx")).alias("next_stop"))


@query("WITH k AS (SELECT DISTINCT k FROM (SELECT l_partkey AS k FROM lineitem)), g AS (SELECT p_partkey + 7 AS k, min(s_suppkey) AS s FROM part JOIN supplier ON s_nationkey = p_size % 25 GROUP BY ALL), o AS (SELECT s_suppkey * 3 AS k, min(s_suppkey) AS s FROM supplier GROUP BY ALL) SELECT k.k AS ref, coalesce(p.s_suppkey, g.s, o.s) AS stop_id FROM k LEFT JOIN supplier p ON p.s_suppkey = k.k LEFT JOIN g ON g.k = k.k LEFT JOIN o ON o.k = k.k")
def x_tfl_stop_resolve(t):
    """By the stop's own id, else the first stop of a group that has the id as another name, else by other ids."""
    refs = t.lineitem.select(F.col("l_partkey").alias("ref")).distinct()
    own = t.supplier.select(F.col("s_suppkey").alias("ref"), F.col("s_suppkey").alias("own"))
    group = t.part.join(t.supplier, F.col("s_nationkey") == F.col("p_size") % 25).groupBy((F.col("p_partkey") + 7).alias("ref")).agg(F.min("s_suppkey").alias("of_group"))
    other = t.supplier.groupBy((F.col("s_suppkey") * 3).alias("ref")).agg(F.min("s_suppkey").alias("other"))
    return refs.join(own, "ref", "left").join(group, "ref", "left").join(other, "ref", "left").select("ref", F.coalesce("own", "of_group", "other").alias("stop_id"))


@query(with_("messages", "SELECT vehicle, k AS journey, max(event_id) AS trip FROM messages GROUP BY vehicle, k HAVING min(event_id) = max(event_id)"))
def x_bus_lookup(t):
    """Journeys of a vehicle that one trip alone is known for."""
    got = t.messages().groupBy("vehicle", F.col("k").alias("journey")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("trip"))
    return got.where("a = trip").select("vehicle", "journey", "trip")


@query(with_("messages", "SELECT m.event_id FROM messages m SEMI JOIN (SELECT vehicle, k FROM messages WHERE ts BETWEEN TIMESTAMP '2024-01-20 08:00:00' AND TIMESTAMP '2024-01-20 12:00:00') r ON m.vehicle = r.vehicle AND m.k = r.k"))
def x_tracker_filter(t):
    m = t.messages()
    recent = m.where("ts between timestamp_ntz'2024-01-20 08:00:00' and timestamp_ntz'2024-01-20 12:00:00'").select("vehicle", "k")
    return m.join(recent, ["vehicle", "k"], "left_semi").select("event_id")


@query(with_("legs stops", "SELECT l.journey_id, l.idx, s.name AS destination FROM legs l LEFT JOIN stops s ON s.stop_id = l.destination"))
def x_hydrate_dest(t):
    names = t.stops().select(F.col("stop_id").alias("destination"), "name")
    return t.legs().select("journey_id", "idx", "destination").join(names, "destination", "left").select("journey_id", "idx", F.col("name").alias("destination"))


@query(with_("messages", "SELECT event_id, CASE kind WHEN 'error' THEN 'StopClosed' WHEN 'signup' THEN 'Planned' ELSE 'Information' END AS type FROM messages WHERE k % 2 = 0"))
def x_tfl_disruptions(t):
    """Disruptions of a snapshot as alerts: closures, planned works, other information; what it lacks goes."""
    kind = F.when(F.col("kind") == "error", "StopClosed").when(F.col("kind") == "signup", "Planned").otherwise("Information")
    m = t.messages()
    return m.join(m.where("k % 2 = 0").select("event_id"), "event_id", "left_semi").select("event_id", kind.alias("type"))


@query(with_("messages", "SELECT event_id FROM messages WHERE kind = 'error' AND (k IS NULL OR k % 3 <> 0)"))
def x_snapshot_delete(t):
    """Alerts of a feed that its latest snapshot has no more."""
    mine = t.messages().where("kind = 'error'")
    return mine.join(mine.where("k % 3 = 0").select("event_id"), "event_id", "left_anti").select("event_id")


STATUSES = ("Good Service", "Minor Delays", "Severe Delays", "Service Closed", "Part Closure", "Reduced Service", "Diverted", "Lift out", "No Issues")


@query("WITH e AS (SELECT event_id, list_extract(['" + "','".join(STATUSES) + "'], CAST(event_id % 9 + 1 AS INTEGER)) AS status, event_id % 5 <> 0 AS valid, hour(ts) AS h FROM events) SELECT event_id, CASE status WHEN 'Minor Delays' THEN 'MinorDelays' WHEN 'Severe Delays' THEN 'SevereDelays' WHEN 'Service Closed' THEN 'ServiceSuspended' WHEN 'Part Closure' THEN 'ServicePartSuspended' WHEN 'Reduced Service' THEN 'Delays' WHEN 'Diverted' THEN 'Warning' ELSE 'Information' END AS type FROM e WHERE valid AND status NOT IN ('Good Service', 'No Issues') AND NOT (status = 'Service Closed' AND h BETWEEN 1 AND 3)")
def src_tfl_disruption(t):
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 9 + 1).cast("int"))
    got = t.events.select("event_id", alerts.line_alert(status, F.col("event_id") % 5 != 0, F.hour(F.col("ts").cast("timestamp"))).alias("type"))
    return got.where("type is not null")


REFS = "CASE WHEN p_size % 3 = 0 THEN 'journey' WHEN p_size % 3 = 1 THEN 'service' ELSE 'stop' END AS kind, p_brand AS identifier, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN '2024-01-0' || (1 + p_partkey % 9) END AS date FROM part WHERE p_partkey % 4 <> 0"


def references(t):
    size, k = F.col("p_size"), F.col("p_partkey")
    kind = F.when(size % 3 == 0, "journey").when(size % 3 == 1, "service").otherwise("stop")
    day = F.concat_ws(":", F.lit("DAYINSTANCEOF"), F.concat(F.lit("2024-01-0"), (1 + k % 9).cast("string")), "p_brand")
    named = F.when(k % 4 == 0, F.lit("nothing")).when((size % 3 == 0) & (size % 2 == 0), day).otherwise(F.col("p_brand"))
    refs = F.array(F.struct(F.lit("stop").alias("kind"), F.lit("none").alias("identifier")), F.struct(kind.alias("kind"), F.col("p_brand").alias("identifier")))
    got = t.part.select("p_partkey", alerts.alert_reference(F.array(F.lit("other"), named), refs).alias("r"))
    return got.where("r is not null").select("p_partkey", "r.*")


@query(f"SELECT p_partkey, {REFS}")
def x_alert_ref(t):
    return references(t)


@query(f"WITH r AS (SELECT p_partkey, {REFS}) SELECT p_partkey, '/' || kind || 's/' || replace(identifier, '#', '%23') || CASE WHEN date IS NULL THEN '' ELSE '?date=' || date END AS path FROM r")
def x_notif_url(t):
    return references(t).select("p_partkey", alerts.target_path(F.col("kind"), F.col("identifier"), F.col("date")).alias("path"))


@query(with_("legs journeys", "WITH a AS (SELECT service_id AS commute, count(DISTINCT journey_id) AS journeys, count(DISTINCT origin) AS platform_stops FROM legs JOIN journeys USING (journey_id) WHERE service_id % 10 = 0 GROUP BY ALL) SELECT commute, event_type, journeys, platform_stops FROM a, (SELECT unnest(['ServiceAlertCreated', 'RealtimeJourneyCancelled', 'RealtimeJourneyOverlayCreated', 'RealtimeJourneyDelayed', 'RealtimeJourneyPlatformSet', 'RealtimeJourneyPlatformChanged']) AS event_type)"))
def x_commute_subs(t):
    j = t.journeys().where("service_id % 10 = 0").select("journey_id", "service_id")
    legs = t.legs().join(j, "journey_id").select(F.col("service_id").alias("commute"), F.col("journey_id").alias("journey"), F.col("service_id").alias("service"), "origin", "destination")
    return alerts.commute_subscriptions(legs).select("commute", "event_type", F.size("journeys").cast("long").alias("journeys"), F.size("platform_stops").cast("long").alias("platform_stops"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_mktsegment = 'BUILDING')")
def x_sub_day(t):
    """Subscriptions for today: those without days, and those whose days hold it."""
    days = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("Sunday"), "c_mktsegment")).otherwise(F.array(F.lit("Monday")))
    return t.customer.where((F.size(days) == 0) | F.array_contains(days, "BUILDING")).select("c_custkey")


@query(with_("stops", "SELECT stop_id, (lon + lon + 0.5::DOUBLE) / 2 AS centre_lon, (lat + lat + 0.25::DOUBLE) / 2 AS centre_lat FROM stops"))
def x_rt_bounds_parse(t):
    """A box from its lower left and upper right corner to its centre."""
    return t.stops().select("stop_id", ((F.col("lon") + F.col("lon") + 0.5) / 2).alias("centre_lon"), ((F.col("lat") + F.col("lat") + 0.25) / 2).alias("centre_lat"))


@query(with_("journeys", "SELECT journey_id, day FROM journeys WHERE day BETWEEN DATE '1998-03-01' AND DATE '1998-03-03'"))
def x_compact_days(t):
    """Days of a graph outside the window go: one back, one ahead."""
    return t.journeys().where("day between date'1998-03-01' and date'1998-03-03'").select("journey_id", "day")


@query(with_("journeys calls", "SELECT journey_id, j.day, string_agg(stop_id || '@' || dep, ',' ORDER BY idx) AS path FROM journeys j JOIN calls c USING (journey_id) WHERE j.kind = 'P' GROUP BY ALL"))
def x_materialize_journey(t):
    part = F.concat_ws("@", F.col("stop_id").cast("string"), F.col("dep").cast("string"))
    j = t.journeys().where("kind = 'P'").select("journey_id", "day")
    got = t.calls().join(j, "journey_id").groupBy("journey_id", "day").agg(F.sort_array(F.collect_list(F.struct("idx", part.alias("p")))).alias("l"))
    return got.select("journey_id", "day", F.array_join(F.transform("l", lambda x: x["p"]), ",").alias("path"))


@query(with_("legs", "SELECT DISTINCT destination AS from_stop, origin AS to_stop FROM legs"))
def x_static_index(t):
    return t.legs().select(F.col("destination").alias("from_stop"), F.col("origin").alias("to_stop")).distinct()


@query(with_("calls journeys", "SELECT DISTINCT c.journey_id FROM calls c JOIN journeys j USING (journey_id) WHERE c.stop_id IN (1, 2, 3) AND j.day = DATE '1998-03-02'"))
def x_load_stop(t):
    at = t.calls().where("stop_id in (1, 2, 3)").select("journey_id")
    return t.journeys().where("day = date'1998-03-02'").select("journey_id").join(at, "journey_id", "left_semi")


@query("SELECT c_custkey, n_name AS place FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0")
def x_saved_create(t):
    """What is saved must resolve and pass its checks."""
    places_ = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    return t.customer.where("c_acctbal > 0").join(places_, "c_nationkey").select("c_custkey", "place")


@query(with_("messages", "WITH w AS (SELECT *, CAST(round(value / 10) * 10 AS BIGINT) AS o, row_number() OVER (PARTITION BY vehicle ORDER BY ts DESC, event_id DESC) AS rn FROM messages) SELECT vehicle, event_id, CASE WHEN abs(o) <= 45 THEN 0 ELSE o END AS delay FROM w WHERE rn = 1"))
def st_update_journey(t):
    """Delay of each vehicle's last message, to ten seconds; up to 45 it counts as none."""
    tens = (F.round(F.col("value") / 10) * 10).cast("long")
    return t.latest().select("vehicle", "event_id", F.when(F.abs(tens) <= 45, F.lit(0).cast("long")).otherwise(tens).alias("delay"))


@query(with_("messages", "SELECT vehicle, max(ts) AS seen FROM messages WHERE kind <> 'error' GROUP BY vehicle HAVING max(ts) >= TIMESTAMP '2024-01-20 10:30:00' AND max(ts) <= TIMESTAMP '2024-02-20 12:00:00'"))
def st_store_mapping(t):
    """Mappings of vehicles that the last 90 minutes or later messages renewed."""
    seen = t.messages().where("kind <> 'error'").groupBy("vehicle").agg(F.max("ts").alias("seen"))
    return seen.where("seen between timestamp_ntz'2024-01-20 10:30:00' and timestamp_ntz'2024-02-20 12:00:00'")


@query(with_("journeys", "SELECT DISTINCT day FROM journeys WHERE day BETWEEN DATE '1998-02-20' AND DATE '1998-03-10' AND day NOT IN (SELECT day FROM journeys WHERE journey_id % 5 = 0)"))
def st_graph_refresh(t):
    """Days of the window that the graph does not hold yet."""
    j = t.journeys().where("day between date'1998-02-20' and date'1998-03-10'")
    return j.select("day").distinct().join(j.where("journey_id % 5 = 0").select("day"), "day", "left_anti")


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'fleet' ELSE 'rest' END AS kind, count(*) AS n, CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY ALL")
def sink_stats(t):
    """Counts by kind and day, one row of statistics each."""
    return t.orders.groupBy(F.when(F.col("o_orderstatus") == "P", "fleet").otherwise("rest").alias("kind"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, rank // 3 AS batch FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS rank FROM supplier WHERE s_acctbal < 5000)")
def set_stale_batches(t):
    """Sorted stale ids of each data set in batches of equal size."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return t.supplier.where("s_acctbal < 5000").select("s_suppkey", (F.row_number().over(w) - 1).alias("r")).select("s_suppkey", F.expr("cast(r as bigint) div 3").alias("batch"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN 5 ELSE least(o_orderkey % 30, 20) END AS plans, CASE WHEN o_custkey % 7 - 2 < 0 THEN 4 ELSE o_custkey % 7 - 2 + 1 END AS legs FROM orders")
def pl_config(t):
    """Plans default to 5 and end at 20; changes allow one leg more, and negative ones four legs."""
    n, changes = F.col("o_orderkey") % 30, F.col("o_custkey") % 7 - 2
    return t.orders.select("o_orderkey", F.when(n <= 0, 5).otherwise(F.least(n, F.lit(20))).alias("plans"), F.when(changes < 0, 4).otherwise(changes + 1).alias("legs"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0 OR CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '1998-03-01 12:00:00'")
def sink_publish_journeys(t):
    """Journeys of data sets published in full, and of the others what changed in the last 24 hours."""
    return t.orders.where("o_custkey % 2 = 0 or o_orderdate >= timestamp_ntz'1998-03-02 12:00:00' - interval 24 hours").select("o_orderkey", "o_custkey")


@query("WITH k AS (SELECT p_brand AS fleet, min(p_type) AS vehicle_type, max(p_size) AS coaches FROM part WHERE p_size > 10 GROUP BY p_brand) SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 = 0 THEN p_name END, k.vehicle_type) AS vehicle_type, coalesce(nullif(p_size % 3, 0), k.coaches) AS coaches FROM part LEFT JOIN k ON k.fleet = p_brand")
def fn_rail_enrich(t):
    """What a train does not say comes from its class's definition."""
    classes = t.part.where("p_size > 10").groupBy("p_brand").agg(F.min("p_type").alias("of_class"), F.max("p_size").alias("coaches_of_class"))
    own = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name"))
    return t.part.join(classes, "p_brand", "left").select("p_partkey", F.coalesce(own, "of_class").alias("vehicle_type"), F.coalesce(F.nullif(F.col("p_size") % 3, F.lit(0)), "coaches_of_class").alias("coaches"))


@query(with_("latest", "SELECT vehicle, event_id, ts + INTERVAL 24 HOUR AS until FROM latest WHERE k % 5 <> 0 AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20 12:00:00'"))
def st_linx(t):
    """The last formation of each train for 24 hours; an empty one deletes it."""
    until = F.col("ts") + F.expr("interval 24 hours")
    return t.latest().where("k % 5 <> 0").select("vehicle", "event_id", until.alias("until")).where("until > timestamp_ntz'2024-01-20 12:00:00'")


@query(with_("messages", "WITH l AS (SELECT vehicle, k, max(event_id) AS trip FROM messages WHERE kind <> 'error' GROUP BY vehicle, k HAVING min(event_id) = max(event_id)) SELECT m.event_id, l.trip FROM messages m JOIN l ON l.vehicle = m.vehicle AND l.k = m.k WHERE m.kind = 'error'"))
def st_tfl_bus_match(t):
    """Positions of a vehicle to the one trip its arrivals tell of."""
    m = t.messages()
    one = m.where("kind <> 'error'").groupBy("vehicle", "k").agg(F.min("event_id").alias("first"), F.max("event_id").alias("trip")).where("first = trip")
    return m.where("kind = 'error'").join(one, ["vehicle", "k"]).select("event_id", "trip")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'large' WHEN s_suppkey % 4 = 1 THEN 'medium' ELSE 'small' END AS stage FROM supplier WHERE s_nationkey % 5 <> 0")
def br_plan(t):
    """Data sets in the stage of their size, small where it is not known; those for queues and runners of their own are left out."""
    size = F.when(F.col("s_suppkey") % 4 == 0, "large").when(F.col("s_suppkey") % 4 == 1, "medium").when(F.col("s_suppkey") % 4 == 2, "huge")
    return t.supplier.where("s_nationkey % 5 <> 0").select("s_suppkey", F.when(size.isin("small", "medium", "large"), size).otherwise("small").alias("stage"))


@query(with_("legs", "WITH e AS (SELECT DISTINCT origin, destination FROM legs), r AS (SELECT min(stop_id) AS stop_id FROM calls UNION SELECT e.origin FROM e JOIN r ON e.destination = r.stop_id) SELECT stop_id FROM r").replace("WITH ", "WITH RECURSIVE ", 1))
def pl_incoming_state(t):
    """Stops from which edges lead to a restricted transfer, which starts at the least stop."""
    restricted = t.calls().agg(F.min("stop_id").alias("stop_id"))
    return linking.reaching(restricted, t.legs().select("origin", "destination"))
