
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.functions import geo, text
from tramline.operators import board, transfers
from tramline.operators.linking import identifier_groups, merge_pick, merge_recent, stale
from tramline.plans.base import query, with_
from tramline.plans.lookups import alias

FLAT = "sqrt(pow((b.lat - a.lat) * 111320.0, 2) + pow((b.lon - a.lon) * 111320.0 * cos(radians(a.lat)), 2))"


@query(with_("services", "SELECT s.service_id, n.n_name AS operator FROM services s LEFT JOIN nation n ON n.n_nationkey = s.operator_id"))
def j_ref_operator(t):
    n = t.nation.select(F.col("n_nationkey").alias("operator_id"), F.col("n_name").alias("operator"))
    return t.services().join(n, "operator_id", "left").select("service_id", "operator")


@query(with_("journeys services", "SELECT j.journey_id, s.name AS service FROM journeys j LEFT JOIN services s ON s.service_id = j.service_id"))
def j_ref_service(t):
    return t.journeys().join(t.services().select("service_id", F.col("name").alias("service")), "service_id", "left").select("journey_id", "service")


@query(with_("legs stops", "SELECT l.journey_id, l.idx, a.name AS origin_name, b.name AS destination_name FROM legs l LEFT JOIN stops a ON a.stop_id = l.origin LEFT JOIN stops b ON b.stop_id = l.destination"))
def j_ref_stops(t):
    s = t.stops()
    a, b = s.select(F.col("stop_id").alias("origin"), F.col("name").alias("origin_name")), s.select(F.col("stop_id").alias("destination"), F.col("name").alias("destination_name"))
    return t.legs().join(a, "origin", "left").join(b, "destination", "left").select("journey_id", "idx", "origin_name", "destination_name")


@query(with_("journeys services", "SELECT j.journey_id, n.n_name AS operator FROM journeys j LEFT JOIN services s ON s.service_id = j.service_id LEFT JOIN nation n ON n.n_nationkey = s.operator_id"))
def j_batch_operator(t):
    n = t.nation.select(F.col("n_nationkey").alias("operator_id"), F.col("n_name").alias("operator"))
    return t.journeys().select("journey_id", "service_id").join(t.services().select("service_id", "operator_id"), "service_id", "left").join(n, "operator_id", "left").select("journey_id", "operator")


@query(with_("journeys services", "SELECT s.service_id, s.name, count(*) AS n FROM journeys j JOIN services s ON s.service_id = j.service_id GROUP BY s.service_id, s.name"))
def j_batch_service(t):
    # counted before the join: a service with very many journeys is one row in it
    n = t.journeys().groupBy("service_id").agg(F.count("*").alias("n"))
    return n.join(t.services().select("service_id", "name"), "service_id").select("service_id", "name", "n")


@query(with_("legs", "SELECT count(*) AS legs, CAST(sum(CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM (SELECT (origin * 1000 + destination) % 5000 AS track FROM legs) l LEFT JOIN part ON p_partkey = l.track"))
def j_tracks(t):
    refs = t.legs().groupBy(((F.col("origin") * 1000 + F.col("destination")) % 5000).alias("track")).agg(F.count("*").alias("n"))
    known = t.part.select(F.col("p_partkey").alias("track"), F.lit(1).alias("known"))
    return refs.join(known, "track", "left").agg(F.sum("n").alias("legs"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("missing"))


@query(with_("stops", "SELECT n.n_name AS group_name, s.stop_id FROM nation n JOIN stops s ON s.group_id = n.n_nationkey"))
def j_group_stops(t):
    s = t.stops().select("stop_id", F.explode(F.array("group_id")).alias("group_id"))
    return s.join(t.nation.select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name")), "group_id").select("group_name", "stop_id")


@query("SELECT r_name AS group_name, string_agg(n_name, ',' ORDER BY n_name) AS operators FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def j_group_operators(t):
    j = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy(F.col("r_name").alias("group_name")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("operators"))


@query(with_("journeys latest", "SELECT j.journey_id, l.kind AS realtime, l.value AS offset_s FROM journeys j LEFT JOIN latest l ON l.vehicle = j.journey_id"))
def j_realtime_overlay(t):
    return t.journeys().join(t.latest().select(F.col("vehicle").alias("journey_id"), F.col("kind").alias("realtime"), F.col("value").alias("offset_s")), "journey_id", "left").select("journey_id", "realtime", "offset_s")


@query(with_("stops", "SELECT w.ref, min(s.stop_id) AS stop_id FROM (VALUES ('stop-1'), ('Supplier#000000002'), ('nothing')) w(ref) LEFT JOIN stops s ON s.name = w.ref OR 'stop-' || s.stop_id = w.ref GROUP BY w.ref"))
def j_stop_alias(t):
    w = t.spark.createDataFrame([("stop-1",), ("Supplier#000000002",), ("nothing",)], "ref string")
    return w.join(alias(t).withColumnRenamed("alias", "ref"), "ref", "left").groupBy("ref").agg(F.min("stop_id").alias("stop_id"))


@query(with_("calls latest", "SELECT c.journey_id, c.idx, coalesce(a.kind, b.kind) AS realtime FROM calls c LEFT JOIN latest a ON a.vehicle = c.stop_id AND a.k % 7 = c.idx - 1 LEFT JOIN latest b ON b.vehicle = c.stop_id + 100"))
def j_realtime_stop(t):
    c, lt = t.calls(), t.latest()
    a = lt.select(F.col("vehicle").alias("stop_id"), (F.col("k") % 7 + 1).alias("idx"), F.col("kind").alias("exact"))
    b = lt.select((F.col("vehicle") - 100).alias("stop_id"), F.col("kind").alias("other"))
    return c.join(a, ["stop_id", "idx"], "left").join(b, "stop_id", "left").select("journey_id", "idx", F.coalesce("exact", "other").alias("realtime"))


@query(with_("journeys", "SELECT journey_id, lag(journey_id) OVER (PARTITION BY block, day ORDER BY start, journey_id) AS before FROM journeys"))
def j_block_preceding(t):
    w = Window.partitionBy("block", "day").orderBy("start", "journey_id")
    return t.journeys().select("journey_id", F.lag("journey_id").over(w).alias("before"))


#: Journeys with the offset that realtime gives them; block 0 is none.  A call counts if it is at most 45 minutes from now (30,000).
BLOCKS = "SELECT j.block, j.journey_id, j.start, CASE WHEN l.kind IN ('view', 'click') THEN CAST(l.k AS BIGINT) * 10 - 200 END AS off FROM journeys j LEFT JOIN latest l ON l.vehicle = j.journey_id % 400"
#: Delay of the newest run of the same block that starts earlier and is known to realtime.
LATE = f"WITH r AS ({BLOCKS}), c AS (SELECT * FROM r WHERE off IS NULL AND block <> 0 AND start BETWEEN 30000 AND 32700), e AS (SELECT c.journey_id, greatest(arg_max(p.off, (p.start, p.journey_id)), 0) AS estimate FROM c JOIN r p ON p.block = c.block AND p.start < c.start AND p.off IS NOT NULL GROUP BY 1)"


def block_rows(t):
    late = F.when(F.col("kind").isin("view", "click"), F.col("k") * 10 - 200)
    block = text.block_key(F.lit("d"), F.lit(None).cast("string"), F.when(F.col("block") != 0, F.col("block").cast("string")))
    rt = t.latest().select(F.col("vehicle").alias("v"), late.alias("offset"))
    return t.journeys().select(block.alias("block"), "journey_id", "start").join(rt, F.col("journey_id") % 400 == F.col("v"), "left").drop("v")


def block_estimates(t):
    rows = block_rows(t)
    return board.estimates(rows.withColumns({"time": F.col("start"), "scheduled": F.col("offset").isNull()}), rows, 30_000)


@query(with_("journeys latest", f"{LATE} SELECT r.journey_id, e.estimate FROM r LEFT JOIN e ON e.journey_id = r.journey_id"))
def j_block_estimate(t):
    return block_estimates(t).select("journey_id", "estimate")


@query(with_("journeys latest", f"{LATE} SELECT count(*) AS n, CAST(sum(r.start + e.estimate) AS BIGINT) AS total FROM r JOIN e ON e.journey_id = r.journey_id"))
def bd_block_apply(t):
    return block_estimates(t).where("estimate is not null").agg(F.count("*").alias("n"), F.sum(F.col("time") + F.col("estimate")).alias("total"))


@query(with_("stops", f"SELECT a.stop_id AS from_id, b.stop_id AS to_id, round({FLAT}, 3) AS distance_m FROM stops a JOIN stops b ON a.stop_id <> b.stop_id AND {FLAT} <= 5000"))
def j_nearby_grid(t):
    p = t.stops().select(F.col("stop_id").alias("id"), "lat", "lon")
    return geo.neighbours(p, p, 5000.0).withColumn("distance_m", F.round("distance_m", 3))


@query(with_("stops", f"SELECT * FROM (SELECT a.stop_id AS from_id, b.stop_id AS to_id, row_number() OVER (PARTITION BY a.stop_id ORDER BY {FLAT}, b.stop_id) AS rank FROM stops a JOIN stops b ON a.stop_id <> b.stop_id AND {FLAT} <= 15000) WHERE rank <= 3"))
def w_top24_nearest(t):
    return transfers.nearby(t.stops(), 15000.0, 3).select("from_id", "to_id", F.col("rank").cast("long").alias("rank"))


@query(with_("stops", f"SELECT b.stop_id AS to_id, round({FLAT}, 3) AS distance_m FROM stops a JOIN stops b ON a.stop_id <> b.stop_id WHERE a.stop_id = 5 AND {FLAT} <= 30000 ORDER BY {FLAT}, b.stop_id LIMIT 5"))
def j_nearby_stops(t):
    p = t.stops().select(F.col("stop_id").alias("id"), "lat", "lon")
    return geo.neighbours(p.where("id = 5"), p, 30000.0).orderBy("distance_m", "to_id").limit(5).select("to_id", F.round("distance_m", 3).alias("distance_m"))


@query(with_("stops", f"SELECT a.stop_id AS from_id, b.stop_id AS to_id, round({FLAT}, 3) AS distance_m FROM stops a JOIN stops b ON a.group_id = b.group_id AND a.stop_id <> b.stop_id WHERE {FLAT} <= 30000"))
def j_same_group(t):
    return transfers.same_group(t.stops(), 30000.0).withColumn("distance_m", F.round("distance_m", 3))


@query(with_("stops", "SELECT 'stop-' || stop_id AS station, 'stop-' || stop_id || '-p' || p AS platform FROM stops CROSS JOIN (VALUES (1), (2)) x(p)"))
def j_platform_alias(t):
    name = F.concat(F.lit("stop-"), F.col("stop_id").cast("string"))
    return t.stops().select(name.alias("station"), F.explode(F.array(F.lit(1), F.lit(2))).alias("p")).select("station", F.concat("station", F.lit("-p"), F.col("p").cast("string")).alias("platform"))


EDGES = f"SELECT a.stop_id AS from_id, b.stop_id AS to_id, {FLAT} AS m, CASE WHEN a.group_id = b.group_id AND {FLAT} <= 10000 THEN 1 ELSE 2 END AS priority FROM stops a JOIN stops b ON a.stop_id <> b.stop_id WHERE {FLAT} <= 5000 OR (a.group_id = b.group_id AND {FLAT} <= 10000)"


@query(with_("stops", f"SELECT from_id, to_id, CASE WHEN priority = 1 THEN 'SameStopGroup' ELSE 'Nearby' END AS type, CAST(ceil(m / 1.2) AS BIGINT) + 60 AS total_s FROM ({EDGES})"))
def lk_transfers(t):
    return transfers.generate(t.stops(), 5000.0, 1000, 1.2).select("from_id", "to_id", "type", "total_s")


@query(with_("calls", "SELECT a.stop_id AS from_id, b.stop_id AS to_id, min(b.arr - a.dep) AS total_s FROM calls a JOIN calls b ON a.journey_id = b.journey_id AND b.idx = a.idx + 1 GROUP BY 1, 2"))
def w_best_transfer(t):
    a = t.calls().select("journey_id", (F.col("idx") + 1).alias("idx"), F.col("stop_id").alias("from_id"), F.col("dep").alias("out"))
    b = t.calls().select("journey_id", "idx", F.col("stop_id").alias("to_id"), "arr")
    edges = a.join(b, ["journey_id", "idx"]).select("from_id", "to_id", (F.col("arr") - F.col("out")).alias("total_s"))
    return edges.groupBy("from_id", "to_id").agg(F.min("total_s").alias("total_s"))


@query(with_("stops", f"WITH e AS (SELECT from_id, to_id, CAST(ceil(m / 1.2) AS BIGINT) + 60 AS total_s FROM ({EDGES})) SELECT from_id, to_id, total_s FROM e WHERE NOT (from_id % 5 = 0 AND to_id % 2 = 0)"))
def pl_topology(t):
    e = transfers.generate(t.stops(), 5000.0, 1000, 1.2)
    bad = e.where("from_id % 5 = 0 and to_id % 2 = 0").select("from_id", "to_id")
    return transfers.usable(e, t.stops(), bad).select("from_id", "to_id", "total_s")


LINKED = "SELECT o_orderkey AS record, 'c' || o_custkey AS identifier FROM orders UNION SELECT o_orderkey, 'd' || CAST(o_orderdate AS DATE) || o_orderpriority || o_orderstatus FROM orders WHERE o_orderstatus = 'P'"


def records(t):
    """Every order under its customer; those of status P under their day and priority too."""
    o = t.orders
    a = o.select(F.col("o_orderkey").alias("record"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("identifier"))
    b = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("record"), F.concat(F.lit("d"), F.col("o_orderdate").cast("date").cast("string"), "o_orderpriority", "o_orderstatus").alias("identifier"))
    return a.unionByName(b)


@query()
def j_linker_groups(t):
    return identifier_groups(records(t))


@query()
def agg_merge_pick(t):
    created = t.orders.select(F.col("o_orderkey").alias("record"), F.col("o_orderdate").alias("created"))
    return merge_pick(created, identifier_groups(records(t)), "created")


@query("SELECT identifier, count(DISTINCT record) AS n FROM (" + LINKED + ") WHERE identifier LIKE 'c%' GROUP BY identifier HAVING count(DISTINCT record) > 1")
def agg_link_stops(t):
    return records(t).where(F.col("identifier").rlike("^c")).distinct().groupBy("identifier").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_name || '|' || p_brand || '|' || p_type AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def agg_link_services(t):
    return t.part.groupBy(F.concat_ws("|", "p_name", "p_brand", "p_type").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query(with_("calls legs", "SELECT l.journey_id, l.origin, c.stop_id, c.dep FROM (SELECT journey_id, origin, arr FROM legs WHERE journey_id = 11) l JOIN (SELECT stop_id, journey_id, dep FROM calls) c ON c.stop_id = l.origin AND c.dep >= l.arr AND c.dep <= l.arr + 3600"))
def j_board_ride(t):
    one = t.legs().where("journey_id = 11").select("journey_id", "origin", "arr")
    c = t.calls().select(F.col("stop_id"), "dep")
    return one.join(c, (F.col("origin") == F.col("stop_id")) & (F.col("dep") >= F.col("arr")) & (F.col("dep") <= F.col("arr") + 3600)).select("journey_id", "origin", "stop_id", "dep")


@query(with_("stops calls", f"SELECT c.journey_id, c.idx, b.stop_id AS to_id FROM calls c JOIN stops a ON a.stop_id = c.stop_id JOIN stops b ON b.stop_id <> a.stop_id AND {FLAT} <= 3000"))
def j_transfer_edge(t):
    p = t.stops().select(F.col("stop_id").alias("id"), "lat", "lon")
    edges = geo.neighbours(p, p, 3000.0).select(F.col("from_id").alias("stop_id"), "to_id")
    return t.calls().join(edges, "stop_id").select("journey_id", "idx", "to_id")


@query(with_("journeys", "SELECT a.journey_id FROM journeys a WHERE NOT EXISTS (SELECT 1 FROM journeys r WHERE r.service_id = a.service_id AND r.kind = 'P') OR EXISTS (SELECT 1 FROM journeys r WHERE r.service_id = a.service_id AND r.kind = 'P' AND r.journey_id % 10 = a.journey_id % 10)"))
def j_transfer_restrict(t):
    """A service with restrictions lets through only journeys that one of them names."""
    rules = t.journeys().where("kind = 'P'").select("service_id", (F.col("journey_id") % 10).alias("named")).distinct()
    held = rules.groupBy("service_id").agg(F.collect_set("named").alias("names"))
    return t.journeys().join(held, "service_id", "left").where(F.col("names").isNull() | F.array_contains("names", F.col("journey_id") % 10)).select("journey_id")


@query(with_("journeys services", "SELECT j.journey_id, s.service_id FROM journeys j JOIN (SELECT service_id % 1000 AS key, min(service_id) AS service_id FROM services GROUP BY 1 HAVING count(*) = 1) s ON s.key = j.service_id % 1000"), name="j_identify_gtfs_trip")
def j_identify_gtfs_trip(t):
    """A key identifies only where exactly one row has it."""
    one = t.services().groupBy((F.col("service_id") % 1000).alias("key")).agg(F.count("*").alias("n"), F.min("service_id").alias("found")).where("n = 1").select("key", "found")
    return t.journeys().join(one, F.col("service_id") % 1000 == F.col("key")).select("journey_id", F.col("found").alias("service_id"))


@query(with_("services", "SELECT a.service_id, b.p_partkey FROM services a JOIN part b ON upper(replace(a.name, '#', '')) = 'CUSTOMER' || lpad(CAST(b.p_partkey AS VARCHAR), 9, '0')"))
def j_identify_services(t):
    s = t.services().select("service_id", F.regexp_replace(text.service_key("name"), "#", "").alias("key"))
    p = t.part.select("p_partkey", F.concat(F.lit("CUSTOMER"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("key"))
    return s.join(p, "key").select("service_id", "p_partkey")


@query(with_("stops", "SELECT e.event_id, s.stop_id FROM events e JOIN (SELECT group_id, min(stop_id) AS stop_id FROM stops GROUP BY group_id HAVING count(*) = 1) s ON s.group_id = e.user_id % 25"))
def j_identify_gtfs_stop(t):
    one = t.stops().groupBy("group_id").agg(F.count("*").alias("n"), F.min("stop_id").alias("stop_id")).where("n = 1")
    return t.events.select("event_id", (F.col("user_id") % 25).alias("group_id")).join(one, "group_id").select("event_id", "stop_id")


@query(with_("journeys", "SELECT e.event_id, coalesce(a.journey_id, b.journey_id) AS journey_id, CASE WHEN a.journey_id IS NOT NULL THEN 'trip' WHEN b.journey_id IS NOT NULL THEN 'block' ELSE 'none' END AS by_ FROM events e LEFT JOIN journeys a ON a.journey_id = e.event_id LEFT JOIN (SELECT block, max(journey_id) AS journey_id FROM journeys GROUP BY block) b ON b.block = e.user_id"))
def j_identify_siri(t):
    """The trip where it is known, else the block's last journey."""
    a = t.journeys().select(F.col("journey_id").alias("event_id"), F.col("journey_id").alias("trip"))
    b = t.journeys().groupBy(F.col("block").alias("user_id")).agg(F.max("journey_id").alias("of_block"))
    got = t.events.select("event_id", "user_id").join(a, "event_id", "left").join(b, "user_id", "left")
    return got.select("event_id", F.coalesce("trip", "of_block").alias("journey_id"), F.when(F.col("trip").isNotNull(), "trip").when(F.col("of_block").isNotNull(), "block").otherwise("none").alias("by_"))


@query(with_("calls", "WITH n AS (SELECT journey_id, stop_id, idx, row_number() OVER (PARTITION BY journey_id, stop_id ORDER BY idx) AS occ FROM calls), r AS (SELECT journey_id, stop_id, arr, row_number() OVER (PARTITION BY journey_id, stop_id ORDER BY arr, idx) AS occ FROM calls WHERE idx > 1) SELECT n.journey_id, n.idx, r.arr FROM n JOIN r ON r.journey_id = n.journey_id AND r.stop_id = n.stop_id AND r.occ = n.occ"))
def j_darwin_occurrence(t):
    w = lambda *o: Window.partitionBy("journey_id", "stop_id").orderBy(*o)
    n = t.calls().select("journey_id", "stop_id", "idx", F.row_number().over(w("idx")).alias("occ"))
    r = t.calls().where("idx > 1").select("journey_id", "stop_id", "arr", F.row_number().over(w("arr", "idx")).alias("occ"))
    return n.join(r, ["journey_id", "stop_id", "occ"]).select("journey_id", "idx", "arr")


@query("SELECT coalesce(a.s_suppkey, b.c_custkey) AS carriage, a.s_acctbal AS loading, b.c_mktsegment AS class FROM (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) a FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) b ON a.s_suppkey = b.c_custkey")
def j_formation_merge(t):
    a = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("carriage"), F.col("s_acctbal").alias("loading"))
    b = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("carriage"), F.col("c_mktsegment").alias("class"))
    return a.join(b, "carriage", "full_outer").select("carriage", "loading", "class")


@query("SELECT e.event_id, s.s_suppkey AS train FROM events e JOIN supplier s ON e.user_id BETWEEN s.s_suppkey * 4 AND s.s_suppkey * 4 + 3")
def j_darwin_train(t):
    coaches = t.supplier.select(F.col("s_suppkey").alias("train"), F.explode(F.sequence(F.col("s_suppkey") * 4, F.col("s_suppkey") * 4 + 3)).alias("user_id"))
    return t.events.join(coaches, "user_id").select("event_id", "train")


@query(with_("legs journeys latest", "SELECT l.journey_id, l.idx, j.service_id, r.kind AS realtime FROM legs l JOIN journeys j ON j.journey_id = l.journey_id LEFT JOIN latest r ON r.vehicle = l.journey_id WHERE l.idx = 1"))
def j_hydrate_plan(t):
    r = t.latest().select(F.col("vehicle").alias("journey_id"), F.col("kind").alias("realtime"))
    return t.legs().where("idx = 1").join(t.journeys().select("journey_id", "service_id"), "journey_id").join(r, "journey_id", "left").select("journey_id", "idx", "service_id", "realtime")


# set operations
@query("SELECT p_partkey, list_aggregate(list_distinct([p_brand, p_type, p_brand]), 'count') AS n FROM part")
def set_distinct_strings(t):
    return t.part.select("p_partkey", F.size(text.distinct_strings(F.array("p_brand", "p_type", "p_brand"))).cast("long").alias("n"))


@query("SELECT p_partkey, p_brand IN ('Brand#1', 'Brand#2') OR p_type IN ('Brand#1', 'Brand#2') AS overlap FROM part")
def set_overlap(t):
    return t.part.select("p_partkey", F.arrays_overlap(F.array("p_brand", "p_type"), F.array(F.lit("Brand#1"), F.lit("Brand#2"))).alias("overlap"))


@query("SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AS red FROM part")
def set_contains(t):
    return t.part.select("p_partkey", F.array_contains(F.split("p_name", " "), "red").alias("red"))


@query(with_("messages", "SELECT vehicle, CAST(min(event_id) AS BIGINT) AS event_id FROM (SELECT vehicle, event_id, 0 AS src FROM messages WHERE kind = 'view' UNION ALL SELECT vehicle, event_id, 1 FROM messages WHERE kind = 'click') x WHERE NOT (src = 1 AND vehicle IN (SELECT vehicle FROM messages WHERE kind = 'view')) GROUP BY vehicle"))
def set_union_tfl(t):
    m = t.messages()
    both = m.where("kind = 'view'").select("vehicle", "event_id", F.lit(0).alias("src")).unionByName(m.where("kind = 'click'").select("vehicle", "event_id", F.lit(1).alias("src")))
    return both.groupBy("vehicle").agg(F.min(F.struct("src", "event_id")).alias("f")).select("vehicle", "f.event_id")


@query(with_("calls", "WITH a AS (SELECT journey_id, dep AS time FROM calls WHERE stop_id = 2 AND dep > 80000), b AS (SELECT journey_id, dep + 86400 AS time FROM calls WHERE stop_id = 2 AND dep < 20000) SELECT * FROM a UNION ALL SELECT * FROM b"))
def set_union_boards(t):
    c = t.calls().where("stop_id = 2").select("journey_id", F.col("dep").alias("time"))
    return board.fill(c.where("time > 80000"), c.where("time < 20000"), 1_000_000)


@query("SELECT o_orderkey AS id, len(list_filter([o_custkey % 5, o_custkey % 7], lambda x: NOT list_contains([o_orderkey % 5, o_orderkey % 7], x))) > 0 AS grew FROM orders")
def set_diff_identifiers(t):
    after, before = F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 7), F.array(F.col("o_orderkey") % 5, F.col("o_orderkey") % 7)
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.size(F.array_except(after, before)) > 0).alias("grew"))


@query(with_("legs", "SELECT DISTINCT origin, destination FROM (SELECT origin, destination FROM legs UNION ALL SELECT destination, origin FROM legs)"))
def set_union_routes(t):
    l = t.legs().select("origin", "destination")  # noqa: E741
    return l.unionByName(l.select(F.col("destination").alias("origin"), F.col("origin").alias("destination"))).dropDuplicates()


@query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ',' || p_type END AS ids FROM part")
def set_append_unique(t):
    return t.part.select("p_partkey", F.array_join(text.distinct_strings(F.array("p_brand", F.lit(""), "p_type", F.lit(None).cast("string"))), ",").alias("ids"))


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def set_filter_inplace(t):
    return t.part.where("p_size > 25").select("p_partkey")


@query(with_("journeys", "SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY) g(d) WHERE CAST(d AS DATE) NOT IN (SELECT day FROM journeys WHERE service_id % 3 = 0)"))
def set_missing_days(t):
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).alias("day"))
    return days.join(t.journeys().where("service_id % 3 = 0").select("day"), "day", "left_anti")


# publishing
@query("SELECT o_orderkey AS id, o_custkey % 20 AS dataset, 'new' AS version FROM orders WHERE o_custkey % 20 < 5 UNION ALL SELECT o_orderkey, o_custkey % 20, 'old' FROM orders WHERE o_custkey % 20 >= 5 AND o_orderkey % 2 = 0")
def sink_incremental_merge(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("dataset"))
    raw, live = o.where("dataset < 5").withColumn("version", F.lit("new")), o.where("id % 2 = 0").withColumn("version", F.lit("old"))
    return merge_recent(raw, live, "id", "dataset", "version")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 20 < 10 AND o_orderkey % 3 <> 0")
def sink_stale_filter(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("dataset"), (F.col("o_orderkey") % 3).alias("stamp"))
    current = t.spark.range(10).select(F.col("id").alias("dataset"), F.lit(0).cast("long").alias("stamp"))
    return stale(rows, current, "dataset", "stamp").select("id")


@query("SELECT o_custkey % 20 AS dataset, max(o_orderdate) AS last FROM orders GROUP BY 1 HAVING max(o_orderdate) > TIMESTAMP '2001-07-30 00:00:00'")
def sink_changed_datasets(t):
    return t.orders.groupBy((F.col("o_custkey") % 20).alias("dataset")).agg(F.max("o_orderdate").alias("last")).where("last > timestamp_ntz'2001-07-30 00:00:00'")


@query(with_("calls", "SELECT stop_id, journey_id, min(arr) AS arr FROM calls WHERE arr > 50000 GROUP BY stop_id, journey_id"))
def sink_stop_index(t):
    return t.calls().where("arr > 50000").groupBy("stop_id", "journey_id").agg(F.min("arr").alias("arr"))


@query("SELECT o_custkey % 20 AS dataset, string_agg(DISTINCT CAST(o_orderkey % 3 AS VARCHAR), ',' ORDER BY CAST(o_orderkey % 3 AS VARCHAR)) AS stamps FROM orders GROUP BY 1")
def agg_dataset_timestamps(t):
    return t.orders.groupBy((F.col("o_custkey") % 20).alias("dataset")).agg(F.array_join(F.sort_array(F.collect_set((F.col("o_orderkey") % 3).cast("string"))), ",").alias("stamps"))


@query("SELECT o_custkey % 20 AS dataset, max(o_orderdate) + INTERVAL 2000 DAY > TIMESTAMP '2007-01-15 00:00:00' AS fresh FROM orders GROUP BY 1")
def src_fresh_skip(t):
    last = t.orders.groupBy((F.col("o_custkey") % 20).alias("dataset")).agg(F.max("o_orderdate").alias("last"))
    return last.select("dataset", (F.col("last") + F.expr("interval 2000 days") > F.lit("2007-01-15 00:00:00").cast("timestamp_ntz")).alias("fresh"))
