
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.functions import text, times
from tramline.operators import board, journeys, planner, realtime, transfers
from tramline.operators.alerts import added_identifiers, compile_subscription, match_subscriptions, notification_text
from tramline.operators.stats import conditional_counts, count_by, identification_rates, rating
from tramline.plans.base import TODAY, query, with_
from tramline.plans.lookups import RUNS, alerts, now
from tramline.plans.joins import FLAT


@query("SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown') AS key, count(*) AS n FROM customer GROUP BY 1")
def agg_count_by(t):
    return count_by(t.customer, F.nullif("c_mktsegment", F.lit("BUILDING")))


@query("SELECT split_part(p_brand, '#', 1) || split_part(p_type, ' ', 1) AS country, count(*) AS n FROM part WHERE split_part(p_type, ' ', 1) <> 'PROMO' GROUP BY 1")
def agg_countries(t):
    key = F.concat(F.split_part("p_brand", F.lit("#"), F.lit(1)), F.split_part("p_type", F.lit(" "), F.lit(1)))
    return t.part.where("split_part(p_type, ' ', 1) <> 'PROMO'").groupBy(key.alias("country")).agg(F.count("*").alias("n"))


@query(with_("stops", "SELECT 'total' AS measure, 'all' AS key, count(*) AS n FROM stops UNION ALL SELECT 'group', CAST(group_id AS VARCHAR), count(*) FROM stops GROUP BY group_id"))
def agg_stats_stops(t):
    # one pass: the total is a grouping set
    return t.stops().rollup("group_id").agg(F.count("*").alias("n"), F.grouping("group_id").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise("group").alias("measure"), F.when(F.col("g") == 1, "all").otherwise(F.col("group_id").cast("string")).alias("key"), "n")


@query(with_("services", "SELECT 'total' AS measure, 'all' AS key, count(*) AS n FROM services UNION ALL SELECT 'operator', CAST(operator_id AS VARCHAR), count(*) FROM services GROUP BY operator_id UNION ALL SELECT 'kind', kind, count(*) FROM services GROUP BY kind"))
def agg_stats_services(t):
    sets = t.services().select("operator_id", "kind").groupingSets([[], ["operator_id"], ["kind"]], "operator_id", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "operator").otherwise("kind").alias("measure"), F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("operator_id").cast("string")).otherwise(F.col("kind")).alias("key"), "n")


@query("SELECT r_name AS key, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def agg_stats_operators(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS type, count(*) AS total, CAST(sum(CASE WHEN ts < TIMESTAMP '2024-01-20 12:00:00' AND ts + INTERVAL 2 DAY > TIMESTAMP '2024-01-20 12:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS active FROM events GROUP BY event_type")
def agg_stats_alerts(t):
    active = (F.col("valid_from") < now()) & (F.col("valid_until") > now())
    return conditional_counts(alerts(t), ["type"], {"active": active})


@query(with_("latest", "SELECT kind, count(*) AS total, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS tracked FROM latest GROUP BY kind"))
def agg_stats_realtime(t):
    return conditional_counts(t.latest(), ["kind"], {"tracked": F.col("value") > 50})


@query("SELECT event_type AS operator, count(*) AS total, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM events WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def agg_ident_query(t):
    e = t.events.where("ts >= timestamp_ntz'2024-01-13 00:00:00' and ts < timestamp_ntz'2024-01-20 00:00:00'").withColumnRenamed("event_type", "operator")
    return conditional_counts(e, ["operator"], {"good": F.col("value") > 20})


def _rate(days: int) -> str:
    span = f"ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL {days} DAY AND ts < TIMESTAMP '2024-01-20 00:00:00'"
    return f"round(sum(CASE WHEN {span} AND value > 20 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN {span} THEN 1 ELSE 0 END), 0), 6)"


@query(f"SELECT event_type AS operator, {_rate(1)} AS day, {_rate(7)} AS week, {_rate(31)} AS month FROM events GROUP BY 1")
def agg_ident_rate(t):
    rates = identification_rates(t.events.withColumnRenamed("event_type", "operator"), F.col("value") > 20, "2024-01-20")
    return rates.select("operator", *[F.round(x, 6).alias(x) for x in ("day", "week", "month")])


@query(f"WITH r AS (SELECT user_id AS operator, {_rate(1)} AS day, {_rate(7)} AS week FROM events GROUP BY 1) SELECT operator, CASE WHEN day >= 0.95 THEN 'PERFECT' WHEN day >= 0.75 THEN 'EXCELLENT' WHEN day <= 0.5 AND week >= 0.75 THEN 'TEMPORARY-ISSUES' WHEN day >= 0.53 THEN 'GOOD' ELSE 'POOR' END AS rating FROM r")
def agg_rating(t):
    rates = identification_rates(t.events.withColumnRenamed("user_id", "operator"), F.col("value") > 20, "2024-01-20")
    return rates.select("operator", rating(F.round("day", 6), F.round("week", 6)).alias("rating"))


@query(with_("calls journeys", "WITH p AS (SELECT journey_id, string_agg(CAST(stop_id AS VARCHAR), '>' ORDER BY idx) AS pattern FROM calls GROUP BY journey_id) SELECT service_id, pattern, count(*) AS n FROM p JOIN journeys j ON j.journey_id = p.journey_id GROUP BY 1, 2"))
def agg_stop_patterns(t):
    return journeys.patterns(t.calls(), t.journeys())


@query(with_("calls journeys", "SELECT j.day, c.stop_id, count(*) AS n, min(c.dep) AS first, max(c.dep) AS last FROM calls c JOIN journeys j ON j.journey_id = c.journey_id GROUP BY 1, 2"))
def agg_departure_buckets(t):
    return t.calls().join(t.journeys().select("journey_id", "day"), "journey_id").groupBy("day", "stop_id").agg(F.count("*").alias("n"), F.min("dep").alias("first"), F.max("dep").alias("last"))


@query(with_("calls journeys", "SELECT j.service_id, c.stop_id, c.journey_id, c.idx, row_number() OVER (PARTITION BY j.service_id, c.stop_id ORDER BY c.dep, c.journey_id, c.idx) AS place FROM calls c JOIN journeys j ON j.journey_id = c.journey_id"))
def agg_pattern_departures(t):
    w = Window.partitionBy("service_id", "stop_id").orderBy("dep", "journey_id", "idx")
    return t.calls().join(t.journeys().select("journey_id", "service_id"), "journey_id").select("service_id", "stop_id", "journey_id", "idx", F.row_number().over(w).cast("long").alias("place"))


@query(with_("calls", "SELECT journey_id, stop_id, idx, arr FROM (SELECT *, row_number() OVER (PARTITION BY journey_id, stop_id ORDER BY idx) AS rn FROM (SELECT *, max(idx) OVER (PARTITION BY journey_id) AS final FROM calls) WHERE idx < final) WHERE rn = 1"))
def agg_flatten_stops(t):
    return journeys.flatten_stops(t.calls()).select("journey_id", "stop_id", "idx", "arr")


@query("SELECT 'report' AS name, (SELECT count(*) FROM supplier) AS stops, (SELECT count(*) FROM customer) AS services, (SELECT count(*) FROM orders) AS journeys, CAST(0 AS BIGINT) AS unsupported")
def agg_import_report(t):
    parts = [("supplier", "stops"), ("customer", "services"), ("orders", "journeys")]
    rows = None
    for table, name in parts:
        own = t.read(table).agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
        rows = own if rows is None else rows.unionByName(own)
    return rows.agg(*[F.sum(F.when(F.col("k") == n, F.col("n")).otherwise(0)).alias(n) for _, n in parts]).select(F.lit("report").alias("name"), "*", F.lit(0).cast("long").alias("unsupported"))


@query("SELECT event_type AS line, user_id AS vehicle, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS predictions FROM events GROUP BY 1, 2")
def agg_tfl_group(t):
    g = t.events.groupBy(F.col("event_type").alias("line"), F.col("user_id").alias("vehicle")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("p"))
    return g.select("line", "vehicle", "n", F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ",").alias("predictions"))


@query("SELECT l_orderkey AS journey_id, CAST(max(l_partkey % 300 - l_suppkey) AS BIGINT) AS delay FROM lineitem GROUP BY 1")
def agg_max_delay(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("journey_id")).agg(F.max(F.col("l_partkey") % 300 - F.col("l_suppkey")).alias("delay"))


@query("SELECT p_brand, p_type, CAST(sum(p_size) AS BIGINT) AS capacity, count(*) AS merged FROM part GROUP BY 1, 2")
def agg_bicycle_merge(t):
    return t.part.groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("capacity"), F.count("*").alias("merged"))


@query(with_("calls", "SELECT journey_id, count(*) FILTER (stop_id % 4 <> 0) AS length FROM calls GROUP BY 1"))
def agg_train_length(t):
    cars = t.calls().groupBy("journey_id").agg(F.collect_list("stop_id").alias("cars"))
    return cars.select("journey_id", F.size(F.filter("cars", lambda x: x % 4 != 0)).cast("long").alias("length"))


@query(with_("calls stops journeys", "SELECT 'stops' AS counter, count(*) AS n FROM stops UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'journeys', count(*) FROM journeys"))
def agg_graph_stats(t):
    of = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    return of("stops", t.stops()).unionByName(of("calls", t.calls())).unionByName(of("journeys", t.journeys()))


@query("SELECT date_trunc('hour', ts) AS at, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY 1")
def agg_latency_60s(t):
    return t.events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"))


# windows
@query("SELECT user_id AS journey_id, event_id AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, value, event_id) AS rn FROM events WHERE user_id <> 3) WHERE rn = 1 UNION ALL SELECT NULL, event_id FROM events WHERE user_id = 3")
def w_first_per_journey(t):
    rows = t.events.select(F.when(F.col("user_id") != 3, F.col("user_id")).alias("journey_id"), F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("rank"), F.col("value").alias("time"))
    return board.dedupe(rows).select("journey_id", "row_id")


HASHES = "SELECT j.journey_id, sha256(j.service_id || '|' || j.kind || '|' || p.path) AS hash FROM journeys j JOIN (SELECT journey_id, string_agg(stop_id || ':' || dep, ',' ORDER BY idx) AS path FROM calls GROUP BY journey_id) p ON p.journey_id = j.journey_id"


@query(with_("journeys calls", HASHES))
def w_journey_hash(t):
    return journeys.functional_hash(t.calls(), t.journeys())


@query(with_("journeys calls", f"SELECT hash, min(journey_id) AS journey_id FROM ({HASHES}) GROUP BY hash"))
def w_identical_journeys(t):
    return journeys.first_identical(journeys.functional_hash(t.calls(), t.journeys()))


@query()
def w_future_stops(t):
    """Each call's arrival under the journey's realtime offset; a fold that SQL of the other engine has no form for."""
    c = t.calls().groupBy("journey_id").agg(F.sort_array(F.collect_list(F.struct("idx", "arr", "dep"))).alias("p"))
    got = c.join(t.latest().select(F.col("vehicle").alias("journey_id"), (F.col("k") * 10 - 300).alias("offset")), "journey_id")
    return got.select("journey_id", F.array_join(times.fold_delay(F.transform("p", lambda x: x["arr"]), F.transform("p", lambda x: x["dep"]), F.col("offset")).cast("array<string>"), ",").alias("arrivals"))


@query(with_("calls", "SELECT journey_id, idx, CAST(sum(arr % 100) OVER (PARTITION BY journey_id ORDER BY idx) AS BIGINT) AS elapsed FROM calls"))
def w_path_times(t):
    return t.calls().select("journey_id", "idx", F.sum(F.col("arr") % 100).over(Window.partitionBy("journey_id").orderBy("idx")).alias("elapsed"))


@query(with_("legs", "SELECT * FROM legs"))
def w_leg_pairs(t):
    return t.legs()


@query(with_("calls", "WITH m AS (SELECT stop_id, max(dep) AS mark FROM calls WHERE journey_id % 20 = 0 GROUP BY stop_id) SELECT c.journey_id, c.idx FROM calls c LEFT JOIN m ON m.stop_id = c.stop_id WHERE c.journey_id % 20 <> 0 AND (m.mark IS NULL OR c.dep > m.mark)"))
def w_direction_watermark(t):
    mark = t.calls().where("journey_id % 20 = 0").groupBy("stop_id").agg(F.max("dep").alias("mark"))
    return t.calls().where("journey_id % 20 <> 0").join(mark, "stop_id", "left").where("mark is null or dep > mark").select("journey_id", "idx")


@query(with_("messages", "WITH c AS (SELECT vehicle, min(ts) AS first FROM messages WHERE ts > TIMESTAMP '2024-01-25 00:00:00' GROUP BY vehicle) SELECT m.event_id, CASE WHEN m.ts < c.first THEN 'Historical' ELSE 'Current' END AS state FROM messages m JOIN c ON c.vehicle = m.vehicle"))
def w_realtime_reconcile(t):
    first = t.messages().where("ts > timestamp_ntz'2024-01-25 00:00:00'").groupBy("vehicle").agg(F.min("ts").alias("first"))
    return t.messages().join(first, "vehicle").select("event_id", F.when(F.col("ts") < F.col("first"), "Historical").otherwise("Current").alias("state"))


DIFF = "WITH p AS (SELECT *, lag(kind) OVER w AS was, lag(value) OVER w AS was_value, lag(k) OVER w AS was_k FROM messages WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)) SELECT vehicle, event_id, 'Created' AS change FROM p WHERE was IS NULL UNION ALL SELECT vehicle, event_id, 'Cancelled' FROM p WHERE kind = 'error' AND was <> 'error' UNION ALL SELECT vehicle, event_id, x FROM (SELECT vehicle, event_id, unnest([CASE WHEN kind = 'view' AND was <> 'view' THEN 'ActivelyTracked' END, CASE WHEN k <> was_k THEN 'NextStopChanged' END, CASE WHEN value >= was_value + 5 THEN 'DelayIncreased' END]) AS x FROM p WHERE was IS NOT NULL AND NOT (kind = 'error' AND was <> 'error')) WHERE x IS NOT NULL"


@query(with_("messages", DIFF))
def w_events_lag(t):
    return realtime.diff_events(t.messages()).select("vehicle", "event_id", "change")


@query(with_("messages", "SELECT event_id, CAST(k * 1200 AS BIGINT) AS scheduled, CAST(CASE WHEN abs(a - 86400 - s) < abs(a - s) AND abs(a - 86400 - s) <= abs(a + 86400 - s) THEN a - 86400 WHEN abs(a + 86400 - s) < abs(a - s) THEN a + 86400 ELSE a END AS BIGINT) AS actual FROM (SELECT event_id, k, k * 1200 AS s, (event_id * 37) % 86400 AS a FROM messages)"))
def w_nearest_day(t):
    s, a = F.col("k") * 1200, (F.col("event_id") * 37) % 86400
    return t.messages().select("event_id", s.alias("scheduled"), times.nearest_day(s, a).alias("actual"))


@query(with_("calls", "SELECT journey_id, CAST(arg_max(stop_id, idx) AS BIGINT) AS destination FROM calls WHERE stop_id % 6 <> 0 GROUP BY 1"))
def w_last_uncancelled(t):
    return t.calls().where("stop_id % 6 <> 0").groupBy("journey_id").agg(F.max_by("stop_id", "idx").alias("destination"))


@query(with_("messages", "SELECT vehicle, event_id FROM (SELECT vehicle, event_id, value, lead(value) OVER w AS second, row_number() OVER w AS rn FROM messages WINDOW w AS (PARTITION BY vehicle ORDER BY value, event_id)) WHERE rn = 1 AND (second IS NULL OR second - value >= 1)"))
def w_ambiguous_top2(t):
    w = Window.partitionBy("vehicle").orderBy("value", "event_id")
    m = t.messages().select("vehicle", "event_id", "value", F.lead("value").over(w).alias("second"), F.row_number().over(w).alias("rn"))
    return m.where("rn = 1 and (second is null or second - value >= 1)").select("vehicle", "event_id")


@query(with_("messages", "SELECT event_id, round(value - CASE WHEN k % 4 = 0 THEN 50 ELSE 0 END + CASE WHEN k > 95 THEN 200 ELSE 0 END, 2) AS score FROM messages"))
def w_candidate_score(t):
    return t.messages().select("event_id", F.round(F.col("value") - F.when(F.col("k") % 4 == 0, 50).otherwise(0) + F.when(F.col("k") > 95, 200).otherwise(0), 2).alias("score"))


# realtime
@query(with_("messages", "SELECT event_id FROM (SELECT *, max(ts2) OVER (PARTITION BY vehicle ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT *, ts + CASE WHEN k % 10 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ts2 FROM messages)) WHERE seen IS NULL OR ts2 > seen"))
def st_touch_mapping(t):
    m = t.messages().withColumn("ts", F.when(F.col("k") % 10 == 0, F.col("ts") + F.expr("interval 1 day")).otherwise(F.col("ts")))
    return realtime.increasing_only(m).select("event_id")


@query(with_("messages", "SELECT vehicle, CAST(ts AS DATE) AS day, CAST(min(CASE WHEN kind = 'view' THEN 0 ELSE 1 END) AS INTEGER) AS owner FROM messages GROUP BY 1, 2"))
def st_gtfs_ownership(t):
    return t.messages().groupBy("vehicle", F.col("ts").cast("date").alias("day")).agg(F.min(F.when(F.col("kind") == "view", 0).otherwise(1)).alias("owner"))


@query(with_("messages", DIFF.replace("SELECT vehicle, event_id, 'Created'", "SELECT change, count(*) AS n FROM (SELECT vehicle, event_id, 'Created'") + ") GROUP BY change"))
def st_diff_events(t):
    return realtime.diff_events(t.messages()).groupBy("change").agg(F.count("*").alias("n"))


@query(with_("messages", "SELECT event_id FROM messages WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 90 MINUTE"))
def st_ttl(t):
    return realtime.live(t.messages(), "2024-01-20 12:00:00", 90).select("event_id")


@query(with_("latest", "SELECT vehicle FROM (SELECT DISTINCT user_id AS vehicle FROM events) WHERE vehicle NOT IN (SELECT vehicle FROM latest WHERE ts > TIMESTAMP '2024-01-29 12:00:00')"))
def st_geo_cleanup(t):
    alive = t.latest().where("ts > timestamp_ntz'2024-01-29 12:00:00'").select("vehicle")
    return t.events.select(F.col("user_id").alias("vehicle")).distinct().join(alive, "vehicle", "left_anti")


@query(with_("messages", "WITH p AS (SELECT *, lag(k) OVER w AS was_k, lag(kind) OVER w AS was FROM messages WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)) SELECT event_id, CASE WHEN was IS NULL OR kind <> was THEN 'content' ELSE 'identifiers' END AS change FROM p WHERE was IS NULL OR kind <> was OR k <> was_k"))
def st_alert_cdc(t):
    return added_identifiers(realtime.with_previous(t.messages())).select("event_id", "change")


@query("SELECT s.sub_id, e.event_id FROM events e JOIN (VALUES (1, 'error', 50.0), (2, 'error', 0.5), (3, 'signup', 20.0), (4, 'view', 90.0)) s(sub_id, type, threshold) ON e.event_type = s.type AND e.value > s.threshold")
def st_subscription_match(t):
    subs = t.spark.createDataFrame([(1, "error", 50.0), (2, "error", 0.5), (3, "signup", 20.0), (4, "view", 90.0)], "sub_id int, event_type string, threshold double")
    return match_subscriptions(t.events, subs)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'Journey cancelled: ' || user_id WHEN 'signup' THEN 'New alert for ' || user_id ELSE 'Update for ' || user_id END AS title FROM events")
def st_notification_text(t):
    return t.events.select("event_id", notification_text(F.col("event_type"), F.col("user_id").cast("string")).alias("title"))


@query("SELECT event_id FROM events WHERE event_type IN ('error') AND (user_id IN (3, 5, 8) OR user_id % 10 = 4)")
def udf_expr_alert(t):
    rule = compile_subscription({"alert_types": ["error"], "any_of": {"user_id": [3, 5, 8], "digit": [4]}})
    return t.events.withColumn("digit", F.col("user_id") % 10).where(rule).select("event_id")


@query("SELECT event_id FROM events WHERE user_id IN (1, 2) OR event_type IN ('purchase')")
def udf_expr_journey(t):
    return t.events.where(compile_subscription({"any_of": {"user_id": [1, 2], "event_type": ["purchase"]}})).select("event_id")


@query("SELECT event_id FROM events WHERE (user_id IN (1, 2) OR event_type IN ('purchase')) AND user_id % 5 IN (1, 2)")
def udf_expr_platform(t):
    return t.events.where(compile_subscription({"any_of": {"user_id": [1, 2], "event_type": ["purchase"]}}) & (F.col("user_id") % 5).isin(1, 2)).select("event_id")


# boards and plans
BOARD = f"""WITH c AS (SELECT * FROM (SELECT c.journey_id, c.dep, c.stop_id, row_number() OVER (PARTITION BY c.journey_id ORDER BY c.dep, c.idx, c.stop_id) AS rn FROM calls c JOIN stops s ON s.stop_id = c.stop_id WHERE s.group_id < 12 AND c.dep >= 20000) WHERE rn = 1),
 r AS (SELECT j.journey_id, j.service_id, j.block, j.start, c.stop_id, c.dep, l.kind = 'error' AS cancelled, CASE WHEN l.kind IN ('view', 'click') THEN l.k * 10 - 200 END AS off FROM journeys j JOIN c ON c.journey_id = j.journey_id LEFT JOIN latest l ON l.vehicle = j.journey_id % 400 WHERE {RUNS} AND coalesce(l.kind <> 'signup', TRUE)),
 k AS (SELECT j.block, j.start, j.journey_id, l.k * 10 - 200 AS off FROM journeys j JOIN latest l ON l.vehicle = j.journey_id % 400 WHERE l.kind IN ('view', 'click') AND j.block <> 0),
 e AS (SELECT r.journey_id, greatest(arg_max(k.off, (k.start, k.journey_id)), 0) AS est FROM r JOIN k ON k.block = r.block AND k.start < r.start WHERE r.off IS NULL AND NOT coalesce(r.cancelled, FALSE) AND r.dep BETWEEN 20000 AND 22700 GROUP BY 1)
 SELECT r.journey_id, service_id, stop_id, dep, CAST(dep + coalesce(off, est, 0) AS BIGINT) AS time, CASE WHEN cancelled THEN 'Cancelled' WHEN off IS NOT NULL THEN 'RealtimeTracked' WHEN est IS NOT NULL THEN 'Estimated' ELSE 'Scheduled' END AS type FROM r LEFT JOIN e ON e.journey_id = r.journey_id WHERE dep + coalesce(off, est, 0) >= 20000"""


def _board(t, count):
    rule = F.struct(F.lit("DayOfWeek").alias("type"), F.date_format("day", "EEEE").alias("value"), F.lit(None).cast("string").alias("description"))
    none = F.array().cast("array<struct<type: string, value: string, description: string>>")
    j = t.journeys().withColumn("availability", F.struct(F.array(rule).alias("match"), none.alias("match_secondary"), none.alias("condition"), none.alias("exclude")))
    j = j.withColumn("block", text.block_key(F.lit("d"), F.lit(None).cast("string"), F.when(F.col("block") != 0, F.col("block").cast("string"))))
    own = F.when(F.col("kind").isin("view", "click"), F.col("k") * 10 - 200)
    rt = t.latest().select("vehicle", own.alias("offset"), (F.col("kind") == "error").alias("cancelled"), (F.col("kind") == "signup").alias("suppressed"))
    rt = t.journeys().select("journey_id", (F.col("journey_id") % 400).alias("vehicle")).join(rt, "vehicle").drop("vehicle")
    return board.generate(t.calls(), j, rt, t.stops().where("group_id < 12"), TODAY, 20000, count)


@query(with_("calls stops journeys latest", BOARD))
def bd_generate(t):
    return _board(t, None)


@query(with_("calls stops journeys latest", f"SELECT * FROM ({BOARD}) ORDER BY time, journey_id LIMIT 25"))
def bd_query(t):
    return _board(t, 25)


@query(with_("calls", "WITH a AS (SELECT DISTINCT c.stop_id FROM calls c JOIN (SELECT journey_id, max(idx) AS last FROM calls WHERE stop_id = 7 GROUP BY journey_id) l ON l.journey_id = c.journey_id WHERE c.idx < l.last), b AS (SELECT DISTINCT c.stop_id FROM calls c JOIN (SELECT journey_id, max(idx) AS last FROM calls WHERE stop_id = 7 OR stop_id IN (SELECT stop_id FROM a) GROUP BY journey_id) l ON l.journey_id = c.journey_id WHERE c.idx < l.last) SELECT stop_id, min(rides) AS rides FROM (SELECT 7 AS stop_id, 0 AS rides UNION ALL SELECT stop_id, 1 FROM a UNION ALL SELECT stop_id, 2 FROM b) GROUP BY stop_id"))
def pl_corridor(t):
    return planner.corridor(t.calls(), 7, 2)


@query(with_("calls", "SELECT min(b.arr) AS arrival FROM calls a JOIN calls b ON a.journey_id = b.journey_id AND b.idx > a.idx WHERE a.stop_id = 3 AND b.stop_id = 9 AND a.dep BETWEEN 20000 AND 63200 HAVING min(b.arr) IS NOT NULL"))
def pl_rides(t):
    none = t.spark.createDataFrame([], "from_id long, to_id long, total_s long")
    return planner.plan(t.calls(), none, 3, 9, 20000, rides=1, count=1).select("arrival")


@query()
def pl_plan(t):
    """Up to two rides with walks between near stops; the tests compare it with a search by hand."""
    walks = transfers.generate(t.stops(), 3000.0, 24, 1.2).select("from_id", "to_id", "total_s")
    return planner.plan(t.calls(), walks, 3, 9, 20000, rides=2)


@query(with_("stops", f"SELECT from_id, to_id FROM (SELECT a.stop_id AS from_id, b.stop_id AS to_id, {FLAT} AS m FROM stops a JOIN stops b ON a.group_id = b.group_id AND a.stop_id <> b.stop_id) WHERE m <= 10000"))
def pl_equivalence(t):
    return transfers.generate(t.stops(), 5000.0, 24, 1.2).where(F.col("type").isin("SameStopGroup", "PlatformAlias")).select("from_id", "to_id")


@query(with_("legs latest", "SELECT l.journey_id, l.idx, CAST(l.dep + coalesce(r.k, 0) AS BIGINT) AS dep, CAST(l.arr + coalesce(r.k, 0) AS BIGINT) AS arr FROM legs l LEFT JOIN latest r ON r.vehicle = l.journey_id"))
def pl_realtime_legs(t):
    r = t.latest().select(F.col("vehicle").alias("journey_id"), "k")
    d = F.coalesce("k", F.lit(0))
    return t.legs().join(r, "journey_id", "left").select("journey_id", "idx", (F.col("dep") + d).alias("dep"), (F.col("arr") + d).alias("arr"))


@query(with_("legs latest", "SELECT DISTINCT journey_id FROM legs WHERE journey_id NOT IN (SELECT vehicle FROM latest WHERE kind IN ('error', 'signup'))"))
def pl_validate(t):
    bad = t.latest().where(F.col("kind").isin("error", "signup")).select(F.col("vehicle").alias("journey_id"))
    return t.legs().select("journey_id").distinct().join(bad, "journey_id", "left_anti")


@query(with_("legs", "SELECT l.journey_id, coalesce(CAST(min(p.p_partkey) AS BIGINT), -1) AS track FROM legs l LEFT JOIN part p ON p.p_partkey = l.origin * 10 + l.destination % 10 GROUP BY 1"))
def lk_preserve_tracks(t):
    p = t.part.select("p_partkey")
    return t.legs().join(p, F.col("origin") * 10 + F.col("destination") % 10 == F.col("p_partkey"), "left").groupBy("journey_id").agg(F.coalesce(F.min("p_partkey"), F.lit(-1)).alias("track"))


@query(with_("calls", "SELECT journey_id, stop_id || '@' || idx AS key FROM calls"), name="fn_stop_key")
def fn_stop_key(t):
    return t.calls().select("journey_id", text.stop_key(F.col("stop_id"), F.col("idx")).alias("key"))
