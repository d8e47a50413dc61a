"""Railway feeds, places and alerts by hand."""

import math

from pyspark.sql import functions as F

from tramline.operators import alerts, linking, places, railway


def test_deleted_and_cancelled(spark):
    s = spark.sql("select * from values ('A', date'2024-01-05', date'2024-01-09', '1111100'), ('B', date'2024-01-06', date'2024-01-07', '1111100'), ('C', date'2024-01-02', date'2024-01-01', '1111111'), ('D', null, date'2024-01-01', null) t(uid, first, last, days)")
    got = {r.uid: r.identifiers for r in railway.deleted(s).collect()}
    assert got == {"A": ["DAYINSTANCEOF:2024-01-05:A", "DAYINSTANCEOF:2024-01-08:A", "DAYINSTANCEOF:2024-01-09:A"]}
    j = spark.sql("select * from values ('A', date'2024-01-08', 'j1'), ('A', date'2024-01-08', 'j1'), ('A', date'2024-01-06', 'j2') t(uid, date, journey_id)")
    assert [(r.journey_id, str(r.until)) for r in railway.cancelled(s, j, "2024-01-10 00:00:00").collect()] == [("j1", "2024-01-11 00:00:00")]
    assert railway.cancelled(s, j, "2024-01-11 00:00:00").count() == 0
    assert railway.deleted(s.limit(0)).count() == 0


def test_door_side(spark):
    rows = [
        ((0, 1), (0, 1), (-3, 0), False, "Left", 0.92),
        ((0, -1), (0, 1), (-3, 0), False, "Left", 0.92),
        ((0, 1), (0, 1), (3, 0), False, "Right", 0.92),
        ((0, 1), (1, 0), (3, 0), False, "Unknown", None),
        ((0, 1), (0, 1), (0.1, 0), False, "Unknown", None),
        ((0, 1), (0, 1), (0, 5), False, "Unknown", None),
        ((0, 1), (0, 1), (31, 0), False, "Unknown", None),
        ((0, 1), (0, 1), (31, 0), True, "Right", 0.92),
        ((0, 0), (0, 1), (3, 0), False, "Unknown", None),
        ((1, 1), (0, 1), (3, 0), False, "Right", round(0.72 + 0.2 / math.sqrt(2), 2)),
    ]
    df = spark.createDataFrame([(*map(float, a + b + c), d, e, f) for a, b, c, d, e, f in rows], "a double, b double, c double, d double, e double, f double, g boolean, side string, sure double")
    got = df.select("side", "sure", railway.door_side(*[F.col(x) for x in "abcdefg"]).alias("r")).collect()
    assert [(r.r.side, r.r.confidence) for r in got] == [(r.side, r.sure) for r in got]


def test_consists(spark):
    ids = spark.createDataFrame([("1A23C123450930",), ("short",), (None,)], "core string").select(railway.train_identifier(F.col("core")).alias("i")).collect()
    assert [tuple(r.i) for r in ids] == [("1A23", "C12345", "09"), ("", "", ""), ("", "", "")]
    cars = [("x power", "", 5, "800", 0), ("loco", "", 0, "800", 0), ("loco", "", 5, "800", 0), ("", "pp", None, None, None), ("", "", 0, "755/4", 9000), ("", "", 0, "755/4", 10000), (None, None, None, None, None)]
    df = spark.createDataFrame(cars, "k string, s string, n int, f string, l int")
    assert [r.p for r in df.select(railway.power_car(*[F.col(c) for c in "ksnfl"]).alias("p")).collect()] == [True, True, False, True, True, False, False]
    c = spark.createDataFrame([("t", "1", "Buffet", 3), ("t", "2", None, None)], "train string, id string, role string, occupancy int")
    n = spark.createDataFrame([("t", "1", 1, 10), ("t", "1", 2, 20), ("t", "9", 1, 5)], "train string, id string, seq int, occupancy int")
    got = {r.id: (r.role, r.occupancy) for r in railway.merged_loading(c, n).collect()}
    assert got == {"1": ("Buffet", 20), "2": ("Passenger", None), "9": ("Passenger", 5)}


def test_places(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, False), (None, None, None), (False, False, True)], "r boolean, s boolean, u boolean")
    got = df.select(places.parking(role=F.col("r"), station=F.col("s"), unrelated=F.col("u")).alias("p")).collect()
    assert [(r.p.score, r.p.kind, float(r.p.confidence)) for r in got] == [(8, "Official", 0.95), (4, "Likely", 0.8), (0, "Nearby", 0.55), (-4, "Unrelated", 0.2)]
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "element string")
    m = spark.createDataFrame([("a", "mine"), ("b", "mine"), ("b", "other"), ("c", "other")], "element string, area string")
    assert {r.element for r in places.of_area(e, m, m.where("area = 'mine'").select("area").distinct()).collect()} == {"a", "b", "d"}
    w = spark.createDataFrame([(1, 1, 5, 2), (1, 2, 6, 2), (1, 3, 6, 2), (2, 1, 6, 1), (2, 2, 5, 1)], "way int, seq int, node int, cost int")
    assert [tuple(r) for r in places.rail_edges(w).collect()] == [(5, 6, 1)]


def test_alerts(spark):
    df = spark.createDataFrame([("Service Closed", True, 2), ("Service Closed", True, 12), ("Good Service", True, 12), ("Part Closed", True, 12), ("Part Closed", False, 12), ("odd", True, 12)], "s string, v boolean, h int")
    got = [r.t for r in df.select(alerts.line_alert(F.col("s"), F.col("v"), F.col("h")).alias("t")).collect()]
    assert got == [None, "ServiceSuspended", None, "ServicePartSuspended", None, "Information"]
    refs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("identifier")) for k, i in (("stop", "gb:s 1+~"), ("service", "v"), ("journey", "j"))])
    df = spark.createDataFrame([(["v", "gb:s 1+~"],), (["DAYINSTANCEOF:2024-01-02:j"],), (["DAYINSTANCEOF:2024-01-02:v"],), (["j"],), ([],)], "ids array<string>")
    r = alerts.alert_reference(F.col("ids"), refs)
    got = [x.p for x in df.select(alerts.target_path(r["kind"], r["identifier"], r["date"]).alias("p")).collect()]
    assert got == ["/stops/gb:s%201+~", "/journeys/j?date=2024-01-02", "", "/journeys/j", ""]


def test_reaching(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 7), (None, 3), (1, 2)], "origin int, destination int")
    s = spark.createDataFrame([(3,), (3,), (None,), (9,)], "stop_id int")
    assert {r.stop_id for r in linking.reaching(s, e).collect()} == {1, 2, 3, 4, 5, 9}
    assert linking.reaching(s.limit(0), e).count() == 0
