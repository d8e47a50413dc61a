"""Boards, blocks, plans, tracks and feeds on literal inputs whose results are known."""

import math
import random

import pytest
from pyspark.sql import functions as F

HOUR = 3600


def test_newest_earlier_run_of_a_block_counts(spark):
    """Runs at 0, 1 and 2 hours, late by 2 and 5 minutes: later ones take the newest delay, null blocks nothing."""
    from tramline.operators.board import estimates

    runs = spark.createDataFrame([("b", 1, 0, 120), ("b", 2, HOUR, 300), (None, 9, 0, 600), ("", 8, 0, 600), ("early", 7, 0, -60), ("none", 6, 0, None)], "block string, journey_id long, start long, offset long")
    asked = [("b", 3, 2 * HOUR), ("b", 4, 3 * HOUR), (None, 10, HOUR), ("", 11, HOUR), ("early", 12, HOUR), ("none", 13, HOUR), ("b", 14, 0), ("b", 15, HOUR)]
    rows = spark.createDataFrame([(*x, x[2], True) for x in asked] + [("b", 16, 2 * HOUR, 2 * HOUR, False)], "block string, journey_id long, start long, time long, scheduled boolean")
    got = {r.journey_id: r.estimate for r in estimates(rows, runs, 0, 10 * HOUR).collect()}
    # running early is no delay; a run that starts at the same time is not earlier
    assert got == {3: 300, 4: 300, 10: None, 11: None, 12: 0, 13: None, 14: None, 15: 120, 16: None}
    near = {r.journey_id: r.estimate for r in estimates(rows, runs, 2 * HOUR - 2700).collect()}
    assert near[3] == 300 and near[4] is None and near[15] is None


def test_board_of_a_block(spark):
    """An estimate comes from a run that the board does not show, and is named so even without a delay."""
    from tramline.operators.board import generate

    none = F.array().cast("array<struct<type: string, value: string, description: string>>")
    day = F.array(F.struct(F.lit("Date").alias("type"), F.lit("2026-07-21").alias("value"), F.lit(None).cast("string").alias("description")))
    a = F.struct(day.alias("match"), none.alias("match_secondary"), none.alias("condition"), none.alias("exclude"))
    j = spark.createDataFrame([(1, 1, "b", 1000), (2, 1, "b", 2000), (3, 1, "c", 2000), (4, 1, "c", 900), (5, 1, None, 100), (6, 1, None, 2100)], "journey_id long, service_id long, block string, start long").withColumn("availability", a)
    calls = spark.createDataFrame([(2, 1, 7, 2000, 2000), (3, 1, 7, 2010, 2010), (6, 1, 7, 2100, 2100), (1, 1, 8, 1000, 1000)], "journey_id long, idx int, stop_id long, arr long, dep long")
    rt = spark.createDataFrame([(1, 90, False, False), (4, -30, False, False), (5, 600, False, False)], "journey_id long, offset long, cancelled boolean, suppressed boolean")
    stops = spark.createDataFrame([(7,)], "stop_id long")
    got = [(r.journey_id, r.time, r.type) for r in generate(calls, j, rt, stops, "2026-07-21", 1900).collect()]
    assert got == [(3, 2010, "Estimated"), (2, 2090, "Estimated"), (6, 2100, "Scheduled")]


def test_block_keys(spark):
    from tramline.functions.text import block_key

    df = spark.createDataFrame([("d", "s", "4"), (None, "s", "4"), ("", "s", "4"), ("d", "s", ""), ("d", "s", None), ("s", None, "4")], "d string, s string, b string")
    got = [r[0] for r in df.select(block_key(F.col("d"), F.col("s"), F.col("b"))).collect()]
    assert got == ["dataset\x1fd\x1f4", "service\x1fs\x1f4", "service\x1fs\x1f4", None, None, "dataset\x1fs\x1f4"]


def test_destinations_and_suppression(spark):
    from tramline.operators.board import dedupe, destination_shown, suppressed_on

    legs = spark.createDataFrame([(1, 1, "a", "b", False), (1, 2, "b", "c", True), (1, 3, "c", "d", True), (2, 1, "a", "b", True), (3, 1, "x", "y", None)], "journey_id int, idx int, origin string, destination string, cancelled boolean")
    assert {r.journey_id: r.shown for r in destination_shown(legs).collect()} == {1: "b", 2: "b", 3: "y"}
    assert {r.journey_id: r.shown for r in destination_shown(legs, True).collect()} == {1: "a", 2: "a", 3: "x"}
    on = lambda s, d, day: suppressed_on(F.lit(s), F.lit(d).cast("array<string>") if d is None else F.array(*map(F.lit, d)), F.lit(day))
    got = spark.range(1).select(on(True, ["2026-07-10"], "2026-07-10"), on(True, ["2026-07-10"], "2026-07-11"), on(True, None, "2026-07-11"), on(False, ["2026-07-10"], "2026-07-10")).first()
    assert tuple(got) == (True, False, True, False)
    rows = spark.createDataFrame([("j", 1, 0, 5), ("j", 2, 1, 1), (None, 3, 0, 1), (None, 4, 0, 1)], "journey_id string, row_id int, rank int, time int")
    assert sorted(r.row_id for r in dedupe(rows).collect()) == [1, 3, 4]


def test_tomorrow_fills_a_short_board(spark):
    from tramline.operators.board import fill

    today = spark.createDataFrame([(1, 10), (2, 20)], "journey_id int, time int")
    tomorrow = spark.createDataFrame([(3, 5)], "journey_id int, time int")
    assert sorted(r.time for r in fill(today, tomorrow, 3).collect()) == [10, 20, 86405]
    assert sorted(r.time for r in fill(today, tomorrow, 2).collect()) == [10, 20]


@pytest.mark.parametrize("lat", [0.0, 51.0, 65.0, 69.0, 85.0, -89.95])
def test_neighbours_at_any_latitude(spark, lat):
    from tramline.functions import geo

    rnd = random.Random(1)
    pts = [(i, max(-90.0, lat + rnd.uniform(-0.02, 0.02)), 179.9 + rnd.uniform(-0.1, 0.1) if i % 9 == 0 else rnd.uniform(-0.1, 0.1)) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    m = geo.DEGREE_M
    far = lambda a, b: math.hypot((b[1] - a[1]) * m, (b[2] - a[2]) * m * math.cos(math.radians(a[1])))
    got = sorted((r.from_id, r.to_id) for r in geo.neighbours(df, df, 700.0).collect())
    assert got == sorted((a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and far(a, b) <= 700.0)


CALL = "journey_id long, idx int, stop_id long, arr long, dep long, service_id long"
WALK = "from_id long, to_id long, total_s long, type string, from_route long, to_route long, from_trip long, to_trip long"


def ride(journey, a, b, dep, arr, service=None):
    return [(journey, 1, a, dep, dep, service), (journey, 2, b, arr, arr, service)]


def test_direct_alternatives_and_exclusions(spark):
    from tramline.operators.planner import plan

    calls = spark.createDataFrame([c for i in range(20) for c in ride(i, 1, 2, 10 * HOUR + 60 * i, 10 * HOUR + 60 * i + 1800)], CALL)
    none = spark.createDataFrame([], WALK)
    got = plan(calls, none, 1, 2, 9 * HOUR, count=3).collect()
    assert [r.legs[0].journey_id for r in got] == [0, 1, 2]
    assert [r.legs[0].journey_id for r in plan(calls, none, 1, 2, 9 * HOUR, count=1, excluded=[0]).collect()] == [1]


def test_walks_at_both_ends_and_between(spark):
    """Access, ride, walk, ride, egress: five legs."""
    from tramline.operators.planner import near_point, plan

    stops = spark.createDataFrame([(1, 52.0, 0.0), (2, 52.0, 0.1), (3, 52.0, 0.101), (4, 52.0, 0.2)], "stop_id long, lat double, lon double")
    calls = spark.createDataFrame(ride(1, 1, 2, 9 * HOUR, 9 * HOUR + 1200) + ride(2, 3, 4, 9 * HOUR + 1800, 10 * HOUR), CALL)
    walks = spark.createDataFrame([(2, 3, 90, "Nearby", None, None, None, None)], WALK)
    a, b = near_point(stops, 52.0, 0.0, 500, 1), near_point(stops, 52.0, 0.2005, 500, 1)
    (got,) = plan(calls, walks, a, b, 8 * HOUR, count=1).collect()
    assert [(x.type, x.transfer, x.journey_id) for x in got.legs] == [("transfer", "Access", None), ("ride", None, 1), ("transfer", "Nearby", None), ("ride", None, 2), ("transfer", "Egress", None)]
    assert got.rides == 2 and got.arrival == 10 * HOUR + got.legs[4].arr - got.legs[4].dep and got.start == 9 * HOUR


def test_access_may_go_on_over_another_name(spark):
    from tramline.operators.planner import near_point, plan

    stops = spark.createDataFrame([(1, 52.0, 0.0)], "stop_id long, lat double, lon double")
    calls = spark.createDataFrame(ride(1, 2, 3, 10 * HOUR, 11 * HOUR), CALL)
    at = near_point(stops, 52.0, 0.0, 80, 1)
    for kind, n in (("PlatformAlias", [3]), ("Nearby", [])):
        walks = spark.createDataFrame([(1, 2, 60, kind, None, None, None, None)], WALK)
        assert [len(r.legs) for r in plan(calls, walks, at, 3, 9 * HOUR, count=1).collect()] == n


def test_restricted_transfers(spark):
    """An edge for one service to another is open to these alone, and forbidden edges to nobody."""
    from tramline.operators.planner import plan

    calls = spark.createDataFrame(ride(1, 1, 2, 9 * HOUR, 9 * HOUR + 1800, 10) + ride(2, 3, 4, 10 * HOUR, 11 * HOUR, 20), CALL)
    for edge, n in (((2, 3, 120, "Timed", 10, 20, None, None), 1), ((2, 3, 120, "Timed", 11, 20, None, None), 0), ((2, 3, 120, "Timed", 10, 21, None, None), 0), ((2, 3, 120, "Timed", None, None, 1, 2), 1), ((2, 3, 120, "Timed", None, None, 1, 3), 0), ((2, 3, 120, "Forbidden", None, None, None, None), 0)):
        got = plan(calls, spark.createDataFrame([edge], WALK), 1, 4, 8 * HOUR, count=1).collect()
        assert len(got) == n and all(len(r.legs) == 3 for r in got), edge


def test_states_and_dominance(spark):
    from tramline.operators.planner import LABEL, undominated

    labels = spark.createDataFrame([(1, 600, 1, None, False, None, None, []), (1, 660, 2, None, False, None, None, []), (2, 600, 1, None, False, None, None, []), (2, 600, 2, None, False, None, None, [])], LABEL)
    asked = spark.createDataFrame([(2, 3, 60, "Timed", 5, None, None, None)], WALK)
    assert sorted((r.stop_id, r.last) for r in undominated(labels, asked).collect()) == [(1, 1), (2, 1), (2, 2)]
    assert sorted((r.stop_id, r.time) for r in undominated(labels, None, 2).where("stop_id = 1").collect()) == [(1, 600), (1, 660)]


def test_arrive_by(spark):
    from tramline.operators.planner import arrive_by

    calls = spark.createDataFrame([c for i in range(5) for c in ride(i, 1, 2, 10 * HOUR + 600 * i, 10 * HOUR + 600 * i + 1800)], CALL)
    none = spark.createDataFrame([], WALK)
    assert [r.legs[0].journey_id for r in arrive_by(calls, none, 1, 2, 9 * HOUR, 10 * HOUR + 3000, 1).collect()] == [2]
    assert arrive_by(calls, none, 1, 2, 9 * HOUR, 10 * HOUR, 1).count() == 0


def test_positions_and_cuts(spark):
    from tramline.operators.tracks import journey_positions, ordered_snaps, simplified, split_legs

    import numpy as np

    line = "array<struct<lon: double, lat: double>>"
    track = [(0.0, 51.0), (0.01, 51.0), (0.02, 51.0)]
    rows = spark.createDataFrame([(1, 0.015, 51.0, None, track), (2, 0.015, 51.0, [track[:2], track[1:]], None), (3, 0.0, 0.0, None, None), (4, 0.0, 0.0, [[]], [])], f"journey_id long, lon double, lat double, legs array<{line}>, track {line}")
    got = {r.journey_id: (r.leg, round(r.progress, 2)) for r in journey_positions(rows).collect()}
    assert got == {1: (-1, 0.75), 2: (1, 0.5)}
    # out and back on one street: the order of stops says which way each lies on
    loop = [(0.0, 51.0), (0.02, 51.0), (0.0, 51.0)]
    cases = [(1, [(0.005, 51.0001), (0.015, 51.0), (0.01, 51.0)], loop), (2, [(0.0, 51.0), (0.0, 52.0)], loop), (3, [(0.0, 51.0)], loop), (4, None, None)]
    legs = {r.journey_id: r.legs for r in split_legs(spark.createDataFrame(cases, f"journey_id long, stops {line}, track {line}")).collect()}
    assert [[round(p.lon, 4) for p in x] for x in legs[1]][0][0] == pytest.approx(0.0049, abs=2e-4) and max(p.lon for p in legs[1][1]) == 0.02
    assert [[p.lon for p in x] for x in legs[2]] == [[0.0, 0.02, 0.0]] and legs[3] == [] and legs[4] == []
    away, along = np.array([[1.0, 5.0], [1.0, 2.0]]), np.array([[10.0, 3.0], [4.0, 9.0]])
    assert ordered_snaps(away, along, 50.0).tolist() == [3.0, 4.0] and ordered_snaps(away, along, 0.5) is None
    rnd = random.Random(2)
    for _ in range(50):
        pts = [(rnd.random() * 0.01, 51 + rnd.random() * 0.01) for _ in range(rnd.randint(3, 40))]
        kept = simplified(pts, 100.0)
        assert kept[0] == pts[0] and kept[-1] == pts[-1] and len(simplified(pts, 0.0)) == len(pts)


def test_cheapest_ways(spark):
    from tramline.operators.tracks import cheapest, routes

    rnd = random.Random(3)
    place = {i: (rnd.random() * 1000, rnd.random() * 1000) for i in range(40)}
    edges = {}
    for _ in range(90):
        a, b = rnd.sample(range(40), 2)
        cost = math.dist(place[a], place[b]) * rnd.choice([1.0, 4.0])
        edges.setdefault(a, []).append((b, cost))
        edges.setdefault(b, []).append((a, cost))
    best = {0: 0.0}
    for _ in range(40):
        for a, to in edges.items():
            for b, cost in to:
                if a in best and best[a] + cost < best.get(b, math.inf):
                    best[b] = best[a] + cost
    for goal in place:
        got = cheapest(edges, place, 0, goal)
        assert (got is None) == (goal not in best) and (got is None or got[0] == pytest.approx(best[goal]) and got[1][0] == 0 and got[1][-1] == goal)
    nodes = spark.createDataFrame([(1, 0.0, 51.0), (2, 0.01, 51.0), (3, 0.02, 51.0), (4, 0.01, 51.001)], "node long, lon double, lat double")
    ways = spark.createDataFrame([(1, 2, True), (2, 3, True), (1, 4, False), (4, 3, False)], "a long, b long, service boolean")
    pairs = spark.createDataFrame([(1, 3), (1, 9), (9, 1)], "origin long, destination long")
    assert [(r.origin, r.destination, r.nodes) for r in routes(pairs, nodes, ways).collect()] == [(1, 3, [1, 4, 3])]


def test_hot_identifiers_and_links(spark):
    from tramline.operators.linking import identifier_groups

    rows = [(1, "a"), (1, "b"), (2, "d"), (2, "e"), (3, "b"), (3, "c"), (4, "x"), (5, "c"), (5, "d"), (6, None)] + [(100 + i, "hot") for i in range(900)] + [(100, "y"), (2000, "y")]
    got = {r.record: r.root for r in identifier_groups(spark.createDataFrame(rows, "record long, identifier string")).collect()}
    assert {got[k] for k in (1, 2, 3, 5)} == {1} and got[4] == 4 and 6 not in got and got[999] == got[2000] == 100


def test_subscriptions(spark, monkeypatch):
    from tramline.operators import alerts

    events = spark.createDataFrame([(i, "error" if i % 3 else "view", float(i)) for i in range(60)], "event_id long, event_type string, value double")
    subs = spark.createDataFrame([(1, "error", 10.0), (2, "error", 50.0), (3, "view", 30.0)], "sub_id int, event_type string, threshold double")
    want = sorted((s, i) for s, t, m in ((1, "error", 10), (2, "error", 50), (3, "view", 30)) for i in range(60) if ("error" if i % 3 else "view") == t and i > m)
    assert sorted(tuple(r) for r in alerts.match_subscriptions(events, subs).collect()) == want
    monkeypatch.setattr(alerts, "SMALL", 1)
    assert sorted(tuple(r) for r in alerts.match_subscriptions(events, subs).collect()) == want
    odd = spark.createDataFrame([(1, "error")], "`a.b or 1=1` int, event_type string")
    assert odd.where(alerts.compile_subscription({"any_of": {"a.b or 1=1": [1]}})).count() == 1


def test_upserts_keep_whole_versions(spark, tmp_path):
    from tramline.streaming.vehicles import current, upsert

    path = str(tmp_path / "t")
    assert current(spark, path) is None
    for rows in ([(1, 1, "a")], [(1, 2, "b"), (2, 1, "c")], [(1, 1, "old")]):
        upsert(spark.createDataFrame(rows, "k int, at int, v string"), path, "k", "at")
    assert sorted(tuple(r) for r in current(spark, path).collect()) == [(1, 2, "b"), (2, 1, "c")]
    # a version that was not finished is not read
    (tmp_path / "t" / "v000000000099").mkdir()
    assert current(spark, path).count() == 2 and len(list((tmp_path / "t").glob("v*"))) == 3
