"""Readers on small feeds, and streams that run until their files are read."""

import os

import pytest
from pyspark.sql import functions as F

GTFS = {
    "agency": "agency_id,agency_name,agency_timezone\na1,Buses,Europe/London\n",
    "stops": "﻿stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station,platform_code\nS,Station,51.0,0.0,1,,\nP1,Station 1,51.0,0.001,0,S,1\nX,Stop X,51.1,0.1,,,\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nr1,a1,1,One,3\nr2,a1,,Two,109\n",
    "trips": "trip_id,route_id,service_id,block_id,direction_id\nt1,r1,wk,b1,0\nt2,r2,ex,,1\n",
    "stop_times": "trip_id,stop_sequence,stop_id,arrival_time,departure_time,pickup_type,drop_off_type\nt1,2,X,6:30:00,6:30:00,1,0\nt1,1,P1,06:00:00,06:00:00,0,1\nt2,5,P1,25:10:00,25:11:00,,\nt2,7,X,25:30:00,25:30:00,,\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20260701,20260731\n",
    "calendar_dates": "service_id,date,exception_type\nwk,20260710,2\nwk,20260711,1\nex,20260801,1\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nt1,06:10:00,07:00:00,900\nt1,06:30:00,08:00:00,900\nt1,07:00:00,07:10:00,900\n",
    "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nP1,X,2,120\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns,51.1,0.1,2\ns,51.0,0.0,1\n",
}


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    top = tmp_path_factory.mktemp("gtfs")
    for name, body in GTFS.items():
        (top / f"{name}.txt").write_text(body, encoding="utf-8")
    return str(top)


def test_gtfs(spark, feed):
    from tramline.functions.calendar import match_date
    from tramline.sources import gtfs, registry

    stops = {r.stop_id: r for r in gtfs.stops(spark, feed, "d").collect()}
    assert set(stops) == {"d-stop-S", "d-stop-X"} and [p.name for p in stops["d-stop-S"].platforms] == ["1"]
    assert {(r.name, r.transport_type) for r in gtfs.services(spark, feed, "d").collect()} == {("1", "Bus"), ("Two", "Rail")}
    calls = {(r.journey_id, r.idx): (r.stop_id, r.arr, r.dep, r.activities) for r in gtfs.calls(spark, feed, "d").collect()}
    assert calls["d-journey-t1", 1] == ("d-stop-P1", 21600, 21600, ["Pickup"]) and calls["d-journey-t2", 1][2] == 90660
    j = gtfs.journeys(spark, feed, "d")
    starts = sorted(r.start for r in j.where("service_id = 'd-service-r1'").collect())
    assert [x // 60 for x in starts] == [370, 385, 400, 415, 420]  # the overlapping window is dropped, the adjacent one not
    runs = lambda day: {r.service_id for r in j.where(match_date(F.col("availability"), F.lit(day).cast("date"))).collect()}
    assert runs("2026-07-09") == {"d-service-r1"} and runs("2026-07-10") == set() and runs("2026-07-11") == {"d-service-r1"} and runs("2026-07-12") == set()
    assert runs("2026-08-01") == {"d-service-r2"} and runs("2026-08-03") == set()
    t = gtfs.transfers(spark, feed, "d").first()
    assert (t.type, t.total_s, t.from_route) == ("MinimumTime", 120, None)
    assert [(p.lat, p.lon) for p in gtfs.tracks(spark, feed).first().points] == [(51.0, 0.0), (51.1, 0.1)]
    assert gtfs.read(spark, feed, "translations").count() == 0
    (d,) = registry.datasets([{"identifier": "src", "provider": {"name": "p"}, "datasets": [{"identifier": "x", "format": "gtfs-schedule"}]}])
    assert d.identifier == "src-x" and d.provider == {"name": "p"} and d.supported["stops"] and not d.supported["journey_tracks"]
    assert set(registry.read(spark, d, feed)) == {"operators", "stops", "services", "journeys"}
    with pytest.raises(ValueError):
        registry.read(spark, registry.Dataset("a", "no-such-format"), feed)
    assert registry.fresh(100, 50, 120) and not registry.fresh(100, 50, 120, True) and not registry.fresh(None, 50, 120)


def line(width=80, **at):
    out = [" "] * width
    for k, v in at.items():
        i = int(k[1:]) - 1
        out[i : i + len(v)] = v
    return "".join(out)


def test_cif(spark, tmp_path):
    from tramline.sources import feeds

    def train(stp, first, last, uid="A12345"):
        return [line(_1="BS", _3="N", _4=uid, _10=first, _16=last, _22="1111100", _31="OO", _80=stp), line(_1="BX", _12="GW")]

    rows = ["HD" + " " * 78, *train("P", "260701", "260731"), line(_1="LO", _3="PADTON", _11="0900 ", _16="0900", _20="4"), line(_1="LI", _3="RDNGSTN", _11="0925 ", _16="0926 ", _26="0925", _30="0926"), line(_1="LT", _3="OXFD", _11="0955 ", _16="0955")]
    rows += train("C", "260710", "260710")[:1] + train("O", "260715", "260716") + [line(_1="LO", _3="PADTON", _11="0910 ", _16="0910"), line(_1="LT", _3="OXFD", _11="1000 ", _16="1000"), "ZZ"]
    (tmp_path / "a.mca").write_text("\n".join(rows))
    s = feeds.cif_schedules(spark, str(tmp_path / "a.mca"))
    assert s.count() == 3
    got = {r.stp: r for r in feeds.cif_resolved(s).collect()}
    assert got["P"].exclude == ["2026-07-10:2026-07-10", "2026-07-15:2026-07-16"] and got["O"].exclude == []
    assert [(c.location, c.public_arrival, c.public_departure) for c in got["P"].calls] == [("PADTON", "", "0900"), ("RDNGSTN", "0925", "0926"), ("OXFD", "0955", "")]


def test_xml_and_json(spark, tmp_path):
    from tramline.sources import feeds

    vm = "<S>" + "".join(f"<VehicleActivity><RecordedAtTime>2026-07-10T{t}:00Z</RecordedAtTime><MonitoredVehicleJourney><LineRef>1</LineRef><OperatorRef>OP</OperatorRef><VehicleRef>{v}</VehicleRef><VehicleLocation><Longitude>0.5</Longitude><Latitude>51.5</Latitude></VehicleLocation></MonitoredVehicleJourney></VehicleActivity>" for t, v in (("11:50", "v1"), ("11:00", "v2"))) + "</S>"
    (tmp_path / "vm.xml").write_text(vm)
    got = feeds.siri_vm(spark, str(tmp_path / "vm.xml"), "2026-07-10 12:00:00").collect()
    assert [(r.vehicle, r.lon) for r in got] == [("v1", 0.5)] and got[0].local_id.startswith("SIRI-VM:OP:1:")
    (tmp_path / "n.xml").write_text('<N><StopPoint Status="active"><AtcoCode>490</AtcoCode><NaptanCode>abc</NaptanCode><Descriptor><CommonName>High St</CommonName><Indicator>Stop A</Indicator></Descriptor><StopClassification><StopType>BCT</StopType></StopClassification></StopPoint></N>')
    s = feeds.naptan_stops(spark, str(tmp_path / "n.xml")).first()
    assert (s.stop_id, s.other_ids, s.name, s.active) == ("gb-atco-490", ["gb-atco-490", "gb-naptan-abc"], "High St (Stop A)", True)
    (tmp_path / "c.json").write_text('{"TIPLOCDATA": [{"NLC": 1, "STANOX": "12", "TIPLOC": "ABC ", "3ALPHA": " "}, {"NLC": 2, "STANOX": "", "TIPLOC": "X", "3ALPHA": "XXX"}]}')
    assert [r.other_ids for r in feeds.corpus(spark, str(tmp_path / "c.json"), "d").collect()] == [["gb-stanox-12", "gb-tiploc-ABC"]]
    rt = spark.createDataFrame([('{"id": "1", "vehicle": {"trip": {"tripId": "t"}, "timestamp": 1783684800, "occupancyStatus": "FULL"}}',), ('{"id": "2", "vehicle": {"timestamp": 1}}',)], "value string")
    assert [(r.id, r.occupancy) for r in feeds.gtfs_rt(rt, "2026-07-10 12:10:00").collect()] == [("1", 100)]


def test_streams(spark, tmp_path):
    from tramline.operators.realtime import diff_events
    from tramline.plans.base import Tables
    from tramline.streaming.vehicles import current, rates, track, upsert

    m = Tables(spark, "/root/testdata/sf0.001").messages()
    src = str(tmp_path / "in")
    m.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(m.schema).parquet(src)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = sorted(tuple(r) for r in run(track(stream, None), "changes").collect())
    assert got == sorted(tuple(r) for r in diff_events(m).select("vehicle", "event_id", "change").collect())
    whole = run(rates(stream), "rates", "complete")
    assert whole.agg(F.sum("n")).first()[0] == m.count()
    table = str(tmp_path / "state")
    for part in (m.where("event_id % 2 = 0"), m.where("event_id % 2 = 1"), m.where("event_id % 2 = 1")):
        upsert(part.select("vehicle", "ts", "event_id"), table, "vehicle", "ts")
    assert current(spark, table).count() == m.select("vehicle").distinct().count()
    assert os.path.exists(table)
