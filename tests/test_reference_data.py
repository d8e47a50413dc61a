"""Readers of reference data in XML."""

from pyspark.sql import functions as F

from tramline.sources import reference as r

NOC = """<T><NOCTable><NOCTableRecord><NOCCODE>ABCD</NOCCODE><OperatorPublicName>Buses</OperatorPublicName><VOSA_PSVLicenseName>Buses Ltd</VOSA_PSVLicenseName><OpId>1</OpId><PubNmId>9</PubNmId></NOCTableRecord></NOCTable>
<NOCLines><NOCLinesRecord><NOCCODE>ABCD</NOCCODE><PubNm>Buses</PubNm><Mode>Bus</Mode><LO>x</LO><SE>x</SE></NOCLinesRecord></NOCLines>
<Operators><OperatorsRecord><OpId>1</OpId><OpNm>Buses Ltd</OpNm><ManDivId>5</ManDivId></OperatorsRecord></Operators>
<ManagementDivisions><ManagementDivisionsRecord><ManDivId>5</ManDivId><GpId>7</GpId></ManagementDivisionsRecord></ManagementDivisions>
<Groups><GroupsRecord><GpId>7</GpId><GpNme>Group</GpNme></GroupsRecord></Groups>
<PublicName><PublicNameRecord><PubNmId>9</PubNmId><Website>Buses#http://buses.example#</Website></PublicNameRecord></PublicName></T>"""
SX = """<S><PtSituationElement><SituationNumber>1</SituationNumber><ValidityPeriod><StartTime>2026-07-01T00:00:00Z</StartTime><EndTime>{end}</EndTime></ValidityPeriod><Summary>Closed</Summary><Description>Road</Description><Consequences><Consequence><Severity>severe</Severity><Affects><Networks><AffectedNetwork><AffectedLine><AffectedOperator><OperatorRef>OP</OperatorRef></AffectedOperator><LineRef>5</LineRef></AffectedLine></AffectedNetwork></Networks><StopPoints><AffectedStopPoint><StopPointRef>490</StopPointRef></AffectedStopPoint></StopPoints></Affects></Consequence></Consequences></PtSituationElement></S>"""


def test_operators(spark, tmp_path):
    (tmp_path / "n.xml").write_text(NOC)
    o = r.noc_operators(spark, str(tmp_path / "n.xml")).first()
    assert (o.operator_id, o.name, o.other_names, o.group_id, o.regions, o.website) == ("gb-noc-ABCD", "Buses", ["Buses Ltd"], "gb-nocgroup-7", ["London", "SouthEast"], "http://buses.example")
    assert r.noc_groups(spark, str(tmp_path / "n.xml")).first().name == "Group"
    (tmp_path / "t.xml").write_text("<L><TrainOperatingCompany><AtocCode>GW</AtocCode><Name>Great</Name><LegalName>Great Ltd</LegalName><CustomerService><PostalAddress><Line>1 St</Line><Line>Town</Line><PostCode>AB1</PostCode></PostalAddress></CustomerService></TrainOperatingCompany></L>")
    t = r.train_companies(spark, str(tmp_path / "t.xml")).first()
    assert (t.operator_id, t.address) == ("gb-toc-GW", "1 St, Town, AB1")


def test_situations(spark, tmp_path):
    for name, end in (("open", ""), ("ended", "2026-07-02T00:00:00Z"), ("later", "2026-08-02T00:00:00Z")):
        (tmp_path / f"{name}.xml").write_text(SX.format(end=end))
    n = lambda name, flag=False: r.siri_sx(spark, str(tmp_path / f"{name}.xml"), "d", "2026-07-10 00:00:00", flag).count()
    assert (n("open"), n("ended"), n("later")) == (1, 0, 1) and (n("open", True), n("ended", True)) == (0, 1)
    a = r.siri_sx(spark, str(tmp_path / "later.xml"), "d", "2026-07-10 00:00:00").first()
    assert a.type == "Warning" and [tuple(x) for x in a.concerns] == [("5", "OP", None), (None, None, "490")]


def test_transxchange(spark):
    from tramline.functions.calendar import match_date

    links = spark.createDataFrame([("p", 1, "A", "B", "PT5M", None, "PT1M"), ("p", 2, "B", "C", "PT1H2M3S", "PT30S", None)], "pattern_id string, seq int, from_stop string, to_stop string, run string, from_wait string, to_wait string")
    journeys = spark.createDataFrame([("j", "p", "23:00:00")], "journey_id string, pattern_id string, departure string")
    got = sorted(tuple(x) for x in r.txc_calls(links, journeys).collect())
    assert got == [("j", 1, "A", 82800, 82800), ("j", 2, "B", 83100, 83190), ("j", 3, "C", 86913, 86913)]
    df = spark.createDataFrame([(["MondayToSatuday"], ["2026-07-12:2026-07-12"], ["2026-07-10:2026-07-10"])], "d array<string>, o array<string>, n array<string>")
    a = r.txc_availability(F.col("d"), F.col("o"), F.col("n"), F.lit("2026-07-01"), F.lit(None))
    on = lambda day: df.select(match_date(a, F.lit(day).cast("date"))).first()[0]
    assert [on(x) for x in ("2026-06-30", "2026-07-09", "2026-07-10", "2026-07-11", "2026-07-12", "2026-07-19")] == [False, True, False, True, True, False]


def test_insert_records(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    got = r.insert_records(t, spark.createDataFrame([(2, "c"), (3, "d")], "id int, name string"), "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
