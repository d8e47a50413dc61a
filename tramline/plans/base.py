"""Registry of queries, and how the domain's tables are read from the driver's.

orders are journeys, customers services, nations operators, suppliers stops,
line items the calls of journeys, events realtime messages of vehicles.  Each
mapping is given twice, as a frame and as SQL, from the same integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.session import ready

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Moments and days that queries take as their present; the tables' dates hold them.
NOW, TODAY = "2024-01-20 12:00:00", "1998-03-02"

CTE = {
    "stops": "SELECT s_suppkey AS stop_id, s_name AS name, s_nationkey AS group_id, 50 + ((s_suppkey * 7919) % 1000) / 1000.0 AS lat, -1 + ((s_suppkey * 104729) % 1000) / 1000.0 AS lon FROM supplier",
    "calls": "SELECT l_orderkey AS journey_id, l_linenumber AS idx, min(l_suppkey) AS stop_id, (l_orderkey * 97) % 86400 + l_linenumber * 600 + min(l_partkey) % 300 AS arr, (l_orderkey * 97) % 86400 + l_linenumber * 600 + min(l_partkey) % 300 + 60 AS dep FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "legs": "SELECT * FROM (SELECT journey_id, idx, stop_id AS origin, lead(stop_id) OVER w AS destination, dep, lead(arr) OVER w AS arr FROM calls WINDOW w AS (PARTITION BY journey_id ORDER BY idx)) WHERE destination IS NOT NULL",
    "journeys": "SELECT o_orderkey AS journey_id, o_custkey AS service_id, o_orderstatus AS kind, CAST(o_orderdate AS DATE) AS day, (o_orderkey * 97) % 86400 AS start, o_orderkey % 50 AS block FROM orders",
    "services": "SELECT c_custkey AS service_id, c_name AS name, c_mktsegment AS kind, c_nationkey AS operator_id FROM customer",
    "messages": "SELECT event_id, user_id AS vehicle, ts, event_type AS kind, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY ts DESC, event_id DESC) AS rn FROM messages) WHERE rn = 1",
}
NEEDS = {"legs": ["calls"], "latest": ["messages"]}


def with_(names: str, body: str) -> str:
    """SQL over some of the mapped tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in order)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


class Tables:
    """The driver's tables by name, and the domain's tables made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def stops(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(k.alias("stop_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("group_id"), (50 + ((k * 7919) % 1000) / 1000.0).alias("lat"), (-1 + ((k * 104729) % 1000) / 1000.0).alias("lon"))

    def calls(self) -> DataFrame:
        start = (F.col("l_orderkey") * 97) % 86400 + F.col("l_linenumber") * 600
        one = self.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("stop_id"), F.min("l_partkey").alias("p"))
        return one.select(F.col("l_orderkey").alias("journey_id"), F.col("l_linenumber").alias("idx"), "stop_id", (start + F.col("p") % 300).alias("arr"), (start + F.col("p") % 300 + 60).alias("dep"))

    def legs(self) -> DataFrame:
        from tramline.operators.journeys import leg_pairs

        return leg_pairs(self.calls())

    def journeys(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.read("orders").select(k.alias("journey_id"), F.col("o_custkey").alias("service_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").cast("date").alias("day"), ((k * 97) % 86400).alias("start"), (k % 50).alias("block"))

    def services(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("service_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("operator_id"))

    def messages(self) -> DataFrame:
        return self.read("events").select("event_id", F.col("user_id").alias("vehicle"), "ts", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))

    def latest(self) -> DataFrame:
        from tramline.operators.realtime import latest_state

        return latest_state(self.messages(), "vehicle", ["ts", "event_id"])


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its own name, with the SQL it must equal."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in REGISTRY:
            raise ValueError(f"{key} is registered twice")
        REGISTRY[key] = lambda spark, sf_dir: f(Tables(ready(spark), sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add
