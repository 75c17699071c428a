"""Registry of named queries over the driver tables, each with its SQL counterpart.

The driver tables stand in for plant data: ``events`` are sensor readings of two plants, ``lineitem``
and ``orders`` are flows, ``embeddings`` are vectors, ``documents`` are payloads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MICROS, epoch_us, floor_to, time_bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BUCKET_S = 6 * 3600
DAY_US = 86_400 * MICROS
CLASSES = ["replay", "ddos", "port-scan", "mitm", "ip-scan"]
SENSORS = ["click", "error", "purchase", "signup", "view"]


class Tables:
    """The driver tables of one folder and the views of them that the queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def readings(self) -> DataFrame:
        e = self.events
        return e.select(
            F.col("event_id").alias("row_id"), (F.col("user_id") % 2).cast("string").alias("series"),
            F.col("event_type").alias("sensor"), epoch_us(e, "ts").alias("t_us"), "value",
        )

    @property
    def bucketed(self) -> DataFrame:
        return self.readings.withColumn("bucket", time_bucket(F.col("t_us"), BUCKET_S))

    @property
    def windows(self) -> DataFrame:
        """One attack window per day: it starts with the day's first large error reading."""
        start = (
            self.readings.filter("sensor = 'error' AND value > 100")
            .groupBy((floor_to(F.col("t_us"), DAY_US) / DAY_US).cast("long").alias("win_id"))
            .agg(F.min("t_us").alias("start_us"))
        )
        kinds = F.array(*[F.lit(c) for c in CLASSES])
        lengths = F.array(*[F.lit(s) for s in (5, 1800, 10800, 28800)])
        day = F.col("win_id")
        return start.select(
            "win_id", F.get(kinds, (day % 5).cast("int")).alias("attack"), "start_us",
            (F.col("start_us") + F.get(lengths, (day % 4).cast("int")).cast("long") * MICROS).alias("end_us"),
        )

    @property
    def flows(self) -> DataFrame:
        li = self.lineitem
        return li.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("flow_id"),
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            epoch_us(li, "l_shipdate").alias("t_us"),
        )


READINGS = """readings AS (
  SELECT event_id AS row_id, CAST(user_id % 2 AS VARCHAR) AS series, event_type AS sensor,
         epoch_us(ts) AS t_us, value FROM events)"""
BUCKETED = READINGS + """, bucketed AS (
  SELECT *, (t_us // 21600000000) * 21600 AS bucket FROM readings)"""
WINDOWS = READINGS + """, windows AS (
  SELECT win_id, ['replay','ddos','port-scan','mitm','ip-scan'][win_id % 5 + 1] AS attack, start_us,
         start_us + CAST([5, 1800, 10800, 28800][win_id % 4 + 1] AS BIGINT) * 1000000 AS end_us
  FROM (SELECT t_us // 86400000000 AS win_id, min(t_us) AS start_us FROM readings
        WHERE sensor = 'error' AND value > 100 GROUP BY 1))"""
FLOWS = """flows AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flow_id, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) AS t_us
  FROM lineitem)"""
FLOW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under an operator's name."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(col: Column | str, digits: int = 6, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits).alias(name or col)
