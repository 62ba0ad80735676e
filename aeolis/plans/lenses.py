"""The driver's tables seen as station panels, in Spark and in SQL.

Series lens: `events` as one series a user, with gaps where the event is an error. Join lens:
`orders` as measurements of customers, nations and regions as districts and cities, shipments
as weather and forecasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import CITY_ALIASES, DISTRICT_ALIASES, STATION_ALIASES
from ..sources.tables import dimension

TYPES = ("click", "view", "purchase", "signup", "error")
ORDER = ("Datetime", "event_id")
CUTS = ("2024-01-20", "2024-01-25")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("station_id"),
        F.col("ts").cast("timestamp_ntz").alias("Datetime"),
        "event_id",
        "event_type",
        "value",
        F.when(F.col("event_type") != "error", F.col("value")).alias("y"),
        *(F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in TYPES),
    )


#: The same in SQL, as the first of a list of WITH tables; w names the order within a station.
SERIES = (
    'WITH s AS (SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS "Datetime", event_id, event_type, value, '
    "CASE WHEN event_type <> 'error' THEN value END AS y, "
    + ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS \"{t}\"" for t in TYPES)
    + " FROM events)"
)
BY_TIME = 'PARTITION BY station_id ORDER BY "Datetime", event_id'
SPLIT = (
    "CASE WHEN \"Datetime\" <= TIMESTAMP '2024-01-20' THEN 'train' WHEN \"Datetime\" <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END"
)


def air(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("station_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("Datetime"), F.col("o_totalprice").alias("y"), "o_orderkey")


def geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stations, districts and cities, under headers as raw files have them."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = lambda key: F.concat(F.lit(" d"), F.col(key).cast("string")).alias("District ID")
    t = lambda key: F.concat(F.lit("c"), F.col(key).cast("string")).alias("city")
    return (
        dimension(c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("Station ID"), d("c_nationkey")), STATION_ALIASES, ["station_id", "district_id"]),
        dimension(n.select(d("n_nationkey"), t("n_regionkey")), DISTRICT_ALIASES, ["district_id", "city_id"]),
        dimension(r.select(t("r_regionkey")), CITY_ALIASES, ["city_id"]),
    )


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, n = (load(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    placed = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return placed.withColumn("Datetime", F.col("l_shipdate").cast("timestamp_ntz"))


def _by_place(rows: DataFrame) -> DataFrame:
    """Each shipment as a row of its nation (even ones only) and of its region, in one pass."""
    district = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("d"), F.col("s_nationkey").cast("string")))
    city = F.concat(F.lit("c"), F.col("n_regionkey").cast("string"))
    return rows.withColumn("geo_id", F.explode(F.array(district, city))).where("geo_id is not null")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geo_id, Datetime, temperature, humidity) by district (even nations only) and by city."""
    rows = _by_place(_shipments(spark, sf_dir).select("Datetime", "s_nationkey", "n_regionkey", "l_quantity", "l_discount"))
    return rows.groupBy("geo_id", "Datetime").agg(F.avg("l_quantity").alias("temperature"), F.avg("l_discount").alias("humidity"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geo_id, Datetime, time_forecast, up_temperature) by district (even nations only) and by city."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("time_forecast"))
    rows = _by_place(_shipments(spark, sf_dir).join(o, "l_orderkey"))
    return rows.select("geo_id", "Datetime", "time_forecast", F.col("l_extendedprice").alias("up_temperature"))


AIR = """WITH air AS (
  SELECT CAST(o_custkey AS VARCHAR) AS station_id, o_orderdate AS "Datetime", o_totalprice AS y, o_orderkey,
         'd' || c_nationkey AS district_id, 'c' || n_regionkey AS city_id
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
), ship AS (
  SELECT l.*, s_nationkey, n_regionkey, l_shipdate AS "Datetime", o_orderdate AS time_forecast
  FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey LEFT JOIN orders ON o_orderkey = l_orderkey
), met_d AS (
  SELECT 'd' || s_nationkey AS geo_id, "Datetime", avg(l_quantity) AS temperature, avg(l_discount) AS humidity FROM ship WHERE s_nationkey % 2 = 0 GROUP BY ALL
), met_c AS (SELECT 'c' || n_regionkey AS geo_id, "Datetime", avg(l_quantity) AS temperature, avg(l_discount) AS humidity FROM ship GROUP BY ALL)"""
