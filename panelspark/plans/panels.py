"""Panels derived from the given tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue in millions per order priority and month; whole cents are summed, so it is exact."""
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc("o_orderdate", "month").alias("date"),
        )
        .agg((F.sum(_cents("o_totalprice")) / F.lit(1e8)).alias("target"))
    )


MONTHLY = """panel AS (
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 1e8 AS target
  FROM orders GROUP BY 1, 2)"""


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue in millions per market segment and Monday week."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(
            F.col("c_mktsegment").alias("series_id"),
            F.trunc("o_orderdate", "week").alias("date"),
        )
        .agg((F.sum(_cents("o_totalprice")) / F.lit(1e8)).alias("target"))
    )


WEEKLY = """panel AS (
  SELECT c_mktsegment AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
         sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 1e8 AS target
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Discounted revenue in hundreds per return flag and ship day."""
    value = _cents("l_extendedprice") * (F.lit(100) - F.round(F.col("l_discount") * 100).cast("bigint"))
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date"))
        .agg((F.sum(value) / F.lit(1e6)).alias("target"))
    )


DAILY = """panel AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)
             * (100 - CAST(round(l_discount * 100) AS BIGINT)))::DOUBLE / 1e6 AS target
  FROM lineitem GROUP BY 1, 2)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Total event value per event type and hour."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("date"))
        .agg((F.sum(_cents("value")) / F.lit(1e2)).alias("target"))
    )


HOURLY = """panel AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS date,
         sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 1e2 AS target
  FROM events GROUP BY 1, 2)"""

PANELS = {"monthly": (monthly, MONTHLY), "weekly": (weekly, WEEKLY), "daily": (daily, DAILY), "hourly": (hourly, HOURLY)}

POS = """pos AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos,
         count(*) OVER (PARTITION BY series_id) AS n FROM panel)"""

# 0.70 / 0.20 / 0.10 with horizon 3
SPLIT = """sized AS (
  SELECT *, CAST(floor(n * 2e-1) AS BIGINT) // 3 * 3 AS n_val, CAST(floor(n * 1e-1) AS BIGINT) // 3 * 3 AS n_test FROM pos),
parts AS (
  SELECT series_id, date, target, pos, n, n_val, n_test, n - n_val - n_test AS n_train,
         CASE WHEN pos < n - n_val - n_test THEN 'train' WHEN pos < n - n_test THEN 'validation' ELSE 'test' END AS split
  FROM sized)"""


def with_sql(*parts: str, tail: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + tail
