"""The driver's tables seen as claims, payments and rides; the same adapters as Spark columns and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.tables import table

# claims from orders, payments from lineitem, rides from events
CLAIMS_SQL = "select o_orderkey as inv_id, o_custkey as batch, o_totalprice as inv_amount, cast(o_orderdate as date) as inv_date from orders"
PAYMENTS_SQL = """select cast(l_orderkey as varchar) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as pay_id, l_extendedprice as pay_amount,
  l_extendedprice + l_extendedprice * l_discount as pay_total, l_shipdate as pay_time, l_suppkey as supp, l_linenumber as line_no, l_returnflag as flag, l_orderkey as order_key from lineitem"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("inv_id"), F.col("o_custkey").alias("batch"), F.col("o_totalprice").alias("inv_amount"), F.to_date("o_orderdate").alias("inv_date"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(key.alias("pay_id"), F.col("l_extendedprice").alias("pay_amount"), (F.col("l_extendedprice") + F.col("l_extendedprice") * F.col("l_discount")).alias("pay_total"), F.col("l_shipdate").alias("pay_time"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("order_key"), key.alias("pay_pos"))


def rides(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """Every other event as a ride (part 0) or as a payment of the same user (part 1)."""
    e = table(spark, sf_dir, "events").filter(F.col("event_id") % 2 == part)
    if part:
        return e.select("user_id", F.col("event_id").alias("pay_id"), F.col("ts").alias("pay_time"), F.col("value").alias("pay_amount"), F.col("event_id").alias("pay_pos"))
    return e.select("user_id", F.col("event_id").alias("ride_id"), F.col("ts").alias("ride_time"), F.col("value").alias("ride_amount"))


RIDES_SQL = "select user_id, event_id as ride_id, ts as ride_time, value as ride_amount from events where event_id % 2 = 0"
RIDE_PAY_SQL = "select user_id, event_id as pay_id, ts as pay_time, value as pay_amount from events where event_id % 2 = 1"
