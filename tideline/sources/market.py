"""Market tables derived from the given relational tables.

Ticks are reduced to one row per (key, day) with mergeable aggregates (``min_by``/``max_by`` over the
total order), so the map side combines a hot key before the shuffle and the result of any key is
bounded by the number of calendar days, whatever share of the ticks that key holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.frames import Col, col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(
    ticks: DataFrame,
    keys: Sequence[str],
    price: Col = "price",
    order: Col = "ord",
    size: Col | None = None,
) -> DataFrame:
    """open/high/low/close/volume/dollar per key in one aggregation; ``order`` is a total order."""
    p, o = col(price), col(order)
    qty = F.lit(1.0) if size is None else col(size)
    return ticks.groupBy(*keys).agg(
        F.min_by(p, o).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, o).alias("close"),
        F.sum(qty).cast("double").alias("volume"),
        F.sum(p * qty).alias("dollar"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per order: asset = customer nation, venue = priority class (first character)."""
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("bigint").alias("id"),
        F.substring("o_orderpriority", 1, 1).cast("int").cast("bigint").alias("venue_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("ord"),
    )


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(order_ticks(spark, sf_dir), ["id", "ts"])


def nation_venue_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(order_ticks(spark, sf_dir), ["id", "venue_id", "ts"])


def supplier_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("ord"),
    )


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(supplier_ticks(spark, sf_dir), ["id", "ts"], size="qty")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        "ts",
        F.col("value").alias("price"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.struct("ts", "event_id").alias("ord"),
        "event_id",
    )


def user_day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = event_ticks(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    return ohlcv(ticks, ["id", "day"]).withColumnRenamed("day", "ts").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
