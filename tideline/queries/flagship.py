"""Flagship: order ticks -> Sunday-week bars -> returns -> Bollinger -> SMA cross -> signals per asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.frames import Frame, bool0, div
from tideline.operators import bars as B
from tideline.queries.base import NB, lag, query, ro
from tideline.sources import market as M

SQL = f"""SELECT id, count(*) AS n_bars, count(*) FILTER (entry) AS entries, count(*) FILTER (leave) AS exits,
  count(*) FILTER (close > up) AS above_band, avg(ret) AS mean_ret FROM (
  SELECT *, coalesce(f > s AND {lag('f')} <= {lag('s')}, false) AS entry, coalesce(f < s AND {lag('f')} >= {lag('s')}, false) AS leave FROM (
   SELECT id, ts, close, close / {lag('close')} - 1 AS ret, {ro('avg', 'close', 20)} + 2 * {ro('stddev_samp', 'close', 20)} AS up,
    {ro('avg', 'close', 4)} AS f, {ro('avg', 'close', 10)} AS s FROM weekly)) GROUP BY id"""
WEEKLY = """weekly AS (SELECT id, wk AS ts, arg_max(close, ts) AS close FROM (SELECT *, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS wk,
  CAST(min(ts) OVER (PARTITION BY id) AS DATE) AS f FROM bars) WHERE wk >= f GROUP BY id, wk)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = M.nation_bars(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    f = Frame()
    first = F.min("day").over(f.whole)
    weekly = (
        daily.withColumns({"wk": B.week_start("day", "us"), "_first": first})
        .filter(F.col("wk") >= F.col("_first"))
        .groupBy("id", "wk")
        .agg(F.max_by("close", "ts").alias("close"))
        .withColumnRenamed("wk", "ts")
    )
    s = weekly.withColumns(
        {
            "ret": f.pct("close"),
            "up": f.mean("close", 20) + f.std("close", 20) * 2,
            "fast": f.mean("close", 4),
            "slow": f.mean("close", 10),
        }
    )
    s = s.withColumns(
        {
            "entry": bool0((F.col("fast") > F.col("slow")) & (f.lag("fast") <= f.lag("slow"))),
            "leave": bool0((F.col("fast") < F.col("slow")) & (f.lag("fast") >= f.lag("slow"))),
        }
    )
    return s.groupBy("id").agg(
        F.count("*").alias("n_bars"),
        F.count_if("entry").alias("entries"),
        F.count_if("leave").alias("exits"),
        F.count_if(F.col("close") > F.col("up")).alias("above_band"),
        F.avg("ret").alias("mean_ret"),
    )


query("flagship_weekly_signals", "id n_bars# entries# exits# above_band# mean_ret:6", SQL, NB + ", " + WEEKLY)(flagship)
