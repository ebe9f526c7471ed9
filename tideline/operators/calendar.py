"""Timeframe dimension, sessions and date parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.frames import Col, col


def timeframes(spark: SparkSession, max_days: int = 365, max_weeks: int = 52, max_months: int = 12, max_years: int = 5) -> DataFrame:
    """Timeframe dimension generated by rule: row-count days, and calendar / anchored W, M, Y in two schemes."""
    kinds = [
        ("tf_day", "D", max_days, 1.0, 0.0),
        *[(f"{kind}_{s}", u, n, days, slack)
          for kind in ("calendar", "anchor") for s in ("us", "iso")
          for u, n, days, slack in (("W", max_weeks, 7.0, 0.0), ("M", max_months, 30.4375, 0.05), ("Y", max_years, 365.25, 0.01))],
    ]
    base = spark.createDataFrame(kinds, "alignment string, unit string, n_max int, unit_days double, slack double")
    nominal = F.round(F.col("n") * F.col("unit_days")).cast("int")
    return base.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n_max")))).select(
        F.concat(F.col("n").cast("string"), F.col("unit")).alias("tf"),
        "alignment",
        "n",
        "unit",
        nominal.alias("tf_days"),
        F.floor(nominal * (1 - F.col("slack"))).cast("int").alias("tf_days_min"),
        F.ceil(nominal * (1 + F.col("slack"))).cast("int").alias("tf_days_max"),
        (F.col("alignment") == "tf_day").alias("is_canonical"),
        F.col("alignment").startswith("anchor").alias("allow_partial_start"),
    )


def list_timeframes(dim: DataFrame, alignment: str | None = None, canonical_only: bool = False) -> DataFrame:
    if alignment is not None:
        dim = dim.filter(F.col("alignment") == alignment)
    return dim.filter("is_canonical") if canonical_only else dim


def realized_days_ok(bars: DataFrame, dim: DataFrame) -> DataFrame:
    """Is the realised bar length inside the bounds of its timeframe (nominal when bounds are absent)?"""
    d = F.broadcast(dim.select("tf", F.col("tf_days").alias("_nom"), "tf_days_min", "tf_days_max").dropDuplicates(["tf"]))
    return bars.join(d, "tf", "left").withColumn(
        "days_ok",
        F.col("tf_days").between(F.coalesce("tf_days_min", "_nom"), F.coalesce("tf_days_max", "_nom")),
    ).drop("_nom", "tf_days_min", "tf_days_max")


def table_rules(spark: SparkSession) -> DataFrame:
    """Which alignment and which partial bars each bar table allows."""
    rows = [
        ("bars_1d", "tf_day", False, False),
        ("bars_multi_tf", "tf_day", False, True),
        ("bars_cal_us", "calendar_us", False, True),
        ("bars_cal_iso", "calendar_iso", False, True),
        ("bars_anchor_us", "anchor_us", True, True),
        ("bars_anchor_iso", "anchor_iso", True, True),
    ]
    return spark.createDataFrame(
        rows, "table_name string, alignment string, partial_start boolean, partial_end boolean"
    )


def illegal_timeframes(used: DataFrame, dim: DataFrame, rules: DataFrame) -> DataFrame:
    """(table, tf) pairs that the table's alignment does not define."""
    legal = F.broadcast(rules.join(dim, "alignment").select("table_name", "tf"))
    return used.join(legal, ["table_name", "tf"], "left_anti")


def session_windows(
    assets: DataFrame, start: Col, end: Col, open_time: str = "09:30", close_time: str = "16:00", tz: str = "America/New_York"
) -> DataFrame:
    """UTC open and close per asset and local date. A close at or before the open falls on the next day."""
    days = assets.withColumn("session_date", F.explode(F.sequence(col(start), col(end), F.expr("INTERVAL 1 DAY"))))
    overnight = 1 if close_time <= open_time else 0
    local_open = F.concat(F.col("session_date").cast("string"), F.lit(f" {open_time}:00")).cast("timestamp")
    close_day = F.date_add("session_date", overnight)
    local_close = F.concat(close_day.cast("string"), F.lit(f" {close_time}:00")).cast("timestamp")
    out = days.withColumns({"_lo": local_open, "_lc": local_close})
    out = out.withColumns(
        {
            "open_utc": F.to_utc_timestamp("_lo", tz),
            "close_utc": F.to_utc_timestamp("_lc", tz),
        }
    )
    round_trip = (F.from_utc_timestamp("open_utc", tz) == F.col("_lo")) & (
        F.from_utc_timestamp("close_utc", tz) == F.col("_lc")
    )
    return out.withColumn("dst_safe", round_trip).drop("_lo", "_lc")


# Length of the synodic month in days and a new-moon instant (2000-01-06 18:14 UTC) in unix seconds.
SYNODIC_DAYS = 29.530588853
NEW_MOON_UNIX = 947182440


def date_parts(ts: Col, prefix: str = "") -> dict[str, Column]:
    """Calendar features of a timestamp, one Column per part."""
    t = col(ts)
    d = t.cast("date")
    m = F.month(d)
    phase = F.pmod((F.unix_timestamp(t.cast("timestamp")) - NEW_MOON_UNIX) / 86400.0, F.lit(SYNODIC_DAYS)) / SYNODIC_DAYS
    iso_dow = F.weekday(d) + 1
    parts = {
        "year": F.year(d),
        "quarter": F.quarter(d),
        "half": F.when(m <= 6, 1).otherwise(2),
        "month": m,
        "week_iso": F.weekofyear(d),
        "day": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d),
        "dow_us": F.dayofweek(d),
        "dow_iso": iso_dow,
        "hour": F.hour(t),
        "minute": F.minute(t),
        "second": F.second(t),
        "unix": F.unix_timestamp(t.cast("timestamp")),
        "is_weekend": iso_dow >= 6,
        "is_business_day": iso_dow <= 5,
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": d == F.last_day(d),
        "is_quarter_start": (F.dayofmonth(d) == 1) & (m % 3 == 1),
        "is_quarter_end": (d == F.last_day(d)) & (m % 3 == 0),
        "is_year_start": (F.dayofmonth(d) == 1) & (m == 1),
        "is_year_end": (F.dayofmonth(d) == 31) & (m == 12),
        "season": F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn"),
        "moon_phase": phase,
        "moon_illumination": (F.lit(1.0) - F.cos(phase * 2 * 3.141592653589793)) / 2,
    }
    return {f"{prefix}{k}": v for k, v in parts.items()}


def with_date_parts(df: DataFrame, ts: str = "ts", prefix: str = "") -> DataFrame:
    return df.withColumns(date_parts(ts, prefix))


def ema_alphas(dim: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Smoothing factors per (timeframe, period): in bars, and the daily rate with the same decay."""
    out = dim.withColumn("period", F.explode(F.array(*[F.lit(int(p)) for p in periods])))
    alpha = F.lit(2.0) / (F.col("period") + 1)
    return out.withColumns(
        {
            "alpha_bar": alpha,
            "alpha_daily": 1 - F.pow(1 - alpha, F.lit(1.0) / F.col("tf_days")),
            "effective_days": F.col("period") * F.col("tf_days"),
        }
    )
