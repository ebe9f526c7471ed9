"""All-time-high cycles and rolling extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.frames import Frame, div


def ath_cycle(df: DataFrame, f: Frame, x: str = "close", ts: str = "ts") -> DataFrame:
    """All-time high (>= counts as new), time since it, and the low since it."""
    df = df.withColumns({"ath": F.max(x).over(f.cum), "_rn": f.rn()})
    df = df.withColumn("is_at_ath", F.col(x) >= F.coalesce(F.max(x).over(f.before), F.col(x)))
    df = df.withColumn("cycle_number", F.sum(F.col("is_at_ath").cast("bigint")).over(f.cum))
    inside = Frame((*f.keys, "cycle_number"), f.order)
    df = df.withColumns(
        {
            "ath_ts": F.first(ts).over(inside.cum),
            "_ath_rn": F.first("_rn").over(inside.cum),
            "cycle_low": F.min(x).over(inside.cum),
            "cycle_low_ts": F.min_by(ts, F.struct(F.col(x), F.col("_rn"))).over(inside.cum),
            "_low_rn": F.min_by("_rn", F.struct(F.col(x), F.col("_rn"))).over(inside.cum),
        }
    )
    return df.withColumns(
        {
            "dd_from_ath": F.coalesce(div(F.col(x) - F.col("ath"), "ath"), F.lit(0.0)),
            "bars_since_ath": F.col("_rn") - F.col("_ath_rn"),
            "days_since_ath": F.datediff(ts, "ath_ts"),
            "dd_ath_to_low": F.coalesce(div(F.col("cycle_low") - F.col("ath"), "ath"), F.lit(0.0)),
            "bars_ath_to_low": F.col("_low_rn") - F.col("_ath_rn"),
            "days_ath_to_low": F.greatest(F.datediff("cycle_low_ts", "ath_ts"), F.lit(0)),
        }
    ).drop("_rn", "_ath_rn", "_low_rn")


def rolling_extremes(df: DataFrame, f: Frame, n: int, x: str = "close", ts: str = "ts") -> DataFrame:
    """Window high/low with their age; short windows at the start count; a tie takes the latest row."""
    df = df.withColumn("_rn", f.rn())
    w = f.last_rows(n)
    df = df.withColumns(
        {
            "_hi": F.max(F.struct(F.col(x), F.col("_rn"), F.col(ts))).over(w),
            "_lo": F.min(F.struct(F.col(x), (-F.col("_rn")).alias("back"), F.col(ts))).over(w),
        }
    )
    df = df.withColumns(
        {
            "rolling_high": F.col(f"_hi.{x}"),
            "rolling_high_ts": F.col(f"_hi.{ts}"),
            "bars_since_rolling_high": F.col("_rn") - F.col("_hi._rn"),
            "rolling_low": F.col(f"_lo.{x}"),
            "rolling_low_ts": F.col(f"_lo.{ts}"),
            "bars_since_rolling_low": F.col("_rn") + F.col("_lo.back"),
        }
    )
    span = F.col("rolling_high") - F.col("rolling_low")
    return df.withColumns(
        {
            "days_since_rolling_high": F.datediff(ts, "rolling_high_ts"),
            "days_since_rolling_low": F.datediff(ts, "rolling_low_ts"),
            "range_position": F.when(span > 0, div(F.col(x) - F.col("rolling_low"), span)).otherwise(1.0),
            "dd_from_rolling_high": F.coalesce(div(F.col(x) - F.col("rolling_high"), "rolling_high"), F.lit(0.0)),
        }
    ).drop("_rn", "_hi", "_lo")


def rolling_extremes_long(df: DataFrame, f: Frame, windows: Sequence[int]) -> DataFrame:
    """Several windows stacked; each window size is one more frame on the same partitioning."""
    out: DataFrame | None = None
    for n in windows:
        part = rolling_extremes(df, f, n).withColumn("lookback_bars", F.lit(n))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out
