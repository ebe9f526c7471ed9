"""Null strategies, outliers, bounded fills, coverage flags and series quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, col, div, run_ids
from tideline.plans.segments import percentiles


def fill_nulls(df: DataFrame, f: Frame, x: str, strategy: str = "skip", limit: int | None = None) -> DataFrame:
    """``skip`` keeps NULLs; ``forward_fill`` fills forward then backward within ``limit`` rows;
    ``interpolate`` is linear in row position between known values (ends stay as the nearest value)."""
    if strategy == "skip":
        return df
    if strategy == "forward_fill":
        return df.withColumn(x, F.coalesce(f.ffill(x, limit), F.col(x))).withColumn(x, F.coalesce(F.col(x), f.bfill(x, limit)))
    df = df.withColumn("_rn", f.rn())
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("_rn").alias("r"), F.col(x).alias("v")))
    df = df.withColumn("_k", known)
    df = df.withColumns({"_p": f.ffill("_k"), "_n": f.bfill("_k")})
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * div(F.col("_rn") - F.col("_p.r"), F.col("_n.r") - F.col("_p.r"))
    value = F.coalesce(F.col(x), between, F.col("_p.v"))
    return df.withColumn(x, value).drop("_rn", "_k", "_p", "_n")


def add_zscores(df: DataFrame, f: Frame, cols: Sequence[str], n: int) -> DataFrame:
    return df.withColumns({f"{c}_zscore": f.zscore(c, n) for c in cols})


def enough_points(df: DataFrame, keys: Sequence[str], x: str, n: int) -> DataFrame:
    """Keep keys with at least n non-null values."""
    ok = df.groupBy(*keys).agg(F.count(x).alias("_n")).filter(F.col("_n") >= n).drop("_n")
    return df.join(ok, list(keys), "left_semi")


def flag_outliers(df: DataFrame, keys: Sequence[str], x: str, n_sigma: float = 4.0, method: str = "zscore") -> DataFrame:
    """Outlier against the whole key; statistics are one aggregate joined back (keys of any size)."""
    keys = list(keys)
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(x).alias("_a"), F.stddev_samp(x).alias("_b"))
        flag = F.abs(div(F.col(x) - F.col("_a"), "_b")) > n_sigma
    else:
        stats = percentiles(df, keys, x, {"_a": 0.25, "_b": 0.75})
        iqr = F.col("_b") - F.col("_a")
        flag = (iqr > 0) & ((F.col(x) < F.col("_a") - 1.5 * iqr) | (F.col(x) > F.col("_b") + 1.5 * iqr))
    return df.join(stats, keys).withColumn(f"{x}_is_outlier", F.coalesce(flag, F.lit(False))).drop("_a", "_b")


def feature_template(df: DataFrame, f: Frame, compute, null_cols: Sequence[str], strategy: str, z_cols: Sequence[str], z_window: int, outlier_cols: Sequence[str]) -> DataFrame:
    """null handling -> compute -> z-scores -> outlier flags."""
    for c in null_cols:
        df = fill_nulls(df, f, c, strategy)
    df = add_zscores(compute(df, f), f, z_cols, z_window)
    for c in outlier_cols:
        df = flag_outliers(df, f.keys, c)
    return df


def fill_with_source(df: DataFrame, f: Frame, x: str, limit: int | None = None, ts: str = "ts") -> DataFrame:
    """Forward fill within ``limit`` rows and carry the timestamp the value came from."""
    src = F.when(F.col(x).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(x).alias("v")))
    df = df.withColumn("_s", src).withColumn("_s", f.ffill("_s", limit))
    return df.withColumns({f"{x}_filled": F.col("_s.v"), f"{x}_source_ts": F.col("_s.t")}).drop("_s")


# Forward-fill limits in days by the frequency of a series.
FILL_LIMITS = {"daily": 5, "weekly": 10, "monthly": 45}


def fill_by_frequency(df: DataFrame, f: Frame, series: Mapping[str, str]) -> DataFrame:
    for name, freq in series.items():
        df = df.withColumn(name, f.ffill(name, FILL_LIMITS[freq]))
    return df


def combine_frames(frames: Mapping[str, DataFrame], on: Sequence[str], ffill: Frame | None = None) -> DataFrame:
    """Outer join of frames on a date with ``has_<name>`` coverage flags and an optional forward fill."""
    on = list(on)
    tagged = [df.withColumn(f"has_{n}", F.lit(True)) for n, df in frames.items()]
    out = reduce(lambda a, b: a.join(b, on, "full"), tagged)
    flags = [f"has_{n}" for n in frames]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})
    if ffill is not None:
        values = [c for c in out.columns if c not in on and c not in flags]
        out = out.withColumns({c: ffill.ffill(c) for c in values})
    return out


def mask_ranges(df: DataFrame, f: Frame, mask: Col, ts: str = "ts") -> DataFrame:
    """Intervals of consecutive rows where the mask holds."""
    marked = run_ids(df.withColumn("_m", F.coalesce(col(mask), F.lit(False))), f, "_m")
    return marked.filter("_m").groupBy(*f.keys, "run_id").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_rows")
    ).drop("run_id")


def series_issues(df: DataFrame, f: Frame, x: str, max_gap_days: int, low: float, high: float, as_of: Column, stale_days: int, z_limit: float = 4.0, ts: str = "ts") -> DataFrame:
    """gap / outlier / range / stale issues of each series, one row per issue."""
    df = df.withColumns(
        {
            "_gap": F.datediff(ts, f.lag(ts)),
            "_z": div(F.col(x) - F.avg(x).over(f.whole), F.stddev_samp(x).over(f.whole)),
            "_last": F.max(ts).over(f.whole),
        }
    )
    checks = [
        ("gap", F.col("_gap") > max_gap_days, F.col("_gap").cast("double")),
        ("outlier", F.abs("_z") > z_limit, F.col(x)),
        ("range", (F.col(x) < low) | (F.col(x) > high), F.col(x)),
        ("stale", (F.col(ts) == F.col("_last")) & (F.datediff(as_of, ts) > stale_days), F.datediff(as_of, ts).cast("double")),
    ]
    items = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("issue"), v.alias("detail"))) for n, c, v in checks])
    return df.withColumn("_i", F.explode(F.filter(items, lambda i: i.isNotNull()))).select(*f.keys, ts, "_i.*")


def feature_issues(df: DataFrame, f: Frame, features: Sequence[str], reference: DataFrame, max_gap_days: int = 1, null_ratio: float = 0.5, sigma: float = 6.0, ts: str = "ts") -> DataFrame:
    """Feature-table validation: gaps, outliers, rows missing against a reference table, null ratios."""
    keys = list(f.keys)
    gaps = df.withColumn("_g", F.datediff(ts, f.lag(ts))).filter(F.col("_g") > max_gap_days).select(
        *keys, F.lit("gap").alias("issue"), F.lit(ts).alias("feature"))
    missing = reference.select(*keys, ts).join(df.select(*keys, ts), [*keys, ts], "left_anti").select(
        *keys, F.lit("missing").alias("issue"), F.lit(ts).alias("feature"))
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c_{c}") for c in features],
        *[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_samp(c).alias(f"_s_{c}") for c in features])
    nulls = agg.select(*keys, F.lit("null_ratio").alias("issue"), F.explode(F.filter(F.array(*[
        F.when(1 - F.col(f"_c_{c}") / F.col("_n") > null_ratio, F.lit(c)) for c in features]), lambda x: x.isNotNull())).alias("feature"))
    wild = df.join(agg, keys).select(*keys, F.lit("outlier").alias("issue"), F.explode(F.filter(F.array(*[
        F.when(F.abs(F.col(c) - F.col(f"_m_{c}")) > sigma * F.col(f"_s_{c}"), F.lit(c)) for c in features]), lambda x: x.isNotNull())).alias("feature"))
    all_issues = gaps.unionByName(missing).unionByName(nulls).unionByName(wild)
    return all_issues.groupBy(*keys, "issue", "feature").agg(F.count(F.lit(1)).alias("n"))


def newest(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")
