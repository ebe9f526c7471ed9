"""Daily repair, resampling and multi-timeframe snapshot bars.

Snapshot style: one row per day shows the state of the bar still open on that day;
``is_partial_end`` is false only on the closing row. Every timeframe of every key is built in one job
by exploding a broadcast timeframe list (at most a few hundred rows) after the rows have been
partitioned by key, so all timeframes share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, col, div

def one_ms() -> Column:
    return F.expr("INTERVAL '0.001' SECOND")



# --- daily bars ------------------------------------------------------------------------------------
def ohlc_sanity(df: DataFrame) -> DataFrame:
    """Clamp high/low to cover open/close and flag what was repaired."""
    top = F.greatest("open", "close")
    bottom = F.least("open", "close")
    bad_high = F.col("high").isNull() | (F.col("high") < top)
    bad_low = F.col("low").isNull() | (F.col("low") > bottom)
    return df.withColumns(
        {
            "repaired_high": F.coalesce(bad_high, F.lit(False)),
            "repaired_low": F.coalesce(bad_low, F.lit(False)),
            "high": F.when(bad_high, top).otherwise(F.col("high")),
            "low": F.when(bad_low, bottom).otherwise(F.col("low")),
        }
    )


def repair_times(df: DataFrame) -> DataFrame:
    """Repair time_high / time_low outside [time_open, time_close], then the price they point at."""
    bad_th = F.col("time_high").isNull() | (F.col("time_high") < F.col("time_open")) | (
        F.col("time_high") > F.col("time_close")
    )
    bad_tl = F.col("time_low").isNull() | (F.col("time_low") < F.col("time_open")) | (
        F.col("time_low") > F.col("time_close")
    )
    up = F.col("close") >= F.col("open")
    down = F.col("close") <= F.col("open")
    df = df.withColumns({"repaired_timehigh": bad_th, "repaired_timelow": bad_tl})
    high1 = F.when(F.col("repaired_timehigh"), F.greatest("open", "close")).otherwise(F.col("high"))
    low1 = F.when(F.col("repaired_timelow"), F.least("open", "close")).otherwise(F.col("low"))
    df = df.withColumns(
        {
            "time_high": F.when(
                F.col("repaired_timehigh"), F.when(up, F.col("time_close")).otherwise(F.col("time_open"))
            ).otherwise(F.col("time_high")),
            "time_low": F.when(
                F.col("repaired_timelow"), F.when(down, F.col("time_close")).otherwise(F.col("time_open"))
            ).otherwise(F.col("time_low")),
            "_h1": high1,
            "_l1": low1,
        }
    )
    df = df.withColumns(
        {
            "high": F.greatest("_h1", "open", "close", "_l1"),
            "low": F.least("_l1", "open", "close", "_h1"),
        }
    )
    return df.withColumns(
        {
            "repaired_high": F.col("high") != F.col("_h1"),
            "repaired_low": F.col("low") != F.col("_l1"),
        }
    ).drop("_h1", "_l1")


def bar_sequence(df: DataFrame, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """bar_seq = dense rank of the timestamp within the key."""
    return df.withColumn("bar_seq", F.dense_rank().over(Window.partitionBy(*keys).orderBy(ts)))


def violation_codes() -> Column:
    """Codes of the broken OHLC rules of a row, as an array."""
    rules = [
        ("missing_price", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()),
        ("high_below_low", F.col("high") < F.col("low")),
        ("high_below_body", F.col("high") < F.greatest("open", "close")),
        ("low_above_body", F.col("low") > F.least("open", "close")),
        ("negative_volume", F.col("volume") < 0),
    ]
    flagged = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules])
    return F.filter(flagged, lambda c: c.isNotNull())


def rejects(df: DataFrame) -> DataFrame:
    """One row per (bar, violation)."""
    return df.withColumn("violation", F.explode(violation_codes()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their codes) for two sinks."""
    coded = df.withColumn("violations", violation_codes())
    return coded.filter(F.size("violations") == 0).drop("violations"), coded.filter(F.size("violations") > 0)


def duplicate_local_days(
    df: DataFrame, tz: str, keys: Sequence[str] = ("id",), ts: str = "ts"
) -> DataFrame:
    """Keys with more than one row on a local calendar day (empty = contract holds)."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz).cast("date")
    return (
        df.groupBy(*keys, local.alias("local_day"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def coverage(df: DataFrame, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col(ts).cast("date")).alias("n_days"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def missing_day_parts(df: DataFrame, keys: Sequence[str], start: str, end: str, day: str = "day") -> DataFrame:
    """Missing days of a period split into before the first, between, and after the last observed day.

    Counts only (dates are arithmetic), so no calendar rows are generated.
    """
    g = df.groupBy(*keys, start, end).agg(
        F.min(day).alias("_a"), F.max(day).alias("_b"), F.count_distinct(day).alias("count_days")
    )
    return g.select(
        *keys,
        start,
        end,
        "count_days",
        F.datediff("_a", start).alias("missing_start"),
        (F.datediff("_b", "_a") + 1 - F.col("count_days")).alias("missing_interior"),
        F.datediff(end, "_b").alias("missing_end"),
    )


# --- snapshot bars ---------------------------------------------------------------------------------
def snapshot_columns(df: DataFrame, keys: Sequence[str], seq: str = "bar_seq", ts: str = "ts") -> DataFrame:
    """Running state of the open bar per (key, bar): open, high, low, close, volume, extreme times, gaps."""
    f = Frame((*keys, seq), (ts,))
    per_key = Frame(keys, (ts,))
    gap = F.greatest(F.datediff(ts, per_key.lag(ts)) - 1, F.lit(0))
    df = df.withColumns(
        {
            "time_open": F.coalesce(per_key.lag(ts), F.col(ts) - F.expr("INTERVAL 1 DAY")) + one_ms(),
            "_gap": F.when(f.rn() == 1, F.lit(0)).otherwise(gap),
        }
    )
    return df.withColumns(
        {
            "bar_open": F.first("open").over(f.cum),
            "bar_high": F.max("high").over(f.cum),
            "bar_low": F.min("low").over(f.cum),
            "bar_volume": F.sum(F.coalesce("volume", F.lit(0.0))).over(f.cum),
            "time_high": F.min_by(ts, F.struct(-F.col("high"), F.col(ts))).over(f.cum),
            "time_low": F.min_by(ts, F.struct(F.col("low"), F.col(ts))).over(f.cum),
            "time_open_bar": F.first("time_open").over(f.cum),
            "count_days": F.row_number().over(f.w),
            "count_missing_days": F.sum("_gap").over(f.cum),
        }
    ).drop("_gap")


def _state_output(df: DataFrame, keys: Sequence[str], ts: str, extra: Sequence[str]) -> DataFrame:
    return df.select(
        *keys,
        ts,
        *extra,
        F.col("bar_open").alias("open"),
        F.col("bar_high").alias("high"),
        F.col("bar_low").alias("low"),
        "close",
        F.col("bar_volume").alias("volume"),
        "time_open",
        "time_high",
        "time_low",
        "time_open_bar",
        "count_days",
        "count_missing_days",
    )


def count_snapshots(
    daily: DataFrame, tf_days: Sequence[int], keys: Sequence[str] = ("id",), ts: str = "ts"
) -> DataFrame:
    """Row-count bars for every timeframe: bar_seq = (row - 1) div tf_days + 1."""
    df = daily.withColumn("_row", Frame(keys, (ts,)).rn() - 1)
    df = df.withColumn("tf_days", F.explode(F.array(*[F.lit(int(n)) for n in tf_days])))
    df = df.withColumns(
        {
            "tf": F.concat(F.col("tf_days").cast("string"), F.lit("D")),
            "bar_seq": F.floor(F.col("_row") / F.col("tf_days")).cast("int") + 1,
            "pos_in_bar": (F.col("_row") % F.col("tf_days")) + 1,
        }
    )
    df = snapshot_columns(df, (*keys, "tf"), ts=ts)
    df = df.withColumns(
        {
            "is_partial_end": F.col("pos_in_bar") < F.col("tf_days"),
            "count_days_remaining": F.col("tf_days") - F.col("pos_in_bar"),
        }
    )
    return _state_output(
        df, (*keys, "tf"), ts,
        ("tf_days", "bar_seq", "pos_in_bar", "is_partial_end", "count_days_remaining"),
    )


# Reference Monday and Sunday of the anchored week grids.
WEEK_ANCHOR = {"iso": "1970-01-05", "us": "1970-01-04"}


def week_start(day: Col, scheme: str) -> Column:
    d = col(day)
    return F.date_sub(d, F.weekday(d)) if scheme == "iso" else F.date_sub(d, F.dayofweek(d) - 1)


def anchored_period(day: Col, n: int, unit: str, scheme: str) -> tuple[Column, Column]:
    """(first day, last day) of the fixed calendar window that holds ``day``."""
    d = col(day)
    if unit == "W":
        ref = F.lit(WEEK_ANCHOR[scheme]).cast("date")
        index = F.floor(F.datediff(d, ref) / (7 * n)).cast("int")
        start = F.date_add(ref, index * (7 * n))
        return start, F.date_add(start, 7 * n - 1)
    if unit == "M":
        first_month = F.floor((F.month(d) - 1) / n).cast("int") * n + 1
        start = F.make_date(F.year(d), first_month, F.lit(1))
        year_end = F.make_date(F.year(d), F.lit(12), F.lit(31))
        return start, F.least(F.date_sub(F.add_months(start, n), 1), year_end)
    first_year = F.floor(F.year(d) / n).cast("int") * n
    start = F.make_date(first_year, F.lit(1), F.lit(1))
    return start, F.make_date(first_year + (n - 1), F.lit(12), F.lit(31))


def first_full_period(day: Col, unit: str, scheme: str) -> Column:
    """First period start on or after ``day``."""
    d = col(day)
    start = {
        "W": week_start(d, scheme),
        "M": F.trunc(d, "month"),
        "Y": F.trunc(d, "year"),
    }[unit]
    following = {
        "W": F.date_add(start, 7),
        "M": F.add_months(start, 1),
        "Y": F.add_months(start, 12),
    }[unit]
    return F.when(start == d, d).otherwise(following)


def aligned_period(day: Col, anchor: Col, n: int, unit: str) -> tuple[Column, Column, Column]:
    """(index from 0, first day, last day) of N-unit periods counted from an anchor period start."""
    d, a = col(day), col(anchor)
    if unit == "W":
        k = F.floor(F.datediff(d, a) / (7 * n)).cast("int")
        return k, F.date_add(a, k * (7 * n)), F.date_add(a, k * (7 * n) + (7 * n - 1))
    months = n if unit == "M" else 12 * n
    k = F.floor(
        ((F.year(d) - F.year(a)) * 12 + F.month(d) - F.month(a)) / months
    ).cast("int")
    return k, F.add_months(a, k * months), F.date_sub(F.add_months(a, (k + 1) * months), 1)


def epoch_period(day: Col, n: int, unit: str, scheme: str) -> Column:
    """Period start with multi-week periods counted in whole weeks from 1970-01-01."""
    d = col(day)
    if unit == "W":
        base = week_start(d, scheme)
        if n == 1:
            return base
        epoch = F.lit("1970-01-01").cast("date")
        return F.date_add(epoch, (F.floor(F.floor(F.datediff(base, epoch) / 7) / n) * (7 * n)).cast("int"))
    return anchored_period(d, n, unit, scheme)[0]


def _calendar_rows(
    daily: DataFrame, specs: Sequence[tuple[int, str]], scheme: str, keys: Sequence[str], ts: str, anchored: bool
) -> DataFrame:
    """Explode each day into one row per timeframe with its period bounds."""
    day = F.col(ts).cast("date")
    df = daily.withColumn("_day", day)
    if not anchored:
        df = df.withColumn("_first", F.min("_day").over(Window.partitionBy(*keys)))
    items = []
    for n, unit in specs:
        if anchored:
            start, end = anchored_period("_day", n, unit, scheme)
        else:
            anchor = first_full_period("_first", unit, scheme)
            _, start, end = aligned_period("_day", anchor, n, unit)
            start = F.when(F.col("_day") >= anchor, start)
        items.append(F.struct(F.lit(f"{n}{unit}").alias("tf"), start.alias("s"), end.alias("e")))
    df = df.withColumn("_p", F.explode(F.array(*items))).filter(F.col("_p.s").isNotNull())
    return df.select(
        *[c for c in df.columns if c not in ("_p", "_day", "_first")],
        F.col("_p.tf").alias("tf"),
        F.col("_p.s").alias("period_start"),
        F.col("_p.e").alias("period_end"),
    )


def calendar_snapshots(
    daily: DataFrame,
    specs: Sequence[tuple[int, str]],
    scheme: str,
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
) -> DataFrame:
    """Calendar bars counted from the first full period of the key: no partial start."""
    df = _calendar_rows(daily, specs, scheme, keys, ts, anchored=False)
    return _finish_calendar(df, keys, ts, anchored=False)


def anchored_snapshots(
    daily: DataFrame,
    specs: Sequence[tuple[int, str]],
    scheme: str,
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
) -> DataFrame:
    """Bars on the fixed calendar grid; the first and last bar of a key may be partial."""
    df = _calendar_rows(daily, specs, scheme, keys, ts, anchored=True)
    return _finish_calendar(df, keys, ts, anchored=True)


def _finish_calendar(df: DataFrame, keys: Sequence[str], ts: str, anchored: bool) -> DataFrame:
    tf_keys = (*keys, "tf")
    df = df.withColumns(
        {
            "tf_days": F.datediff("period_end", "period_start") + 1,
            "bar_seq": F.dense_rank().over(Window.partitionBy(*tf_keys).orderBy("period_start")),
        }
    )
    df = snapshot_columns(df, tf_keys, ts=ts)
    if anchored:
        whole = Window.partitionBy(*tf_keys, "bar_seq")
        df = df.withColumns(
            {
                "_rows": F.count(F.lit(1)).over(whole),
                "_ended": F.max(ts).over(Window.partitionBy(*tf_keys)).cast("date") > F.col("period_end"),
            }
        )
        expected = F.when(F.col("_ended"), F.col("_rows")).otherwise(F.col("tf_days"))
        df = df.withColumns(
            {
                "is_partial_start": F.col("_ended") & (F.col("_rows") < F.col("tf_days")),
                "is_partial_end": F.col("count_days") < expected,
                "count_days_remaining": expected - F.col("count_days"),
            }
        )
    else:
        df = df.withColumns(
            {
                "is_partial_start": F.lit(False),
                "is_partial_end": F.col("count_days") < F.col("tf_days"),
                "count_days_remaining": F.col("tf_days") - F.col("count_days"),
            }
        )
    return _state_output(
        df, tf_keys, ts,
        ("tf_days", "bar_seq", "period_start", "period_end", "is_partial_start", "is_partial_end", "count_days_remaining"),
    )


def period_snapshots(
    daily: DataFrame, n: int, unit: str, scheme: str = "iso", keys: Sequence[str] = ("id",), ts: str = "ts"
) -> DataFrame:
    """Daily snapshots inside epoch-counted periods, keyed by period start."""
    df = daily.withColumn("period_start", epoch_period(F.col(ts).cast("date"), n, unit, scheme))
    df = df.withColumn("tf", F.lit(f"{n}{unit}"))
    df = snapshot_columns(df, (*keys, "tf"), seq="period_start", ts=ts)
    return _state_output(df, (*keys, "tf"), ts, ("period_start",))


def to_timeframe(
    daily: DataFrame, n: int, unit: str, alignment: str = "tf_day", keys: Sequence[str] = ("id",), ts: str = "ts"
) -> DataFrame:
    """Dispatch on alignment: tf_day, calendar_us, calendar_iso, anchor_us, anchor_iso."""
    if alignment == "tf_day":
        return count_snapshots(daily, [n], keys, ts)
    scheme = alignment.rsplit("_", 1)[1]
    build = anchored_snapshots if alignment.startswith("anchor") else calendar_snapshots
    return build(daily, [(n, unit)], scheme, keys, ts)


def enough_history(daily: DataFrame, min_days: Col, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Keep keys with at least ``min_days`` daily rows."""
    return (
        daily.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .filter(F.col("_n") >= col(min_days))
        .drop("_n")
    )


def canonical(bars: DataFrame) -> DataFrame:
    return bars.filter(~F.col("is_partial_end"))


def bar_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float) -> DataFrame:
    """Rows of two bar tables that differ by more than ``tol`` or exist on one side only."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("_ina"))
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("_inb"))
    both = left.join(right, list(keys), "full")
    status = F.when(F.col("_ina").isNull(), F.lit("only_b")).when(F.col("_inb").isNull(), F.lit("only_a"))
    worst = F.greatest(*[F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) for v in values], F.lit(0.0))
    status = F.coalesce(status, F.when(worst > tol, F.lit("differs")))
    return both.withColumns({"max_diff": worst, "status": status}).filter(F.col("status").isNotNull()).select(
        *keys, "max_diff", "status"
    )


def venue_vwap(bars: DataFrame, keys: Sequence[str] = ("id", "ts"), min_venues: int = 2) -> DataFrame:
    """One bar across venues: volume-weighted open/close, max high, min low."""
    return (
        bars.groupBy(*keys)
        .agg(
            div(F.sum(F.col("open") * F.col("volume")), F.sum("volume")).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            div(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_venues"),
        )
        .filter(F.col("n_venues") >= min_venues)
    )


# --- resampling ------------------------------------------------------------------------------------
def bucket_start(ts: Col, freq: str) -> Column:
    """Bucket start for 'nS/nMIN/nH/nD' (from the epoch) or '1W', 'nM', 'nQ', 'nY' (calendar)."""
    digits = "".join(c for c in freq if c.isdigit()) or "1"
    n, unit = int(digits), freq.lstrip("0123456789").upper()
    t = col(ts)
    if unit == "W":
        return week_start(t.cast("date"), "iso").cast("timestamp_ntz")
    if unit in ("M", "Q", "Y"):
        months = n * {"M": 1, "Q": 3, "Y": 12}[unit]
        index = F.floor((F.year(t) * 12 + F.month(t) - 1) / months) * months
        return F.make_date(
            F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1)
        ).cast("timestamp_ntz")
    seconds = n * {"S": 1, "MIN": 60, "H": 3600, "D": 86400}[unit]
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    offset = F.floor(F.timestamp_diff("SECOND", epoch, t) / seconds) * seconds
    return epoch + F.make_dt_interval(secs=offset.cast("decimal(18,6)"))


def resample(
    df: DataFrame,
    freq: str,
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
    order: Col | None = None,
    strict: bool = False,
    sum_cols: Sequence[str] = ("volume",),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """OHLCV per time bucket. ``strict`` drops the last bucket of a key unless data reaches its end."""
    o = col(ts) if order is None else col(order)
    out = (
        df.withColumn("bucket", bucket_start(ts, freq))
        .groupBy(*keys, "bucket")
        .agg(
            F.min_by("open", o).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", o).alias("close"),
            *[F.sum(c).alias(c) for c in sum_cols],
            F.count(F.lit(1)).alias("n_rows"),
            F.max(ts).alias("last_ts"),
            *extra,
        )
    )
    if strict:
        newest = Window.partitionBy(*keys)
        out = out.withColumn("_max", F.max("bucket").over(newest)).filter(
            F.col("bucket") < F.col("_max")
        ).drop("_max")
    return out


def season_bins(
    df: DataFrame, season: Col, n: int, keys: Sequence[str] = ("id",), ts: str = "ts"
) -> DataFrame:
    """OHLCV per run of N consecutive seasons (a season change starts a new count)."""
    f = Frame(keys, (ts,))
    df = df.withColumn("_s", col(season))
    df = df.withColumn("_c", F.when(f.rn() == 1, 0).when(f.lag("_s") != F.col("_s"), 1).otherwise(0))
    df = df.withColumn("bin", F.floor(F.sum("_c").over(f.cum) / n).cast("bigint"))
    return df.groupBy(*keys, "bin").agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"),
    )


def season_of(day: Col) -> Column:
    """Meteorological season name by month."""
    m = F.month(col(day))
    return (
        F.when(m.isin(12, 1, 2), F.lit("winter"))
        .when(m.isin(3, 4, 5), F.lit("spring"))
        .when(m.isin(6, 7, 8), F.lit("summer"))
        .otherwise(F.lit("autumn"))
    )


def price_discrepancy(quotes: DataFrame, bars: DataFrame, keys: Sequence[str] = ("id",), k: float = 3.0, n: int = 30) -> DataFrame:
    """Flag a quote whose distance from the last close exceeds k x the n-bar return deviation."""
    f = Frame(keys, ("ts",))
    rets = bars.withColumn("_r", f.pct("close")).withColumn("ret_std", f.std("_r", n))
    latest = rets.groupBy(*keys).agg(
        F.max_by("close", "ts").alias("last_close"), F.max_by("ret_std", "ts").alias("ret_std")
    )
    gap = F.abs(div(F.col("price") - F.col("last_close"), F.col("last_close")))
    return quotes.join(latest, list(keys)).withColumns(
        {"deviation": gap, "threshold": F.col("ret_std") * k}
    ).withColumn("is_discrepant", F.coalesce(F.col("deviation") > F.col("threshold"), F.lit(False)))


def carry_forward(prior: DataFrame, today: DataFrame, keys: Sequence[str] = ("id", "tf")) -> DataFrame:
    """Next snapshot of an open bar from yesterday's snapshot and today's daily row.

    Applies only when the prior bar is still open and today is the next calendar day; other keys are
    left out and must be rebuilt.
    """
    id_keys = [k for k in keys if k != "tf"]
    p = prior.select(*keys, *[F.col(c).alias(f"p_{c}") for c in prior.columns if c not in keys])
    joined = p.join(today, id_keys)
    ok = F.col("p_is_partial_end") & (F.datediff("ts", "p_ts") == 1)
    pos = F.col("p_count_days") + 1
    return joined.filter(ok).select(
        *keys,
        "ts",
        F.col("p_tf_days").alias("tf_days"),
        F.col("p_bar_seq").alias("bar_seq"),
        F.col("p_open").alias("open"),
        F.greatest("p_high", "high").alias("high"),
        F.least("p_low", "low").alias("low"),
        F.col("close"),
        (F.col("p_volume") + F.coalesce("volume", F.lit(0.0))).alias("volume"),
        F.when(F.col("high") > F.col("p_high"), F.col("ts")).otherwise(F.col("p_time_high")).alias("time_high"),
        F.when(F.col("low") < F.col("p_low"), F.col("ts")).otherwise(F.col("p_time_low")).alias("time_low"),
        pos.alias("count_days"),
        (pos < F.col("p_tf_days")).alias("is_partial_end"),
    )


def synthetic_closes(daily: DataFrame, tf_days: int, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Closes of full N-row bars built from daily rows when a timeframe has no stored bars."""
    df = daily.withColumn("_row", Frame(keys, (ts,)).rn())
    full = df.filter(F.col("_row") % tf_days == 0)
    return full.select(*keys, F.lit(f"{tf_days}D").alias("tf"), ts, "close", (F.col("_row") / tf_days).cast("int").alias("bar_seq"))


def resample_file(spark, source: str, target: str, freq: str, **kw) -> None:
    """Parquet in, resampled Parquet out."""
    resample(spark.read.parquet(source), freq, **kw).write.mode("overwrite").parquet(target)


def conform(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add missing columns with their defaults and fill NULLs of the present ones."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})
