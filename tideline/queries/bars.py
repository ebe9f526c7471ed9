"""Bars, calendars and returns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.operators import bars as B
from tideline.operators import calendar as C
from tideline.operators import openbars as O
from tideline.operators import returns as R
from tideline.plans.incremental import slice_edges
from tideline.queries.base import NB, REGISTRY, SB, TICKS, VB, Query, lag, query, ro
from tideline.session import checkpoint_dir
from tideline.sources import market as M

OHLC = "open high low close volume"

query("bars_daily_nation", f"id ts {OHLC} dollar:2", "SELECT * FROM bars", NB)(M.nation_bars)
query("bars_daily_supplier", "id ts open:8 high:8 low:8 close:8 volume dollar:2", "SELECT * FROM bars", SB)(M.supplier_bars)


def _messy(spark, sf):
    """Daily bars with times of the extremes, some outside the session, from the raw ticks."""
    b = M.nation_venue_bars(spark, sf)
    return b.select(
        "id", "venue_id", "ts", "open", (F.col("high") * 0.999).alias("high"), (F.col("low") * 1.001).alias("low"),
        "close", "volume",
        F.col("ts").alias("time_open"),
        (F.col("ts") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).alias("time_close"),
        (F.col("ts") + F.expr("INTERVAL 12 HOURS") * F.pmod("id", F.lit(3))).alias("time_high"),
        (F.col("ts") - F.expr("INTERVAL 1 HOURS") * F.pmod("venue_id", F.lit(2))).alias("time_low"),
    )


MESSY = VB + """, messy AS (SELECT id, venue_id, ts, open, high * 0.999 AS high, low * 1.001 AS low, close, volume,
 ts AS time_open, ts + INTERVAL '23:59:59' AS time_close,
 ts + INTERVAL 12 HOUR * (id % 3) AS time_high, ts - INTERVAL 1 HOUR * (venue_id % 2) AS time_low FROM vbars)"""

query(
    "bars_repair", "id venue_id ts bar_seq# open high:6 low:6 close time_high time_low repaired_timehigh repaired_timelow repaired_high repaired_low",
    """SELECT *, high <> h1 AS repaired_high, low <> l1 AS repaired_low FROM (
      SELECT *, greatest(h1, open, close, l1) AS high, least(l1, open, close, h1) AS low FROM (
       SELECT id, venue_id, ts, open, close, dense_rank() OVER (PARTITION BY id ORDER BY ts) AS bar_seq, bth AS repaired_timehigh, btl AS repaired_timelow,
        CASE WHEN bth THEN CASE WHEN close >= open THEN time_close ELSE time_open END ELSE time_high END AS time_high,
        CASE WHEN btl THEN CASE WHEN close <= open THEN time_close ELSE time_open END ELSE time_low END AS time_low,
        CASE WHEN bth THEN greatest(open, close) ELSE high END AS h1,
        CASE WHEN btl THEN least(open, close) ELSE low END AS l1
       FROM (SELECT *, time_high IS NULL OR time_high < time_open OR time_high > time_close AS bth,
              time_low IS NULL OR time_low < time_open OR time_low > time_close AS btl FROM messy)))""",
    MESSY,
)(lambda s, p: B.bar_sequence(B.repair_times(_messy(s, p))))

query(
    "bars_ohlc_sanity", "id venue_id ts high:4 low:4 repaired_high repaired_low",
    """SELECT id, venue_id, ts, greatest(high, open, close) AS high, least(low, open, close) AS low,
     high < greatest(open, close) AS repaired_high, low > least(open, close) AS repaired_low FROM messy""",
    MESSY,
)(lambda s, p: B.ohlc_sanity(_messy(s, p)))

query(
    "bars_rejects", "id venue_id ts violation",
    """SELECT id, venue_id, ts, 'high_below_body' AS violation FROM messy WHERE high < greatest(open, close)
     UNION ALL SELECT id, venue_id, ts, 'low_above_body' FROM messy WHERE low > least(open, close)
     UNION ALL SELECT id, venue_id, ts, 'high_below_low' FROM messy WHERE high < low""",
    MESSY,
)(lambda s, p: B.rejects(_messy(s, p)))

query(
    "bars_duplicate_local_days", "id local_day! rows#",
    "SELECT id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_day, count(*) AS rows FROM ticks GROUP BY ALL HAVING count(*) > 1",
    TICKS,
)(lambda s, p: B.duplicate_local_days(M.order_ticks(s, p), "Etc/GMT+5"))

query(
    "bars_coverage", "id n_rows# n_days# first_ts last_ts",
    "SELECT id, count(*) AS n_rows, count(DISTINCT CAST(ts AS DATE)) AS n_days, min(ts) AS first_ts, max(ts) AS last_ts FROM ticks GROUP BY id",
    TICKS,
)(lambda s, p: B.coverage(M.order_ticks(s, p)))


def _month_days(s, p):
    d = M.nation_bars(s, p).withColumn("day", F.col("ts").cast("date"))
    return d.withColumns({"start": F.trunc("day", "month"), "end": F.last_day("day")})


query(
    "bars_missing_day_parts", "id start! end! count_days# missing_start# missing_interior# missing_end#",
    """SELECT id, m AS start, last_day(m) AS "end", count(*) AS count_days, CAST(min(d) AS DATE) - m AS missing_start,
     (max(d) - min(d) + 1) - count(*) AS missing_interior, last_day(m) - max(d) AS missing_end
     FROM (SELECT id, CAST(ts AS DATE) AS d, CAST(date_trunc('month', ts) AS DATE) AS m FROM bars) GROUP BY id, m""",
    NB,
)(lambda s, p: B.missing_day_parts(_month_days(s, p), ["id"], "start", "end"))

TF_DAYS = (2, 5, 7, 30)
_SNAP = """SELECT *, first(open) OVER c AS o, max(high) OVER c AS h, min(low) OVER c AS l, sum(volume) OVER c AS v,
  arg_min(ts, struct_pack(a := -high, b := ts)) OVER c AS time_high, arg_min(ts, struct_pack(a := low, b := ts)) OVER c AS time_low,
  first(t_open) OVER c AS time_open_bar, row_number() OVER c AS count_days,
  sum(gap) OVER c AS count_missing_days FROM ({src}) WINDOW c AS (PARTITION BY id, tf, bar_seq ORDER BY ts)"""
COUNT_SRC = f"""SELECT *, CASE WHEN pos = 1 THEN 0 ELSE greatest(date_diff('day', pts, ts) - 1, 0) END AS gap,
  coalesce(pts, ts - INTERVAL 1 DAY) + INTERVAL 1 MILLISECOND AS t_open FROM (
  SELECT bars.*, n AS tf_days, n || 'D' AS tf, (rn - 1) // n + 1 AS bar_seq, (rn - 1) % n + 1 AS pos,
   {lag('ts')} AS pts FROM bars) b0 CROSS JOIN (SELECT unnest([2, 5, 7, 30]) AS n)"""
COUNT_SRC = f"""SELECT *, CASE WHEN pos = 1 THEN 0 ELSE greatest(date_diff('day', pts, ts) - 1, 0) END AS gap,
  coalesce(pts, ts - INTERVAL 1 DAY) + INTERVAL 1 MILLISECOND AS t_open FROM (
  SELECT b.*, n AS tf_days, n || 'D' AS tf, (rn - 1) // n + 1 AS bar_seq, (rn - 1) % n + 1 AS pos
  FROM (SELECT *, {lag('ts')} AS pts FROM bars) b CROSS JOIN (SELECT unnest([2, 5, 7, 30]) AS n))"""
SNAP_OUT = "time_open time_high time_low time_open_bar count_days# count_missing_days#"
COUNT_OUT = f"id tf ts tf_days# bar_seq# pos_in_bar# is_partial_end count_days_remaining# {OHLC} {SNAP_OUT}"
query(
    "bars_count_snapshots", COUNT_OUT,
    "SELECT id, tf, ts, tf_days, bar_seq, pos AS pos_in_bar, pos < tf_days AS is_partial_end, tf_days - pos AS count_days_remaining, o AS open, h AS high, l AS low, close, v AS volume, t_open AS time_open, time_high, time_low, time_open_bar, count_days, count_missing_days FROM ("
    + _SNAP.format(src=COUNT_SRC) + ")",
    NB,
)(lambda s, p: B.count_snapshots(M.nation_bars(s, p), TF_DAYS))

CAL_SPECS = [(1, "W"), (2, "W"), (1, "M"), (3, "M"), (1, "Y")]


def _wstart(d: str, scheme: str) -> str:
    return f"{d} - CAST(isodow({d}) - 1 AS INTEGER)" if scheme == "iso" else f"{d} - CAST(dayofweek({d}) AS INTEGER)"


def _cal_sql(scheme: str) -> str:
    parts = []
    for n, u in CAL_SPECS:
        if u == "W":
            st = _wstart("f", scheme)
            anchor = f"CASE WHEN {st} = f THEN f ELSE {st} + 7 END"
            start = f"a + CAST(((d - a) // {7 * n}) * {7 * n} AS INTEGER)"
            end = f"ps + {7 * n - 1}"
        else:
            t = "month" if u == "M" else "year"
            m = n if u == "M" else 12 * n
            anchor = f"CASE WHEN date_trunc('{t}', f) = f THEN f ELSE CAST(date_trunc('{t}', f) + INTERVAL 1 {t} AS DATE) END"
            start = f"CAST(a + to_months(CAST((date_diff('month', a, d) // {m}) * {m} AS INTEGER)) AS DATE)"
            end = f"CAST(ps + INTERVAL {m} MONTH AS DATE) - 1"
        parts.append(
            f"SELECT *, {end} AS pe FROM (SELECT *, {start} AS ps FROM (SELECT *, '{n}{u}' AS tf, {anchor} AS a FROM dd) WHERE d >= a)"
        )
    return " UNION ALL BY NAME ".join(parts)


def _anchor_sql(scheme: str) -> str:
    parts = []
    for n, u in CAL_SPECS:
        if u == "W":
            ref = "DATE '1970-01-05'" if scheme == "iso" else "DATE '1970-01-04'"
            start, end = f"{ref} + CAST(floor((d - {ref}) / {7 * n}.0) * {7 * n} AS INTEGER)", f"ps + {7 * n - 1}"
        elif u == "M":
            start = f"make_date(year(d), ((month(d) - 1) // {n}) * {n} + 1, 1)"
            end = f"CAST(ps + INTERVAL {n} MONTH AS DATE) - 1"
        else:
            start, end = f"make_date((year(d) // {n}) * {n}, 1, 1)", f"CAST(ps + INTERVAL {n} YEAR AS DATE) - 1"
        parts.append(f"SELECT *, {end} AS pe FROM (SELECT *, {start} AS ps, '{n}{u}' AS tf FROM dd)")
    return " UNION ALL BY NAME ".join(parts)


_DD = f"""dd AS (SELECT *, CAST(ts AS DATE) AS d, CAST(min(ts) OVER (PARTITION BY id) AS DATE) AS f FROM bars)"""
_CAL_BASE = f"""SELECT *, CASE WHEN bar_seq = lag(bar_seq) OVER k THEN greatest(date_diff('day', lag(ts) OVER k, ts) - 1, 0) ELSE 0 END AS gap,
  coalesce(lag(ts) OVER k, ts - INTERVAL 1 DAY) + INTERVAL 1 MILLISECOND AS t_open FROM (
   SELECT *, pe - ps + 1 AS tf_days, dense_rank() OVER (PARTITION BY id, tf ORDER BY ps) AS bar_seq FROM ({{src}}))
  WINDOW k AS (PARTITION BY id, tf ORDER BY ts)"""
CAL_OUT = f"id tf ts tf_days# bar_seq# period_start! period_end! is_partial_start is_partial_end count_days_remaining# {OHLC} {SNAP_OUT}"
_CAL_SELECT = "id, tf, ts, tf_days, bar_seq, ps AS period_start, pe AS period_end, o AS open, h AS high, l AS low, close, v AS volume, t_open AS time_open, time_high, time_low, time_open_bar, count_days, count_missing_days"

for _scheme in ("us", "iso"):
    query(
        f"bars_calendar_{_scheme}", CAL_OUT,
        f"SELECT {_CAL_SELECT}, false AS is_partial_start, count_days < tf_days AS is_partial_end, tf_days - count_days AS count_days_remaining FROM ("
        + _SNAP.format(src=_CAL_BASE.format(src=_cal_sql(_scheme))) + ")",
        NB + ", " + _DD,
    )(lambda s, p, _k=_scheme: B.calendar_snapshots(M.nation_bars(s, p), CAL_SPECS, _k))
    query(
        f"bars_anchored_{_scheme}", CAL_OUT,
        f"""SELECT {_CAL_SELECT}, ended AND n < tf_days AS is_partial_start, count_days < CASE WHEN ended THEN n ELSE tf_days END AS is_partial_end,
         CASE WHEN ended THEN n ELSE tf_days END - count_days AS count_days_remaining FROM (
         SELECT *, count(*) OVER (PARTITION BY id, tf, bar_seq) AS n, CAST(max(ts) OVER (PARTITION BY id, tf) AS DATE) > pe AS ended FROM ("""
        + _SNAP.format(src=_CAL_BASE.format(src=_anchor_sql(_scheme))) + "))",
        NB + ", " + _DD,
    )(lambda s, p, _k=_scheme: B.anchored_snapshots(M.nation_bars(s, p), CAL_SPECS, _k))

query(
    "bars_period_snapshots", f"id tf ts period_start! {OHLC} count_days#",
    """SELECT id, '2W' AS tf, ts, ps AS period_start, first(open) OVER c AS open, max(high) OVER c AS high, min(low) OVER c AS low, close,
     sum(volume) OVER c AS volume, row_number() OVER c AS count_days FROM (
      SELECT *, DATE '1970-01-01' + CAST(floor(floor((wk - DATE '1970-01-01') / 7.0) / 2) * 14 AS INTEGER) AS ps FROM (
       SELECT *, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS wk FROM bars)) WINDOW c AS (PARTITION BY id, ps ORDER BY ts)""",
    NB,
)(lambda s, p: B.period_snapshots(M.nation_bars(s, p), 2, "W", "us"))

query(
    "bars_derived_vs_direct", "id tf bar_seq# max_diff:4 status",
    """SELECT a.id, '5D' AS tf, a.bar_seq, abs(a.close - b.close) AS max_diff, 'differs' AS status FROM
     (SELECT id, (rn - 1) // 5 + 1 AS bar_seq, arg_max(close, ts) AS close FROM bars GROUP BY ALL HAVING count(*) = 5) a
     JOIN (SELECT id, (rn - 1) // 5 + 1 AS bar_seq, arg_max(close, ts) AS close FROM v GROUP BY ALL HAVING count(*) = 5) b
     USING (id, bar_seq) WHERE abs(a.close - b.close) > 0.01 ORDER BY 1""",
    NB + ", v AS (SELECT * REPLACE (CASE WHEN rn % 40 = 0 THEN close + 1.5 ELSE close END AS close) FROM bars)",
)(
    lambda s, p: B.bar_differences(
        B.canonical(B.count_snapshots(M.nation_bars(s, p), [5])),
        B.canonical(B.count_snapshots(
            M.nation_bars(s, p).withColumn("_n", Frame().rn()).withColumn(
                "close", F.when(F.col("_n") % 40 == 0, F.col("close") + 1.5).otherwise(F.col("close"))).drop("_n"), [5])),
        ["id", "tf", "bar_seq"], ["close"], 0.01,
    )
)

query(
    "bars_vwap", "id ts open:4 high low close:4 volume n_venues#",
    """SELECT id, ts, sum(open * volume) / nullif(sum(volume), 0) AS open, max(high) AS high, min(low) AS low,
     sum(close * volume) / nullif(sum(volume), 0) AS close, sum(volume) AS volume, count(*) AS n_venues
     FROM vbars GROUP BY id, ts HAVING count(*) >= 2""",
    VB,
)(lambda s, p: B.venue_vwap(M.nation_venue_bars(s, p)))


def _event_bars(s, p):
    t = M.event_ticks(s, p)
    return t.select("kind", "ts", "ord", F.col("price").alias("open"), F.col("price").alias("high"),
                    F.col("price").alias("low"), F.col("price").alias("close"), F.col("k").cast("double").alias("volume"))


for _freq, _expr in (("4H", "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')"), ("3D", "time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01')"), ("1W", "date_trunc('week', ts)")):
    query(
        f"resample_{_freq.lower()}", "kind bucket open high low close volume n_rows# last_ts",
        f"""SELECT event_type AS kind, CAST({_expr} AS TIMESTAMP) AS bucket, arg_min(value, o) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, o) AS close, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS volume, count(*) AS n_rows, max(ts) AS last_ts
         FROM (SELECT *, struct_pack(a := ts, b := event_id) AS o FROM events) GROUP BY 1, 2""",
    )(lambda s, p, _k=_freq: B.resample(_event_bars(s, p), _k, ["kind"], "ts", "ord"))

query(
    "resample_month_strict", "id bucket open high low close volume n_rows#",
    """SELECT id, bucket, open, high, low, close, volume, n_rows FROM (SELECT *, max(bucket) OVER (PARTITION BY id) AS mx FROM (
     SELECT id, date_trunc('month', ts)::TIMESTAMP AS bucket, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
     sum(volume) AS volume, count(*) AS n_rows FROM bars GROUP BY 1, 2)) WHERE bucket < mx""",
    NB,
)(lambda s, p: B.resample(M.nation_bars(s, p), "1M", strict=True))

query(
    "bars_season_bins", "id bin# first_ts last_ts open high low close volume",
    """SELECT id, bin, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
     arg_max(close, ts) AS close, sum(volume) AS volume FROM (SELECT *, (sum(c) OVER (PARTITION BY id ORDER BY ts)) // 2 AS bin FROM (
      SELECT *, CASE WHEN s <> lag(s) OVER (PARTITION BY id ORDER BY ts) THEN 1 ELSE 0 END AS c FROM (
       SELECT *, (month(ts) % 12) // 3 AS s FROM bars))) GROUP BY id, bin""",
    NB,
)(lambda s, p: B.season_bins(M.nation_bars(s, p), B.season_of("ts"), 2))

query(
    "bars_enough_history", "id n#",
    "SELECT id, count(*) AS n FROM bars GROUP BY id HAVING count(*) >= 500",
    NB,
)(lambda s, p: B.enough_history(M.nation_bars(s, p), F.lit(500)).groupBy("id").agg(F.count("*").alias("n")))

query(
    "price_discrepancy", "id venue_id deviation:6 threshold:6 is_discrepant",
    f"""SELECT q.id, q.venue_id, abs((q.price - l.last_close) / l.last_close) AS deviation, 3 * l.sd AS threshold,
      coalesce(abs((q.price - l.last_close) / l.last_close) > 3 * l.sd, false) AS is_discrepant FROM
      (SELECT id, venue_id, arg_max(price, struct_pack(a := ts, b := ord)) AS price FROM ticks GROUP BY 1, 2) q JOIN
      (SELECT id, arg_max(close, ts) AS last_close, arg_max(sd, ts) AS sd FROM (SELECT *, {ro('stddev_samp', 'r', 30)} AS sd FROM
        (SELECT *, close / {lag('close')} - 1 AS r FROM bars)) GROUP BY id) l USING (id)""",
    NB,
)(lambda s, p: B.price_discrepancy(
    M.order_ticks(s, p).groupBy("id", "venue_id").agg(F.max_by("price", F.struct("ts", "ord")).alias("price")), M.nation_bars(s, p)))

_carry_prev = lambda s, p: B.count_snapshots(M.nation_bars(s, p), [7]).filter("is_partial_end")
query(
    "bars_carry_forward", "id tf ts bar_seq# open high low close volume time_high time_low count_days# is_partial_end",
    f"""SELECT id, tf, ts, bar_seq, o AS open, h AS high, l AS low, close, v AS volume, time_high, time_low, count_days, pos < tf_days AS is_partial_end
      FROM ({_SNAP.format(src=COUNT_SRC)}) WHERE tf = '7D' AND pos > 1 AND ts = pts + INTERVAL 1 DAY""",
    NB,
)(lambda s, p: B.carry_forward(
    _carry_prev(s, p).withColumn("nxt", F.date_add(F.col("ts").cast("date"), 1)),
    M.nation_bars(s, p).withColumn("nxt", F.col("ts").cast("date")), ("id", "tf", "nxt")).drop("nxt"))

# --- calendar --------------------------------------------------------------------------------------
query(
    "date_parts", "event_id year# quarter# half# month# week_iso# day# day_of_year# dow_us# dow_iso# hour# minute# second# unix# is_weekend is_business_day is_month_start is_month_end is_quarter_end is_year_start season moon_phase:6",
    """SELECT event_id, year(ts) AS year, quarter(ts) AS quarter, CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END AS half, month(ts) AS month, week(ts) AS week_iso,
     day(ts) AS day, dayofyear(ts) AS day_of_year, dayofweek(ts) + 1 AS dow_us, isodow(ts) AS dow_iso, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second,
     floor(epoch(ts)) AS unix, isodow(ts) >= 6 AS is_weekend, isodow(ts) <= 5 AS is_business_day, day(ts) = 1 AS is_month_start,
     CAST(ts AS DATE) = last_day(ts) AS is_month_end, CAST(ts AS DATE) = last_day(ts) AND month(ts) % 3 = 0 AS is_quarter_end,
     day(ts) = 1 AND month(ts) = 1 AS is_year_start, ['winter','spring','summer','autumn'][(month(ts) % 12) // 3 + 1] AS season,
     fmod((floor(epoch(ts)) - 947182440) / 86400.0, 29.530588853) / 29.530588853 AS moon_phase FROM events""",
)(lambda s, p: C.with_date_parts(M.event_ticks(s, p)))


def _sessions(s, p):
    t = M.order_ticks(s, p).groupBy("id").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    return C.session_windows(t, "a", "b").withColumns({"open_utc": F.col("open_utc").cast("timestamp_ntz"), "close_utc": F.col("close_utc").cast("timestamp_ntz")})


query(
    "session_windows_utc", "id session_date! open_utc close_utc dst_safe",
    """SELECT id, CAST(d AS DATE) AS session_date, ((d + INTERVAL '09:30:00') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_utc,
      ((d + INTERVAL '16:00:00') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS close_utc, true AS dst_safe FROM
      (SELECT id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS d FROM ticks GROUP BY id)""",
    TICKS,
)(_sessions)

_DIM_SQL = """dim AS (SELECT n || 'D' AS tf, n AS tf_days, 'tf_day' AS alignment FROM range(1, 31) t(n)
  UNION ALL SELECT n || 'W', 7 * n, 'calendar_iso' FROM range(1, 5) t(n))"""
query(
    "ema_alpha_lookup_on_bars", "id tf period# alpha_bar:8 alpha_daily:8 effective_days# n_bars#",
    """SELECT id, tf, period, 2.0 / (period + 1) AS alpha_bar, 1 - pow(1 - 2.0 / (period + 1), 1.0 / tf_days) AS alpha_daily,
     period * tf_days AS effective_days, n // tf_days AS n_bars FROM (SELECT id, count(*) AS n FROM bars GROUP BY id)
     CROSS JOIN dim CROSS JOIN (SELECT unnest([9, 21, 50]) AS period) WHERE n // tf_days >= period""",
    NB + ", " + _DIM_SQL,
)(lambda s, p: C.ema_alphas(
    F.broadcast(C.timeframes(s, 30, 4, 0, 0).filter("alignment IN ('tf_day', 'calendar_iso')").filter("n >= 1 AND unit IN ('D', 'W')")), (9, 21, 50)
).crossJoin(M.nation_bars(s, p).groupBy("id").agg(F.count("*").alias("n0"))).withColumn(
    "n_bars", F.floor(F.col("n0") / F.col("tf_days"))).filter(F.col("n_bars") >= F.col("period")))

query(
    "timeframe_realized_days", "id tf ts tf_days# days_ok",
    f"""SELECT id, '1M' AS tf, ts, tf_days, tf_days BETWEEN 28 AND 32 AS days_ok FROM (SELECT id, ts, date_diff('day', ps, CAST(ps + INTERVAL 1 MONTH AS DATE)) AS tf_days FROM
      (SELECT id, ts, CAST(date_trunc('month', ts) AS DATE) AS ps FROM bars))""",
    NB,
)(lambda s, p: C.realized_days_ok(B.anchored_snapshots(M.nation_bars(s, p), [(1, "M")], "iso"), C.timeframes(s)))

query(
    "timeframe_illegal_for_table", "table_name tf n#",
    """SELECT 'bars_cal_iso' AS table_name, tf, count(*) AS n FROM (SELECT id, unnest(['1D', '3D']) AS tf FROM bars) GROUP BY tf""",
    NB,
)(lambda s, p: C.illegal_timeframes(
    M.nation_bars(s, p).select("id", F.explode(F.array(F.lit("1D"), F.lit("3D"), F.lit("2W"))).alias("tf")).withColumn("table_name", F.lit("bars_cal_iso")),
    C.timeframes(s), C.table_rules(s)).groupBy("table_name", "tf").agg(F.count("*").alias("n")))

# --- returns ---------------------------------------------------------------------------------------
_SNAPS = f"""snap AS (SELECT id, tf, ts, bar_seq, pos < tf_days AS roll, close, h AS high, l AS low FROM ({_SNAP.format(src=COUNT_SRC)})
  WHERE tf IN ('2D', '7D'))"""


def _ret_sql() -> str:
    cols = []
    for sx, pv in (("_roll", "pu"), ("", "pc")):
        cols.append(f"""close - {pv} AS delta1{sx}, close / {pv} - 1 AS ret_arith{sx}, ln(close / {pv}) AS ret_log{sx},
          CASE WHEN {pv} IS NOT NULL THEN high - low END AS range{sx},
          CASE WHEN {pv} IS NOT NULL THEN greatest(high - low, abs(high - {pv}), abs(low - {pv})) END AS true_range{sx}""")
    inner = f"""SELECT *, {', '.join(cols)}, bar_seq - pseq AS gap_bars FROM (
      SELECT *, lag(close) OVER u AS pu, CASE WHEN NOT roll THEN lag(close) OVER c END AS pc, CASE WHEN NOT roll THEN lag(bar_seq) OVER c END AS pseq
      FROM snap WINDOW u AS (PARTITION BY id, tf ORDER BY ts), c AS (PARTITION BY id, tf, roll ORDER BY ts)) WHERE pu IS NOT NULL"""
    return f"""SELECT *, range / close AS range_pct, true_range_roll / close AS true_range_pct_roll, delta1_roll - lag(delta1_roll) OVER u AS delta2_roll, CASE WHEN NOT roll THEN delta1 - lag(delta1) OVER c END AS delta2,
      ret_arith_roll - lag(ret_arith_roll) OVER u AS delta_ret_arith_roll, CASE WHEN NOT roll THEN ret_log - lag(ret_log) OVER c END AS delta_ret_log
      FROM ({inner}) WINDOW u AS (PARTITION BY id, tf ORDER BY ts), c AS (PARTITION BY id, tf, roll ORDER BY ts)"""


query(
    "returns_bars", "id tf ts gap_bars# delta1:2 delta1_roll:2 delta2:2 delta2_roll:2 ret_arith:6 ret_arith_roll:6 ret_log:6 ret_log_roll:6 range:2 range_pct:6 true_range:2 true_range_roll:2 true_range_pct_roll:6 delta_ret_arith_roll:6 delta_ret_log:6",
    _ret_sql(), NB + ", " + _SNAPS,
)(lambda s, p: R.bar_returns(B.count_snapshots(M.nation_bars(s, p), [2, 7])))

for _sch in ("us", "iso"):
    for _kind, _src in (("calendar", _cal_sql), ("anchored", _anchor_sql)):
        _part = "count_days < tf_days" if _kind == "calendar" else "count_days < CASE WHEN ended THEN n ELSE tf_days END"
        query(
            f"returns_bars_{_kind}_{_sch}", "id tf ts gap_bars# delta1:2 ret_arith:6 ret_log_roll:6 true_range:2 delta2:2",
            _ret_sql(),
            NB + ", " + _DD + f""", snap AS (SELECT id, tf, ts, bar_seq, {_part} AS roll, close, h AS high, l AS low FROM (SELECT *,
             count(*) OVER (PARTITION BY id, tf, bar_seq) AS n, CAST(max(ts) OVER (PARTITION BY id, tf) AS DATE) > pe AS ended FROM ("""
            + _SNAP.format(src=_CAL_BASE.format(src=_src(_sch))) + ")))",
        )(lambda s, p, _k=_kind, _c=_sch: R.bar_returns(
            (B.calendar_snapshots if _k == "calendar" else B.anchored_snapshots)(M.nation_bars(s, p), CAL_SPECS, _c)))

query(
    "returns_daily_gaps", "id ts gap_days# ret_arith:6 ret_log:6",
    f"""SELECT * FROM (SELECT id, ts, date_diff('day', {lag('ts')}, ts) AS gap_days, close / {lag('close')} - 1 AS ret_arith,
      ln(close / {lag('close')}) AS ret_log FROM bars) WHERE gap_days IS NOT NULL""",
    NB,
)(lambda s, p: R.daily_returns(M.nation_bars(s, p)))

query(
    "returns_change_columns", "id ts close_pct_delta:6 close_log_delta:6 open_pct_delta:6 open_log_delta:6 open_close_pct:6 open_close_log:6 range_pct:6",
    f"""SELECT id, ts, close / {lag('close')} - 1 AS close_pct_delta, ln(close / {lag('close')}) AS close_log_delta, open / {lag('open')} - 1 AS open_pct_delta,
      ln(open / {lag('open')}) AS open_log_delta, close / open - 1 AS open_close_pct, ln(close / open) AS open_close_log, (high - low) / open AS range_pct FROM bars""",
    NB,
)(lambda s, p: R.changes(M.nation_bars(s, p), Frame(), ["close", "open"]).withColumns(R.intraday_changes()))

query(
    "returns_newest_first", "id ts close_pct_delta:6",
    "SELECT id, ts, close / lead(close) OVER (PARTITION BY id ORDER BY ts) - 1 AS close_pct_delta FROM bars", NB,
)(lambda s, p: R.changes(M.nation_bars(s, p), Frame(), ["close"], ("pct",), newest_first=True))

query(
    "returns_zscore", "id ts ret_arith_z30:5 ret_arith_z90:5 ret_log_z30:5 is_outlier",
    f"""SELECT *, coalesce(greatest(abs(ret_arith_z30), abs(ret_arith_z90), abs(ret_log_z30), abs(ret_log_z90)) > 4, false) AS is_outlier FROM (SELECT id, ts,
      {', '.join(f"(CASE WHEN count(ret_{k}) OVER w{n} = {n} THEN (ret_{k} - avg(ret_{k}) OVER w{n}) / nullif(stddev_samp(ret_{k}) OVER w{n}, 0) END) AS ret_{k}_z{n}" for k in ('arith', 'log') for n in (30, 90))}
      FROM (SELECT id, ts, close / {lag('close')} - 1 AS ret_arith, ln(close / {lag('close')}) AS ret_log FROM bars QUALIFY ret_arith IS NOT NULL)
      WINDOW w30 AS (PARTITION BY id ORDER BY ts ROWS 29 PRECEDING), w90 AS (PARTITION BY id ORDER BY ts ROWS 89 PRECEDING))""",
    NB,
)(lambda s, p: R.return_zscores(R.daily_returns(M.nation_bars(s, p)), ["ret_arith", "ret_log"], ("id",), days=(30, 90)))

query(
    "returns_cross_section_norms", "id ts n_assets# close_cs_z:5 close_cs_rank:6",
    """SELECT id, ts, n AS n_assets, CASE WHEN n >= 5 THEN (close - m) / nullif(s, 0) END AS close_cs_z, CASE WHEN n >= 5 THEN pr END AS close_cs_rank FROM (
      SELECT id, ts, close, count(*) OVER t AS n, avg(close) OVER t AS m, stddev_samp(close) OVER t AS s, percent_rank() OVER (PARTITION BY ts ORDER BY close) AS pr
      FROM bars WINDOW t AS (PARTITION BY ts))""",
    NB,
)(lambda s, p: R.cross_section_norms(M.nation_bars(s, p), "close"))

query(
    "returns_forward_binarized", "id ts fwd_1:6 fwd_5:6 fwd_log_5:6 up_5#",
    """SELECT id, ts, lead(close) OVER w / close - 1 AS fwd_1, lead(close, 5) OVER w / close - 1 AS fwd_5, ln(lead(close, 5) OVER w / close) AS fwd_log_5,
      CAST(lead(close, 5) OVER w / close - 1 > 0 AS INTEGER) AS up_5 FROM bars WINDOW w AS (PARTITION BY id ORDER BY ts)""",
    NB,
)(lambda s, p: M.nation_bars(s, p).withColumns({
    "fwd_1": Frame().forward_return("close", 1), "fwd_5": Frame().forward_return("close", 5),
    "fwd_log_5": Frame().forward_return("close", 5, log=True)}).withColumn("up_5", R.binarize("fwd_5")))


def _same_as(name: str, full: str):
    """A query whose rows must be those of another one's SQL."""

    def add(fn):
        spec = {"bars_count": COUNT_OUT}.get("_".join(full.split("_")[:2]), CAL_OUT)
        query(name, spec)(fn)
        REGISTRY[name] = Query(REGISTRY[name].run, REGISTRY[full].sql)
        return fn

    return add


# --- increments ------------------------------------------------------------------------------------
def _increments(kind: str, specs, scheme: str = "iso", days: int = 700):
    """All days in batches, each folded into the state that the batch before has left."""

    def run(s, p):
        daily, bars, folder = M.nation_bars(s, p), O.Bars(kind, specs, scheme), f"{checkpoint_dir(s).rstrip('/')}/tideline-tables-{uuid.uuid4().hex}"
        cuts = [None, *slice_edges(daily, "ts", days), None]
        for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
            some = daily if low is None else daily.filter(F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
            O.append_days(some if high is None else some.filter(F.col("ts") < F.lit(high).cast("timestamp_ntz")), bars, folder, i)
        return O.finished(s, bars, folder)

    return run


_same_as("bars_count_increments", "bars_count_snapshots")(_increments(O.COUNT, TF_DAYS))
for _scheme in ("us", "iso"):
    _same_as(f"bars_calendar_increments_{_scheme}", f"bars_calendar_{_scheme}")(_increments(O.CALENDAR, CAL_SPECS, _scheme))
    _same_as(f"bars_anchored_increments_{_scheme}", f"bars_anchored_{_scheme}")(_increments(O.ANCHORED, CAL_SPECS, _scheme))
