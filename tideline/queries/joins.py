"""Null handling, joins, cross-timeframe features and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.functions.smoothing import ewm_span
from tideline.operators import asof as J
from tideline.operators import averages as A
from tideline.operators import bars as B
from tideline.operators import gram as GM
from tideline.operators import nulls as N
from tideline.operators import stats as S
from tideline.plans.incremental import slice_edges
from tideline.queries.base import NB, SB, TICKS, VB, W, ema_cte, lag, phi, query, ro, span
from tideline.queries.features import _nb
from tideline.session import checkpoint_dir
from tideline.sources import market as M


def _gappy(s, p):
    """Closes with every third/fourth value of a key missing."""
    d = _nb(s, p).withColumn("rn", Frame().rn())
    return d.withColumn("x", F.when((F.col("rn") % 7 < 4) & (F.col("rn") > 2), F.col("close")))


GAP = NB + ", g AS (SELECT *, CASE WHEN rn % 7 < 4 AND rn > 2 THEN close END AS x FROM bars)"
query("nulls_forward_fill", "id ts x:2",
      f"""SELECT id, ts, coalesce(f, first_value(f IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS x FROM (
       SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts ROWS 2 PRECEDING) AS f FROM g)""", GAP,
      )(lambda s, p: N.fill_nulls(_gappy(s, p), Frame(), "x", "forward_fill", 2))
query("nulls_interpolate", "id ts x:3",
      f"""SELECT id, ts, coalesce(x, pv + (nv - pv) * (rn - pr) / nullif(nr - pr, 0), pv) AS x FROM (SELECT *, last_value(x IGNORE NULLS) OVER {W} AS pv, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER {W} AS pr,
       first_value(x IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER n AS nr FROM g WINDOW n AS (PARTITION BY id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", GAP,
      )(lambda s, p: N.fill_nulls(_gappy(s, p), Frame(), "x", "interpolate"))
query("nulls_fill_with_source", "id ts x_filled:2 x_source_ts",
      f"SELECT id, ts, last_value(x IGNORE NULLS) OVER q AS x_filled, last_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER q AS x_source_ts FROM g WINDOW q AS (PARTITION BY id ORDER BY ts ROWS 1 PRECEDING)", GAP,
      )(lambda s, p: N.fill_with_source(_gappy(s, p), Frame(), "x", 1))
query("zscore_columns", "id ts close_zscore:5 volume_zscore:5",
      f"SELECT id, ts, (close - {ro('avg', 'close', 20)}) / nullif({ro('stddev_samp', 'close', 20)}, 0) AS close_zscore, (volume - {ro('avg', 'volume', 20)}) / nullif({ro('stddev_samp', 'volume', 20)}, 0) AS volume_zscore FROM bars", NB,
      )(lambda s, p: N.add_zscores(_nb(s, p), Frame(), ["close", "volume"], 20))
query("outliers_zscore_iqr", "id ts volume_z volume_iqr",
      """SELECT id, ts, coalesce(abs(volume - m) / nullif(sd, 0) > 2.5, false) AS volume_z, q3 > q1 AND (volume < q1 - 1.5 * (q3 - q1) OR volume > q3 + 1.5 * (q3 - q1)) AS volume_iqr FROM bars
       JOIN (SELECT id, avg(volume) AS m, stddev_samp(volume) AS sd, quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.75) AS q3 FROM bars GROUP BY id) USING (id)""", NB,
      )(lambda s, p: N.flag_outliers(N.flag_outliers(_nb(s, p), ["id"], "volume", 2.5).withColumnRenamed("volume_is_outlier", "volume_z"), ["id"], "volume", method="iqr").withColumnRenamed("volume_is_outlier", "volume_iqr"))
query("nulls_min_points", "id n#", "SELECT id, count(*) AS n FROM g GROUP BY id HAVING count(x) >= 300", GAP)(
    lambda s, p: N.enough_points(_gappy(s, p), ["id"], "x", 300).groupBy("id").agg(F.count("*").alias("n")))


def _macro(s, p):
    """Daily wide series: total order value per priority class on days that have one."""
    t = M.order_ticks(s, p)
    return t.groupBy("ts").pivot("venue_id", [1, 2, 3, 4, 5]).agg(F.sum("price")).select(
        "ts", *[F.col(str(i)).alias(f"s{i}") for i in range(1, 6)], F.lit(0).alias("g"))


MACRO = TICKS + """, mac AS (SELECT ts, 0 AS g, """ + ", ".join(f"sum(price) FILTER (venue_id = {i}) AS s{i}" for i in range(1, 6)) + " FROM ticks GROUP BY ts)"
query("nulls_fill_by_frequency", "ts s1:2 s2:2 s3:2 s4:2 s5:2",
      ", ".join(["SELECT ts"] + [f"last_value(s{i} IGNORE NULLS) OVER (ORDER BY ts ROWS {n} PRECEDING) AS s{i}" for i, n in ((1, 5), (2, 10), (3, 45), (4, 10), (5, 45))]) + " FROM mac", MACRO,
      )(lambda s, p: N.fill_by_frequency(_macro(s, p), Frame(("g",)), {"s1": "daily", "s2": "weekly", "s3": "monthly", "s4": "weekly", "s5": "monthly"}))


def _venue_day(s, p, v, name):
    return M.order_ticks(s, p).filter(F.col("venue_id") == v).groupBy("id", "ts").agg(F.sum("price").alias(name))


query("nulls_combine_frames", "id ts a:2 b:2 c:2 d:2 e:2 has_a has_e",
      "SELECT id, ts, " + ", ".join(f"sum(price) FILTER (venue_id = {i}) AS {c}" for i, c in enumerate("abcde", 1)) + ", count(*) FILTER (venue_id = 1) > 0 AS has_a, count(*) FILTER (venue_id = 5) > 0 AS has_e FROM ticks GROUP BY id, ts", TICKS,
      )(lambda s, p: N.combine_frames({c: _venue_day(s, p, i, c) for i, c in enumerate("abcde", 1)}, ["id", "ts"]))
query("nulls_mask_ranges", "id start_ts end_ts n_rows#",
      """SELECT id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM (SELECT *, rn - row_number() OVER (PARTITION BY id ORDER BY ts) AS k FROM bars WHERE close > 250000) GROUP BY id, k""", NB,
      )(lambda s, p: N.mask_ranges(_nb(s, p), Frame(), F.col("close") > 250000))
query("nulls_series_issues", "id ts issue detail:3",
      f"""WITH q AS (SELECT *, date_diff('day', {lag('ts')}, ts) AS gap, (volume - avg(volume) OVER (PARTITION BY id)) / nullif(stddev_samp(volume) OVER (PARTITION BY id), 0) AS z, max(ts) OVER (PARTITION BY id) AS mx FROM bars)
       SELECT id, ts, 'gap' AS issue, gap::DOUBLE AS detail FROM q WHERE gap > 12 UNION ALL SELECT id, ts, 'outlier', volume FROM q WHERE abs(z) > 4 UNION ALL SELECT id, ts, 'range', volume FROM q WHERE volume < 1 OR volume > 4
       UNION ALL SELECT id, ts, 'stale', date_diff('day', ts, TIMESTAMP '2001-08-10')::DOUBLE FROM q WHERE ts = mx AND date_diff('day', ts, TIMESTAMP '2001-08-10') > 5""", NB,
      )(lambda s, p: N.series_issues(_nb(s, p), Frame(), "volume", 12, 1, 4, F.lit("2001-08-10").cast("date"), 5))
query("nulls_feature_issues", "id issue feature n#",
      f"""WITH fx AS (SELECT *, CASE WHEN rn % 5 <> 0 THEN close / {lag('close')} - 1 END AS r, CASE WHEN rn % 3 = 0 THEN volume END AS thin FROM bars), kept AS (SELECT * FROM fx WHERE rn % 50 <> 0),
       st AS (SELECT id, avg(r) AS m, stddev_samp(r) AS sd, avg(thin) AS mt, stddev_samp(thin) AS st, count(*) AS n, count(thin) AS c, count(r) AS cr FROM kept GROUP BY id)
       SELECT id, 'gap' AS issue, 'ts' AS feature, count(*) AS n FROM (SELECT id, date_diff('day', {lag('ts')}, ts) AS g FROM kept) WHERE g > 1 GROUP BY id
       UNION ALL SELECT id, 'missing', 'ts', count(*) FROM bars WHERE rn % 50 = 0 GROUP BY id UNION ALL SELECT id, 'null_ratio', 'thin', 1 FROM st WHERE 1 - c / n > 0.5 UNION ALL SELECT id, 'null_ratio', 'r', 1 FROM st WHERE 1 - cr / n > 0.5
       UNION ALL SELECT id, 'outlier', 'r', count(*) FROM kept JOIN st USING (id) WHERE abs(r - m) > 4 * sd GROUP BY id UNION ALL SELECT id, 'outlier', 'thin', count(*) FROM kept JOIN st USING (id) WHERE abs(thin - mt) > 4 * st GROUP BY id""", NB,
      )(lambda s, p: (lambda d: N.feature_issues(d.filter("rn % 50 <> 0"), Frame(), ["r", "thin"], d, sigma=4.0))(
          _nb(s, p).withColumn("rn", Frame().rn()).withColumns({"r": F.when(F.col("rn") % 5 != 0, Frame().pct("close")), "thin": F.when(F.col("rn") % 3 == 0, F.col("volume"))})))
query("feature_template", "id ts x:2 sma:3 sma_zscore:4 sma_is_outlier",
      f"""WITH h AS (SELECT id, ts, coalesce(last_value(x IGNORE NULLS) OVER {W}, first_value(x IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM g),
       m AS (SELECT *, {ro('avg', 'x', 5, 1)} AS sma FROM h)
       SELECT id, ts, x, sma, (sma - {ro('avg', 'sma', 30)}) / nullif({ro('stddev_samp', 'sma', 30)}, 0) AS sma_zscore,
        coalesce(abs((sma - avg(sma) OVER (PARTITION BY id)) / nullif(stddev_samp(sma) OVER (PARTITION BY id), 0)) > 4, false) AS sma_is_outlier FROM m""", GAP)(lambda s, p: N.feature_template(
    _gappy(s, p), Frame(), lambda d, f: d.withColumn("sma", f.mean("x", 5, 1)), ["x"], "forward_fill", ["sma"], 30, ["sma"]))

# --- as-of and interval joins ----------------------------------------------------------------------
_LEFT = "SELECT id, venue_id, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY id, ts, venue_id ORDER BY ord) AS k FROM ticks) WHERE k = 1"


def _venue_ticks(s, p, v=None):
    b = M.nation_venue_bars(s, p).select("id", "venue_id", "ts", F.col("close").alias("price"))
    return b if v is None else b.filter(F.col("venue_id") == v).drop("venue_id")


# every venue against the next one
_V1 = VB + ", l AS (SELECT id, venue_id, ts, close AS price FROM vbars), r AS (SELECT id, venue_id % 5 + 1 AS venue_id, ts, close AS ref FROM vbars)"
_asof_args = lambda s, p: (_venue_ticks(s, p), _venue_ticks(s, p).withColumn("venue_id", F.col("venue_id") % 5 + 1).withColumnRenamed("price", "ref"), ["id", "venue_id"], "ts", ["ref"])
query("asof_backward", "id venue_id# ts price:2 matched_ts ref:2", "SELECT l.id, l.venue_id, l.ts, l.price, r.ts AS matched_ts, r.ref FROM l ASOF LEFT JOIN r ON l.id = r.id AND l.venue_id = r.venue_id AND l.ts >= r.ts", _V1)(
    lambda s, p: J.asof_join(*_asof_args(s, p)))
query("asof_forward", "id venue_id# ts price:2 matched_ts ref:2", "SELECT l.id, l.venue_id, l.ts, l.price, r.ts AS matched_ts, r.ref FROM l ASOF LEFT JOIN r ON l.id = r.id AND l.venue_id = r.venue_id AND l.ts <= r.ts", _V1)(
    lambda s, p: J.asof_join(*_asof_args(s, p), direction="forward"))
query("asof_nearest", "id venue_id# ts price:2 matched_ts ref:2",
      """SELECT b.id, b.venue_id, b.ts, b.price, CASE WHEN f.t IS NULL OR b.ts - b.t <= f.t - b.ts THEN b.t ELSE f.t END AS matched_ts, CASE WHEN f.t IS NULL OR b.ts - b.t <= f.t - b.ts THEN b.ref ELSE f.ref END AS ref FROM
       (SELECT l.*, r.ts AS t, r.ref FROM l ASOF LEFT JOIN r ON l.id = r.id AND l.venue_id = r.venue_id AND l.ts >= r.ts) b JOIN (SELECT l.*, r.ts AS t, r.ref FROM l ASOF LEFT JOIN r ON l.id = r.id AND l.venue_id = r.venue_id AND l.ts <= r.ts) f USING (id, venue_id, ts)""", _V1,
      )(lambda s, p: J.asof_join(*_asof_args(s, p), direction="nearest"))
_EV = "el AS (SELECT * FROM events WHERE event_type = 'click'), er AS (SELECT event_type, ts, value AS ref FROM events WHERE event_type = 'purchase')"
query("asof_split_hot_key", "event_id ts matched_ts ref:3", "SELECT el.event_id, el.ts, er.ts AS matched_ts, er.ref FROM el ASOF LEFT JOIN er ON el.ts >= er.ts", _EV)(
    lambda s, p: J.asof_join(
        M.event_ticks(s, p).filter("kind = 'click'").select("event_id", "ts", F.lit(0).alias("g")),
        M.event_ticks(s, p).filter("kind = 'purchase'").select(F.lit(0).alias("g"), "ts", F.col("price").alias("ref")), ["g"], "ts", ["ref"], split=F.date_trunc("day", F.col("ts"))))


def _trades(s, p):
    """Holding intervals: a nation is 'held' from each 40th bar for 25 days."""
    d = _nb(s, p).withColumn("rn", Frame().rn()).filter("rn % 40 = 1")
    return d.select("id", F.col("rn").alias("trade_id"), F.col("ts").alias("entry_ts"), (F.col("ts") + F.expr("INTERVAL 25 DAYS")).alias("exit_ts"), F.col("close").alias("entry_price"))


TRADES = NB + ", trades AS (SELECT id, rn AS trade_id, ts AS entry_ts, ts + INTERVAL 25 DAY AS exit_ts, close AS entry_price FROM bars WHERE rn % 40 = 1)"
query("interval_join", "id trade_id# ts close:2", "SELECT t.id, t.trade_id, b.ts, b.close FROM trades t JOIN bars b ON b.id = t.id AND b.ts BETWEEN t.entry_ts AND t.exit_ts", TRADES)(
    lambda s, p: J.interval_join(_nb(s, p).select("id", "ts", "close"), _trades(s, p), ["id"], "ts", "entry_ts", "exit_ts"))
query("near_event_gate", "id ts in_event_window",
      "SELECT id, ts, EXISTS (SELECT 1 FROM ev WHERE bars.ts BETWEEN ev.ts - INTERVAL 48 HOUR AND ev.ts + INTERVAL 48 HOUR) AS in_event_window FROM bars",
      NB + ", ev AS (SELECT max(ts) AS ts FROM bars GROUP BY year(ts), month(ts))")(
    lambda s, p: J.near_event(_nb(s, p).select("id", "ts"), _nb(s, p).groupBy(F.year("ts"), F.month("ts")).agg(F.max("ts").alias("ev_ts")).select("ev_ts"), "ts", "ev_ts", 48))

# --- cross timeframe -------------------------------------------------------------------------------
_CT = f"""b1 AS (SELECT id, ts, close / {lag('close')} - 1 AS v FROM bars), b7 AS (SELECT id, ts, close / {lag('close')} - 1 AS v FROM (SELECT * FROM bars WHERE rn % 7 = 0)),
 al AS (SELECT a.id, a.ts, a.v AS bv, r.v AS rv, row_number() OVER (PARTITION BY a.id ORDER BY a.ts) AS k FROM b1 a ASOF LEFT JOIN b7 r ON a.id = r.id AND a.ts >= r.ts)"""
_sl = lambda x: ro("regr_slope({x}, k)", x, 5, 2)
query("ctf_features", "id ts base_value:6 ref_value:6 base_slope:6 ref_slope:6 divergence:5 agreement:5 crossover:0",
      f"""SELECT *, {_sl('bv')} AS base_slope, {_sl('rv')} AS ref_slope, (bv - rv) / CASE WHEN {ro('stddev_samp', 'bv', 20, 10)} > 1e-12 THEN {ro('stddev_samp', 'bv', 20, 10)} END AS divergence, {ro('avg', 'ag', 20, 6)} AS agreement, bv AS base_value, rv AS ref_value,
       CASE WHEN nw AND NOT pw THEN 1.0 WHEN pw AND NOT nw THEN -1.0 WHEN nw IS NOT NULL AND pw IS NOT NULL THEN 0.0 END AS crossover FROM (SELECT *, bv > rv AS nw, {lag('bv')} > {lag('rv')} AS pw, CAST(sign(bv) * sign(rv) > 0 AS DOUBLE) AS ag FROM al)""",
      NB + ", " + _CT)(lambda s, p: J.cross_timeframe(
          _nb(s, p).withColumn("v", Frame().pct("close")), B.canonical(B.count_snapshots(_nb(s, p), [7])).withColumn("v", Frame().pct("close")), ["id"], "v", True))


def _ctf_long(s, p):
    d = B.canonical(B.count_snapshots(_nb(s, p), [1, 7, 30]))
    f = Frame(("id", "tf"))
    return d.withColumns({"ret": f.pct("close"), "vol": f.mean("volume", 3)})


query("ctf_all_combinations", "id ts base_tf ref_tf indicator base_value:5 ref_value:5 base_slope:5 divergence:4 agreement:5 crossover:0", None)(
    lambda s, p: J.cross_timeframe_all(_ctf_long(s, p), {"ret": True, "vol": False}, {"1D": ["7D", "30D"], "7D": ["30D"]}))
query("ctf_wide_pivot", "id ts ret_7D_ref_value:6 ret_30D_ref_value:6",
      f"""SELECT a.id, a.ts, r.v AS "ret_7D_ref_value", q.v AS "ret_30D_ref_value" FROM (SELECT * FROM b1 WHERE v IS NOT NULL) a ASOF LEFT JOIN (SELECT * FROM b7 WHERE v IS NOT NULL) r ON a.id = r.id AND a.ts >= r.ts ASOF LEFT JOIN (SELECT * FROM (SELECT id, ts, close / {lag('close')} - 1 AS v FROM bars WHERE rn % 30 = 0) WHERE v IS NOT NULL) q ON a.id = q.id AND a.ts >= q.ts""",
      NB + ", " + _CT)(lambda s, p: J.ctf_wide(J.cross_timeframe_all(_ctf_long(s, p), {"ret": True}, {"1D": ["7D", "30D"]}), ["id"], ["ret_7D", "ret_30D"]))
query("rolling_agreement", "id ts agree_63:6", f"SELECT id, ts, {ro('avg', 'ag', 63, 21)} AS agree_63 FROM (SELECT *, CAST(sign(close - open) * sign(close - {lag('close')}) > 0 AS DOUBLE) AS ag FROM bars)", NB)(
    lambda s, p: J.agreement(_nb(s, p).withColumns({"a": F.col("close") - F.col("open"), "b": Frame().diff("close")}), Frame(), "a", "b", 63, True, "agree_63", 21))
query("forward_return_split", "id agree n# mean:6 median:6 std:6",
      f"""SELECT id, agree, count(*) AS n, avg(fr) AS mean, median(fr) AS median, stddev_samp(fr) AS std FROM (SELECT id, close > {lag('close')} AS agree, lead(close) OVER {W} / close - 1 AS fr FROM bars) WHERE agree IS NOT NULL AND fr IS NOT NULL GROUP BY id, agree""", NB,
      )(lambda s, p: J.forward_split(_nb(s, p).withColumns({"agree": F.col("close") > Frame().lag("close"), "fr": Frame().forward_return("close")}), "agree", "fr", ["id"]))
_LAGS = " UNION ALL ".join(f"SELECT id, {k} AS lag, a, {lag('b', k) if k > 0 else f'lead(b, {-k}) OVER {W}' if k < 0 else 'b'} AS bl FROM ab" for k in range(-5, 6))
_LC = f"lc AS (SELECT id, lag, corr(a, bl) AS c, count(*) AS n FROM ({_LAGS}) WHERE a IS NOT NULL AND bl IS NOT NULL GROUP BY id, lag)"
_AB = f"ab AS (SELECT id, ts, close / {lag('close')} - 1 AS a, volume - {lag('volume')} AS b FROM bars)"
_ab = lambda s, p: _nb(s, p).withColumns({"a": Frame().pct("close"), "b": Frame().diff("volume")})
query("lead_lag_correlations", "id lag# corr:6 n#", "SELECT id, lag, c AS corr, n FROM lc", NB + ", " + _AB + ", " + _LC)(lambda s, p: J.lagged_corr(_ab(s, p), Frame(), "a", "b", 5))
query("lead_lag_best", "id best_lag# best_corr:6 n# feature significant",
      "SELECT id, lag AS best_lag, c AS best_corr, n, 'b' AS feature, abs(c) > 2 / sqrt(n) AS significant FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, lag) AS k FROM lc) WHERE k = 1", NB + ", " + _AB + ", " + _LC)(
    lambda s, p: S.lead_lag_scan(_ab(s, p), ["b"], "a", Frame(), 5))
_EM = ema_cte("e", "bars", "close", {"e5": span(5), "e20": span(20), "e50": span(50)})
_ems = lambda s, p: ewm_span(_nb(s, p), Frame(), "close", {"e5": 5, "e20": 20, "e50": 50})
_PAIR_SQL = " UNION ALL ".join(f"SELECT id, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, avg(CASE WHEN sign(d{a}) = sign(d{b}) THEN 1.0 WHEN d{a} IS NOT NULL AND d{b} IS NOT NULL THEN 0.0 END) AS agree_rate FROM d GROUP BY id" for a, b in (("e5", "e20"), ("e5", "e50"), ("e20", "e50")))
_D = "d AS (SELECT *, " + ", ".join(f"{x} - {lag(x)} AS d{x}" for x in ("e5", "e20", "e50")) + " FROM e)"
query("ema_comovement_pairs", "id a b corr:6 agree_rate:6", _PAIR_SQL, NB + ", " + _EM + ", " + _D)(lambda s, p: J.pairwise_columns(_ems(s, p), Frame(), ["e5", "e20", "e50"]))
query("ema_comovement_hierarchy", "id col mean_abs_corr:6 position#",
      f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY mean_abs_corr DESC, col) AS position FROM (SELECT id, col, avg(abs(corr)) AS mean_abs_corr FROM (SELECT id, a AS col, corr FROM pr UNION ALL SELECT id, b, corr FROM pr) GROUP BY id, col)",
      NB + ", " + _EM + ", " + _D + f", pr AS ({_PAIR_SQL})")(lambda s, p: J.corr_hierarchy(J.pairwise_columns(_ems(s, p), Frame(), ["e5", "e20", "e50"]), ["id"]))


def _store(s, p):
    b, f = _nb(s, p), Frame()
    rets = b.withColumn("ret", f.pct("close")).select("id", "ts", "ret")
    vol = N.flag_outliers(b.withColumn("ret", f.pct("close")), ["id"], "volume", 3.0).select("id", "ts", "volume_is_outlier", F.lit(-1.0).alias("ret"))
    return J.feature_store(b, {"returns": rets.filter("ret IS NOT NULL"), "vol": vol}, ["id", "ts"])


query("feature_store_join", "id ts close ret:6 volume_is_outlier has_price_gap has_outlier",
      f"""SELECT id, ts, close, close / {lag('close')} - 1 AS ret, o AS volume_is_outlier, coalesce(date_diff('day', {lag('ts')}, ts) > 1, false) AS has_price_gap, o AS has_outlier FROM (
       SELECT *, coalesce(abs(volume - avg(volume) OVER (PARTITION BY id)) / nullif(stddev_samp(volume) OVER (PARTITION BY id), 0) > 3, false) AS o FROM bars)""", NB)(_store)
query("source_watermarks", "id dirty_from n_sources# slowest",
      """SELECT id, min(w) AS dirty_from, count(*) AS n_sources, arg_min(s, struct_pack(a := w, b := s)) AS slowest FROM (SELECT id, max(ts) AS w, 'bars' AS s FROM bars GROUP BY id UNION ALL SELECT id, max(ts), 'venue' || venue_id FROM vbars GROUP BY id, venue_id) GROUP BY id""",
      NB + ", vbars AS (SELECT id, venue_id, ts FROM ticks GROUP BY ALL)",
      )(lambda s, p: J.source_watermarks({"bars": _nb(s, p)} | {f"venue{v}": _venue_ticks(s, p, v) for v in range(1, 6)}))
query("sentiment_mean", "ts sentiment:6 n_assets#", f"SELECT ts, CASE WHEN count(r) >= 3 THEN avg(r) END AS sentiment, count(r) AS n_assets FROM (SELECT ts, close / {lag('close')} - 1 AS r FROM bars) GROUP BY ts", NB)(
    lambda s, p: J.sentiment_mean(_nb(s, p).withColumn("r", Frame().pct("close")), "r"))
query("relative_value", "id ts relative_value:5 n_assets#",
      f"SELECT id, ts, CASE WHEN n >= 3 THEN (r - m) / nullif(sd, 0) END AS relative_value, n AS n_assets FROM (SELECT id, ts, r, count(r) OVER t AS n, avg(r) OVER t AS m, stddev_pop(r) OVER t AS sd FROM (SELECT id, ts, close / {lag('close')} - 1 AS r FROM bars) WINDOW t AS (PARTITION BY ts))", NB)(
    lambda s, p: J.relative_value(_nb(s, p).withColumn("r", Frame().pct("close")), "r"))
query("sentiment_pca", "ts pc1:5", None)(lambda s, p: J.sentiment_pca(_nb(s, p).withColumn("r", Frame().log_return("close")), "r"))
_LEAD = f"""SELECT leader, avg(b) AS leader_score, count(*) AS n_followers FROM (SELECT leader, follower, greatest(coalesce(abs(CASE WHEN count(l1) >= 30 THEN corr(l1, r) END), 0), coalesce(abs(CASE WHEN count(l2) >= 30 THEN corr(l2, r) END), 0)) AS b FROM (
       SELECT a.id AS leader, b.id AS follower, a.l1, a.l2, b.r FROM x a JOIN x b ON a.ts = b.ts AND a.id <> b.id) GROUP BY ALL) GROUP BY leader"""
_LAGS = f", rr AS (SELECT id, ts, close / {lag('close')} - 1 AS r FROM bars), x AS (SELECT *, lag(r) OVER {W} AS l1, lag(r, 2) OVER {W} AS l2 FROM rr)"
for _name, _bars, _read in (("leader_scores", NB, _nb), ("leader_scores_suppliers", SB, M.supplier_bars)):
    query(_name, "leader leader_score:6 n_followers#", _LEAD, _bars + _LAGS)(
        lambda s, p, read=_read: GM.leader_scores(read(s, p).withColumn("r", Frame().pct("close")), "r", (1, 2)))
query("promote_features_by_ic", "id ts close:2 volume:1",
      f"""SELECT id, ts, CASE WHEN (SELECT median(abs(corr)) FROM pi WHERE f = 'close') >= 0.02 THEN close END AS close, CASE WHEN (SELECT median(abs(corr)) FROM pi WHERE f = 'volume') >= 0.02 THEN volume END AS volume FROM bars""",
      NB + f", pr AS (SELECT id, close, volume, lead(close) OVER {W} / close - 1 AS y FROM bars), pi AS (SELECT id, 'close' AS f, corr(close, y) AS corr FROM pr GROUP BY id UNION ALL SELECT id, 'volume', corr(volume, y) FROM pr GROUP BY id)")(
    lambda s, p: J.promote_features(
        _nb(s, p).select("id", "ts", F.explode(F.array(F.struct(F.lit("close").alias("feature"), F.col("close").alias("value")), F.struct(F.lit("volume").alias("feature"), F.col("volume").alias("value")))).alias("_i")).select("id", "ts", "_i.*"),
        _nb(s, p).withColumn("y", Frame().forward_return("close")).groupBy("id").agg(*[J.safe_corr(c, "y").alias(c) for c in ("close", "volume")]).select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("ic")) for c in ("close", "volume")])).alias("_i")).select("_i.*"),
        0.02, ["id"], ["close", "volume"]))
query("update_columns", "id ts close:2 flag#", "SELECT id, ts, CASE WHEN rn % 10 = 0 THEN close + 1 ELSE close END AS close, CASE WHEN rn % 10 = 0 THEN 1 END AS flag FROM bars", NB)(
    lambda s, p: J.update_columns(_nb(s, p), _nb(s, p).withColumn("rn", Frame().rn()).filter("rn % 10 = 0").select("id", "ts", (F.col("close") + 1).alias("close"), F.lit(1).alias("flag")), ["id", "ts"], ["close", "flag"]))
query("first_fresh_price", "id as_of! tier price:2",
      """SELECT id, DATE '2001-08-05' AS as_of, CASE WHEN d1 <= 4 THEN 'v1' WHEN d5 <= 4 THEN 'v5' WHEN d3 <= 4 THEN 'v3' WHEN d2 <= 4 THEN 'v2' WHEN d4 <= 4 THEN 'v4' END AS tier, CASE WHEN d1 <= 4 THEN p1 WHEN d5 <= 4 THEN p5 WHEN d3 <= 4 THEN p3 WHEN d2 <= 4 THEN p2 WHEN d4 <= 4 THEN p4 END AS price FROM (SELECT id, """
      + ", ".join(f"date_diff('day', max(ts) FILTER (venue_id = {v}), TIMESTAMP '2001-08-05') AS d{v}, arg_max(close, ts) FILTER (venue_id = {v}) AS p{v}" for v in (1, 5, 3, 2, 4)) + " FROM vbars GROUP BY id)", VB)(
    lambda s, p: J.first_fresh_price(_nb(s, p).select("id").distinct().withColumn("as_of", F.lit("2001-08-05").cast("date")),
                                     [(f"v{v}", _venue_ticks(s, p, v)) for v in (1, 5, 3, 2, 4)], ["id"], "as_of", 4))


def _rates(s, p):
    """Funding-like rates: event values per user (symbol) and type (venue)."""
    return M.event_ticks(s, p).select(F.col("kind").alias("venue"), F.pmod("id", F.lit(20)).alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), (F.col("price") / 1e4).alias("rate")).groupBy("venue", "symbol", "ts").agg(F.avg("rate").alias("rate"))


def _every_venue(rates):
    """Each (symbol, minute) asked for at every venue; the venues are the few kinds of event."""
    return rates.select("symbol", "ts").distinct().join(F.broadcast(rates.select("venue").distinct()), F.lit(True))


RATES = "rates AS (SELECT event_type AS venue, user_id % 20 AS symbol, date_trunc('minute', ts)::TIMESTAMP AS ts, avg(value / 1e4) AS rate FROM events GROUP BY ALL)"
query("funding_with_fallback", "venue symbol# ts rate:7 source",
      """SELECT w.venue, w.symbol, w.ts, coalesce(x.rate, m.r) AS rate, CASE WHEN x.rate IS NOT NULL THEN 'exact' WHEN m.r IS NOT NULL THEN 'cross_venue' END AS source FROM (SELECT venue, symbol, ts FROM (SELECT DISTINCT symbol, ts FROM rates), (SELECT DISTINCT venue FROM rates)) w LEFT JOIN rates x USING (venue, symbol, ts)
       LEFT JOIN (SELECT w.symbol, w.ts, avg(r.rate) AS r FROM (SELECT DISTINCT symbol, ts FROM rates) w JOIN rates r ON r.symbol = w.symbol AND r.ts BETWEEN w.ts - INTERVAL 30 MINUTE AND w.ts + INTERVAL 30 MINUTE GROUP BY ALL) m ON m.symbol = w.symbol AND m.ts = w.ts""", RATES)(
    lambda s, p: J.funding_with_fallback(_every_venue(_rates(s, p)), _rates(s, p)))
query("funding_payments", "id venue_id# ts payment:4",
      "SELECT l.id, l.venue_id, l.ts, -l.price * coalesce(r.rate, 0) * CASE WHEN l.id % 2 = 1 THEN -1 ELSE 1 END AS payment FROM l ASOF LEFT JOIN (SELECT id, venue_id, ts, ref / 1e9 AS rate FROM r) r ON l.id = r.id AND l.venue_id = r.venue_id AND l.ts >= r.ts", _V1)(
    lambda s, p: J.funding_payments(_venue_ticks(s, p), _venue_ticks(s, p).withColumns({"venue_id": F.col("venue_id") % 5 + 1, "rate": F.col("price") / 1e9}), ["id", "venue_id"], "price", F.col("id") % 2 == 1))
query("funding_daily_rollup", "venue symbol# day! rate_sum:6 n#", "SELECT venue, symbol, CAST(ts AS DATE) AS day, sum(rate) AS rate_sum, count(*) AS n FROM rates GROUP BY ALL", RATES)(
    lambda s, p: _rates(s, p).groupBy("venue", "symbol", F.col("ts").cast("date").alias("day")).agg(F.sum("rate").alias("rate_sum"), F.count("*").alias("n")))
query("funding_cross_venue_daily", "symbol# date! avg_rate:7 n_venues# venues z_30:4",
      f"""SELECT *, (avg_rate - {ro('avg', 'avg_rate', 30, 24, 'symbol', 'date')}) / nullif({ro('stddev_samp', 'avg_rate', 30, 24, 'symbol', 'date')}, 0) AS z_30 FROM (SELECT symbol, CAST(ts AS DATE) AS date, avg(rate) AS avg_rate, count(DISTINCT venue) AS n_venues, string_agg(DISTINCT venue, ',' ORDER BY venue) AS venues FROM rates GROUP BY ALL)""", RATES)(
    lambda s, p: S.funding_daily(_rates(s, p).withColumn("date", F.col("ts").cast("date")), (30,)))
query("full_outer_change_tracker", "id n_now# n_then# change",
      "SELECT coalesce(a.id, b.id) AS id, a.n AS n_now, b.n AS n_then, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'gone' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change FROM (SELECT id, count(*) AS n FROM ticks WHERE venue_id <> 3 AND ts >= TIMESTAMP '1995-01-20' GROUP BY id) a FULL JOIN (SELECT id, count(*) AS n FROM ticks WHERE ts < TIMESTAMP '1998-01-01' AND id > 3 GROUP BY id) b ON a.id = b.id", TICKS)(
    lambda s, p: (lambda t: t.filter("venue_id <> 3 AND ts >= timestamp_ntz'1995-01-20'").groupBy("id").agg(F.count("*").alias("n_now")).join(
        t.filter("ts < timestamp_ntz'1998-01-01' AND id > 3").groupBy("id").agg(F.count("*").alias("n_then")), "id", "full").withColumn(
        "change", F.when(F.col("n_then").isNull(), "new").when(F.col("n_now").isNull(), "gone").when(F.col("n_now") != F.col("n_then"), "changed").otherwise("same")))(M.order_ticks(s, p)))

# --- statistics ------------------------------------------------------------------------------------
_RA = f"ra AS (SELECT id, ts, close / {lag('close')} - 1 AS r FROM bars)"
_ret = lambda s, p: _nb(s, p).withColumn("ret_arith", Frame().pct("close"))
_small = f"rs AS (SELECT id, ts, (close / {lag('close')} - 1) / 50 AS r FROM bars)"
_rets = lambda s, p: _nb(s, p).withColumn("ret_arith", Frame().pct("close") / 50)
query("asset_stats", "id ts mean_ret_30:6 std_ret_30:6 sharpe_raw_30:5 sharpe_ann_30:4 skew_30:5 kurt_fisher_30:5 kurt_pearson_30:5 max_dd_window_30:6 max_dd_from_ath:6",
      f"""SELECT id, ts, {ro('avg', 'r', 30)} AS mean_ret_30, {ro('stddev_samp', 'r', 30)} AS std_ret_30, {ro('avg', 'r', 30)} / nullif({ro('stddev_samp', 'r', 30)}, 0) AS sharpe_raw_30, {ro('avg', 'r', 30)} / nullif({ro('stddev_samp', 'r', 30)}, 0) * sqrt(365) AS sharpe_ann_30,
       {ro('skewness', 'r', 30)} AS skew_30, {ro('kurtosis', 'r', 30)} AS kurt_fisher_30, {ro('kurtosis', 'r', 30)} + 3 AS kurt_pearson_30, dd AS max_dd_window_30, eq / max(eq) OVER {W} - 1 AS max_dd_from_ath FROM (
        SELECT *, exp(sum(ln(1 + coalesce(r, 0))) OVER {W}) AS eq FROM rs) LEFT JOIN mdd USING (id, ts)""",
      NB + ", " + _small + """, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS k FROM rs),
       pp AS (SELECT t.id, t.ts, s.k, exp(sum(ln(1 + s.r)) OVER (PARTITION BY t.id, t.ts ORDER BY s.k)) AS e FROM rk t JOIN rk s ON s.id = t.id AND s.k BETWEEN t.k - 29 AND t.k WHERE t.k > 30),
       mdd AS (SELECT id, ts, min(e / m - 1) AS dd FROM (SELECT *, greatest(max(e) OVER (PARTITION BY id, ts ORDER BY k)) AS m FROM pp) GROUP BY id, ts)""")(
    lambda s, p: S.asset_stats(_rets(s, p), Frame(), (30,)))
_PR = _RA + ", pr AS (SELECT a.ts, a.id AS id_a, b.id AS id_b, a.r AS a, b.r AS b FROM ra a JOIN ra b ON a.ts = b.ts AND a.id < b.id WHERE a.r IS NOT NULL AND b.r IS NOT NULL)"
_pw = "(PARTITION BY id_a, id_b ORDER BY ts ROWS 59 PRECEDING)"
_PC = f"CASE WHEN count(*) OVER {_pw} = 60 THEN covar_samp(a, b) OVER {_pw} / nullif(stddev_samp(a) OVER {_pw} * stddev_samp(b) OVER {_pw}, 0) END"
query("pairwise_rolling_corr", "id_a id_b ts pearson:5 n_obs#", f"SELECT id_a, id_b, ts, {_PC} AS pearson, CASE WHEN count(*) OVER {_pw} = 60 THEN 60 END AS n_obs FROM pr", NB + ", " + _PR)(
    lambda s, p: S.rolling_pair_corr(S.paired(_ret(s, p), "ret_arith"), 60, spearman=False))
_PSP = """pn AS (SELECT *, row_number() OVER (PARTITION BY id_a, id_b ORDER BY ts) AS n FROM pr), pw AS (SELECT t.id_a, t.id_b, t.ts, s.a, s.b FROM pn t JOIN pn s ON s.id_a = t.id_a AND s.id_b = t.id_b AND s.n BETWEEN t.n - 59 AND t.n WHERE t.n >= 60),
 ps AS (SELECT id_a, id_b, ts, corr(ra, rb) AS c FROM (SELECT id_a, id_b, ts, rank() OVER (PARTITION BY id_a, id_b, ts ORDER BY a) AS ra, rank() OVER (PARTITION BY id_a, id_b, ts ORDER BY b) AS rb FROM pw) GROUP BY ALL)"""
query("pairwise_rolling_spearman", "id_a id_b ts spearman:5", "SELECT pr.id_a, pr.id_b, pr.ts, c AS spearman FROM pr LEFT JOIN ps USING (id_a, id_b, ts)", NB + ", " + _PR + ", " + _PSP)(
    lambda s, p: S.rolling_pair_corr(S.paired(_ret(s, p), "ret_arith"), 60))
query("market_correlation", "ts avg_corr:5 n_pairs# is_high_corr", f"SELECT ts, avg(c) AS avg_corr, count(c) AS n_pairs, coalesce(avg(c) > 0.05, false) AS is_high_corr FROM (SELECT ts, {_PC} AS c FROM pr) GROUP BY ts", NB + ", " + _PR)(
    lambda s, p: S.market_corr(_ret(s, p), "ret_arith", 60, 0.05))
_MONTHS = f"""months AS (SELECT id, date_trunc('month', ts)::TIMESTAMP AS ts, avg(close) AS x FROM bars GROUP BY ALL),
 mr AS (SELECT id, ts, x / {lag('x')} - 1 AS r FROM months), mg AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS k FROM mr WHERE r IS NOT NULL),
 mw AS (SELECT *, count(*) OVER w = 12 AND k - min(k) OVER w = 11 AND coalesce(stddev_samp(r) OVER w, 0) > 0 AS f FROM mg WINDOW w AS (PARTITION BY id ORDER BY k ROWS 11 PRECEDING)),
 mp AS (SELECT a.ts, a.f AND b.f AS f, covar_samp(a.r, b.r) OVER v / nullif(stddev_samp(a.r) OVER v * stddev_samp(b.r) OVER v, 0) AS c FROM mw a JOIN mw b ON a.k = b.k AND a.id < b.id WINDOW v AS (PARTITION BY a.id, b.id ORDER BY a.k ROWS 11 PRECEDING))"""


def _monthly(s, p):
    m = M.supplier_bars(s, p).groupBy("id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("close").alias("x"))
    return m.withColumn("r", Frame().pct("x"))


query("market_correlation_by_month", "ts avg_corr:6 n_assets# is_high_corr",
      "SELECT ts, c AS avg_corr, n AS n_assets, coalesce(c > 0.01, false) AS is_high_corr FROM (SELECT ts, count_if(f) AS n FROM mw GROUP BY ts) LEFT JOIN (SELECT ts, avg(c) AS c FROM mp WHERE f GROUP BY ts) USING (ts)", SB + ", " + _MONTHS)(
    lambda s, p: GM.market_corr_by_date(_monthly(s, p), "r", 12, 0.01))
query("pair_covariance_suppliers", "id_a id_b n_obs# cov:5 corr:5",
      "SELECT a.id AS id_a, b.id AS id_b, count(*) AS n_obs, CASE WHEN count(*) > 1 THEN covar_samp(a.r, b.r) END AS cov, CASE WHEN count(*) > 1 THEN corr(a.r, b.r) END AS corr FROM mr a JOIN mr b ON a.ts = b.ts AND a.id < b.id WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL", SB + ", " + _MONTHS)(
    lambda s, p: GM.pair_covariance(_monthly(s, p), "r"))
query("unordered_pairs", "id_a id_b", "SELECT a.id AS id_a, b.id AS id_b FROM (SELECT DISTINCT id FROM ticks) a JOIN (SELECT DISTINCT id FROM ticks) b ON a.id < b.id", TICKS)(lambda s, p: S.unordered_pairs(M.order_ticks(s, p)))
_RC = f"CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER q >= 48 THEN covar_samp(r, m) OVER q / nullif(stddev_samp(CASE WHEN m IS NOT NULL THEN r END) OVER q * stddev_samp(CASE WHEN r IS NOT NULL THEN m END) OVER q, 0) END"
query("asset_macro_corr", "id ts corr:5 sign_flip corr_regime",
      f"""SELECT id, ts, c AS corr, coalesce(sign(c) <> sign({lag('c')}), false) AS sign_flip, CASE WHEN abs(c) >= 0.5 THEN 'strong' WHEN abs(c) >= 0.2 THEN 'moderate' WHEN c IS NOT NULL THEN 'weak' END AS corr_regime FROM (SELECT id, ts, {_RC} AS c FROM (SELECT id, ts, r, s1 AS m FROM ra JOIN mac USING (ts)) WINDOW q AS (PARTITION BY id ORDER BY ts ROWS 59 PRECEDING))""",
      NB + ", " + _RA + ", " + MACRO[len(TICKS) + 2:])(
    lambda s, p: S.asset_macro_corr(_ret(s, p), "ret_arith", _macro(s, p), "s1", 60, 48))
query("two_series_corr_windows", "id ts corr_30:5 corr_90:5 vol_regime divergence",
      f"""SELECT id, ts, corr_30, corr_90, CASE WHEN v > 1.5 THEN 'a_volatile' WHEN v < 1 / 1.5 THEN 'b_volatile' WHEN v IS NOT NULL THEN 'balanced' END AS vol_regime, coalesce(abs(corr_30 - corr_90) > 0.3, false) AS divergence FROM (SELECT id, ts, {ro('stddev_samp', 'a', 30)} / nullif({ro('stddev_samp', 'b', 30)}, 0) AS v,
       {', '.join(f"CASE WHEN count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER q{n} = {n} THEN covar_samp(a, b) OVER q{n} / nullif(stddev_samp(a) OVER q{n} * stddev_samp(b) OVER q{n}, 0) END AS corr_{n}" for n in (30, 90))} FROM ab WINDOW q30 AS (PARTITION BY id ORDER BY ts ROWS 29 PRECEDING), q90 AS (PARTITION BY id ORDER BY ts ROWS 89 PRECEDING))""",
      NB + ", " + _AB)(lambda s, p: S.two_series_corr(_ab(s, p), "a", "b", Frame(), (30, 90)))
_PNL = f"pnl AS (SELECT id, ts, r / 100 AS p, CASE WHEN k % 9 = 0 THEN r / 90 ELSE r / 100 END AS q FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS k FROM ra WHERE r IS NOT NULL))"
_paper = lambda s, p: _ret(s, p).filter("ret_arith IS NOT NULL").withColumn("k", Frame().rn()).withColumns({"pnl": F.col("ret_arith") / 100})
_replay = lambda s, p: _paper(s, p).withColumn("pnl", F.when(F.col("k") % 9 == 0, F.col("ret_arith") / 90).otherwise(F.col("ret_arith") / 100))
query("drift_metrics", "id paper_pnl:6 replay_pnl:6 abs_pnl_diff:6 te_5d:7 te_30d:7 sharpe_gap:5 n_days# status",
      f"""SELECT *, abs(paper_pnl - replay_pnl) AS abs_pnl_diff, CASE WHEN te_5d >= 0.0004 THEN 'breach' WHEN te_5d >= 0.0003 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT id, sum(p) AS paper_pnl, sum(q) AS replay_pnl, arg_max(t5, ts) AS te_5d, arg_max(t30, ts) AS te_30d, (avg(p) / stddev_samp(p) - avg(q) / stddev_samp(q)) * sqrt(365) AS sharpe_gap, count(*) AS n_days FROM (SELECT *, {ro('stddev_samp', 'd', 5)} AS t5, {ro('stddev_samp', 'd', 30)} AS t30 FROM (SELECT *, p - q AS d FROM pnl)) GROUP BY id)""",
      NB + ", " + _RA + ", " + _PNL)(lambda s, p: S.drift_metrics(_paper(s, p), _replay(s, p), ["id"], 0.0004))
query("drift_summary_table", "status n# worst_te:7",
      f"""SELECT status, count(*) AS n, max(te) AS worst_te FROM (SELECT id, te, CASE WHEN te >= 0.0004 THEN 'breach' WHEN te >= 0.0003 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT id, arg_max(t5, ts) AS te FROM (SELECT *, {ro('stddev_samp', 'd', 5)} AS t5 FROM (SELECT *, p - q AS d FROM pnl)) GROUP BY id)) GROUP BY status""",
      NB + ", " + _RA + ", " + _PNL)(lambda s, p: S.drift_metrics(_paper(s, p), _replay(s, p), ["id"], 0.0004).groupBy("status").agg(F.count("*").alias("n"), F.max("te_5d").alias("worst_te")))
query("data_snapshot", "id table_name max_ts n_rows#", "SELECT id, 'bars' AS table_name, max(ts) AS max_ts, count(*) AS n_rows FROM bars GROUP BY id UNION ALL SELECT id, 'ticks', max(ts), count(*) FROM ticks GROUP BY id", NB)(
    lambda s, p: S.data_snapshot({"bars": _nb(s, p), "ticks": M.order_ticks(s, p)}))
_CLS = _RA + ", cl AS (SELECT ra.*, n_regionkey AS cls FROM ra JOIN nation ON n_nationkey = id), bm AS (SELECT ts, avg(r) AS m FROM ra WHERE r IS NOT NULL GROUP BY ts)"
_cls = lambda s, p: _ret(s, p).join(F.broadcast(M.table(s, p, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("cls"))), "id")
query("pnl_class_attribution", "cls# beta:6 total:4 beta_pnl:4 alpha_pnl:4 n_days#",
      "SELECT cls, regr_slope(r, m) AS beta, sum(r) AS total, regr_slope(r, m) * sum(m) AS beta_pnl, sum(r) - regr_slope(r, m) * sum(m) AS alpha_pnl, count(*) AS n_days FROM (SELECT cls, ts, avg(r) AS r FROM cl WHERE r IS NOT NULL GROUP BY cls, ts) JOIN bm USING (ts) GROUP BY cls", NB + ", " + _CLS)(
    lambda s, p: S.class_attribution(_cls(s, p).filter("ret_arith IS NOT NULL"), S.equal_weight_returns(_ret(s, p), "ret_arith").withColumnRenamed("ret", "ret_arith"), "cls", "ret_arith"))
query("equal_weight_returns", "ts ret:6 n_assets#", "SELECT ts, avg(r) AS ret, count(*) AS n_assets FROM ra WHERE r IS NOT NULL GROUP BY ts", NB + ", " + _RA)(lambda s, p: S.equal_weight_returns(_ret(s, p), "ret_arith"))


def _fills(s, p):
    """Fills: bar k of a nation trades (k mod 5) - 2 units at the close."""
    return _nb(s, p).withColumn("k", Frame().rn()).select("id", "ts", "k", (F.col("k") % 5 - 2).cast("double").alias("qty"), F.col("close").alias("price"))


query("mark_to_market", "id ts pos:1 pnl:2",
      f"SELECT id, ts, pos, coalesce((pos - dq) * (close - {lag('close')}), 0) + CASE WHEN rn = 1 THEN 0 ELSE 0 END AS pnl FROM (SELECT *, sum(dq) OVER {W} AS pos FROM (SELECT *, rn % 5 - 2 AS dq FROM bars))", NB)(
    lambda s, p: S.mark_to_market(_fills(s, p), _nb(s, p)))
def _trips_sql(src: str, key: str, order: str) -> str:
    """Brute force: all overlaps of buy and sell intervals of running quantities."""
    run = f"SELECT *, row_number() OVER w AS n, sum(greatest(qty, 0)) OVER w AS b, sum(greatest(-qty, 0)) OVER w AS s FROM {src} WHERE qty <> 0 WINDOW w AS (PARTITION BY {key} ORDER BY {order})"
    return f"""ru AS MATERIALIZED ({run}), tr AS (SELECT x.{key}, least(x.n, y.n) AS entry_n, greatest(x.n, y.n) AS exit_n, least(x.b, y.s) - greatest(x.b - x.qty, y.s + y.qty) AS qty,
      CASE WHEN x.n < y.n THEN x.price ELSE y.price END AS entry_price, CASE WHEN x.n < y.n THEN y.price ELSE x.price END AS exit_price, CASE WHEN x.n < y.n THEN 1 ELSE -1 END AS side
      FROM ru x JOIN ru y ON x.{key} = y.{key} AND x.qty > 0 AND y.qty < 0 AND least(x.b, y.s) - greatest(x.b - x.qty, y.s + y.qty) > 1e-12)"""


def _event_fills(s, p):
    """Clicks and views buy one to three units, all other events sell two."""
    e = M.table(s, p, "events")
    return e.select(F.col("user_id").alias("id"), "ts", "event_id", F.when(F.col("event_type").isin("click", "view"), 1 + F.col("event_id") % 3).otherwise(-2).cast("double").alias("qty"), (1 + F.round("value", 2)).alias("price"))


_EFILL = "ef AS (SELECT user_id AS id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 1.0 + event_id % 3 ELSE -2.0 END AS qty, 1 + round(value, 2) AS price FROM events)"
query("fill_round_trips", "id n# mean_ret:6 qty:1", "SELECT id, count(*) AS n, avg(side * (exit_price / entry_price - 1)) AS mean_ret, sum(qty) AS qty FROM tr GROUP BY id",
      NB + ", fl AS (SELECT id, ts, CAST(rn % 5 - 2 AS DOUBLE) AS qty, close AS price FROM bars), " + _trips_sql("fl", "id", "ts"))(
    lambda s, p: S.round_trips(_fills(s, p), ["id"], ["ts"]).groupBy("id").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.sum("qty").alias("qty")))
query("fill_round_trips_events", "id entry_n# exit_n# qty:4 entry_price:4 exit_price:4 side# ret:6", "SELECT *, side * (exit_price / entry_price - 1) AS ret FROM tr", _EFILL + ", " + _trips_sql("ef", "id", "ts, event_id"))(
    lambda s, p: S.round_trips(_event_fills(s, p), ["id"], ["ts", "event_id"], F.date_trunc("day", "ts"), 4096))
query("fill_to_fill_sharpe", "grp# n_fills# n_pairs# mean_ret:6 mean_days:6 sharpe:6",
      """SELECT grp, n_fills, coalesce(n_pairs, 0) AS n_pairs, mean_ret, mean_days, CASE WHEN n_pairs >= 2 AND sd > 1e-12 THEN mean_ret / sd * sqrt(252.0 / mean_days) END AS sharpe FROM (SELECT id % 7 AS grp, count(*) AS n_fills FROM ef GROUP BY 1)
       LEFT JOIN (SELECT grp, count(*) AS n_pairs, avg(r) AS mean_ret, stddev_samp(r) AS sd, avg(d) AS mean_days FROM (SELECT b.id % 7 AS grp, (s.price - b.price) / b.price AS r, greatest(trunc(epoch(s.ts - b.ts)) / 86400.0, 1.0 / 24) AS d
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS k FROM ef WHERE qty > 0) b JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS k FROM ef WHERE qty < 0) s USING (id, k) WHERE b.price > 0) GROUP BY 1) USING (grp)""", _EFILL)(
    lambda s, p: S.fill_to_fill_sharpe(_event_fills(s, p).withColumn("grp", F.col("id") % 7), ["grp"], "id", ["ts", "event_id"], F.date_trunc("day", "ts")))
query("column_profile", "column_name n_rows# n_null# n_distinct# min_value max_value",
      " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM events" for c in ("event_id", "user_id", "event_type", "value", "props")))(
    lambda s, p: S.column_profile(M.table(s, p, "events"), ["event_id", "user_id", "event_type", "value", "props"]))
query("time_profile", "bucket n# is_missing",
      "SELECT CAST(g AS TIMESTAMP) AS bucket, coalesce(n, 0) AS n, n IS NULL AS is_missing FROM (SELECT unnest(generate_series((SELECT min(date_trunc('hour', ts)) FROM e), (SELECT max(date_trunc('hour', ts)) FROM e), INTERVAL 1 HOUR)) AS g) LEFT JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM e GROUP BY 1) ON h = g",
      "e AS (SELECT * FROM events)")(
    lambda s, p: S.time_profile(M.table(s, p, "events"), "ts", "hour").withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))
query("duplicate_keys", "l_orderkey l_linenumber n#", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda s, p: S.duplicate_keys(M.table(s, p, "lineitem"), ["l_orderkey", "l_linenumber"]))
query("free_aggregate", "l_returnflag n# rev:2", "SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS rev FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag HAVING count(*) > 10")(
    lambda s, p: S.free_aggregate(M.table(s, p, "lineitem"), "l_returnflag, count(*) AS n, sum(l_extendedprice) AS rev", "l_returnflag", "l_quantity > 10", "count(*) > 10", "l_returnflag"))
query("percentile_recent", "kind value:4 n#", "SELECT event_type AS kind, quantile_cont(value, 0.95) AS value, count(*) AS n FROM events WHERE ts >= (SELECT TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR) GROUP BY 1")(
    lambda s, p: S.percentile_recent(M.event_ticks(s, p), ["kind"], "price", 0.95, "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 240))
query("performance_degradation", "kind baseline:4 current:4 degraded", "SELECT event_type AS kind, median(value) FILTER (ts < TIMESTAMP '2024-01-20') AS baseline, avg(value) FILTER (ts >= TIMESTAMP '2024-01-20') AS current, avg(value) FILTER (ts >= TIMESTAMP '2024-01-20') > 1.4 * median(value) FILTER (ts < TIMESTAMP '2024-01-20') AS degraded FROM events GROUP BY 1")(
    lambda s, p: S.degraded(M.event_ticks(s, p), ["kind"], "price", "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 1.4))
query("shrunk_covariance", "id_a id_b cov:5 corr:6 cov_used:5", "SELECT *, CASE WHEN avg(corr) OVER () > -1 THEN cov / 2 ELSE cov END AS cov_used FROM (SELECT id_a, id_b, covar_samp(a, b) AS cov, corr(a, b) AS corr FROM pr GROUP BY ALL)", NB + ", " + _PR)(
    lambda s, p: S.shrunk_covariance(_ret(s, p), "ret_arith", -1.0, 0.5))


def _weights(s, p, shift):
    return _nb(s, p).withColumn("rn", Frame().rn()).filter(F.col("rn") % 4 != shift).select("ts", "id", (F.col("rn") % 5 / 10.0).alias("weight"))


query("turnover_cost", "ts turnover:4 buys:4 sells:4 n_trades# cost:6",
      "SELECT ts, sum(abs(d)) AS turnover, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells, count(*) FILTER (d <> 0) AS n_trades, sum(abs(d)) * 10 / 1e4 AS cost FROM (SELECT ts, id, CASE WHEN rn % 4 <> 1 THEN rn % 5 / 10.0 ELSE 0 END - CASE WHEN rn % 4 <> 0 THEN rn % 5 / 10.0 ELSE 0 END AS d FROM bars) GROUP BY ts", NB)(
    lambda s, p: S.turnover_cost(_weights(s, p, 0), _weights(s, p, 1), ["ts"]))
query("top_k_per_date", "ts id close rank#", "SELECT ts, id, close, rank FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY close DESC, id) AS rank FROM bars) WHERE rank <= 3", NB)(lambda s, p: S.top_k(_nb(s, p), ["ts"], "close", 3))
_TOPK = """sc AS (SELECT unnest([1, 2, 3]) AS portfolio, ts, id, unnest([close, -close, volume]) AS score FROM bars),
dn AS MATERIALIZED (SELECT portfolio, ts, row_number() OVER (PARTITION BY portfolio ORDER BY ts) AS d, list(id ORDER BY score DESC, id) AS ranked FROM sc GROUP BY portfolio, ts),
wk AS (SELECT portfolio, ts, d, ranked[1:5] AS held, CAST([] AS BIGINT[]) AS sells, ranked[1:5] AS buys FROM dn WHERE d = 1
  UNION ALL SELECT portfolio, ts, d, list_concat(list_filter(held, lambda h: NOT list_contains(sells, h)), buys), sells, buys FROM (
    SELECT *, CASE WHEN len(held) = 0 THEN ranked[1:5] ELSE list_filter(ranked[1:5], lambda t: NOT list_contains(held, t))[1:len(sells)] END AS buys FROM (
      SELECT dn.portfolio, dn.ts, dn.d, ranked, held, list_concat(list_reverse(list_filter(ranked[6:], lambda r: list_contains(held, r))), list_sort(list_filter(held, lambda h: NOT list_contains(ranked, h))))[1:2] AS sells
      FROM wk JOIN dn ON dn.portfolio = wk.portfolio AND dn.d = wk.d + 1)))"""


def _portfolios(s, p):
    """The same bars scored three ways: one portfolio each."""
    ways = F.array(*[F.struct(F.lit(i).cast("bigint").alias("portfolio"), x.alias("score")) for i, x in ((1, F.col("close")), (2, -F.col("close")), (3, F.col("volume")))])
    return _nb(s, p).select("ts", "id", F.explode(ways).alias("_i")).select("ts", "id", "_i.*")


def _dropout(s, p):
    scores = _portfolios(s, p)
    return S.topk_dropout(scores, ["portfolio"], "ts", 5, 2, slice_edges(scores, "ts", 800), f"{checkpoint_dir(s).rstrip('/')}/tideline-tables-{uuid.uuid4().hex}")


query("topk_dropout_holdings", "portfolio# ts id action",
      "WITH RECURSIVE " + NB + ", " + _TOPK + " SELECT portfolio, ts, id, action FROM (SELECT portfolio, ts, unnest(sells) AS id, 'sell' AS action FROM wk UNION ALL SELECT portfolio, ts, unnest(buys), 'buy' FROM wk UNION ALL SELECT portfolio, ts, unnest(list_filter(held, lambda h: NOT list_contains(buys, h))), 'hold' FROM wk)")(_dropout)
_BS = f"""bs AS (SELECT ts, id, rn % 5 / 10.0 AS w, ({phi('z')}) AS ph, sd FROM (SELECT *, ((rn * 37 + id) % 97 / 97.0 - 0.5) * 2 AS z, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS sd FROM bars)),
 bz AS (SELECT *, CASE WHEN abs(sd * (2 * ph - 1)) >= 0.2 THEN w * sd * (2 * ph - 1) ELSE 0 END AS scaled FROM bs)"""
query("bet_sizing_weights", "ts id scaled:6 final_weight:6",
      "SELECT ts, id, scaled, coalesce(scaled * sum(abs(w)) OVER (PARTITION BY ts) / nullif(sum(abs(scaled)) OVER (PARTITION BY ts), 0), 0) AS final_weight FROM bz", NB + ", " + _BS)(
    lambda s, p: S.scale_weights(_nb(s, p).withColumn("rn", Frame().rn()).select("ts", "id", (F.col("rn") % 5 / 10.0).alias("weight"), ((F.col("rn") * 37 + F.col("id")) % 97 / 97.0).alias("prob"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("side")), ["ts"], 2.0, 0.2))
_SG = f"sg AS (SELECT id, ts, 'mom' AS signal, close / {lag('close', 5)} - 1 AS score, 0.6 AS w FROM bars UNION ALL SELECT id, ts, 'vol', volume / 10, -0.4 FROM bars)"


def _scores(s, p):
    d = _nb(s, p).withColumn("mom", Frame().pct("close", 5))
    return d.select("id", "ts", F.explode(F.array(F.struct(F.lit("mom").alias("signal"), F.col("mom").alias("score")), F.struct(F.lit("vol").alias("signal"), (F.col("volume") / 10).alias("score")))).alias("_i")).select("id", "ts", "_i.*")


query("composite_to_expected_return", "id ts composite:6 mu:6",
      "SELECT id, ts, composite, (composite - avg(composite) OVER t) / nullif(stddev_samp(composite) OVER t, 0) * 0.5 * 0.2 AS mu FROM (SELECT id, ts, sum(score * w) / sum(abs(w)) AS composite FROM sg GROUP BY id, ts) WINDOW t AS (PARTITION BY ts)", NB + ", " + _SG)(
    lambda s, p: S.scores_to_mu(S.weighted_composite(_scores(s, p), s.createDataFrame([("mom", 0.6), ("vol", -0.4)], "signal string, weight double"), ["id", "ts"]).withColumn("vol", F.lit(0.5)), ["ts"], 0.2))
query("weight_overrides", "signal id weight:6",
      "SELECT 'mom' AS signal, id, CASE WHEN id % 3 = 0 THEN 0.5 * 0.8 ELSE 1.0 END AS weight FROM (SELECT DISTINCT id FROM ticks)", TICKS)(
    lambda s, p: (lambda ids: S.weight_overrides(ids.select(F.lit("mom").alias("signal"), "id", F.lit(1.0).alias("weight")),
        ids.filter("id % 3 = 0").withColumn("signal", F.lit("mom")).withColumn("_i", F.explode(F.array(F.struct(F.lit(0.5).alias("factor"), F.lit(True).alias("active")), F.struct(F.lit(0.8).alias("factor"), F.lit(True).alias("active")), F.struct(F.lit(0.1).alias("factor"), F.lit(False).alias("active"))))).select("signal", "id", "_i.*")))(M.order_ticks(s, p).select("id").distinct()))
query("held_portfolio_returns", "portfolio# ts portfolio_ret:6 n_held#",
      f"SELECT 1 AS portfolio, ts, avg(fr) AS portfolio_ret, count(*) AS n_held FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY close DESC, id) AS k FROM (SELECT *, lead(close) OVER {W} / close - 1 AS fr FROM bars)) WHERE k <= 5 GROUP BY ts", NB)(
    lambda s, p: S.held_returns(S.top_k(_nb(s, p), ["ts"], "close", 5).select(F.lit(1).alias("portfolio"), "ts", "id"), _nb(s, p).select("id", "ts", Frame().forward_return("close").alias("fwd_ret")), ["portfolio"]))
query("status_counts", "status n#",
      "SELECT status, count(*) AS n FROM (SELECT CASE WHEN close < 1000 THEN 'FAIL' WHEN close < 20000 THEN 'WARN' ELSE 'PASS' END AS status FROM bars WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01') GROUP BY status", NB)(
    lambda s, p: S.status_counts([_nb(s, p).withColumn("status", F.when(F.col("close") < 1000, "FAIL").when(F.col("close") < 20000, "WARN").otherwise("PASS"))], "ts", F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")))
