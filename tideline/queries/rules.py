"""Regimes, macro, signals and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.functions.smoothing import ewm_span
from tideline.operators import averages as A
from tideline.operators import indicators as I
from tideline.operators import labels as L
from tideline.operators import macro as G
from tideline.operators import regimes as Z
from tideline.operators import signals as X
from tideline.operators import volatility as V
from tideline.queries.base import NB, TICKS, W, ema_cte, lag, query, ro, span
from tideline.queries.features import _ER, _EWS, _LR, _TR, _nb
from tideline.sources import market as M

FR = Frame()

# --- regimes ---------------------------------------------------------------------------------------
_E3 = ema_cte("e", "bars", "close", {"f": span(5), "m": span(20), "s": span(50)})
_emas = lambda s, p: ewm_span(_nb(s, p), FR, "close", {"f": 5, "m": 20, "s": 50})
_UPDN = "ud AS (SELECT bars.*, f, m, s, CAST(close > s AND f > m AS INTEGER) AS u, CAST(close < s AND f < m AS INTEGER) AS d FROM bars JOIN e USING (id, ts))"
query("regime_trend", "id ts trend",
      f"SELECT id, ts, CASE WHEN coalesce({ro('min', 'u', 2)} = 1, false) THEN 'Up' WHEN coalesce({ro('min', 'd', 2)} = 1, false) THEN 'Down' ELSE 'Sideways' END AS trend FROM ud", NB + ", " + _E3 + ", " + _UPDN,
      )(lambda s, p: Z.with_trend(_emas(s, p), FR, price="close", fast="f", mid="m", slow="s", confirm=2))
_VB = f"""va AS (SELECT *, {ro('avg', 'mv', 14)} AS a FROM (SELECT *, abs(close / {lag('close')} - 1) AS mv FROM bars)),
 vr AS (SELECT t.id, t.ts, t.rn, t.a, count(CASE WHEN s.a < t.a THEN 1 END) + (count(CASE WHEN s.a = t.a THEN 1 END) + 1) / 2.0 AS r, count(s.a) AS c FROM va t JOIN va s ON s.id = t.id AND s.rn BETWEEN t.rn - 99 AND t.rn GROUP BY ALL)"""
query("regime_vol_bucket", "id ts vol vol_lite",
      """SELECT id, ts, CASE WHEN a IS NULL THEN NULL WHEN max(rn) OVER (PARTITION BY id) < 100 THEN CASE WHEN a < 0.015 THEN 'Low' WHEN a > 0.04 THEN 'High' ELSE 'Normal' END WHEN c < 33 THEN NULL WHEN 100 * r / least(rn, 100) < 33 THEN 'Low' WHEN 100 * r / least(rn, 100) < 67 THEN 'Normal' ELSE 'High' END AS vol,
       CASE WHEN a < 1.0 THEN 'Low' WHEN a > 2.0 THEN 'High' WHEN a IS NOT NULL THEN 'Normal' END AS vol_lite FROM vr""", NB + ", " + _VB,
      )(lambda s, p: Z.with_vol_bucket(Z.with_vol_bucket(_nb(s, p), FR), FR, mode="lite", low=1.0, high=2.0, out="vol_lite"))
query("regime_liquidity_bucket", "id ts liq",
      f"""SELECT id, ts, CASE WHEN coalesce(sp < 0.8 * ms AND volume < 0.8 * mv, false) THEN 'Easy' WHEN coalesce(sp > 2 * ms, false) OR coalesce(volume > 2 * mv, false) THEN 'Stressed' ELSE 'Normal' END AS liq FROM (
       SELECT *, {ro('median', 'sp', 60, 20)} AS ms, {ro('median', 'volume', 60, 20)} AS mv FROM (SELECT *, high - low AS sp FROM bars))""", NB,
      )(lambda s, p: Z.with_liquidity_bucket(_nb(s, p).withColumn("sp", F.col("high") - F.col("low")), FR, "sp", "volume"))
def _layer_sql(name, src, spans, n):
    """CTEs of one percentile layer over a bar table: trend held two rows, volatility rank in n rows; ``name`` has id, ts, rn, k."""
    return (
        ema_cte(f"{name}_e", src, "close", dict(zip("fms", map(span, spans))))
        + f""", {name}_va AS (SELECT *, {ro('avg', 'mv', 14)} AS a FROM (SELECT *, abs(close / {lag('close')} - 1) AS mv FROM {src})),
      {name}_t AS (SELECT id, ts, rn, CASE WHEN coalesce({ro('min', 'u', 2)} = 1, false) THEN 'Up' WHEN coalesce({ro('min', 'd', 2)} = 1, false) THEN 'Down' ELSE 'Sideways' END AS trend FROM (
       SELECT {src}.*, CAST(close > s AND f > m AS INTEGER) AS u, CAST(close < s AND f < m AS INTEGER) AS d FROM {src} JOIN {name}_e USING (id, ts))),
      {name}_v AS (SELECT t.id, t.ts, t.rn, t.a, count(CASE WHEN s.a < t.a THEN 1 END) + (count(CASE WHEN s.a = t.a THEN 1 END) + 1) / 2.0 AS r, count(s.a) AS c FROM {name}_va t JOIN {name}_va s ON s.id = t.id AND s.rn BETWEEN t.rn - {n - 1} AND t.rn GROUP BY ALL),
      {name} AS (SELECT id, ts, rn, trend || '-' || coalesce(CASE WHEN a IS NULL THEN NULL WHEN max(rn) OVER (PARTITION BY id) < {n} THEN CASE WHEN a < 0.015 THEN 'Low' WHEN a > 0.04 THEN 'High' ELSE 'Normal' END
        WHEN c < {max(20, n // 3)} THEN NULL WHEN 100 * r / least(rn, {n}) < 33 THEN 'Low' WHEN 100 * r / least(rn, {n}) < 67 THEN 'Normal' ELSE 'High' END, '') || '-Normal' AS k FROM {name}_t JOIN {name}_v USING (id, ts, rn))"""
    )


query("regime_layer_daily", "id ts L2", "SELECT id, ts, k AS L2 FROM l2", NB + ", " + _layer_sql("l2", "bars", (20, 50, 100), 250))(lambda s, p: Z.layer_labels(_nb(s, p), FR, "L2"))
query("regime_layer_intraday", "id ts L3",
      f"""SELECT id, ts, concat_ws('-', CASE WHEN close > s AND f > m THEN 'Up' WHEN close < s AND f < m THEN 'Down' ELSE 'Sideways' END, coalesce(CASE WHEN a < 0.015 THEN 'Low' WHEN a > 0.04 THEN 'High' WHEN a IS NOT NULL THEN 'Normal' END, ''), 'Normal') AS L3 FROM va JOIN e USING (id, ts)""",
      NB + ", " + _VB.split(",\n vr AS")[0] + ", " + ema_cte("e", "bars", "close", {"f": span(34), "m": span(55), "s": span(89)}))(lambda s, p: Z.layer_labels(_nb(s, p), FR, "L3"))


def _counts(s, p):
    d = _nb(s, p)
    return d.groupBy("id").agg(F.count_distinct(F.trunc("ts", "month")).alias("monthly"), F.count_distinct(F.trunc("ts", "week")).alias("weekly"), F.count("*").alias("daily"), F.sum("volume").cast("bigint").alias("intraday"))


query("regime_data_budget", "id L0_on L1_on L2_on L3_on tier",
      "SELECT id, mo >= 60 AS L0_on, wk >= 52 AS L1_on, d >= 120 AS L2_on, i >= 300 AS L3_on, CASE WHEN wk >= 100 AND d >= 250 THEN 'full' ELSE 'lite' END AS tier FROM (SELECT id, count(DISTINCT date_trunc('month', ts)) AS mo, count(DISTINCT date_trunc('week', ts)) AS wk, count(*) AS d, sum(volume) AS i FROM bars GROUP BY id)", NB)(
    lambda s, p: Z.data_budget(_counts(s, p)))
query("regime_proxy_caps", "id ts gross_cap_proxy:2 size_mult_proxy:2",
      "SELECT x.id, x.ts, CASE WHEN x.id % 2 = 0 AND NOT m.up THEN 0.6 ELSE 1.0 END AS gross_cap_proxy, CASE WHEN x.id % 3 = 0 AND NOT m.up THEN 0.75 ELSE 1.0 END AS size_mult_proxy FROM bars x JOIN (SELECT ts, avg(close) > 190000 AS up FROM bars GROUP BY ts) m USING (ts)", NB)(
    lambda s, p: Z.proxy_caps(_nb(s, p).withColumns({"L0_on": F.col("id") % 2 != 0, "L1_on": F.col("id") % 3 != 0}), _nb(s, p).groupBy("ts").agg(F.when(F.avg("close") > 190000, "Up-Low-").otherwise("Down-Low-").alias("L2"))))
_KEYS = "kk AS (SELECT *, CASE WHEN close > open * 1.2 THEN 'Up' WHEN close < open * 0.8 THEN 'Down' ELSE 'Sideways' END || '-' || CASE WHEN volume >= 3 THEN 'High' ELSE 'Low' END || '-Normal' AS k FROM bars)"
_keyed = lambda s, p: _nb(s, p).withColumn("k", F.concat_ws("-", F.when(F.col("close") > F.col("open") * 1.2, "Up").when(F.col("close") < F.col("open") * 0.8, "Down").otherwise("Sideways"), F.when(F.col("volume") >= 3, "High").otherwise("Low"), F.lit("Normal")))
# One layer of the policy table in SQL: the first entry whose tokens the key holds, else the fallback.
_POL = lambda c, v: "CASE " + " ".join(f"WHEN {' AND '.join(f'contains({c}, $${t}$$)' for t in ts)} THEN {x}" for ts, x in zip((("Up", "Normal"), ("Up", "Low"), ("Up", "High"), ("Sideways", "Low"), ("Sideways", "High"), ("Down",), ("Stressed",)), v)) + f" ELSE {v[7]} END"
_SZ, _ST = ("1.0", "1.1", "0.75", "0.7", "0.4", "0.6", "0.6", "0.8"), ("1.5", "1.25", "1.75", "1.25", "2.0", "1.6", "1.25", "1.5")
_OR = ("'mixed'", "'mixed'", "'conservative'", "'passive'", "'passive'", "'mixed'", "'passive'", "'mixed'")
_SU = ("['breakout', 'pullback']", "['breakout', 'pullback']", "['pullback']", "['mean_revert']", "['stand_down', 'mean_revert']", "['short_rallies', 'hedge']", "[]", "['pullback']")
_size = lambda c: f"least(1.0, coalesce({_POL(c, _SZ)}, 1.0))"
_stop = lambda c: f"greatest(1.5, {_POL(c, _ST)})"
query("regime_policy_resolve", "id ts size_mult:3 stop_mult:3 gross_cap:3 orders setups pyramids tight",
      f"""SELECT id, ts, CASE WHEN pk IS NULL THEN {_size('k')} ELSE least({_size('k')}, {_size('pk')}) END AS size_mult,
       CASE WHEN pk IS NULL THEN {_stop('k')} ELSE greatest({_stop('k')}, {_stop('pk')}) END AS stop_mult, 1.0 AS gross_cap,
       CASE WHEN contains(coalesce(pk, ''), 'Stressed') OR contains(k, 'Stressed') OR {_POL('k', _OR)} = 'passive' THEN 'passive' WHEN pk IS NULL THEN {_POL('k', _OR)} ELSE {_POL('pk', _OR)} END AS orders,
       array_to_string(list_sort(list_distinct(list_concat({_POL('k', _SU)}, CASE WHEN pk IS NULL THEN [] ELSE {_POL('pk', _SU)} END))), ',') AS setups, true AS pyramids,
       CASE WHEN pk IS NULL THEN true WHEN pk = k THEN false ELSE {_size('k')} < {_size('pk')} OR {_stop('k')} > {_stop('pk')} END AS tight FROM (SELECT *, {lag('k')} AS pk FROM kk)""",
      NB + ", " + _KEYS)(lambda s, p: Z.resolve_policy(_keyed(s, p).withColumn("pk", FR.lag("k")), ("k", "pk")).withColumn("tight", Z.is_tightening("pk", "k")).withColumn("setups", F.array_join("setups", ",")))
_MACRO = "mk AS (SELECT *, CASE id % 3 WHEN 0 THEN 'Hiking' WHEN 1 THEN 'Holding' ELSE 'Unknown' END || '-' || CASE WHEN volume >= 3 THEN 'Strongly_Contracting' WHEN volume >= 2 THEN 'Contracting' ELSE 'Expanding' END || '-' || CASE WHEN close > open THEN 'RiskOff' ELSE 'RiskOn' END || '-' || CASE WHEN close > 200000 THEN 'Unwind' ELSE 'Stable' END AS m FROM bars)"
_macro = lambda s, p: _nb(s, p).withColumn("m", F.concat_ws("-", F.when(F.col("id") % 3 == 0, "Hiking").when(F.col("id") % 3 == 1, "Holding").otherwise("Unknown"), F.when(F.col("volume") >= 3, "Strongly_Contracting").when(F.col("volume") >= 2, "Contracting").otherwise("Expanding"), F.when(F.col("close") > F.col("open"), "RiskOff").otherwise("RiskOn"), F.when(F.col("close") > 200000, "Unwind").otherwise("Stable")))
query("regime_macro_policy", "id ts m size_mult:3 stop_mult:3 gross_cap:3 orders setups pyramids",
      """SELECT id, ts, m, least(1.0, sz) AS size_mult, greatest(1.5, st) AS stop_mult, coalesce(cap, 1.0) AS gross_cap, coalesce(od, 'mixed') AS orders, array_to_string(list_sort(su), ',') AS setups, coalesce(py, true) AS pyramids FROM (
       SELECT mk.*, unnest(CASE WHEN m GLOB '*-Strongly_Contracting-RiskOff-*' THEN {'sz': 0.30, 'st': 2.0, 'cap': 0.40, 'od': 'passive', 'su': ['stand_down', 'hedge'], 'py': false}
        WHEN m GLOB '*-Contracting-RiskOff-*' THEN {'sz': 0.5, 'st': 1.8, 'cap': 0.5, 'od': 'conservative', 'su': ['hedge'], 'py': false}
        WHEN m GLOB 'Hiking-*-RiskOff-*' THEN {'sz': 0.55, 'st': 1.75, 'cap': 0.55, 'od': 'conservative', 'su': ['hedge'], 'py': false}
        WHEN m GLOB '*-RiskOff-*' THEN {'sz': 0.6, 'st': 1.7, 'cap': 0.6, 'od': 'conservative', 'su': ['pullback', 'hedge'], 'py': NULL}
        WHEN m GLOB '*-Unwind' THEN {'sz': 0.65, 'st': 1.65, 'cap': 0.65, 'od': 'conservative', 'su': [], 'py': NULL}
        WHEN m GLOB '*-Strongly_Contracting-*' THEN {'sz': 0.65, 'st': 1.6, 'cap': 0.65, 'od': NULL, 'su': [], 'py': NULL}
        WHEN m GLOB '*-Contracting-*' THEN {'sz': 0.8, 'st': 1.5, 'cap': 0.8, 'od': NULL, 'su': [], 'py': NULL}
        WHEN m GLOB 'Unknown*' THEN {'sz': 1.0, 'st': 1.5, 'cap': 1.0, 'od': NULL, 'su': [], 'py': NULL}
        ELSE {'sz': 0.8, 'st': 1.5, 'cap': NULL, 'od': 'mixed', 'su': ['pullback'], 'py': NULL} END) FROM mk)""", NB + ", " + _MACRO)(
    lambda s, p: Z.resolve_policy(_macro(s, p), ("m",)).withColumn("setups", F.array_join("setups", ",")))
query("regime_hysteresis", "id ts k accepted",
      """SELECT kk.id, kk.ts, kk.k, r.cur AS accepted FROM kk JOIN r USING (id, rn)""",
      NB + ", " + _KEYS + f""", ks AS (SELECT *, {_size('k')} AS sz, {_stop('k')} AS st FROM kk),
      r AS (WITH RECURSIVE w AS (SELECT id, rn, k AS cur, sz AS csz, st AS cst, CAST(NULL AS VARCHAR) AS pend, 0 AS seen FROM ks WHERE rn = 1 UNION ALL
       SELECT id, rn, CASE WHEN acc THEN k ELSE cur END, CASE WHEN acc THEN sz ELSE csz END, CASE WHEN acc THEN st ELSE cst END, CASE WHEN acc OR same THEN NULL ELSE k END, CASE WHEN acc OR same THEN 0 ELSE s2 END FROM (
        SELECT *, NOT same AND (tight OR s2 >= 3) AS acc FROM (SELECT ks.id, ks.rn, ks.k, ks.sz, ks.st, w.cur, w.csz, w.cst, ks.k = w.cur AS same, ks.sz < w.csz OR ks.st > w.cst AS tight, CASE WHEN w.pend = ks.k THEN w.seen + 1 ELSE 1 END AS s2
         FROM w JOIN ks ON ks.id = w.id AND ks.rn = w.rn + 1))) SELECT * FROM w)""")(lambda s, p: Z.hysteresis(_keyed(s, p), FR, "k"))


def _weekly_monthly(s, p):
    d = _nb(s, p)
    roll = lambda unit: d.groupBy("id", F.trunc("ts", unit).cast("timestamp_ntz").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    return d, roll("week"), roll("month")


_period = lambda name, unit: f"{name} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS rn FROM (SELECT id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts, arg_max(close, b.ts) AS close FROM bars b GROUP BY id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP)))"
query("regimes_for_assets", "id ts L2 L1 L0 L2_held size_mult:3 stop_mult:3 gross_cap:3",
      f"""SELECT d.id, d.ts, d.k AS L2, w.k AS L1, m.k AS L0, h.cur AS L2_held, least({_size('h.cur')}, CASE WHEN w.k IS NULL THEN 1.0 ELSE {_size('w.k')} END, CASE WHEN m.k IS NULL THEN 1.0 ELSE {_size('m.k')} END) AS size_mult,
       greatest({_stop('h.cur')}, CASE WHEN w.k IS NULL THEN 1.5 ELSE {_stop('w.k')} END, CASE WHEN m.k IS NULL THEN 1.5 ELSE {_stop('m.k')} END) AS stop_mult, 1.0 AS gross_cap
       FROM l2 d JOIN hd h ON h.id = d.id AND h.rn = d.rn ASOF LEFT JOIN l1 w ON w.id = d.id AND d.ts >= w.ts ASOF LEFT JOIN l0 m ON m.id = d.id AND d.ts >= m.ts""",
      NB + ", " + _period("wb", "week") + ", " + _period("mb", "month") + ", " + _layer_sql("l2", "bars", (20, 50, 100), 250) + ", " + _layer_sql("l1", "wb", (20, 50, 200), 100) + ", " + _layer_sql("l0", "mb", (12, 24, 48), 60)
      + f""", ks AS MATERIALIZED (SELECT *, {_size('k')} AS sz, {_stop('k')} AS st FROM l2),
      hd AS (WITH RECURSIVE w AS (SELECT id, rn, k AS cur, sz AS csz, st AS cst, CAST(NULL AS VARCHAR) AS pend, 0 AS seen FROM ks WHERE rn = 1 UNION ALL
       SELECT id, rn, CASE WHEN acc THEN k ELSE cur END, CASE WHEN acc THEN sz ELSE csz END, CASE WHEN acc THEN st ELSE cst END, CASE WHEN acc OR same THEN NULL ELSE k END, CASE WHEN acc OR same THEN 0 ELSE s2 END FROM (
        SELECT *, NOT same AND (tight OR s2 >= 3) AS acc FROM (SELECT ks.id, ks.rn, ks.k, ks.sz, ks.st, w.cur, w.csz, w.cst, ks.k = w.cur AS same, ks.sz < w.csz OR ks.st > w.cst AS tight, CASE WHEN w.pend = ks.k THEN w.seen + 1 ELSE 1 END AS s2
         FROM w JOIN ks ON ks.id = w.id AND ks.rn = w.rn + 1))) SELECT * FROM w)""")(lambda s, p: Z.regimes_for_assets(*_weekly_monthly(s, p)))
query("regime_sign_flips", "id ts idx# from_sign:0 to_sign:0 direction",
      f"SELECT id, ts, rn AS idx, ps AS from_sign, sg AS to_sign, CASE WHEN sg > ps THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, {lag('sg')} AS ps FROM (SELECT *, sign(close - open) AS sg FROM bars)) WHERE sg <> ps", NB)(
    lambda s, p: Z.sign_flips(_nb(s, p).withColumn("sg", F.signum(F.col("close") - F.col("open"))), FR, "sg"))
query("regime_sign_flips_separated", "id ts idx# direction",
      f"""WITH RECURSIVE fl AS MATERIALIZED (SELECT id, ts, rn, CASE WHEN sg > ps THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, {lag('sg')} AS ps FROM (SELECT *, sign(close - open) AS sg FROM bars)) WHERE sg <> ps),
       nx AS MATERIALIZED (SELECT a.id, a.rn, min(b.rn) AS nrn FROM fl a JOIN fl b ON b.id = a.id AND b.rn >= a.rn + 5 GROUP BY a.id, a.rn),
       w AS (SELECT id, min(rn) AS rn FROM fl GROUP BY id UNION ALL SELECT nx.id, nx.nrn FROM w JOIN nx ON nx.id = w.id AND nx.rn = w.rn)
       SELECT fl.id, fl.ts, fl.rn AS idx, direction FROM fl JOIN w USING (id, rn)""", NB)(lambda s, p: Z.sign_flips(_nb(s, p).withColumn("sg", F.signum(F.col("close") - F.col("open"))), FR, "sg", 5))
query("regime_summary", "id regime_id# n_bars# start end avg_return:5 cum_return:2 duration_days#",
      f"""SELECT id, rg AS regime_id, count(r) AS n_bars, min(ts) AS start, max(ts) AS "end", avg(r) AS avg_return, CASE WHEN count(r) > 0 THEN product(1 + r) - 1 END AS cum_return, date_diff('day', min(ts), max(ts)) + 1 AS duration_days FROM (
       SELECT *, sum(CASE WHEN abs(r) > 8 THEN 1 ELSE 0 END) OVER {W} AS rg FROM (SELECT *, close / {lag('close')} - 1 AS r FROM bars)) GROUP BY id, rg""", NB)(
    lambda s, p: Z.regime_summary(Z.regime_ids(_nb(s, p).withColumn("r", FR.pct("close")), FR, F.abs("r") > 8), ["id"], "regime_id", "r"))
query("regime_layer_flips", "id layer ts new_regime old_regime old_duration_bars#",
      """WITH t AS (SELECT id, ts, 'A' AS layer, CASE WHEN close > 200000 THEN 'hi' WHEN close > 50000 THEN 'lo' END AS g FROM bars UNION ALL SELECT id, ts, 'B', CASE WHEN volume > 1 THEN 'busy' ELSE 'calm' END FROM bars), q AS (SELECT * FROM t WHERE g IS NOT NULL),
       z AS (SELECT *, sum(CASE WHEN g IS DISTINCT FROM pg THEN 1 ELSE 0 END) OVER (PARTITION BY id, layer ORDER BY ts) AS run FROM (SELECT *, lag(g) OVER (PARTITION BY id, layer ORDER BY ts) AS pg FROM q)),
       y AS (SELECT id, layer, run, g, min(ts) AS ts, count(*) AS n FROM z GROUP BY ALL) SELECT id, layer, ts, g AS new_regime, lag(g) OVER o AS old_regime, lag(n) OVER o AS old_duration_bars FROM y WINDOW o AS (PARTITION BY id, layer ORDER BY run)""", NB)(
    lambda s, p: Z.layer_flips(_nb(s, p).withColumns({"A": F.when(F.col("close") > 200000, "hi").when(F.col("close") > 50000, "lo"), "B": F.when(F.col("volume") > 1, "busy").otherwise("calm")}), ["id"], ["A", "B"]))
query("regime_return_stats", "id k n_bars# mean_fwd:5 std_fwd:5 pct_of_time:4",
      f"SELECT id, k, n AS n_bars, mf AS mean_fwd, sf AS std_fwd, 100.0 * n / sum(n) OVER (PARTITION BY id) AS pct_of_time FROM (SELECT id, k, count(*) AS n, avg(fr) AS mf, stddev_samp(fr) AS sf FROM (SELECT *, lead(close) OVER {W} / close - 1 AS fr FROM kk) GROUP BY id, k)", NB + ", " + _KEYS)(
    lambda s, p: Z.regime_return_stats(_keyed(s, p).withColumn("fr", FR.forward_return("close")), ["id"], "k", "fr"))
query("regime_transition_pnl", "id from_regime to_regime n# mean_ret:5 total_ret:4",
      f"SELECT id, pk AS from_regime, k AS to_regime, count(*) AS n, avg(r) AS mean_ret, sum(r) AS total_ret FROM (SELECT *, {lag('k')} AS pk, close / {lag('close')} - 1 AS r FROM kk) WHERE pk <> k GROUP BY ALL", NB + ", " + _KEYS)(
    lambda s, p: Z.transition_pnl(_keyed(s, p).withColumn("r", FR.pct("close")), FR, "k", "r"))
query("transition_matrix", "from_state to_state n# prob:6",
      f"SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS prob FROM (SELECT k AS from_state, nk AS to_state, count(*) AS n FROM (SELECT k, lead(k) OVER {W} AS nk FROM kk) WHERE nk IS NOT NULL GROUP BY ALL)", NB + ", " + _KEYS)(
    lambda s, p: Z.transition_matrix(_keyed(s, p), FR, "k"))
_RT = f"""rt AS (SELECT *, n / sum(n) OVER (PARTITION BY id, window_end, from_state) AS prob FROM (SELECT p.id, we AS window_end, k AS from_state, nk AS to_state, count(*) AS n FROM (SELECT id, CAST(ts AS DATE) AS d, k, lead(k) OVER {W} AS nk FROM kk) p
  JOIN (SELECT id, CAST(unnest(generate_series(date_trunc('month', min(ts)), max(ts), INTERVAL 1 MONTH)) AS DATE) AS we FROM bars GROUP BY id) w ON w.id = p.id AND we > d AND we - d <= 120 WHERE nk IS NOT NULL GROUP BY ALL))"""
query("transition_rolling", "id window_end! from_state to_state n# prob:6", "SELECT * FROM rt", NB + ", " + _KEYS + ", " + _RT)(lambda s, p: Z.rolling_transitions(_keyed(s, p), FR, "k", 120))
query("transition_lookup", "id prob:6 window_end!", "SELECT id, arg_max(prob, window_end) AS prob, max(window_end) AS window_end FROM rt WHERE from_state = 'Sideways-Low-Normal' AND to_state = 'Up-Low-Normal' GROUP BY id", NB + ", " + _KEYS + ", " + _RT)(
    lambda s, p: Z.transition_lookup(Z.rolling_transitions(_keyed(s, p), FR, "k", 120), "Sideways-Low-Normal", "Up-Low-Normal", ["id"]))
query("regime_label_crosstab", "a b n# share_of_a:6 share_of_all:6",
      "SELECT a, b, n, n / sum(n) OVER (PARTITION BY a) AS share_of_a, n / sum(n) OVER () AS share_of_all FROM (SELECT close > open AS a, volume > 1 AS b, count(*) AS n FROM bars GROUP BY ALL)", NB)(
    lambda s, p: Z.label_crosstab(_nb(s, p).select((F.col("close") > F.col("open")).alias("a"), (F.col("volume") > 1).alias("b")), "a", "b"))
query("regime_history_latest", "id ts k", "SELECT id, ts, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS z FROM kk) WHERE z <= 10", NB + ", " + _KEYS)(
    lambda s, p: (lambda d: d.withColumn("z", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("id").orderBy(F.desc("ts")))).filter("z <= 10"))(_keyed(s, p)))

# --- macro -----------------------------------------------------------------------------------------
_V = lambda i: f"sum(CASE WHEN venue_id = {i} THEN price ELSE 0 END)"
MACRO_COLS = {
    "fed_assets": f"{_V(1)} / 100000", "treasury_account": f"{_V(2)} / 200000", "reverse_repo": f"{_V(3)} / 300000",
    "us_rate": "count(*) / 4.0e0", "jp_rate": "max(venue_id) / 2.0e0", "ecb_rate": "min(venue_id) / 2.0e0", "us_10y": "avg(venue_id)", "jp_10y": "avg(id) / 10.0e0",
    "yc_slope": "avg(price) / 1e5 - 2", "vix": "avg(price) / 1e4", "dollar": "max(price) / 4000", "hy_oas": "min(price) / 1e4", "nfci": "avg(id) / 8 - 1.5",
    "m2": "sum(price) / 1e6 + 10", "yen": "avg(price) / 1e5 + 110", "cpi": "avg(id) + 100", "target_upper": "ceil(count(*) / 4.0e0)", "target_lower": "floor(count(*) / 4.0e0)",
}
_MW = TICKS + ", mw AS (SELECT 0 AS g, ts, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in MACRO_COLS.items()) + " FROM ticks GROUP BY ts)"


def _mw(s, p):
    return M.order_ticks(s, p).groupBy("ts").agg(*[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in MACRO_COLS.items()]).withColumn("g", F.lit(0))


FG = Frame(("g",))


def mo(agg, x, n, need=None):
    return ro(agg, x, n, need, part="g")


def ml(x, k=1):
    return lag(x, k, part="g")


_D1 = f"""d1 AS (SELECT *, fed_assets - treasury_account - reverse_repo AS net_liquidity, us_rate - jp_rate AS us_jp_rate_spread, us_rate - ecb_rate AS us_ecb_rate_spread, us_10y - jp_10y AS us_jp_10y_spread, yc_slope - {ml('yc_slope', 5)} AS yc_slope_change_5d,
  CASE WHEN vix > 0 AND vix <= 15 THEN 'calm' WHEN vix <= 25 THEN 'elevated' ELSE 'crisis' END AS vix_regime, dollar - {ml('dollar', 5)} AS dollar_5d_change, dollar - {ml('dollar', 20)} AS dollar_20d_change FROM mw)"""
query("macro_derived", "ts net_liquidity:4 us_jp_rate_spread:4 us_ecb_rate_spread:4 us_jp_10y_spread:5 yc_slope_change_5d:5 vix_regime dollar_5d_change:4 dollar_20d_change:4", "SELECT * FROM d1", _MW + ", " + _D1)(lambda s, p: G.derived(_mw(s, p), FG))
_D2 = f"""d2 AS (SELECT *, us_rate - {ml('us_rate', 90)} AS rate_90d_change, (target_upper + target_lower) / 2 AS target_mid, target_upper - target_lower AS target_spread FROM d1),
 d3 AS (SELECT *, CASE WHEN target_mid <= 0.25 THEN 'zero-bound' WHEN target_spread = 0 THEN 'single-target' ELSE 'target-range' END AS fed_structure, CASE WHEN rate_90d_change > 0.25 THEN 'hiking' WHEN rate_90d_change < -0.25 THEN 'cutting' WHEN rate_90d_change IS NOT NULL THEN 'holding' END AS fed_trajectory FROM d2)"""
query("macro_fed_regime", "ts target_mid:3 target_spread:3 rate_90d_change:3 fed_structure fed_trajectory", "SELECT * FROM d3", _MW + ", " + _D1 + ", " + _D2)(lambda s, p: G.fed_regime(G.derived(_mw(s, p), FG), FG))
_z = lambda x, n, k: f"(({x}) - {mo('avg', x, n, k)}) / nullif({mo('stddev_samp', x, n, k)}, 0)"
_D4 = f"""d4 AS (SELECT *, (yen / {ml('yen')} - 1) * 100 AS r, (cpi / {ml('cpi', 30)} - 1) * 100 AS mom, nfci - {ml('nfci', 28)} AS nf FROM d3),
 d5 AS (SELECT *, hy_oas - {ml('hy_oas', 5)} AS hy_oas_5d_change, {_z('hy_oas', 30, 24)} AS hy_oas_30d_zscore, CASE WHEN nf > 0 THEN 'rising' WHEN nf < 0 THEN 'falling' END AS nfci_direction, (m2 / {ml('m2', 365)} - 1) * 100 AS m2_yoy_pct,
  {mo('stddev_samp', 'r', 20, 16)} AS yen_20d_vol, {_z('r', 20, 16)} AS yen_daily_zscore, {_z('net_liquidity', 365, 292)} AS net_liquidity_365d_zscore, {mo('avg', 'net_liquidity', 30, 24)} - {mo('avg', 'net_liquidity', 150, 120)} AS tr, mom - {mo('avg', 'mom', 90, 72)} AS cpi_surprise,
  us_jp_rate_spread - {ml('us_jp_rate_spread', 5)} AS spread_5d_change FROM d4),
 d6 AS (SELECT *, CASE WHEN tr > 0 THEN 'expanding' WHEN tr < 0 THEN 'contracting' END AS net_liquidity_trend, CAST(abs(yen_daily_zscore) > CASE WHEN us_jp_rate_spread > 0 THEN 2.0 ELSE 1.5 END AS DOUBLE) AS carry_momentum FROM d5)"""
_stress = lambda s, p: G.stress_features(G.fed_regime(G.derived(_mw(s, p), FG), FG), FG)
query("macro_stress_features", "ts hy_oas_30d_zscore:5 nfci_direction m2_yoy_pct:4 yen_20d_vol:5 yen_daily_zscore:5 net_liquidity_365d_zscore:5 net_liquidity_trend cpi_surprise:4 carry_momentum:1", "SELECT * FROM d6", _MW + ", " + _D1 + ", " + _D2 + ", " + _D4)(_stress)
_D7 = """d7 AS (SELECT *, concat_ws('-', coalesce(monetary, 'Unknown'), coalesce(liquidity, 'Unknown'), coalesce(risk, 'Unknown'), coalesce(carry, 'Unknown')) AS regime_key FROM (SELECT *,
  CASE fed_trajectory WHEN 'hiking' THEN 'Hiking' WHEN 'cutting' THEN 'Cutting' WHEN 'holding' THEN 'Holding' END AS monetary,
  CASE WHEN net_liquidity_365d_zscore IS NULL AND net_liquidity_trend IS NULL THEN NULL WHEN net_liquidity_365d_zscore > 1 THEN 'Strongly_Expanding' WHEN net_liquidity_365d_zscore < -1 THEN 'Strongly_Contracting' WHEN net_liquidity_trend = 'expanding' THEN 'Expanding' WHEN net_liquidity_trend = 'contracting' THEN 'Contracting' ELSE 'Neutral' END AS liquidity,
  CASE WHEN vix > 25 OR coalesce(hy_oas_30d_zscore > 1.5, false) OR nfci > 0.5 THEN 'RiskOff' WHEN vix < 15 AND coalesce(hy_oas_30d_zscore < -0.5, true) AND nfci < -0.5 THEN 'RiskOn' ELSE 'Neutral' END AS risk,
  CASE WHEN yen_daily_zscore IS NULL THEN NULL WHEN yen_daily_zscore > 2 AND coalesce(spread_5d_change < 0, false) THEN 'Unwind' WHEN coalesce(yen_20d_vol > 1.5, false) THEN 'Stress' ELSE 'Stable' END AS carry FROM d6))"""
_ALLM = _MW + ", " + _D1 + ", " + _D2 + ", " + _D4 + ", " + _D7
query("macro_labels_state", "ts monetary liquidity risk carry regime_key macro_state",
      """SELECT *, CASE WHEN regime_key LIKE 'Hiking-Strongly\\_Contracting%' ESCAPE '\\' OR regime_key LIKE 'Hiking-Contracting-RiskOff%' OR regime_key LIKE 'Cutting-Strongly\\_Contracting-RiskOff%' ESCAPE '\\' THEN 'adverse' WHEN regime_key LIKE 'Hiking-Contracting%' OR regime_key LIKE 'Hiking-Neutral-RiskOff%' OR regime_key LIKE 'Holding-Contracting-RiskOff%' THEN 'cautious'
       WHEN regime_key LIKE 'Cutting-Expanding-RiskOn%' OR regime_key LIKE 'Cutting-Strongly\\_Expanding%' ESCAPE '\\' THEN 'favorable' WHEN regime_key LIKE 'Holding-Expanding%' OR regime_key LIKE 'Cutting-Expanding%' OR regime_key LIKE 'Cutting-Neutral%' THEN 'constructive' ELSE 'neutral' END AS macro_state FROM d7""", _ALLM)(
    lambda s, p: G.labels(_stress(s, p)).withColumn("macro_state", G.macro_state("regime_key")))
query("macro_classify_held", "ts held_key macro_state", None)(lambda s, p: G.classify(_stress(s, p), FG))
query("macro_gates", "ts vix_state vix_mult:2 carry_state carry_mult:2 credit_mult:2 score:4 tier",
      """SELECT *, CASE WHEN score < 25 THEN 'calm' WHEN score < 50 THEN 'watch' WHEN score < 75 THEN 'stress' ELSE 'crisis' END AS tier FROM (SELECT ts, CASE WHEN vix > 30 THEN 'reduce' ELSE 'normal' END AS vix_state, CASE WHEN vix > 30 THEN 0.5 ELSE 1.0 END AS vix_mult, CASE WHEN abs(z) > 3 THEN 'flatten' WHEN abs(z) > 2 THEN 'reduce' ELSE 'normal' END AS carry_state, CASE WHEN abs(z) > 3 THEN 0.0 WHEN abs(z) > 2 THEN 0.6 ELSE 1.0 END AS carry_mult,
       CASE WHEN h > 2.5 THEN 0.4 WHEN h > 1.5 THEN 0.7 ELSE 1.0 END AS credit_mult, 100 * (0.4 * least(greatest((vix - 12) / 33, 0), 1) + coalesce(0.25 * least(greatest((h + 1) / 4, 0), 1), 0) + coalesce(0.2 * least(greatest(abs(z) / 3, 0), 1), 0) + 0.15 * least(greatest((nfci + 0.5) / 1.5, 0), 1)) / (0.55 + CASE WHEN h IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN z IS NOT NULL THEN 0.2 ELSE 0 END) AS score
       FROM (SELECT *, yen_daily_zscore AS z, hy_oas_30d_zscore AS h FROM d6))""", _MW + ", " + _D1 + ", " + _D2 + ", " + _D4)(
    lambda s, p: (lambda d: d.select("ts", F.col("a.state").alias("vix_state"), F.col("a.mult").alias("vix_mult"), F.col("b.state").alias("carry_state"), F.col("b.mult").alias("carry_mult"), F.col("c.mult").alias("credit_mult"), "score", G.stress_tier("score").alias("tier")))(
        _stress(s, p).withColumns({"a": G.vix_gate("vix"), "b": G.carry_gate("yen_daily_zscore", 3.0), "c": G.credit_gate("hy_oas_30d_zscore"), "score": G.stress_score("vix", "hy_oas_30d_zscore", "yen_daily_zscore", "nfci")})))
query("macro_index_features", "id ts ret_1d:4 ret_21d:4 vol_21d:4 drawdown_pct:4 ma_ratio_50_200d:5 zscore_252d:5",
      f"""SELECT id, ts, r AS ret_1d, (close / {lag('close', 21)} - 1) * 100 AS ret_21d, {ro('stddev_samp', 'r', 21, 17)} AS vol_21d, (close / {ro('max', 'close', 252, 1)} - 1) * 100 AS drawdown_pct, {ro('avg', 'close', 50, 40)} / {ro('avg', 'close', 200, 160)} AS ma_ratio_50_200d,
       (close - {ro('avg', 'close', 252, 201)}) / nullif({ro('stddev_samp', 'close', 252, 201)}, 0) AS zscore_252d FROM (SELECT *, (close / {lag('close')} - 1) * 100 AS r FROM bars)""", NB)(lambda s, p: G.index_features(_nb(s, p), FR, "close"))
query("macro_freshness_gate", "worst_stale# n_stale# state mult:2",
      """SELECT max(b) AS worst_stale, count(*) FILTER (b > 3) AS n_stale, CASE WHEN max(b) > 3 THEN 'reduce' ELSE 'normal' END AS state, CASE WHEN max(b) > 6 THEN 0.5 WHEN max(b) > 3 THEN 0.8 ELSE 1.0 END AS mult FROM (
       SELECT id, (SELECT count(*) FROM generate_series(CAST(m AS DATE) + INTERVAL 1 DAY, TIMESTAMP '2001-08-12', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5) AS b FROM (SELECT id, max(ts) AS m FROM ticks GROUP BY id))""", TICKS)(
    lambda s, p: G.freshness_gate(M.order_ticks(s, p).withColumnRenamed("id", "series"), F.lit("2001-08-12").cast("date")))

# --- signals ---------------------------------------------------------------------------------------
_XE = ema_cte("e", "bars", "close", {"fa": span(9), "sl": span(21)})
_XS = f"""xs AS (SELECT *, coalesce(fa > sl AND {lag('fa')} <= {lag('sl')}, false) AS cu, coalesce(fa < sl AND {lag('fa')} >= {lag('sl')}, false) AS cd FROM bars JOIN e USING (id, ts))"""
_xema = lambda s, p: ewm_span(_nb(s, p), FR, "close", {"fa": 9, "sl": 21})
query("signal_ema_cross", "id ts entry_long exit_long signal# position#",
      f"""SELECT *, coalesce(CASE WHEN entry_long THEN 1 WHEN cd THEN 0 END, 0) AS signal, cd AS exit_long, coalesce(last_value(CASE WHEN entry_long THEN 1 WHEN cd THEN 0 END IGNORE NULLS) OVER {W}, 0) AS position FROM (
       SELECT *, cu AND max(CAST(cd AS INTEGER)) OVER (PARTITION BY id ORDER BY ts ROWS 3 PRECEDING) = 0 AS entry_long FROM xs)""", NB + ", " + _XE + ", " + _XS)(
    lambda s, p: X.crossover_signals(_xema(s, p), FR, "fa", "sl", cooldown=3))
query("signal_ema_cross_shorts", "id ts entry_long entry_short position#",
      f"SELECT id, ts, cu AS entry_long, cd AS entry_short, coalesce(last_value(CASE WHEN cu THEN 1 WHEN cd THEN -1 END IGNORE NULLS) OVER {W}, 0) AS position FROM xs", NB + ", " + _XE + ", " + _XS)(
    lambda s, p: X.crossover_signals(_xema(s, p), FR, "fa", "sl", shorts=True))
query("signal_ema_gated_size", "id ts entry_long size:6",
      f"SELECT id, ts, cu AND coalesce(a / close >= 0.5, false) AS entry_long, coalesce(least(r / quantile_cont(r, 0.95) OVER (PARTITION BY id), 1), 0) AS size FROM (SELECT *, 1 / greatest(a / close, 1e-12) AS r FROM xs JOIN (SELECT id, ts, {ro('avg', 'tr', 14)} AS a FROM tr) USING (id, ts))", NB + ", " + _TR + ", " + _XE + ", " + _XS)(
    lambda s, p: X.crossover_signals(I.atr(_xema(s, p), FR, 14), FR, "fa", "sl", atr="atr_14", min_atr_pct=0.5))
query("signal_macd", "id ts entry exit",
      f"SELECT id, ts, coalesce(m > sg AND {lag('m')} <= {lag('sg')}, false) AS entry, coalesce(m < sg AND {lag('m')} >= {lag('sg')}, false) AS exit FROM mm JOIN s USING (id, ts)",
      NB + ", " + ema_cte("e", "bars", "close", {"f": span(12), "s": span(26)}) + ", mm AS (SELECT id, ts, f - s AS m FROM e), " + ema_cte("s", "mm", "m", {"sg": span(9)}))(lambda s, p: X.macd_signals(_nb(s, p), FR))
_RS = f"rx AS (SELECT *, 100 * {ro('avg', 'CAST(close > open AS INTEGER)', 10)} AS x FROM bars)"
_osc = lambda s, p: _nb(s, p).withColumn("up", (F.col("close") > F.col("open")).cast("int")).withColumn("x", 100 * FR.mean("up", 10))
query("signal_rsi_reversion", "id ts entry exit",
      f"SELECT id, ts, NOT b AND coalesce({lag('b')}, false) AS entry, (a AND NOT coalesce({lag('a')}, false)) OR coalesce({lag('x')} > x, false) AS exit FROM (SELECT *, coalesce(x <= 20, false) AS b, coalesce(x >= 50, false) AS a FROM rx)", NB + ", " + _RS)(
    lambda s, p: X.rsi_reversion(_osc(s, p), FR, "x", 20, 50))
query("signal_rsi_adaptive_thresholds", "id ts x_lower:4 x_upper:4", f"SELECT id, ts, {ro('quantile_cont({x}, 0.2)', 'x', 100, 50)} AS x_lower, {ro('quantile_cont({x}, 0.8)', 'x', 100, 50)} AS x_upper FROM rx", NB + ", " + _RS)(lambda s, p: X.adaptive_thresholds(_osc(s, p), FR, "x"))
query("signal_breakout", "id ts channel_high:2 channel_low:2 entry exit",
      f"SELECT *, coalesce(close > channel_high, false) AS entry, coalesce(close < channel_low, false) AS exit FROM (SELECT *, {lag('hi')} AS channel_high, {lag('lo')} AS channel_low FROM (SELECT *, {ro('max', 'high', 10)} AS hi, {ro('min', 'low', 10)} AS lo FROM bars))", NB)(lambda s, p: X.breakout(_nb(s, p), FR, 10))
query("signal_breakout_trailing", "id ts entry exit",
      f"""SELECT id, ts, entry, t > 0 AND coalesce(close < max(close - 2 * a) OVER (PARTITION BY id, t ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS exit FROM (SELECT *, sum(CAST(entry AS INTEGER)) OVER {W} AS t FROM (
       SELECT *, coalesce(close > {lag('hi')}, false) AS entry FROM (SELECT *, {ro('max', 'high', 10)} AS hi, {ro('avg', 'tr', 14)} / 10 AS a FROM tr)))""", NB + ", " + _TR)(
    lambda s, p: X.breakout(I.atr(_nb(s, p), FR, 14).withColumn("a", F.col("atr_14") / 10), FR, 10, "a", exit_on="trail"))
query("signal_breakout_type", "id ts kind",
      f"SELECT id, ts, CASE WHEN b AND w THEN 'both' WHEN b THEN 'channel_break' WHEN w THEN 'atr_expansion' END AS kind FROM (SELECT id, ts, coalesce(close > {lag('hi')}, false) AS b, coalesce(a > 1.2 * {ro('avg', 'a', 20)}, false) AS w FROM (SELECT *, {ro('max', 'high', 10)} AS hi, {ro('avg', 'tr', 5)} AS a FROM tr))", NB + ", " + _TR)(
    lambda s, p: (lambda d: d.withColumns({"ma": FR.mean("atr_5", 20), "ch": FR.lag("hi")}).withColumn("kind", X.breakout_type("close", "ch", "atr_5", "ma", 1.2)))(I.atr(_nb(s, p), FR, 5).withColumn("hi", FR.max("high", 10))))
_BSE = f"SELECT *, rn - last_value(CASE WHEN entry THEN rn END IGNORE NULLS) OVER {W} AS bars_since_entry FROM ({{src}})"
query("signal_threshold_holding", "id ts entry exit bars_since_entry#",
      f"SELECT *, q OR coalesce(bars_since_entry >= 4, false) AS exit FROM ({_BSE.format(src=f'SELECT *, r > 1.0 AS entry, r < -0.7 AS q FROM (SELECT *, coalesce(close / ' + lag('close') + ' - 1, 0) AS r FROM bars)')})", NB)(
    lambda s, p: X.threshold_signals(_nb(s, p).withColumn("r", FR.pct("close")), FR, "r", 1.0, -0.7, holding=4))
_AZ = f"(x - {ro('avg', 'x', 20, 2)}) / nullif({ro('stddev_samp', 'x', 20, 2)}, 0)"
query("signal_ama_momentum", "id ts z:4 entry exit bars_since_entry#",
      f"SELECT *, q OR coalesce(bars_since_entry >= 7, false) AS exit FROM ({_BSE.format(src=f'SELECT *, coalesce(z > 0.5, false) AS entry, coalesce(z < -0.5, false) AS q FROM (SELECT *, {_AZ} AS z FROM (SELECT *, 0.75 * fa + 0.25 * sl AS x FROM xs))')})", NB + ", " + _XE + ", " + _XS)(
    lambda s, p: X.ama_momentum(_xema(s, p), FR, {"fa": 3.0, "sl": 1.0}, threshold=0.5))
query("signal_ama_reversion", "id ts z:4 entry exit",
      f"SELECT *, q OR coalesce(bars_since_entry >= 10, false) AS exit FROM ({_BSE.format(src=f'SELECT *, coalesce(z < -1.0, false) AS entry, coalesce(z > 0, false) AS q FROM (SELECT *, {_AZ} AS z FROM (SELECT *, close - sl AS x FROM xs))')})", NB + ", " + _XE + ", " + _XS)(
    lambda s, p: X.ama_reversion(_xema(s, p), FR, "sl", enter=-1.0))
query("signal_ama_regime", "id ts entry exit",
      f"SELECT *, q OR coalesce(bars_since_entry >= 7, false) AS exit FROM ({_BSE.format(src='SELECT *, coalesce(d > 0, false) AND coalesce(x > 40, false) AS entry, coalesce(d < 0, false) OR NOT coalesce(x > 40, false) AS q FROM (SELECT rx.*, sl - lag(sl) OVER (PARTITION BY id ORDER BY ts) AS d FROM rx JOIN e USING (id, ts))')})", NB + ", " + _XE + ", " + _RS)(
    lambda s, p: X.ama_regime(ewm_span(_osc(s, p), FR, "close", {"sl": 21}), FR, "sl", "x", 40.0))
query("signal_sizing", "id ts risk:6 inv:6 units:6",
      f"SELECT id, ts, coalesce(0.005 * close / nullif(1.5 * a, 0), 0) AS risk, least(greatest(coalesce(0.5 / (nullif(abs(a / close), 0) + 1e-12), 0), 0), 1) AS inv, least(0.01 / nullif(a / close, 0), 0.3) * 1e6 / close AS units FROM (SELECT *, {ro('avg', 'tr', 14)} AS a FROM tr)", NB + ", " + _TR)(
    lambda s, p: I.atr(_nb(s, p), FR, 14).withColumns({"risk": X.risk_size("close", "atr_14"), "inv": X.inverse_vol_size(F.col("atr_14") / F.col("close")), "units": X.vol_units("close", "atr_14", 1e6)}))


def _ee(s, p):
    return _nb(s, p).withColumns({"rn": FR.rn()}).withColumns({"entry": F.pmod(F.col("rn") * 7 + F.col("id"), F.lit(11)) < 3, "exit": F.pmod(F.col("rn") * 5 + F.col("id"), F.lit(13)) < 3})


query("signal_position_records", "id position_no# entry_ts entry_price:2 exit_ts exit_price:2 pnl_pct:4 state",
      """SELECT e.id, e.n AS position_no, e.ts AS entry_ts, e.close AS entry_price, x.ts AS exit_ts, x.close AS exit_price, (x.close / e.close - 1) * 100 AS pnl_pct, CASE WHEN x.ts IS NULL THEN 'open' ELSE 'closed' END AS state FROM (SELECT * FROM q WHERE entry) e
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts) AS k FROM (SELECT q.* FROM q JOIN lv USING (id, rn) WHERE q.leave AND lv.eff)) x ON x.id = e.id AND x.k = e.n""",
      NB + """, q AS (SELECT *, sum(CAST(entry AS INTEGER)) OVER (PARTITION BY id ORDER BY ts) AS n FROM (SELECT *, (rn * 7 + id) % 11 < 3 AS entry, (rn * 5 + id) % 13 < 3 AS leave FROM bars)),
      lv AS (WITH RECURSIVE r AS (SELECT id, rn, CASE WHEN entry AND leave THEN 0 WHEN entry THEN 1 ELSE 0 END AS lev, entry AND leave AS eff FROM q WHERE rn = 1 UNION ALL
       SELECT q.id, q.rn, greatest(r.lev + CAST(entry AS INTEGER) - CAST(leave AS INTEGER), 0), leave AND r.lev + CAST(entry AS INTEGER) > 0 FROM r JOIN q ON q.id = r.id AND q.rn = r.rn + 1) SELECT * FROM r)""")(
    lambda s, p: X.position_records(_ee(s, p), FR, snapshot=("close", "volume")))
query("signal_feature_hash", "id is_current", "SELECT id, id % 5 <> 0 AS is_current FROM (SELECT DISTINCT id FROM bars)", NB)(
    lambda s, p: X.stale_hashes(X.feature_hash(_nb(s, p), ["id"], ["close", "volume"]), X.feature_hash(_nb(s, p).withColumn("volume", F.when((F.col("id") % 5 == 0) & (F.dayofmonth("ts") == 3), F.col("volume") + 1).otherwise(F.col("volume"))), ["id"], ["close", "volume"]), ["id"]))
query("signal_count_anomalies", "kind last_day! today# mean:4 std:4 z:4 is_anomaly",
      """SELECT kind, l AS last_day, sum(n) FILTER (d = l) AS today, avg(n) FILTER (d < l) AS mean, stddev_samp(n) FILTER (d < l) AS std, (sum(n) FILTER (d = l) - avg(n) FILTER (d < l)) / stddev_samp(n) FILTER (d < l) AS z, abs((sum(n) FILTER (d = l) - avg(n) FILTER (d < l)) / stddev_samp(n) FILTER (d < l)) > 1 AS is_anomaly
       FROM (SELECT *, max(d) OVER (PARTITION BY kind) AS l FROM (SELECT event_type AS kind, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)) GROUP BY kind, l""")(lambda s, p: X.count_anomalies(M.event_ticks(s, p), ["kind"], z=1.0))
query("signal_crowding", "day! long_share:6 n# is_crowded", "SELECT CAST(ts AS DATE) AS day, avg(CAST(close > open AS DOUBLE)) AS long_share, count(*) AS n, greatest(avg(CAST(close > open AS DOUBLE)), 1 - avg(CAST(close > open AS DOUBLE))) >= 0.8 AS is_crowded FROM bars GROUP BY 1", NB)(
    lambda s, p: X.crowding(_nb(s, p).withColumn("side", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))))
query("signal_compare_runs", "id ts max_gap:4 result",
      "SELECT id, ts, CASE WHEN rn % 20 = 3 THEN 2.0 ELSE 0.0 END AS max_gap, CASE WHEN rn % 31 = 5 THEN 'only_1' WHEN rn % 20 = 3 THEN 'differs' ELSE 'same' END AS result FROM bars WHERE rn % 31 <> 5 UNION ALL SELECT id, ts, 0.0, 'only_1' FROM bars WHERE rn % 31 = 5", NB)(
    lambda s, p: (lambda d: X.compare_runs(d, d.filter("rn % 31 <> 5").withColumn("close", F.when(F.col("rn") % 20 == 3, F.col("close") + 2).otherwise(F.col("close"))), ["id", "ts"], ["close"]))(_nb(s, p).withColumn("rn", FR.rn())))
query("signal_blend_positions", "id ts vote:3 position#", "SELECT id, ts, v AS vote, CASE WHEN v > 0.1 THEN 1 WHEN v < -0.1 THEN -1 ELSE 0 END AS position FROM (SELECT id, ts, 0.6 * CASE WHEN close > open THEN 1 ELSE -1 END + 0.5 * CASE WHEN volume > 1 THEN 1 ELSE 0 END AS v FROM bars)", NB)(
    lambda s, p: X.blend_positions([(_nb(s, p).withColumn("position", F.when(F.col("close") > F.col("open"), 1).otherwise(-1)), 0.6), (_nb(s, p).filter("volume > 1").withColumn("position", F.lit(1)), 0.5)], ["id", "ts"], 0.1))
_OI = "oi AS (SELECT *, dollar / 1000 + 500 AS oi, (close - open) / 1e7 AS funding FROM bars)"
_oi = lambda s, p: M.nation_bars(s, p).withColumns({"oi": F.col("dollar") / 1000 + 500, "funding": (F.col("close") - F.col("open")) / 1e7})
_fz = f"(funding - {ro('avg', 'funding', 20)}) / nullif({ro('stddev_samp', 'funding', 20)}, 0)"
query("derivatives_oi_features", "id ts oi_mom:5 funding_z:4 funding_mom:4 oi_price_div:4 vol_oi_regime# liquidation_pressure:4",
      f"""SELECT *, 0.4 * abs(funding_z) + 0.3 * abs(oi_mom) + 0.3 * abs(oi_price_div) AS liquidation_pressure FROM (SELECT *, funding_z - {lag('funding_z', 5)} AS funding_mom, (gap - {ro('avg', 'gap', 20)}) / nullif({ro('stddev_samp', 'gap', 20)}, 0) AS oi_price_div,
       CASE WHEN o > 0 AND v > 0 AND pr > 0 THEN 1 WHEN o > 0 AND v > 0 AND pr <= 0 THEN 2 WHEN o <= 0 AND v > 0 AND pr > 0 THEN 3 WHEN o <= 0 AND v > 0 AND pr <= 0 THEN 4 WHEN o > 0 AND v <= 0 THEN 5 WHEN o <= 0 AND v <= 0 THEN 6 END AS vol_oi_regime FROM (
       SELECT *, oi / {lag('oi', 5)} - 1 AS oi_mom, oi / {lag('oi', 5)} - close / {lag('close', 5)} AS gap, {_fz} AS funding_z, oi - {lag('oi')} AS o, volume - {lag('volume')} AS v, close - {lag('close')} AS pr FROM oi))""", NB + ", " + _OI)(lambda s, p: X.oi_features(_oi(s, p), FR))
query("derivatives_oi_force", "id ts oi_force:2", "SELECT id, ts, v AS oi_force FROM e",
      NB + ", " + _OI + f", fx AS (SELECT id, ts, (close - {lag('close')}) * volume * oi / avg(oi) OVER (PARTITION BY id ORDER BY ts ROWS 12 PRECEDING) AS x FROM oi), " + ema_cte("e0", "fx", "x", {"v": span(13)}) + ", e AS (SELECT fx.id, fx.ts, v FROM fx LEFT JOIN e0 USING (id, ts))")(lambda s, p: X.oi_force(_oi(s, p), FR))
query("derivatives_oi_concentration", "id ts oi_share:6 oi_share_z:4", f"SELECT *, (oi_share - {ro('avg', 'oi_share', 20)}) / nullif({ro('stddev_samp', 'oi_share', 20)}, 0) AS oi_share_z FROM (SELECT *, oi / sum(oi) OVER (PARTITION BY ts) AS oi_share FROM oi)", NB + ", " + _OI)(lambda s, p: X.oi_concentration(_oi(s, p), FR))
query("composite_er_regime", "id ts er_regime:5",
      """SELECT t.id, t.ts, CASE WHEN t.er IS NOT NULL AND count(s.er) >= 20 THEN (count(CASE WHEN s.er < t.er THEN 1 END) + (count(CASE WHEN s.er = t.er THEN 1 END) + 1) / 2.0) / count(s.er) * sign(t.close - k.v) END AS er_regime FROM er t JOIN er s ON s.id = t.id AND s.rn BETWEEN t.rn - 59 AND t.rn LEFT JOIN k ON k.id = t.id AND k.rn = t.rn GROUP BY t.id, t.ts, t.er, t.close, k.v""", NB + ", " + _ER)(
    lambda s, p: X.er_regime(A.kama(_nb(s, p), FR, sets=((10, 2, 30),)), FR, "er_10", "kama_10_2_30"))
_zz = lambda x: f"({x} - {ro('avg', x, 60)}) / nullif({ro('stddev_samp', x, 60)}, 0)"
query("composite_oi_divergence", "id ts oi_div_agreement:4", f"SELECT id, ts, ({_zz('o')} - {_zz('q')}) * coalesce(ag, 1) AS oi_div_agreement FROM (SELECT *, oi / {lag('oi', 5)} - 1 AS o, close / {lag('close', 5)} - 1 AS q, CASE WHEN rn % 4 > 0 THEN 0.5 END AS ag FROM oi)", NB + ", " + _OI)(
    lambda s, p: X.oi_divergence_agreement(_oi(s, p).withColumn("rn", FR.rn()).withColumn("ag", F.when(F.col("rn") % 4 > 0, 0.5)), FR, "ag"))
query("composite_funding_momentum", "id ts funding_adj_mom:4", f"SELECT id, ts, {_zz('m')} - {_zz('fs')} AS funding_adj_mom FROM (SELECT *, close / {lag('close', 20)} - 1 AS m, {ro('sum', 'funding', 20)} AS fs FROM oi)", NB + ", " + _OI)(lambda s, p: X.funding_adjusted_momentum(_oi(s, p), FR))
query("composite_lead_lag", "id ts lead_lag_composite:5",
      f"SELECT f AS id, ts, sum(ic * v) / sum(abs(ic)) AS lead_lag_composite FROM (SELECT id, ts, {lag('r', 2)} AS v FROM (SELECT id, ts, close / {lag('close')} - 1 AS r FROM bars)) l JOIN (SELECT a.id AS l, b.id AS f, (a.id + 1) / 100.0 * CASE WHEN (a.id + b.id) % 2 = 0 THEN 1 ELSE -1 END AS ic FROM (SELECT max(id) + 1 AS n FROM bars) u CROSS JOIN (SELECT DISTINCT id FROM bars) a JOIN (SELECT DISTINCT id FROM bars) b ON b.id IN ((a.id + 1) % u.n, (a.id + 2) % u.n)) p ON p.l = l.id WHERE v IS NOT NULL GROUP BY f, ts", NB)(
    lambda s, p: (lambda d: X.leader_composite(d, d.select(F.col("id").alias("leader")).distinct().crossJoin(F.broadcast(d.agg((F.max("id") + 1).alias("n")))).select("leader", F.explode(F.array((F.col("leader") + 1) % F.col("n"), (F.col("leader") + 2) % F.col("n"))).alias("follower")).withColumn(
        "ic", (F.col("leader") + 1) / 100.0 * F.when((F.col("leader") + F.col("follower")) % 2 == 0, 1).otherwise(-1)), FR, "r", 2))(_nb(s, p).withColumn("r", FR.pct("close"))))
query("composite_gated_trend", "id ts gated_trend:5", f"SELECT t.id, t.ts, (t.close - k.v) / a * (0.5 + 0.5 * tanh(t.volume / mv - 1)) AS gated_trend FROM (SELECT *, {ro('avg', 'tr', 14)} AS a, {ro('avg', 'volume', 20)} AS mv FROM tr) t LEFT JOIN k ON k.id = t.id AND k.rn = t.rn", NB + ", " + _TR + ", " + _ER)(
    lambda s, p: X.gated_trend(I.atr(A.kama(_nb(s, p), FR, sets=((10, 2, 30),)), FR, 14), FR, "kama_10_2_30", "atr_14"))


def _positions(s, p):
    return _nb(s, p).groupBy("id").agg(F.min_by("close", "ts").alias("entry_price")).withColumn("side", F.when(F.col("id") % 2 == 0, "long").otherwise("short"))


_SCH = """po AS (SELECT id, arg_min(close, ts) AS entry_price, arg_max(close, ts) AS last, CASE WHEN id % 2 = 0 THEN 'long' ELSE 'short' END AS side, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS sg FROM bars GROUP BY id),
 sc AS (SELECT po.*, kind, tier, CASE WHEN kind = 'sl' THEN entry_price * (1 - sg * d) ELSE entry_price * (1 + sg * d) END AS level, share FROM po CROSS JOIN (VALUES ('sl', 1, 0.05, 0.5), ('sl', 2, 0.1, 0.5), ('tp', 1, 0.1, 0.3), ('tp', 2, 0.3, 0.7)) t(kind, tier, d, share))"""
_sched = lambda s, p: X.exit_schedule(_positions(s, p), [(0.05, 0.5), (0.1, 0.5)], [(0.1, 0.3), (0.3, 0.7)])
query("stop_ladder_schedule", "id side kind tier# level:3 share:2", "SELECT * FROM sc", NB + ", " + _SCH)(_sched)
query("stop_ladder_triggers", "id side kind tier# level:3", "SELECT * FROM sc WHERE CASE WHEN (kind = 'sl') = (side = 'long') THEN last <= level ELSE last >= level END AND NOT (kind = 'tp' AND tier = 1)", NB + ", " + _SCH)(
    lambda s, p: X.triggered_tiers(_sched(s, p), _nb(s, p).groupBy("id").agg(F.max_by("close", "ts").alias("price")), ["id"], _positions(s, p).select("id", F.lit("tp").alias("kind"), F.lit(1).alias("tier"))))
query("signal_latest_per_asset", "id ts close:2", "SELECT id, max(ts) AS ts, arg_max(close, ts) AS close FROM bars GROUP BY id", NB)(lambda s, p: X.latest_per_key(_nb(s, p), ["id"]))

# --- labels ----------------------------------------------------------------------------------------
_CT = _LR + ", " + _EWS(100) + ", th AS (SELECT id, avg(dv) * 2 AS t FROM ew GROUP BY id)"
query("label_cusum_threshold", "id cusum_threshold:6", "SELECT id, t AS cusum_threshold FROM th", NB + ", " + _CT)(lambda s, p: L.cusum_thresholds(_nb(s, p), FR))
_CU = """, ce AS (WITH RECURSIVE c AS (SELECT lr.id, lr.rn, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS ev FROM lr WHERE rn = 1 UNION ALL
  SELECT id, rn, CASE WHEN u >= t THEN 0 ELSE u END, CASE WHEN u < t AND d <= -t THEN 0 ELSE d END, u >= t OR d <= -t FROM (SELECT lr.id, lr.rn, th.t, greatest(0, c.up + lr.r) AS u, least(0, c.dn + lr.r) AS d FROM c JOIN lr ON lr.id = c.id AND lr.rn = c.rn + 1 JOIN th ON th.id = c.id)) SELECT * FROM c)"""
query("label_cusum_events", "id ts is_event", "SELECT lr.id, lr.ts, ce.ev AS is_event FROM lr JOIN ce USING (id, rn)", NB + ", " + _CT + _CU)(lambda s, p: L.cusum_events(_nb(s, p), FR))
query("label_cusum_density", "id n_events# n_bars# density:6 in_range", "SELECT id, count(*) FILTER (ev) AS n_events, count(*) AS n_bars, count(*) FILTER (ev) / count(*) AS density, count(*) FILTER (ev) / count(*) BETWEEN 0.05 AND 0.3 AS in_range FROM ce GROUP BY id", NB + ", " + _CT + _CU)(lambda s, p: L.event_density(L.cusum_events(_nb(s, p), FR), ["id"]))
query("label_vertical_barrier", "id ts t1", f"SELECT id, ts, coalesce(lead(ts, 5) OVER {W}, max(ts) OVER (PARTITION BY id)) AS t1 FROM bars", NB)(lambda s, p: _nb(s, p).withColumn("t1", L.vertical_barrier(FR, 5)))
_TB = f"""tb AS (SELECT t.id, t.ts, t.rn, t.close, t.v, min(CASE WHEN s.close >= t.close * (1 + 1.0 * t.v) OR s.close <= t.close * (1 - 0.5 * t.v) THEN s.rn END) AS h, max(s.rn) AS l FROM (SELECT *, {ro('stddev_samp', 'r', 20)} AS v FROM lr) t LEFT JOIN bars s ON s.id = t.id AND s.rn > t.rn AND s.rn <= t.rn + 5 WHERE t.v IS NOT NULL GROUP BY ALL)"""
query("label_triple_barrier", "id ts t1 ret:6 bin# barrier_type",
      "SELECT tb.id, tb.ts, coalesce(b.ts, tb.ts) AS t1, ln(coalesce(b.close, tb.close) / tb.close) AS ret, CASE WHEN h IS NULL THEN 0 WHEN b.close >= tb.close * (1 + v) THEN 1 ELSE -1 END AS bin, CASE WHEN h IS NULL THEN 'vb' WHEN b.close >= tb.close * (1 + v) THEN 'pt' ELSE 'sl' END AS barrier_type FROM tb LEFT JOIN bars b ON b.id = tb.id AND b.rn = coalesce(h, l)", NB + ", " + _LR + ", " + _TB)(
    lambda s, p: L.triple_barrier(_nb(s, p).withColumn("lr", FR.log_return("close")).withColumn("v", FR.std("lr", 20)), FR, "v", 1.0, 0.5, 5))
query("label_returns_at_t1", "id ts t1 ret:6", f"SELECT id, ts, t1, ln(c1 / close) AS ret FROM (SELECT *, coalesce(lead(ts, 7) OVER {W}, max(ts) OVER (PARTITION BY id)) AS t1, coalesce(lead(close, 7) OVER {W}, arg_max(close, ts) OVER (PARTITION BY id)) AS c1 FROM bars)", NB)(
    lambda s, p: L.returns_at(_nb(s, p).withColumn("t1", L.vertical_barrier(FR, 7)).select("id", "ts", "t1"), _nb(s, p), ["id"]))
_TS = """ts0 AS (SELECT t.id, t.ts, n, covar_samp(ln(s.close), s.rn) / var_samp(s.rn) AS sl, var_samp(ln(s.close)) AS vy, var_samp(s.rn) AS vx, max(s.ts) AS t1 FROM bars t CROSS JOIN (SELECT unnest(range(5, 13)) AS n) JOIN bars s ON s.id = t.id AND s.rn BETWEEN t.rn AND t.rn + n - 1 GROUP BY t.id, t.ts, n HAVING count(*) = n),
 ts1 AS (SELECT *, sl / sqrt(greatest(vy - sl * sl * vx, 0) * (n - 1) / (n - 2) / (vx * (n - 1))) AS tv FROM ts0), ts2 AS (SELECT *, row_number() OVER (PARTITION BY id, ts ORDER BY abs(tv) DESC, n) AS k FROM ts1)"""
query("label_trend_scan", "id ts t1 tvalue:3 bin#", "SELECT id, ts, t1, tv AS tvalue, CASE WHEN abs(tv) > 2 THEN sign(tv) ELSE 0 END AS bin FROM ts2 WHERE k = 1", NB + ", " + _TS)(lambda s, p: L.trend_scan(_nb(s, p), FR, 12, 5, 2.0))
query("label_trend_weights", "id ts weight:4", "SELECT id, ts, (abs(tv) - min(abs(tv)) OVER p) / (max(abs(tv)) OVER p - min(abs(tv)) OVER p) AS weight FROM ts2 WHERE k = 1 WINDOW p AS (PARTITION BY id)", NB + ", " + _TS)(lambda s, p: L.trend_weights(L.trend_scan(_nb(s, p), FR, 12, 5, 2.0), ["id"]))
query("label_meta", "id ts meta#", f"SELECT id, ts, CAST(CASE WHEN close > open THEN 1 ELSE -1 END * sign(lead(close, 3) OVER {W} - close) > 0 AS INTEGER) AS meta FROM bars", NB)(
    lambda s, p: _nb(s, p).withColumn("meta", L.meta_label(F.when(F.col("close") > F.col("open"), 1).otherwise(-1), F.signum(FR.lead("close", 3) - F.col("close")))))
query("label_rows_at_events", "id ts close:2", "SELECT id, ts, close FROM bars WHERE rn % 9 = 0", NB)(lambda s, p: L.rows_at(_nb(s, p), _nb(s, p).withColumn("rn", FR.rn()).filter("rn % 9 = 0"), ["id"]))
