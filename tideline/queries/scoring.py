"""Evaluation, factor research, microstructure and expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.expressions import evaluate
from tideline.functions.frames import Frame
from tideline.operators import evaluate as E
from tideline.operators import labels as L
from tideline.operators import micro as K
from tideline.operators import research as Q
from tideline.operators import resample as RS
from tideline.operators import stats as S
from tideline.queries.base import NB, W, ema_cte, lag, lead, phi, query, ro, span
from tideline.queries.features import _nb
from tideline.queries.joins import TRADES, _trades
from tideline.sources import market as M

FR = Frame()

# --- evaluation ------------------------------------------------------------------------------------
# position: long after an up day on busy days; returns are scaled so that compounding stays finite
_POS = f"""pb AS (SELECT *, CASE WHEN close > open THEN 1 WHEN volume > 2 THEN -1 ELSE 0 END AS position FROM bars),
 sr AS (SELECT *, coalesce({lag('position')}, 0) * coalesce((close / {lag('close')} - 1), 0) / 100 AS g, abs(position - {lag('position')}) AS dp FROM pb),
 st AS (SELECT *, g - 10e-4 / 100 * coalesce(abs(h - {lag('h')}), 0) AS strat_ret FROM (SELECT *, coalesce({lag('position')}, 0) AS h FROM sr)),
 eq AS (SELECT *, exp(sum(ln(1 + strat_ret)) OVER {W}) AS equity FROM st), dd AS (SELECT *, equity / max(equity) OVER {W} - 1 AS drawdown FROM eq)"""


def _pos(s, p):
    return _nb(s, p).withColumn("position", F.when(F.col("close") > F.col("open"), 1).when(F.col("volume") > 2, -1).otherwise(0))


def _strat(s, p):
    """Strategy returns of the position table, scaled by 1/100."""
    d = E.position_returns(_pos(s, p), FR, costs_bps=10)
    return d.withColumn("strat_ret", F.col("strat_ret") / 100)


_SR = _POS.replace("10e-4 / 100", "10e-4 / 100")
query("eval_position_returns", "id ts strat_ret:7 equity:5 drawdown:5", "SELECT * FROM dd", NB + ", " + _SR)(lambda s, p: E.with_equity(_strat(s, p), FR, "strat_ret"))
_sh = lambda x, n: f"avg({x}) * sqrt({n}) / (stddev_samp({x}) + 1e-12)"
query("eval_metrics", "id ann_return:5 sharpe:5 sortino:5 max_drawdown:5 calmar:4 mar:4 hit_rate:6 n_bars# turnover:6",
      f"""SELECT *, ann_return / (abs(max_drawdown) + 1e-12) AS calmar, ann_return / abs(max_drawdown) AS mar FROM (SELECT id, pow(exp(sum(ln(1 + strat_ret))), 252.0 / count(*)) - 1 AS ann_return, {_sh('strat_ret', 252)} AS sharpe, avg(strat_ret) * sqrt(252) / (stddev_samp(CASE WHEN strat_ret < 0 THEN strat_ret END) + 1e-12) AS sortino,
       min(drawdown) AS max_drawdown, avg(CAST(strat_ret > 0 AS DOUBLE)) AS hit_rate, count(*) AS n_bars, avg(dp) AS turnover FROM dd GROUP BY id)""", NB + ", " + _SR)(
    lambda s, p: E.metrics(E.with_equity(_strat(s, p), FR, "strat_ret").withColumn("_dp", F.abs(FR.diff("position"))), ["id"], "strat_ret", 252.0, F.avg("_dp").alias("turnover")).withColumn("mar", E.ratio("ann_return", F.abs("max_drawdown"))))
query("eval_by_regime", "id busy sharpe:5 mean_ret:6 hit_rate:6 n_bars#", f"SELECT id, busy, {_sh('r', 252)} AS sharpe, avg(r) AS mean_ret, avg(CAST(r > 0 AS DOUBLE)) AS hit_rate, count(*) AS n_bars FROM (SELECT *, volume > 1 AS busy, g * 100 AS r FROM sr) GROUP BY id, busy", NB + ", " + _SR)(
    lambda s, p: E.by_regime(_pos(s, p).withColumn("busy", F.col("volume") > 1), FR, "busy"))
query("eval_funding_adjusted_equity", "id ts cum_funding:6 adj_equity:5", f"SELECT id, ts, c AS cum_funding, equity + c AS adj_equity FROM (SELECT *, sum(-h * 0.001) OVER {W} AS c FROM eq)", NB + ", " + _SR)(
    lambda s, p: E.funding_adjusted_equity(E.with_equity(_strat(s, p), FR, "strat_ret").withColumn("payment", -F.coalesce(FR.lag("position"), F.lit(0)) * 0.001), FR))
query("eval_psr", "id n# sr:6 skew:5 kurt:5", "SELECT id, count(*) AS n, avg(strat_ret) / stddev_samp(strat_ret) AS sr, (sum(pow(strat_ret - m, 3)) / count(*)) / pow(var_pop(strat_ret), 1.5) AS skew, (sum(pow(strat_ret - m, 4)) / count(*)) / pow(var_pop(strat_ret), 2) AS kurt FROM (SELECT *, avg(strat_ret) OVER (PARTITION BY id) AS m FROM st) GROUP BY id", NB + ", " + _SR)(
    lambda s, p: E.psr(_strat(s, p), ["id"], "strat_ret"))
_MOM = "mo AS (SELECT id, count(*) AS n, avg(strat_ret) AS m0, stddev_samp(strat_ret) AS sd, avg(strat_ret) / stddev_samp(strat_ret) AS sr, (sum(pow(strat_ret - m, 3)) / count(*)) / pow(var_pop(strat_ret), 1.5) AS sk, (sum(pow(strat_ret - m, 4)) / count(*)) / pow(var_pop(strat_ret), 2) AS ku FROM (SELECT *, avg(strat_ret) OVER (PARTITION BY id) AS m FROM st) GROUP BY id)"
query("eval_psr_probability", "id psr:6", f"SELECT id, {phi('z')} AS psr FROM (SELECT id, sr / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1)) AS z FROM mo)", NB + ", " + _SR + ", " + _MOM)(lambda s, p: E.psr(_strat(s, p), ["id"], "strat_ret"))
query("eval_deflated_sharpe", "id sr:6 sr_max:6 n_trials# dsr:6", None)(lambda s, p: E.deflated(_strat(s, p), [], "id", "strat_ret"))
query("eval_min_track_record", "id sr:6 min_obs:3 min_days#",
      """SELECT id, sr, CASE WHEN sr > -0.05 THEN pow(1.6448536269514722 * sqrt(CASE WHEN v > 0 THEN v ELSE 1 + sr * sr / 2 END) / (sr + 0.05), 2) + 1 END AS min_obs, CASE WHEN sr > -0.05 THEN round(ceil(pow(1.6448536269514722 * sqrt(CASE WHEN v > 0 THEN v ELSE 1 + sr * sr / 2 END) / (sr + 0.05), 2) + 1) / 365 * 365) END AS min_days FROM (
       SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS v FROM (SELECT id, avg(strat_ret) / stddev_samp(strat_ret) AS sr, (sum(pow(strat_ret - m, 3)) / count(*)) / pow(var_pop(strat_ret), 1.5) AS sk, (sum(pow(strat_ret - m, 4)) / count(*)) / pow(var_pop(strat_ret), 2) AS ku FROM (SELECT *, avg(strat_ret) OVER (PARTITION BY id) AS m FROM st) GROUP BY id))""", NB + ", " + _SR)(
    lambda s, p: E.min_track_record(_strat(s, p), ["id"], "strat_ret", -0.05))
query("eval_var_suite", "id var_hist:6 var_normal:6 cvar_hist:6 n#",
      "SELECT x.id, v AS var_hist, m - 1.6448536269514729 * sd AS var_normal, avg(strat_ret) AS cvar_hist, max(n) AS n FROM st x JOIN (SELECT id, quantile_cont(strat_ret, 0.05) AS v, avg(strat_ret) AS m, stddev_samp(strat_ret) AS sd, count(*) AS n FROM st GROUP BY id) q ON q.id = x.id AND x.strat_ret <= q.v GROUP BY x.id, v, m, sd", NB + ", " + _SR)(
    lambda s, p: E.var_suite(_strat(s, p), ["id"], "strat_ret"))
_Z5 = -1.6448536269514729
query("eval_var_cornish_fisher", "id var_cf:6",
      f"SELECT id, CASE WHEN abs(ku - 3) > 8 THEN v ELSE m0 + sd * ({_Z5} + ({_Z5**2 - 1}) * sk / 6 + ({_Z5**3 - 3 * _Z5}) * (ku - 3) / 24 - ({2 * _Z5**3 - 5 * _Z5}) * sk * sk / 36) END AS var_cf FROM mo JOIN (SELECT id, quantile_cont(strat_ret, 0.05) AS v FROM st GROUP BY id) USING (id)", NB + ", " + _SR + ", " + _MOM)(lambda s, p: E.var_suite(_strat(s, p), ["id"], "strat_ret"))
query("eval_daily_cap", "g# daily_cap:6", "SELECT 1 AS g, least(median(abs(v)), 0.15) AS daily_cap FROM (SELECT id, quantile_cont(strat_ret, 0.05) AS v FROM st GROUP BY id)", NB + ", " + _SR)(
    lambda s, p: E.daily_cap(E.var_suite(_strat(s, p), ["id"], "strat_ret").withColumn("g", F.lit(1)), ["g"]))
query("eval_worst_days", "id worst_1:6 worst_3:6 worst_10:6", "SELECT id, avg(strat_ret) FILTER (k <= 1) AS worst_1, avg(strat_ret) FILTER (k <= 3) AS worst_3, avg(strat_ret) FILTER (k <= 10) AS worst_10 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strat_ret) AS k FROM st) GROUP BY id", NB + ", " + _SR)(
    lambda s, p: E.worst_days(_strat(s, p), ["id"], "strat_ret", (1, 3, 10)))
query("eval_garch_var_and_position", "id ts gv:6 units:4", f"SELECT id, ts, -1.6448536269514729 * v AS gv, CASE WHEN v IS NOT NULL THEN least(0.01 / nullif(0.5 * v + 0.5 * 0.3, 0), 0.3) * 1e6 / close END AS units FROM (SELECT *, {ro('stddev_samp', 'strat_ret', 20)} AS v FROM st)", NB + ", " + _SR)(
    lambda s, p: _strat(s, p).withColumn("v", FR.std("strat_ret", 20)).withColumns({"gv": E.garch_var("v"), "units": F.when(F.col("v").isNotNull(), E.vol_position("close", "v", 1e6, forecast=F.lit(0.3)))}))
query("eval_mae_mfe", "id trade_id# mae:6 mfe:6",
      "SELECT t.id, t.trade_id, CASE WHEN t.trade_id % 80 = 1 THEN -(max(b.close) / t.entry_price - 1) ELSE min(b.close) / t.entry_price - 1 END AS mae, CASE WHEN t.trade_id % 80 = 1 THEN -(min(b.close) / t.entry_price - 1) ELSE max(b.close) / t.entry_price - 1 END AS mfe FROM trades t JOIN bars b ON b.id = t.id AND b.ts BETWEEN t.entry_ts AND t.exit_ts GROUP BY t.id, t.trade_id, t.entry_price", TRADES)(
    lambda s, p: E.excursions(_trades(s, p).withColumn("side", F.when(F.col("trade_id") % 80 == 1, "short").otherwise("long")), _nb(s, p)))
query("eval_calibrated_stops", "id n_trades# stop_p25:5 stop_p50:5 stop_p75:5 target_p50:5 target_p75:5",
      "SELECT id, count(*) AS n_trades, quantile_cont(abs(mae), 0.25) AS stop_p25, quantile_cont(abs(mae), 0.5) AS stop_p50, quantile_cont(abs(mae), 0.75) AS stop_p75, quantile_cont(mfe, 0.5) AS target_p50, quantile_cont(mfe, 0.75) AS target_p75 FROM (SELECT t.id, t.trade_id, min(b.close) / t.entry_price - 1 AS mae, max(b.close) / t.entry_price - 1 AS mfe FROM trades t JOIN bars b ON b.id = t.id AND b.ts BETWEEN t.entry_ts AND t.exit_ts GROUP BY t.id, t.trade_id, t.entry_price) GROUP BY id HAVING count(*) >= 10", TRADES)(
    lambda s, p: E.calibrated_stops(E.excursions(_trades(s, p).withColumn("side", F.lit("long")), _nb(s, p)), ["id"], 10))
_ent = lambda s, p: _nb(s, p).withColumn("rn", FR.rn()).filter("rn % 15 = 1").select("id", "ts")
_SX = """sx AS (SELECT e.id, e.ts, lv.v AS stop_pct, e.close AS entry_price, min(CASE WHEN b.close <= {base} * (1 - lv.v) THEN b.rn END) AS h, max(b.rn) AS l, e.rn FROM bars e CROSS JOIN (SELECT unnest([0.3, 0.6]) AS v) lv JOIN {path} ON b.id = e.id AND b.rn > e.rn AND b.rn <= e.rn + 20 WHERE e.rn % 15 = 1 GROUP BY ALL)"""
_SXO = "SELECT sx.id, sx.ts, stop_pct, b.close AS exit_price, b.rn - sx.rn AS bars_held, h IS NOT NULL AS stopped, b.close / entry_price - 1 - 0.001 AS ret FROM sx JOIN bars b ON b.id = sx.id AND b.rn = coalesce(h, l)"
query("eval_hard_stop_sweep", "id ts stop_pct:2 exit_price:2 bars_held# stopped ret:6", _SXO, NB + ", " + _SX.format(base="e.close", path="bars b"))(
    lambda s, p: E.stop_exits(_ent(s, p), _nb(s, p), FR, (0.3, 0.6), "hard", 20, 5.0))
query("eval_trailing_stop_sweep", "id ts stop_pct:2 exit_price:2 bars_held# stopped ret:6", _SXO,
      NB + ", " + _SX.format(base="b.pk", path="(SELECT e.id AS eid, e.rn AS ern, b.id, b.rn, b.close, greatest(e.close, coalesce(max(b.close) OVER (PARTITION BY e.id, e.rn ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pk FROM bars e JOIN bars b ON b.id = e.id AND b.rn > e.rn AND b.rn <= e.rn + 20 WHERE e.rn % 15 = 1) b").replace("ON b.id = e.id AND b.rn > e.rn", "ON b.eid = e.id AND b.ern = e.rn AND b.rn > e.rn").replace("JOIN bars b ON b.eid = e.id AND b.ern = e.rn AND", "JOIN bars b ON b.id = e.id AND"))(
    lambda s, p: E.stop_exits(_ent(s, p), _nb(s, p), FR, (0.3, 0.6), "trailing", 20, 5.0))
query("eval_time_exits", "id ts exit_price:2 ret:6", f"SELECT id, ts, x AS exit_price, x / close - 1 AS ret FROM (SELECT *, {lead('close', 10)} AS x FROM bars) WHERE rn % 15 = 1", NB)(lambda s, p: E.time_exits(_ent(s, p), _nb(s, p), FR, 10))
query("eval_best_stop", "id stop_pct:2 n# score:5",
      f"SELECT id, stop_pct, n, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, stop_pct) AS k FROM (SELECT id, stop_pct, count(*) AS n, avg(ret) / (stddev_samp(ret) + 1e-12) AS score FROM ({_SXO}) GROUP BY ALL)) WHERE k = 1", NB + ", " + _SX.format(base="e.close", path="bars b"))(
    lambda s, p: E.best_stop(E.stop_summary(E.stop_exits(_ent(s, p), _nb(s, p), FR, (0.3, 0.6), "hard", 20, 5.0), ["id", "stop_pct"]), ["id"]))
query("eval_recovery_time", "id mean_recovery_bars:5 n_drawdowns#",
      f"""WITH q AS (SELECT *, sum(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER {W} AS ep FROM dd), m AS (SELECT id, max(ep) AS le FROM q GROUP BY id) SELECT id, avg(e + 1 - t) AS mean_recovery_bars, count(*) AS n_drawdowns FROM (SELECT q.id, ep, arg_min(rn, struct_pack(a := drawdown, b := rn)) AS t, max(rn) AS e FROM q JOIN m USING (id) WHERE drawdown < 0 AND ep < le GROUP BY ALL) GROUP BY id""", NB + ", " + _SR)(
    lambda s, p: E.recovery_time(_strat(s, p), FR, "strat_ret"))
query("eval_bar_returns_of_trades", "id ts ret:6", f"SELECT b.id, b.ts, CASE WHEN EXISTS (SELECT 1 FROM trades t WHERE t.id = b.id AND b.ts > t.entry_ts AND b.ts <= t.exit_ts) THEN coalesce(r, 0) ELSE 0 END AS ret FROM (SELECT *, close / {lag('close')} - 1 AS r FROM bars) b", TRADES)(
    lambda s, p: E.bar_returns_of_trades(_nb(s, p), _trades(s, p)))
query("eval_daily_trade_returns", "id day! pnl:3",
      "SELECT g.id, g.day, coalesce(sum(t.p), 0) AS pnl FROM (SELECT id, CAST(unnest(generate_series((SELECT CAST(min(CAST(exit_ts AS DATE)) AS TIMESTAMP) FROM trades), (SELECT CAST(max(CAST(exit_ts AS DATE)) AS TIMESTAMP) FROM trades), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT id FROM trades)) g LEFT JOIN (SELECT id, CAST(exit_ts AS DATE) AS day, entry_price / 1000 AS p FROM trades) t USING (id, day) GROUP BY g.id, g.day", TRADES)(
    lambda s, p: E.daily_trade_returns(_trades(s, p).withColumn("pnl", F.col("entry_price") / 1000), ["id"]))
query("eval_bootstrap_sharpe", "id lo:5 median:5 hi:5 samples#", None)(lambda s, p: E.bootstrap_sharpe(_strat(s, p), ["id"], "strat_ret"))
_MT = _MOM + f", mt AS (SELECT m0.*, psr FROM (SELECT id, {_sh('strat_ret', 252)} AS sharpe, min(drawdown) AS max_drawdown, avg(dp) AS turnover, pow(exp(sum(ln(1 + strat_ret))), 252.0 / count(*)) - 1 AS ann_return, count(*) AS n_trades FROM dd GROUP BY id) m0 JOIN (SELECT id, {phi('z')} AS psr FROM (SELECT id, sr / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1)) AS z FROM mo)) USING (id))"


def _mt(s, p):
    d = E.with_equity(_strat(s, p), FR, "strat_ret").withColumn("_dp", F.abs(FR.diff("position")))
    m = E.metrics(d, ["id"], "strat_ret", 252.0, F.avg("_dp").alias("turnover"))
    psr = F.when(F.col("psr") < 6.22096e-16, 0.0).otherwise(F.col("psr"))  # phi() is 0 below -8; normalising would blow up what is left
    return m.join(E.psr(_strat(s, p), ["id"], "strat_ret").select("id", psr.alias("psr")), "id").withColumnRenamed("n_bars", "n_trades")


_IEEE = {"flat": float("nan"), "missing": None}  # as the division of _un: 0 / 0, and null stays null
_un = lambda m: f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())"
_CS = f"cs AS (SELECT *, 0.35 * {_un('sharpe')} + 0.25 * {_un('max_drawdown')} + 0.25 * {_un('psr')} + 0.15 * (1 - {_un('turnover')}) AS composite_score FROM mt)"
query("eval_composite_rank", "id composite_score:5 rank#", "SELECT id, composite_score, rank() OVER (ORDER BY composite_score DESC) AS rank FROM cs", NB + ", " + _SR + ", " + _MT + ", " + _CS)(lambda s, p: E.rank_strategies(E.composite_score(_mt(s, p), **_IEEE)))
query("eval_gates_v1", "id gate_failures passes", "SELECT id, concat_ws(',', CASE WHEN sharpe < -0.3 THEN 'sharpe' END, CASE WHEN abs(max_drawdown) > 0.9 THEN 'max_drawdown' END) AS gate_failures, sharpe >= -0.3 AND abs(max_drawdown) <= 0.9 AS passes FROM mt", NB + ", " + _SR + ", " + _MT)(lambda s, p: E.gates_v1(_mt(s, p), -0.3, 0.9))
query("eval_rank_sensitivity", "id best_rank# worst_rank# n_top# n_schemes#",
      f"SELECT id, min(r) AS best_rank, max(r) AS worst_rank, count(*) FILTER (r <= 5) AS n_top, count(*) AS n_schemes FROM (SELECT id, rank() OVER (ORDER BY x DESC) AS r FROM (SELECT id, {_un('sharpe')} AS x FROM mt) UNION ALL SELECT id, rank() OVER (ORDER BY x DESC) FROM (SELECT id, 0.5 * {_un('max_drawdown')} + 0.5 * (1 - {_un('turnover')}) AS x FROM mt)) GROUP BY id", NB + ", " + _SR + ", " + _MT)(
    lambda s, p: E.rank_sensitivity(_mt(s, p), {"sharpe": {"sharpe": 1.0}, "safe": {"max_drawdown": 0.5, "turnover": 0.5}}, ["id"], 5, **_IEEE))
query("eval_leaderboard", "grp# id place#", "SELECT id % 3 AS grp, id, row_number() OVER (PARTITION BY id % 3 ORDER BY ann_return / abs(max_drawdown) DESC, id) AS place FROM mt", NB + ", " + _SR + ", " + _MT)(
    lambda s, p: E.leaderboard(_mt(s, p).withColumns({"grp": F.col("id") % 3, "strategy": F.col("id")}), ["grp"], then=()))
query("eval_select_distinct", "id pick#", "SELECT id, pick FROM (SELECT *, row_number() OVER (ORDER BY composite_score DESC, fam) AS pick FROM (SELECT *, id % 4 AS fam, row_number() OVER (PARTITION BY id % 4 ORDER BY composite_score DESC) AS k FROM cs) WHERE k = 1) WHERE pick <= 2", NB + ", " + _SR + ", " + _MT + ", " + _CS)(
    lambda s, p: E.select_distinct(E.composite_score(_mt(s, p), **_IEEE).withColumns({"g": F.lit(1), "fam": F.col("id") % 4}), ["g"], "fam", "composite_score", tie=("id",)))
query("eval_sequential_gates", "gate step# survivors#",
      "SELECT unnest(['all', 'dsr', 'pbo', 'drawdown', 'trades']) AS gate, unnest([0, 1, 2, 3, 4]) AS step, unnest([count(*), count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND d)]) AS survivors FROM (SELECT psr >= 0.4 AND id % 6 <> 0 AS a, turnover <= 1.2 OR id % 5 = 0 AS b, abs(max_drawdown) <= 0.95 AS c, n_trades >= 500 AS d FROM mt)", NB + ", " + _SR + ", " + _MT)(
    lambda s, p: E.sequential_gates(_mt(s, p).withColumns({"dsr": F.when(F.col("id") % 6 != 0, F.col("psr")), "pbo": F.when(F.col("id") % 5 != 0, F.col("turnover"))}), 0.4, 1.2, 0.95, 500))
query("eval_scorecard", "gate measured:5 threshold:2 status",
      "SELECT 'best_sharpe' AS gate, max(sharpe) AS measured, 0.5 AS threshold, CASE WHEN max(sharpe) >= 0.5 THEN 'PASS' WHEN max(sharpe) >= 0.3 THEN 'CONDITIONAL' ELSE 'FAIL' END AS status FROM mt UNION ALL SELECT 'worst_drawdown', min(max_drawdown), -0.5, CASE WHEN min(max_drawdown) >= -0.5 THEN 'PASS' WHEN min(max_drawdown) >= -0.7 THEN 'CONDITIONAL' ELSE 'FAIL' END FROM mt", NB + ", " + _SR + ", " + _MT)(
    lambda s, p: E.scorecard([("best_sharpe", _mt(s, p).agg(F.max("sharpe").alias("v")), "v", 0.5, "above"), ("worst_drawdown", _mt(s, p).agg(F.min("max_drawdown").alias("v")), "v", -0.5, "above")], 0.2))
query("eval_paired_comparison", "a# b# wins# losses# ties# mean_delta:5",
      "SELECT pr.a, pr.b, count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (d < -1e-9) AS losses, count(*) FILTER (abs(d) <= 1e-9) AS ties, avg(d) AS mean_delta FROM (SELECT id AS a, lead(id) OVER (ORDER BY id) AS b FROM (SELECT DISTINCT id FROM bars)) pr JOIN (SELECT x.id AS a, y.id AS b, x.close - y.close AS d FROM bars x JOIN bars y ON x.ts = y.ts) USING (a, b) GROUP BY 1, 2", NB)(
    lambda s, p: E.paired_comparisons(_nb(s, p), (lambda ids: ids.select(F.col("id").alias("a"), F.lead("id").over(Window.orderBy("id")).alias("b")))(_nb(s, p).select("id").distinct()), ["ts"], "id", "close"))
query("eval_tail_score_caps", "id score:4", "SELECT x.id, 0.4 * sharpe + 0.3 * so + 0.2 * (1 + ann_return / (abs(max_drawdown) + 1e-12)) + 0.1 * least(greatest(1 - abs(w5) / 0.2, -1), 1) AS score FROM mt x JOIN (SELECT id, avg(strat_ret) * sqrt(252) / (stddev_samp(CASE WHEN strat_ret < 0 THEN strat_ret END) + 1e-12) AS so FROM st GROUP BY id) USING (id) JOIN (SELECT id, avg(strat_ret) AS w5 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strat_ret) AS k FROM st) WHERE k <= 5 GROUP BY id) USING (id)", NB + ", " + _SR + ", " + _MT)(
    lambda s, p: _mt(s, p).join(E.worst_days(_strat(s, p), ["id"], "strat_ret", (5,)), "id").withColumn("score", E.tail_score(F.lit(-0.2))))
query("eval_loss_caps", "grp# daily_loss_cap:6 drawdown_cap:6", "SELECT id % 2 AS grp, least(avg(abs(max_drawdown)) * 0.1 * 1.5, 0.2) AS daily_loss_cap, least(avg(abs(max_drawdown)) * 1.5, 0.4) AS drawdown_cap FROM mt GROUP BY 1", NB + ", " + _SR + ", " + _MT)(lambda s, p: E.loss_caps(_mt(s, p).withColumn("grp", F.col("id") % 2), ["grp"]))
_SWN = [("one", "1996-01-01", "1996-06-30"), ("two", "1998-03-01", "1998-12-31")]
query("eval_stress_windows", "id window_name window_return:5 max_drawdown:5 n_bars#",
      " UNION ALL ".join(f"SELECT id, '{n}' AS window_name, exp(sum(ln(1 + strat_ret))) - 1 AS window_return, min(e / m - 1) AS max_drawdown, count(*) AS n_bars FROM (SELECT *, max(e) OVER {W} AS m FROM (SELECT *, exp(sum(ln(1 + strat_ret)) OVER {W}) AS e FROM st WHERE ts BETWEEN '{a}' AND '{b}')) GROUP BY id" for n, a, b in _SWN), NB + ", " + _SR)(
    lambda s, p: E.stress_windows(_strat(s, p), FR, _SWN, "strat_ret"))
_FO = "fo AS (SELECT *, CASE WHEN rn - 1 < (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1) ELSE n % 5 + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM (SELECT st.*, count(*) OVER (PARTITION BY id) AS n FROM st))"
query("eval_fold_metrics", "id fold# sharpe:5 total_return:5 n#", f"SELECT id, fold, {_sh('strat_ret', 365)} AS sharpe, exp(sum(ln(1 + strat_ret))) - 1 AS total_return, count(*) AS n FROM fo GROUP BY id, fold", NB + ", " + _SR + ", " + _FO)(
    lambda s, p: E.fold_metrics(E.with_folds(_strat(s, p), FR, 5), ["id"], "strat_ret"))
query("eval_fold_aggregate", "id mean:5 std:5 worst:5 n_folds#", f"SELECT id, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS worst, count(*) AS n_folds FROM (SELECT id, fold, {_sh('strat_ret', 365)} AS x FROM fo GROUP BY id, fold) GROUP BY id", NB + ", " + _SR + ", " + _FO)(
    lambda s, p: E.fold_aggregate(E.fold_metrics(E.with_folds(_strat(s, p), FR, 5), ["id"], "strat_ret"), ["id"]))
_PK = f"""pk AS (SELECT x.id, x.ts, x.fold, sp.fold AS test_fold, CASE WHEN x.fold = sp.fold THEN 'test' WHEN x.t1 > sp.s AND x.ts <= sp.e THEN 'purged' WHEN x.rn > sp.l AND x.rn <= sp.l + greatest(floor(sp.n * 0.02), 1) THEN 'embargo' ELSE 'train' END AS role,
  CASE WHEN x.fold = sp.fold THEN 'test' WHEN x.t1 > sp.s THEN 'purged' ELSE 'train' END AS old_role FROM (SELECT *, coalesce(lead(ts, 5) OVER {W}, max(ts) OVER (PARTITION BY id)) AS t1 FROM fo) x JOIN (SELECT id, fold, min(ts) AS s, max(t1) AS e, max(rn) AS l, max(n) AS n FROM (SELECT *, coalesce(lead(ts, 5) OVER {W}, max(ts) OVER (PARTITION BY id)) AS t1 FROM fo) GROUP BY id, fold) sp ON sp.id = x.id)"""
query("eval_purged_kfold", "id ts fold# test_fold# role", "SELECT * FROM pk", NB + ", " + _SR + ", " + _FO + ", " + _PK)(
    lambda s, p: E.purged_kfold(_nb(s, p).withColumn("t1", L.vertical_barrier(FR, 5)), FR, 5, 0.02))
query("eval_purged_kfold_strict", "id test_fold# role n#", "SELECT id, test_fold, old_role AS role, count(*) AS n FROM pk GROUP BY ALL", NB + ", " + _SR + ", " + _FO + ", " + _PK)(
    lambda s, p: E.purged_kfold(_nb(s, p).withColumn("t1", L.vertical_barrier(FR, 5)), FR, 5, 0.0, strict_before=True).groupBy("id", "test_fold", "role").agg(F.count("*").alias("n")))
query("eval_cpcv", "id combo# n# oos_sharpe:5",
      f"SELECT id, combo, count(*) AS n, avg(strat_ret) / stddev_samp(strat_ret) * sqrt(252) AS oos_sharpe FROM fo JOIN (SELECT row_number() OVER (ORDER BY a, b) - 1 AS combo, a, b FROM range(5) t(a), range(5) u(b) WHERE a < b) c ON fold IN (a, b) GROUP BY id, combo", NB + ", " + _SR + ", " + _FO)(
    lambda s, p: E.cpcv_sharpes(_strat(s, p), FR, "strat_ret", 5, 2))
query("eval_walk_forward", "id split# train_start! train_end! test_start! test_end!",
      "SELECT id, c AS split, make_date(a, 1, 1) AS train_start, make_date(c - 1, 12, 31) AS train_end, make_date(c, 1, 1) AS test_start, make_date(c, 12, 31) AS test_end FROM (SELECT id, a, unnest(range(a + 3, b + 1)) AS c FROM (SELECT id, min(year(ts)) AS a, max(year(ts)) AS b FROM bars GROUP BY id))", NB)(lambda s, p: E.walk_forward(_nb(s, p), ["id"], 3, 1))
query("eval_fixed_windows", "split id n#", "SELECT 'w_1' AS split, id, count(*) AS n FROM bars WHERE ts BETWEEN '1996-01-01' AND '1997-01-01' GROUP BY id UNION ALL SELECT 'w_2', id, count(*) FROM bars WHERE ts BETWEEN '1996-06-01' AND '1999-01-01' GROUP BY id", NB)(
    lambda s, p: E.fixed_windows(_nb(s, p), [("1996-01-01", "1997-01-01"), ("1996-06-01", "1999-01-01")], "w").groupBy("split", "id").agg(F.count("*").alias("n")))
_SWP = f"swp AS (SELECT id, c, avg(r) * sqrt(252) / (stddev_samp(r) + 1e-12) AS sharpe, exp(sum(ln(1 + r))) - 1 AS total_return, avg(ch) AS turnover FROM (SELECT id, c, g - ch * c * 1e-4 AS r, ch FROM (SELECT *, coalesce(abs(h - {lag('h')}), 0) AS ch FROM st) CROSS JOIN (SELECT unnest([5.0, 25.0]) AS c)) GROUP BY ALL)"
_swp = lambda s, p: E.sweep(_scaled(s, p), ["id"], E.cost_scenarios(s, [5.0, 20.0], [0.0]).withColumn("cost_bps", F.col("fee_bps") + F.when(F.col("fee_bps") > 10, 5.0).otherwise(0.0)))


def _scaled(s, p):
    """Positions on a synthetic price whose returns are 1/100 of the bar returns."""
    d = _pos(s, p).withColumn("_r", F.coalesce(FR.pct("close"), F.lit(0.0)) / 100)
    return d.withColumn("close", F.exp(F.sum(F.log1p("_r")).over(FR.cum))).drop("_r")


query("eval_cost_sweep", "id cost_bps:1 sharpe:5 total_return:5 turnover:5", "SELECT id, c AS cost_bps, sharpe, total_return, turnover FROM swp", NB + ", " + _SR + ", " + _SWP)(lambda s, p: _swp(s, p))
query("eval_cost_matrix", "id sharpe_5bps:5 sharpe_25bps:5", "SELECT id, max(sharpe) FILTER (c = 5) AS sharpe_5bps, max(sharpe) FILTER (c = 25) AS sharpe_25bps FROM swp GROUP BY id", NB + ", " + _SR + ", " + _SWP)(lambda s, p: E.cost_matrix(_swp(s, p), ["id"], [5.0, 25.0]))
query("eval_slippage", "id mean_slippage_bps:4 n#", "SELECT id, avg(abs(close - open) / open) * 1e4 AS mean_slippage_bps, count(*) AS n FROM bars GROUP BY id", NB)(
    lambda s, p: E.slippage_bps(_nb(s, p).select("id", "ts", F.col("close").alias("price")), _nb(s, p).select("id", "ts", F.col("open").alias("price")), ["id", "ts"], ["id"]))
query("eval_parity", "id matched# only_replay# only_backtest# max_price_diff_bps:4 pnl_corr:6",
      "SELECT coalesce(a.id, b.id) AS id, count(a.id) FILTER (b.id IS NOT NULL) AS matched, count(*) FILTER (b.id IS NULL) AS only_replay, count(*) FILTER (a.id IS NULL) AS only_backtest, max(abs(a.close / b.open - 1)) * 1e4 AS max_price_diff_bps, corr(a.volume, b.dollar) AS pnl_corr FROM (SELECT * FROM bars WHERE rn % 5 <> 0) a FULL JOIN (SELECT * FROM bars WHERE rn % 7 <> 0) b ON a.id = b.id AND a.ts = b.ts GROUP BY 1", NB)(
    lambda s, p: (lambda d: E.parity(d.filter("rn % 5 <> 0").select("id", "ts", F.col("close").alias("price"), F.col("volume").alias("pnl")), d.filter("rn % 7 <> 0").select("id", "ts", F.col("open").alias("price"), F.col("dollar").alias("pnl")), ["id", "ts"], ["id"]))(M.nation_bars(s, p).withColumn("rn", FR.rn())))
query("eval_attribution", "id step# pnl:2 delta:2 share:5", f"SELECT id, step, pnl, pnl - lag(pnl) OVER (PARTITION BY id ORDER BY step) AS delta, (pnl - lag(pnl) OVER (PARTITION BY id ORDER BY step)) / gap AS share FROM (SELECT *, arg_max(pnl, step) OVER (PARTITION BY id) - arg_min(pnl, step) OVER (PARTITION BY id) AS gap FROM (SELECT id, rn % 7 AS step, sum(close) / 1000 AS pnl FROM bars GROUP BY ALL))", NB)(
    lambda s, p: E.attribution(_nb(s, p).withColumn("step", FR.rn() % 7).groupBy("id", "step").agg((F.sum("close") / 1000).alias("pnl")), ["id"]))

# --- research --------------------------------------------------------------------------------------
_F = f"""fx AS (SELECT *, close / {lag('close')} - 1 AS mom, volume AS vol, lead(close) OVER {W} / close - 1 AS y1, lead(close, 5) OVER {W} / close - 1 AS y5 FROM bars)"""
_fx = lambda s, p: _nb(s, p).withColumns({"mom": FR.pct("close"), "vol": F.col("volume"), "y1": FR.forward_return("close"), "y5": FR.forward_return("close", 5)})


def _rk(x, by):
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def _ic_sql(src, by, x, y, need=20):
    ic = f"CASE WHEN count(*) >= {need} THEN covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) END"
    return f"SELECT {by}, {ic} AS ic, count(*) AS n_obs, {ic} * sqrt(count(*) - 2) / sqrt(greatest(1 - pow({ic}, 2), 1e-15)) AS t_stat FROM (SELECT {by}, {_rk(x, by)} AS rx, {_rk(y, by)} AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by}"


query("research_ic", "id ic:6 n_obs# t_stat:5", _ic_sql("fx", "id", "mom", "y1"), NB + ", " + _F)(lambda s, p: Q.spearman(_fx(s, p), ["id"], "mom", "y1"))
_ICT = " UNION ALL ".join(_ic_sql(f"(SELECT *, '{c}' AS feature, {h} AS horizon FROM fx WHERE ts BETWEEN '1995-06-01' AND '2000-12-31' AND ts + INTERVAL {h} DAY <= '2000-12-31')", "id, feature, horizon", c, f"y{h}") for c in ("mom", "vol") for h in (1, 5))
query("research_ic_table", "id feature horizon# ic:6 n_obs# t_stat:5", _ICT, NB + ", " + _F)(lambda s, p: Q.ic_table(_fx(s, p), FR, ["mom", "vol"], [1, 5], ("1995-06-01", "2000-12-31")))
query("research_ic_p_values", "id feature horizon# p_value:6", f"SELECT id, feature, horizon, 2 * ({phi('-abs(t_stat)')}) AS p_value FROM ({_ICT})", NB + ", " + _F)(
    lambda s, p: Q.ic_table(_fx(s, p), FR, ["mom", "vol"], [1, 5], ("1995-06-01", "2000-12-31")))
query("research_ic_by_regime", "id busy ic:6 n_obs#", _ic_sql("(SELECT *, volume > 1 AS busy FROM fx)", "id, busy", "mom", "y5"), NB + ", " + _F)(lambda s, p: Q.spearman_windows(_fx(s, p).withColumn("busy", F.col("volume") > 1), ["id", "busy"], "mom", "y5"))
_WR = lambda x: f"CASE WHEN count(s.{x}) = 30 AND t.{x} IS NOT NULL THEN count(CASE WHEN s.{x} < t.{x} THEN 1 END) + (count(CASE WHEN s.{x} = t.{x} THEN 1 END) + 1) / 2.0 END"
_RI = f"""wr AS (SELECT t.id, t.ts, {_WR('mom')} AS a, {_WR('y1')} AS b FROM fx t JOIN fx s ON s.id = t.id AND s.rn BETWEEN t.rn - 29 AND t.rn GROUP BY t.id, t.ts, t.mom, t.y1),
 ri AS (SELECT id, ts, CASE WHEN count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER q = 30 THEN covar_samp(a, b) OVER q / nullif(stddev_samp(CASE WHEN b IS NOT NULL THEN a END) OVER q * stddev_samp(CASE WHEN a IS NOT NULL THEN b END) OVER q, 0) END AS rolling_ic FROM wr WINDOW q AS (PARTITION BY id ORDER BY ts ROWS 29 PRECEDING))"""
query("research_rolling_ic", "id ts rolling_ic:5", "SELECT * FROM ri", NB + ", " + _F + ", " + _RI)(lambda s, p: Q.rolling_ic(_fx(s, p), FR, "mom", "y1", 30))
query("research_ic_ir", "id ic_mean:6 ic_ir:5 ic_ir_t:4 n_ic#", "SELECT id, avg(rolling_ic) AS ic_mean, avg(rolling_ic) / stddev_samp(rolling_ic) AS ic_ir, avg(rolling_ic) * sqrt(count(*)) / stddev_samp(rolling_ic) AS ic_ir_t, count(*) AS n_ic FROM ri WHERE rolling_ic IS NOT NULL GROUP BY id", NB + ", " + _F + ", " + _RI)(
    lambda s, p: Q.ic_ir(Q.rolling_ic(_fx(s, p), FR, "mom", "y1", 30), ["id"]))
_RSP = """rw AS (SELECT t.id, t.ts, s.mom AS a, s.y1 AS b FROM fx t JOIN fx s ON s.id = t.id AND s.rn BETWEEN t.rn - 29 AND t.rn WHERE s.mom IS NOT NULL AND s.y1 IS NOT NULL),
 rr AS (SELECT id, ts, count(*) AS n, covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0) AS c FROM (SELECT id, ts, rank() OVER (PARTITION BY id, ts ORDER BY a) + (count(*) OVER (PARTITION BY id, ts, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY id, ts ORDER BY b) + (count(*) OVER (PARTITION BY id, ts, b) - 1) / 2.0 AS rb FROM rw) GROUP BY id, ts)"""
query("research_rolling_spearman", "id ts rolling_spearman:6", "SELECT fx.id, fx.ts, CASE WHEN n = 30 THEN c END AS rolling_spearman FROM fx LEFT JOIN rr USING (id, ts)", NB + ", " + _F + ", " + _RSP)(lambda s, p: Q.rolling_spearman(_fx(s, p), FR, "mom", "y1", 30))
query("research_feature_turnover", "id turnover:6", f"SELECT id, 1 - ic AS turnover FROM ({_ic_sql(f'(SELECT *, {lag(chr(109) + chr(111) + chr(109))} AS pm FROM fx WHERE mom IS NOT NULL)', 'id', 'pm', 'mom', 2)})", NB + ", " + _F)(lambda s, p: Q.feature_turnover(_fx(s, p), FR, "mom"))
_QT = """qt AS (SELECT ts, avg(y1) FILTER (q = 1) AS q1, avg(y1) FILTER (q = 2) AS q2, avg(y1) FILTER (q = 3) AS q3, avg(y1) FILTER (q = 4) AS q4, avg(y1) FILTER (q = 5) AS q5 FROM (SELECT *, greatest(ceil(5.0 * (k - 1) / (n - 1)), 1) AS q FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mom, id) AS k, count(*) OVER (PARTITION BY ts) AS n FROM fx WHERE mom IS NOT NULL)) WHERE n >= 6 AND y1 IS NOT NULL GROUP BY ts HAVING count(DISTINCT q) = 5)"""
query("research_quintiles", "ts q1:6 q3:6 q5:6", "SELECT * FROM qt", NB + ", " + _F + ", " + _QT)(lambda s, p: Q.quintile_returns(_fx(s, p), FR, "mom", 1, 6))
query("research_quintile_monotonicity", "monotonicity:6",
      "SELECT corr(pos, r) AS monotonicity FROM (SELECT pos, rank() OVER (ORDER BY x) AS r FROM (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest([" + ", ".join(f"sum(ln(1 + q{i}))" for i in range(1, 6)) + "]) AS x FROM qt))", NB + ", " + _F + ", " + _QT)(
    lambda s, p: Q.monotonicity(Q.cumulative_quintiles(Q.quintile_returns(_fx(s, p), FR, "mom", 1, 6))))
_PV = f"pv AS (SELECT *, least(1.0, exp(-0.7 * abs(t_stat))) AS p_value FROM ({_ICT}))"
_pv = lambda s, p: Q.ic_table(_fx(s, p), FR, ["mom", "vol"], [1, 5], ("1995-06-01", "2000-12-31")).withColumn("p_value", F.least(F.lit(1.0), F.exp(-0.7 * F.abs("t_stat"))))
query("research_fdr", "id feature horizon# p_adj:6 significant", "SELECT *, p_adj <= 0.2 AS significant FROM (SELECT *, least(1.0, min(p_value * m / k) OVER (ORDER BY p_value DESC)) AS p_adj FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM pv WHERE p_value IS NOT NULL))", NB + ", " + _F + ", " + _PV)(lambda s, p: Q.fdr(_pv(s, p), alpha=0.2))
query("research_bh_gate", "feature pass_rate:6 n_tests# promoted", "SELECT feature, avg(CAST(pa <= 0.2 AS DOUBLE)) AS pass_rate, count(*) AS n_tests, avg(CAST(pa <= 0.2 AS DOUBLE)) >= 0.05 AS promoted FROM (SELECT *, min(p_value * m / k) OVER (PARTITION BY feature ORDER BY p_value DESC) AS pa FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY p_value) AS k, count(*) OVER (PARTITION BY feature) AS m FROM pv WHERE p_value IS NOT NULL)) GROUP BY feature", NB + ", " + _F + ", " + _PV)(
    lambda s, p: Q.bh_gate(_pv(s, p), ["feature"], 0.2, 0.05))
query("research_haircut_sharpe", "id haircut:6", None)(lambda s, p: _mt(s, p).withColumn("haircut", Q.haircut_sharpe("sharpe", F.lit(25), "n_trades")))
_PRK = lambda c: f"rank() OVER (PARTITION BY id ORDER BY {c}) + (count(*) OVER (PARTITION BY id, {c}) - 1) / 2.0"
_PERM = f"""pk AS MATERIALIZED (SELECT *, ('0x' || substr(md5(id || '/' || pos || '/11'), 1, 8))::BIGINT AS h FROM (SELECT id, {_PRK('mom')} AS rx, {_PRK('y1')} AS ry, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY ts) AS pos FROM fx WHERE mom IS NOT NULL AND y1 IS NOT NULL)),
 pb AS (SELECT *, h % CAST(ceil(n / 65536.0) AS BIGINT) AS blk FROM pk),
 ps AS MATERIALIZED (SELECT id, blk, rx, s, (k + (1 + s * m // 100) % m) % m AS j FROM (SELECT id, blk, rx, row_number() OVER (PARTITION BY id, blk ORDER BY h, pos) - 1 AS k, count(*) OVER (PARTITION BY id, blk) AS m FROM pb), range(0, 100) t(s)),
 pj AS MATERIALIZED (SELECT id, blk, ry, g, row_number() OVER (PARTITION BY id, blk, g ORDER BY (h % 2147483647) * f % 2147483647, h, pos) - 1 AS j FROM pb, (SELECT unnest([{', '.join(map(str, RS.multipliers(10_000)))}]) AS f, unnest(range(0, 100)) AS g)),
 pp AS (SELECT id, g * 100 + s AS b, sum(rx * ry) AS product FROM ps JOIN pj USING (id, blk, j) GROUP BY 1, 2),
 pw AS (SELECT id, count(*) AS n_obs, sum(rx * ry) AS p, stddev_pop(rx) AS sx, stddev_pop(ry) AS sy FROM pb GROUP BY 1),
 pc AS (SELECT id, n_obs, (p / n_obs - ((n_obs + 1) / 2.0) * ((n_obs + 1) / 2.0)) / nullif(sx * sy, 0) AS ic, (product / n_obs - ((n_obs + 1) / 2.0) * ((n_obs + 1) / 2.0)) / nullif(sx * sy, 0) AS c FROM pp JOIN pw USING (id))"""
query("research_permutation_ic", "id ic:6 n_obs# n_perms# perm_p:6", "SELECT id, ic, n_obs, 10000 AS n_perms, (count(*) FILTER (abs(c) >= abs(ic)) + 1) / 10001.0 AS perm_p FROM pc GROUP BY id, ic, n_obs", NB + ", " + _F + ", " + _PERM)(
    lambda s, p: Q.permutation_ic(_fx(s, p), ["id"], "mom", "y1"))
query("research_block_bootstrap_ic", "id ic_lo:6 ic_hi:6 n_boot#", None)(lambda s, p: Q.block_bootstrap_ic(_fx(s, p), ["id"], "mom", "y1"))
query("research_stability", "id sign_flips# ic_mean:6 ic_cv:5 n_windows# stable", None)(lambda s, p: Q.stability(_fx(s, p), FR, "mom", "y1"))
_SWI = " UNION ALL ".join(_ic_sql(f"(SELECT *, {n} AS length, close / {ro('avg', 'close', n)} AS x FROM fx)", "id, length", "x", "y1") for n in (5, 10, 20))
_swi = lambda s, p: Q.window_sweep(_fx(s, p), FR, "close", "y1", (5, 10, 20), lambda f, x, n: F.col(x) / f.mean(x, n))
query("research_param_sweep", "id length# ic:6 n_obs#", _SWI, NB + ", " + _F)(_swi)
query("research_best_of_sweep", "id length# ic:6", f"SELECT id, length, ic FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(ic) DESC, length) AS k FROM ({_SWI})) WHERE k = 1", NB + ", " + _F)(lambda s, p: Q.best_of_sweep(_swi(s, p), ["id"]))
query("research_plateau", "id best_length# best_score:6 plateau:4 n_neighbours#",
      f"SELECT b.id, b.length AS best_length, b.ic AS best_score, avg(CAST(sign(s.ic) = sign(b.ic) AND abs(s.ic) >= 0.5 * abs(b.ic) AS DOUBLE)) AS plateau, count(*) AS n_neighbours FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(ic) DESC, length) AS k FROM sw) b JOIN sw s ON s.id = b.id AND s.length <> b.length AND abs(s.length - b.length) / 15.0 <= 0.7 WHERE k = 1 GROUP BY ALL", NB + ", " + _F + f", sw AS ({_SWI})")(
    lambda s, p: Q.plateau(_swi(s, p), ["length"], "ic", ["id"], 0.7, 0.5))
query("research_feature_tier", "id tier",
      "SELECT id, CASE WHEN ir IS NULL THEN 'archive' WHEN ir >= need AND hr >= 0.3 THEN 'active' WHEN ir >= need OR (ir >= 0.5 * need AND hr >= 0.3) THEN 'conditional' WHEN ir >= 0.1 THEN 'watch' ELSE 'archive' END AS tier FROM (SELECT id, abs(avg(rolling_ic) / stddev_samp(rolling_ic)) AS ir, CASE WHEN id % 2 = 0 THEN 0.3 ELSE 0.45 END AS need, CASE WHEN id % 3 = 0 THEN 0.2 ELSE 0.5 END AS hr FROM ri WHERE rolling_ic IS NOT NULL GROUP BY id)", NB + ", " + _F + ", " + _RI)(
    lambda s, p: Q.ic_ir(Q.rolling_ic(_fx(s, p), FR, "mom", "y1", 30), ["id"]).withColumn("tier", Q.feature_tier("ic_ir", F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.5), F.col("id") % 2 == 0, F.lit(None).cast("double"), 0.3)))
_CM = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) / (stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END)) AS corr FROM fx" for a in ("mom", "vol", "close") for b in ("mom", "vol", "close"))
query("research_corr_matrix", "a b corr:6", _CM, NB + ", " + _F)(lambda s, p: Q.corr_matrix(_fx(s, p), ["mom", "vol", "close"]))
query("research_redundant", "a b corr:6", f"SELECT * FROM ({_CM}) WHERE a < b AND abs(corr) >= 0.002", NB + ", " + _F)(lambda s, p: Q.redundant(Q.corr_matrix(_fx(s, p), ["mom", "vol", "close"]), 0.002))
query("research_target_ranking", "id feature corr:6 place#", "SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(corr) DESC, feature) AS place FROM (SELECT id, 'mom' AS feature, corr(mom, y1) AS corr FROM fx GROUP BY id UNION ALL SELECT id, 'vol', corr(vol, y1) FROM fx GROUP BY id)", NB + ", " + _F)(lambda s, p: Q.target_ranking(_fx(s, p), ["mom", "vol"], "y1", ["id"]))
_SIX = ("close", "high", "low", "mom", "open", "vol")
_CM6 = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM fx" for a in _SIX for b in _SIX if a != b)
query("research_feature_clusters", "feature cluster",
      f"""WITH RECURSIVE ed AS MATERIALIZED (SELECT a, b FROM ({_CM6}) WHERE abs(corr) >= 0.3), reach AS (SELECT unnest({list(_SIX)}) AS f, unnest({list(_SIX)}) AS g UNION SELECT reach.f, ed.b FROM reach JOIN ed ON ed.a = reach.g)
       SELECT f AS feature, min(g) AS cluster FROM reach GROUP BY f""", NB + ", " + _F)(
    lambda s, p: (lambda m: Q.connected_features(m, m.select(F.col("a").alias("feature")).distinct(), 0.3))(Q.corr_matrix(_fx(s, p), list(_SIX))))
_IS = _ic_sql("(SELECT *, 'mom' AS feature FROM fx)", "id, feature", "mom", "y1")
query("research_ic_staleness", "id feature ic_long:6 ic_recent:6 weight_factor:2",
      f"SELECT a.id, a.feature, a.ic AS ic_long, b.ic AS ic_recent, CASE WHEN sign(b.ic) <> sign(a.ic) OR abs(b.ic) < 0.5 * abs(a.ic) THEN 0.5 ELSE 1.0 END AS weight_factor FROM ({_IS}) a LEFT JOIN ({_IS.replace('FROM fx)', 'FROM (SELECT * FROM (SELECT *, max(rn) OVER (PARTITION BY id) - rn AS back FROM fx) WHERE back < 100))')}) b USING (id, feature)", NB + ", " + _F)(
    lambda s, p: Q.ic_staleness(_fx(s, p), FR, ["mom"], "y1", 100))
query("research_concordance", "concordance:6 n_obs#", f"SELECT corr(ra, rb) AS concordance, count(*) AS n_obs FROM (SELECT {_rk('a', 'g')} AS ra, {_rk('b', 'g')} AS rb FROM (SELECT 1 AS g, id, avg(close) AS a, stddev_samp(close) AS b FROM bars GROUP BY id))", NB)(
    lambda s, p: Q.concordance(_nb(s, p).groupBy("id").agg(F.avg("close").alias("x")), _nb(s, p).groupBy("id").agg(F.stddev_samp("close").alias("y")), "id", "x", "y"))
query("research_lead_lag_ic", "leader follower horizon# ic:6 n_obs#", _ic_sql("(SELECT a.id AS leader, b.id AS follower, h AS horizon, a.mom AS x, CASE h WHEN 1 THEN b.y1 ELSE b.y5 END AS y FROM fx a JOIN fx b ON a.ts = b.ts AND a.id <> b.id CROSS JOIN (SELECT unnest([1, 5]) AS h))", "leader, follower, horizon", "x", "y"), NB + ", " + _F)(
    lambda s, p: Q.lead_lag_ic(_fx(s, p), FR, "mom", (1, 5)))
query("research_coverage", "id expected# present# coverage:6", "SELECT id, count(*) AS expected, count(*) FILTER (rn % 9 <> 0) AS present, count(*) FILTER (rn % 9 <> 0) / count(*) AS coverage FROM bars GROUP BY id", NB)(
    lambda s, p: Q.coverage(_nb(s, p), _nb(s, p).withColumn("rn", FR.rn()).filter("rn % 9 <> 0"), ["id", "ts"], ["id"]))
query("research_ndcg", "ts ndcg:6",
      "SELECT ts, sum(CASE WHEN r <= 3 THEN g / log2(r + 1) END) / nullif(sum(CASE WHEN i <= 3 THEN g / log2(i + 1) END), 0) AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, id) AS r, row_number() OVER (PARTITION BY ts ORDER BY g DESC, id) AS i FROM (SELECT *, y1 - min(y1) OVER (PARTITION BY ts) AS g FROM fx WHERE mom IS NOT NULL AND y1 IS NOT NULL)) GROUP BY ts", NB + ", " + _F)(
    lambda s, p: Q.ndcg(_fx(s, p), ["ts"], "mom", "y1", 3))
_RUNS = list(range(25))  # all nations
query("research_compare_experiments", "metric " + " ".join(f"{i}:4" for i in _RUNS), " UNION ALL ".join(f"SELECT '{m}' AS metric, " + ", ".join(f'avg({m}) FILTER (id = {i}) AS "{i}"' for i in _RUNS) + " FROM bars" for m in ("close", "volume")), NB)(
    lambda s, p: Q.compare_experiments(_nb(s, p).groupBy("id").agg(F.avg("close").alias("close"), F.avg("volume").alias("volume")).select("id", F.explode(F.array(F.struct(F.lit("close").alias("metric"), F.col("close").alias("value")), F.struct(F.lit("volume").alias("metric"), F.col("volume").alias("value")))).alias("_i")).select("id", "_i.*"), "id", "metric", "value", _RUNS))
query("research_threshold_impact", "threshold:2 n_kept# hit_rate:6 mean_ret:6", " UNION ALL ".join(f"SELECT {t} AS threshold, count(*) AS n_kept, avg(CAST(y1 > 0 AS DOUBLE)) AS hit_rate, avg(y1) AS mean_ret FROM fx WHERE close / 500000 >= {t}" for t in (0.2, 0.5)), NB + ", " + _F)(
    lambda s, p: Q.threshold_impact(_fx(s, p).withColumn("pr", F.col("close") / 500000), "pr", "y1", (0.2, 0.5)))

# --- microstructure --------------------------------------------------------------------------------
_FW = K.ffd_weights(0.4)
query("micro_frac_diff", "id ts ffd:5", "SELECT id, ts, " + " + ".join(f"{w!r} * {lag('ln(close)', k) if k else 'ln(close)'}" for k, w in enumerate(_FW)) + " AS ffd FROM bars", NB)(
    lambda s, p: _nb(s, p).withColumn("lc", F.log("close")).withColumn("ffd", K.frac_diff(FR, "lc")))
query("micro_amihud", "id ts amihud:12", f"SELECT id, ts, CASE WHEN rn > 20 THEN avg(q) OVER (PARTITION BY id ORDER BY ts ROWS 19 PRECEDING) END AS amihud FROM (SELECT *, abs(close / {lag('close')} - 1) / nullif(abs(close * volume), 0) AS q FROM bars)", NB)(lambda s, p: K.amihud(_nb(s, p), FR))
_IMP = "CASE WHEN rn > 20 THEN regr_slope(dp, {x}) OVER (PARTITION BY id ORDER BY ts ROWS 19 PRECEDING) END"
query("micro_impact_slopes", "id ts kyle:2 hasbrouck:4", f"SELECT id, ts, {_IMP.format(x='sign(dp) * volume')} AS kyle, {_IMP.format(x='sign(dp) * sqrt(abs(close * volume))')} AS hasbrouck FROM (SELECT *, close - {lag('close')} AS dp FROM bars)", NB)(lambda s, p: K.impact_slopes(_nb(s, p), FR))
query("micro_rolling_adf", "id ts rolling_adf:5", None)(lambda s, p: K.rolling_adf(_nb(s, p), FR))
query("micro_rolling_entropy", "id ts entropy:6 complexity:6", None)(lambda s, p: K.rolling_entropy(_nb(s, p).withColumn("r", FR.log_return("close")), FR, "r"))
query("micro_stationarity", "id adf_t:5 kpss:5 n# verdict", None)(lambda s, p: K.stationarity(_nb(s, p).withColumn("lc", F.log("close")), ["id"], "lc"))
query("micro_minimal_order", "id min_d:4 passed", None)(lambda s, p: K.minimal_order(_nb(s, p), ["id"], "close"))
_QB = lambda c: f"(SELECT id, ts, least(len(list_filter(ed[2:], lambda e: e < {c})), len(ed) - 2) AS {c}_bin FROM bars JOIN (SELECT id, list_sort(list_distinct(quantile_cont({c}, [" + ", ".join(str(i / 5) for i in range(6)) + "]))) AS ed FROM bars GROUP BY id) USING (id))"
_MI = f"jc AS (SELECT id, close_bin AS a, volume_bin AS b, count(*) AS n FROM {_QB('close')} JOIN {_QB('volume')} USING (id, ts) GROUP BY ALL), mi AS (SELECT id, sum(n) AS t, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hab FROM jc GROUP BY id), ha AS (SELECT id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT id, a, sum(n) AS n FROM jc GROUP BY ALL) GROUP BY id), hb AS (SELECT id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT id, b, sum(n) AS n FROM jc GROUP BY ALL) GROUP BY id)"
query("micro_mutual_information", "id mi:6 vi:6 h_a:6 h_b:6 n#", "SELECT id, ha.h + hb.h - hab AS mi, 2 * hab - ha.h - hb.h AS vi, ha.h AS h_a, hb.h AS h_b, t AS n FROM mi JOIN ha USING (id) JOIN hb USING (id)", NB + ", " + _MI)(
    lambda s, p: K.mutual_information(K.quantile_bins(K.quantile_bins(_nb(s, p), ["id"], "close", 5), ["id"], "volume", 5), ["id"], "close_bin", "volume_bin"))
query("micro_shannon_entropy", "id entropy:6 n#", "SELECT id, ha.h AS entropy, t AS n FROM mi JOIN ha USING (id)", NB + ", " + _MI)(lambda s, p: K.entropy_of(K.quantile_bins(_nb(s, p), ["id"], "close", 5), ["id"], "close_bin"))
_CBIN = lambda c: f"greatest(least(len(list_filter(e{c}[2:], lambda v: v < {c})), len(e{c}) - 2), 0)"
_COD = f"""rr AS (SELECT id, ts, ln(close / {lag('close')}) AS r FROM bars), pr AS MATERIALIZED (SELECT x.id AS id_a, y.id AS id_b, ts, x.r AS a, y.r AS b FROM rr x JOIN rr y USING (ts) WHERE x.id < y.id AND x.r IS NOT NULL AND y.r IS NOT NULL),
 ds AS (SELECT p.id_a, p.id_b, p.ts, count(*) AS n, sum(abs(p.a - q.a)) AS ra, sum(abs(p.b - q.b)) AS rb, sum(abs(p.a - q.a) * abs(p.b - q.b)) AS ab, sum((p.a - q.a) ** 2) AS aa, sum((p.b - q.b) ** 2) AS bb FROM pr p JOIN pr q ON p.id_a = q.id_a AND p.id_b = q.id_b GROUP BY 1, 2, 3),
 dv AS (SELECT id_a, id_b, sum(ab) / n ** 2 + sum(ra) * sum(rb) / n ** 4 - 2 * sum(ra * rb) / n ** 3 AS xy, sum(aa) / n ** 2 + sum(ra) ** 2 / n ** 4 - 2 * sum(ra * ra) / n ** 3 AS xx, sum(bb) / n ** 2 + sum(rb) ** 2 / n ** 4 - 2 * sum(rb * rb) / n ** 3 AS yy FROM ds GROUP BY id_a, id_b, n),
 ed AS (SELECT id_a, id_b, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS pearson, list_sort(list_distinct(quantile_cont(a, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS ea, list_sort(list_distinct(quantile_cont(b, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS eb FROM pr GROUP BY 1, 2),
 jc AS (SELECT id_a, id_b, {_CBIN('a')} AS a, {_CBIN('b')} AS b, count(*) AS n FROM pr JOIN ed USING (id_a, id_b) GROUP BY ALL),
 h0 AS (SELECT id_a, id_b, sum(n) AS n, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hab FROM jc GROUP BY 1, 2),
 h1 AS (SELECT id_a, id_b, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS ha FROM (SELECT id_a, id_b, a, sum(n) AS n FROM jc GROUP BY ALL) GROUP BY 1, 2), h2 AS (SELECT id_a, id_b, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hb FROM (SELECT id_a, id_b, b, sum(n) AS n FROM jc GROUP BY ALL) GROUP BY 1, 2)"""
query("micro_codependence", "id_a id_b pearson:6 dcor:6 mi:6 vi:6 n#",
      "SELECT id_a, id_b, pearson, coalesce(sqrt(greatest(xy, 0) / nullif(sqrt(greatest(xx, 0) * greatest(yy, 0)), 0)), 0) AS dcor, ha + hb - hab AS mi, 2 * hab - ha - hb AS vi, n FROM ed JOIN dv USING (id_a, id_b) JOIN h0 USING (id_a, id_b) JOIN h1 USING (id_a, id_b) JOIN h2 USING (id_a, id_b)", NB + ", " + _COD)(lambda s, p: K.codependence(S.paired(_nb(s, p).withColumn("r", FR.log_return("close")), "r"), 5))
query("micro_table", "id ts ffd_close:5 amihud:12 kyle:2 rolling_adf:4 entropy:5", None)(lambda s, p: K.micro_table(_nb(s, p), FR))

# --- expressions -----------------------------------------------------------------------------------
ex = lambda name, spec, text, sql, ctes="": query(name, "id ts " + spec, sql, NB + (", " + ctes if ctes else ""))(lambda s, p: evaluate(text, _nb(s, p), FR))
ex("expr_mean_ref", "factor:6", "Mean($close, 5) / Ref($close, 1) - 1", f"SELECT id, ts, {ro('avg', 'close', 5, 1)} / {lag('close')} - 1 AS factor FROM bars")
ex("expr_delta_std", "factor:5", "Delta($close, 3) / Std($close, 10)", f"SELECT id, ts, (close - {lag('close', 3)}) / {ro('stddev_samp', 'close', 10, 1)} AS factor FROM bars")
ex("expr_max_min", "factor:6", "($close - Min($low, 14)) / (Max($high, 14) - Min($low, 14) + 1)", f"SELECT id, ts, (close - {ro('min', 'low', 14, 1)}) / ({ro('max', 'high', 14, 1)} - {ro('min', 'low', 14, 1)} + 1) AS factor FROM bars")
ex("expr_ema", "factor:6", "EMA($close, 10) / $close - 1", "SELECT b.id, b.ts, e / close - 1 AS factor FROM bars b JOIN x USING (id, ts)", ema_cte("x", "bars", "close", {"e": span(10)}))
ex("expr_wma", "factor:4", "WMA($close, 6)", f"SELECT t.id, t.ts, sum(s.close * (s.rn - greatest(t.rn - 6, 0))) / sum(s.rn - greatest(t.rn - 6, 0)) AS factor FROM bars t JOIN bars s ON s.id = t.id AND s.rn BETWEEN t.rn - 5 AND t.rn GROUP BY t.id, t.ts")
ex("expr_corr_slope", "factor:6", "Corr($close, $volume, 20) + Slope($close, 8) / 100000", f"SELECT id, ts, CASE WHEN rn >= 20 THEN covar_samp(close, volume) OVER q / nullif(stddev_samp(close) OVER q * stddev_samp(volume) OVER q, 0) END + {ro('regr_slope({x}, rn)', 'close', 8, 2)} / 100000 AS factor FROM bars WINDOW q AS (PARTITION BY id ORDER BY ts ROWS 19 PRECEDING)")
ex("expr_skew_kurt", "factor:5", "Skew($close, 20) - Kurt($close, 20)", f"SELECT id, ts, {ro('skewness', 'close', 20)} - {ro('kurtosis', 'close', 20)} AS factor FROM bars")
ex("expr_abs_sign_log", "factor:6", "Abs($close - $open) * Sign($close - $open) + Log($volume)", "SELECT id, ts, abs(close - open) * sign(close - open) + ln(greatest(volume, 1e-10)) AS factor FROM bars")
ex("expr_rank_ts", "factor:6", "Rank($close)", f"SELECT id, ts, ({_rk('close', 'id')}) / count(*) OVER (PARTITION BY id) AS factor FROM bars")
ex("expr_rank_cs", "factor:6", "RankCs(Mean($close, 3))", f"SELECT id, ts, ({_rk('m', 'ts')}) / count(*) OVER (PARTITION BY ts) AS factor FROM (SELECT *, round({ro('avg', 'close', 3, 1)}, 6) AS m FROM bars)")
