"""Evaluation of position and return tables: performance, splits, gates, rankings, bootstraps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, col, div
from tideline.functions.numeric import norm_cdf, norm_ppf, norm_ppf_value

EPS = 1e-12


# --- returns of positions --------------------------------------------------------------------------
def position_returns(df: DataFrame, f: Frame, position: str = "position", close: str = "close", costs_bps: float = 0.0, out: str = "strat_ret") -> DataFrame:
    """Previous position times the bar return, less one-way costs on position changes."""
    held = F.coalesce(f.lag(F.coalesce(F.col(position), F.lit(0))), F.lit(0)).cast("double")
    df = df.withColumns({"_held": held, "_r": F.coalesce(f.pct(close), F.lit(0.0))})
    cost = F.abs(F.coalesce(f.diff("_held"), F.lit(0.0))) * (costs_bps * 1e-4)
    return df.withColumn(out, F.col("_held") * F.col("_r") - cost).drop("_held", "_r")


def log_growth(ret: Col) -> Column:
    """ln(1 + r) as IEEE numbers: -inf for a loss of everything, NaN for a greater one, NULL for no return."""
    r = col(ret).cast("double")
    return F.when(r > -1, F.log1p(r)).when(r == -1, F.lit(float("-inf"))).when(r < -1, F.lit(float("nan")))


def ratio(a: Col, b: Col) -> Column:
    """a / b as IEEE numbers for b of zero or more: 0 / 0 is NaN, other numbers over zero are infinite."""
    a, b = col(a).cast("double"), col(b).cast("double")
    over_zero = F.when(a.isNull(), F.lit(None)).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, over_zero).otherwise(div(a, b))


def equity(f: Frame, ret: Col, start: float = 1.0) -> Column:
    """start x running product of (1 + r) by logs: zero after a loss of everything, NaN after a greater one."""
    return F.exp(F.sum(log_growth(F.coalesce(col(ret), F.lit(0.0)))).over(f.cum)) * start


def with_equity(df: DataFrame, f: Frame, ret: str) -> DataFrame:
    """Equity, its peak and drawdown columns."""
    df = df.withColumn("equity", equity(f, ret))
    df = df.withColumn("peak", F.max("equity").over(f.cum))
    return df.withColumn("drawdown", div("equity", "peak") - 1)


def growth(ret: Col) -> Column:
    """Product of (1 + r) over a group by logs: zero with a loss of everything, NaN with a greater one."""
    return F.exp(F.sum(log_growth(ret)))


def annual_return(ret: Col, periods: float = 252.0) -> Column:
    return F.pow(growth(ret), periods / F.nullif(F.count(col(ret)), F.lit(0))) - 1


def cagr(equity_first: Col, equity_last: Col, rows: Col, periods: float = 252.0) -> Column:
    """Compound annual growth between two equity values ``rows`` bars apart."""
    return F.pow(div(equity_last, equity_first), F.lit(periods) / F.nullif(col(rows), F.lit(0))) - 1


def sharpe(ret: Col, periods: float = 252.0, rf: float = 0.0) -> Column:
    return (F.avg(col(ret)) - rf) * math.sqrt(periods) / (F.stddev_samp(col(ret)) + EPS)


def sortino(ret: Col, periods: float = 252.0, rf: float = 0.0) -> Column:
    down = F.when(col(ret) - rf < 0, col(ret) - rf)
    return (F.avg(col(ret)) - rf) * math.sqrt(periods) / (F.stddev_samp(down) + EPS)


def hit_rate(ret: Col) -> Column:
    return F.avg((col(ret) > 0).cast("double"))


def evaluate(df: DataFrame, f: Frame, position: str = "position", close: str = "close", costs_bps: float = 0.0, periods: float = 252.0) -> DataFrame:
    """All metrics of a position table per key in one aggregation."""
    df = with_equity(position_returns(df, f, position, close, costs_bps), f, "strat_ret")
    df = df.withColumn("_dp", F.abs(f.diff(F.coalesce(F.col(position), F.lit(0)))))
    return metrics(df, f.keys, "strat_ret", periods, F.avg("_dp").alias("turnover"))


def metrics(df: DataFrame, keys: Sequence[str], ret: str, periods: float = 252.0, *extra: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(
        annual_return(ret, periods).alias("ann_return"), sharpe(ret, periods).alias("sharpe"), sortino(ret, periods).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), hit_rate(ret).alias("hit_rate"), F.count(F.lit(1)).alias("n_bars"), *extra)
    return g.withColumn("calmar", F.col("ann_return") / (F.abs("max_drawdown") + EPS)).withColumn("mar", div("ann_return", F.abs("max_drawdown")))


def by_regime(df: DataFrame, f: Frame, regime: str, **kw) -> DataFrame:
    """Metrics per regime; positions and returns are computed on the whole history first."""
    d = position_returns(df, f, **kw)
    return d.groupBy(*f.keys, regime).agg(sharpe("strat_ret").alias("sharpe"), F.avg("strat_ret").alias("mean_ret"), hit_rate("strat_ret").alias("hit_rate"), F.count(F.lit(1)).alias("n_bars"))


def funding_adjusted_equity(df: DataFrame, f: Frame, equity_col: str = "equity", payment: str = "payment") -> DataFrame:
    return df.withColumn("cum_funding", F.sum(F.coalesce(payment, F.lit(0.0))).over(f.cum)).withColumn("adj_equity", F.col(equity_col) + F.col("cum_funding"))


# --- probabilistic Sharpe --------------------------------------------------------------------------
def _moments(keys: Sequence[str], ret: str, df: DataFrame) -> DataFrame:
    r = F.col(ret)
    g = df.filter(r.isNotNull()).groupBy(*keys).agg(
        F.count(r).cast("double").alias("n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3.0).alias("kurt"))
    return g.withColumn("sr", div("_m", "_s"))


def _psr(sr_star: Column) -> Column:
    sr, g3, g4 = F.col("sr"), F.col("skew"), F.col("kurt")
    var = (1.0 - g3 * sr + (g4 - 1.0) / 4.0 * sr * sr) / (F.col("n") - 1)
    z = F.when(var > 0, (sr - sr_star) / F.sqrt(var))
    flat = F.when(sr_star == 0, 0.5).when(sr_star > 0, 0.0).otherwise(1.0)
    return F.when(F.col("n") < 30, F.lit(None).cast("double")).when(F.col("_s") == 0, flat).otherwise(norm_cdf(z))


def psr(df: DataFrame, keys: Sequence[str], ret: str, sr_star: float = 0.0) -> DataFrame:
    """Probability that the true Sharpe exceeds ``sr_star``; NULL under 30 observations."""
    return _moments(keys, ret, df).withColumn("psr", _psr(F.lit(sr_star))).select(*keys, "n", "sr", "skew", "kurt", "psr")


EULER_GAMMA = 0.5772156649015329


def expected_max_sharpe(estimates: DataFrame, by: Sequence[str], sr: str = "sr", mean: float = 0.0) -> DataFrame:
    """Expected best of N Sharpe estimates."""
    g = estimates.filter(F.col(sr).isNotNull()).groupBy(*by).agg(F.count(sr).cast("double").alias("n_trials"), F.stddev_samp(sr).alias("_s"), F.avg(sr).alias("_m"))
    e = F.lit(1 - EULER_GAMMA) * norm_ppf(1 - 1 / F.col("n_trials")) + EULER_GAMMA * norm_ppf(1 - 1 / (F.col("n_trials") * math.e))
    value = F.when((F.col("n_trials") == 1) | (F.col("_s") == 0), F.col("_m")).otherwise(mean + F.col("_s") * e)
    return g.withColumn("sr_max", value).drop("_s", "_m")


def deflated(df: DataFrame, group: Sequence[str], trial: str, ret: str) -> DataFrame:
    """Deflated Sharpe of the best trial of each group against the expected best of all its trials."""
    m = _moments([*group, trial], ret, df)
    bench = expected_max_sharpe(m, group) if group else expected_max_sharpe(m.withColumn("_g", F.lit(1)), ["_g"]).drop("_g")
    best = m.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("sr"), trial))).filter("_r = 1")
    j = best.join(F.broadcast(bench), list(group)) if group else best.crossJoin(F.broadcast(bench))
    return j.withColumn("dsr", _psr(F.col("sr_max"))).select(*group, trial, "sr", "sr_max", "n_trials", "dsr")


def min_track_record(df: DataFrame, keys: Sequence[str], ret: str, sr_star: float = 0.0, target: float = 0.95, per_year: int = 365) -> DataFrame:
    m = _moments(keys, ret, df)
    sr = F.coalesce(F.col("sr"), F.lit(0.0))
    v = 1.0 - F.col("skew") * sr + (F.col("kurt") - 1.0) / 4.0 * sr * sr
    v = F.when(v > 0, v).otherwise(1.0 + sr * sr / 2)
    n = F.when(sr > sr_star, F.pow(norm_ppf_value(target) * F.sqrt(v) / (sr - sr_star), F.lit(2.0)) + 1.0)
    return m.withColumn("min_obs", n).withColumn("min_days", F.round(F.ceil("min_obs") / per_year * 365)).select(*keys, "sr", "min_obs", "min_days")


# --- trades ----------------------------------------------------------------------------------------
def excursions(trades: DataFrame, closes: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Largest adverse and favourable move of each trade between entry and exit (bucketed interval join)."""
    from tideline.operators.asof import interval_join

    path = interval_join(closes.select(*by, "ts", "close"), trades, by, "ts", "entry_ts", "exit_ts", "month")
    g = path.groupBy(*by, "trade_id").agg(F.min("close").alias("_lo"), F.max("close").alias("_hi"))
    j = trades.join(g, [*by, "trade_id"], "left")
    lo, hi = div("_lo", "entry_price") - 1, div("_hi", "entry_price") - 1
    short = F.col("side") == "short"
    return j.withColumns({"mae": F.when(short, -hi).otherwise(lo), "mfe": F.when(short, -lo).otherwise(hi)}).drop("_lo", "_hi")


def calibrated_stops(ex: DataFrame, by: Sequence[str], min_trades: int = 10) -> DataFrame:
    g = ex.groupBy(*by).agg(
        F.percentile(F.abs("mae"), [0.25, 0.5, 0.75]).alias("_a"), F.percentile("mfe", [0.5, 0.75]).alias("_f"), F.count(F.lit(1)).alias("n_trades"))
    return g.filter(F.col("n_trades") >= min_trades).select(
        *by, "n_trades", *[F.col("_a")[i].alias(f"stop_p{p}") for i, p in enumerate((25, 50, 75))], *[F.col("_f")[i].alias(f"target_p{p}") for i, p in enumerate((50, 75))])


def stop_exits(entries: DataFrame, bars: DataFrame, f: Frame, levels: Sequence[float], kind: str = "hard", horizon: int = 50, fee_bps: float = 0.0) -> DataFrame:
    """Exit of each entry per stop level: first close through the level, else the close ``horizon`` rows on.

    ``hard`` measures from the entry price, ``trailing`` from the running maximum since entry. The
    forward path is a bounded window list, so levels are compared without copying bars.
    """
    marked = bars.withColumn("_path", F.collect_list("close").over(f.next_rows(horizon)))
    e = entries.join(marked.select(*f.keys, *f.order, "_path", F.col("close").alias("entry_price")), [*f.keys, *f.order])
    e = e.withColumn("stop_pct", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    start = F.struct(F.col("entry_price").alias("peak"), F.lit(None).cast("double").alias("px"), F.lit(0).alias("n"), F.col("entry_price").alias("last"))

    def step(acc: Column, p: Column) -> Column:
        base = F.col("entry_price") if kind == "hard" else acc["peak"]
        hit = acc["px"].isNull() & (p <= base * (1 - F.col("stop_pct")))
        return F.struct(F.greatest(acc["peak"], p).alias("peak"), F.when(hit, p).otherwise(acc["px"]).alias("px"),
                        (acc["n"] + F.when(acc["px"].isNull(), 1).otherwise(0)).alias("n"), p.alias("last"))

    e = e.withColumn("_x", F.aggregate("_path", start, step))
    e = e.withColumns({"exit_price": F.coalesce("_x.px", "_x.last"), "bars_held": F.col("_x.n"), "stopped": F.col("_x.px").isNotNull()})
    return e.withColumn("ret", div("exit_price", "entry_price") - 1 - 2 * fee_bps * 1e-4).drop("_path", "_x")


def time_exits(entries: DataFrame, bars: DataFrame, f: Frame, n: int, fee_bps: float = 0.0) -> DataFrame:
    ahead = bars.select(*f.keys, *f.order, F.col("close").alias("entry_price"), f.lead("close", n).alias("exit_price"))
    return entries.join(ahead, [*f.keys, *f.order]).withColumn("ret", div("exit_price", "entry_price") - 1 - 2 * fee_bps * 1e-4)


def stop_summary(exits: DataFrame, by: Sequence[str]) -> DataFrame:
    return exits.groupBy(*by).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean_ret"), sharpe("ret", 1.0).alias("score"), F.avg(F.col("stopped").cast("double")).alias("stop_rate"))


def best_stop(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return summary.groupBy(*by).agg(F.max_by(F.struct("stop_pct", "score", "n"), F.struct("score", -F.col("stop_pct"))).alias("_b")).select(*by, "_b.*")


def recovery_time(df: DataFrame, f: Frame, ret: str) -> DataFrame:
    """Mean rows from the trough to the recovery of each finished drawdown."""
    d = with_equity(df, f, ret).withColumn("_rn", f.rn())
    d = d.withColumn("_ep", F.sum((F.col("drawdown") >= 0).cast("int")).over(f.cum))
    n = Window.partitionBy(*f.keys)
    d = d.withColumn("_lastep", F.max("_ep").over(n)).filter((F.col("drawdown") < 0) & (F.col("_ep") < F.col("_lastep")))
    e = d.groupBy(*f.keys, "_ep").agg(F.min_by("_rn", F.struct("drawdown", "_rn")).alias("_t"), F.max("_rn").alias("_e"))
    return e.groupBy(*f.keys).agg(F.avg(F.col("_e") + 1 - F.col("_t")).alias("mean_recovery_bars"), F.count(F.lit(1)).alias("n_drawdowns"))


def bar_returns_of_trades(bars: DataFrame, trades: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Bar returns while a trade is open (after its entry, up to its exit), zero elsewhere."""
    from tideline.operators.asof import interval_join

    f = Frame(by)
    b = bars.withColumn("_r", f.pct("close"))
    hit = interval_join(b.select(*by, "ts"), trades.select(*by, "entry_ts", "exit_ts"), by, "ts", "entry_ts", "exit_ts", "month").filter("ts > entry_ts").select(*by, "ts").distinct()
    return b.join(hit.withColumn("_in", F.lit(1)), [*by, "ts"], "left").withColumn("ret", F.when(F.col("_in") == 1, F.coalesce("_r", F.lit(0.0))).otherwise(0.0)).drop("_r", "_in")


def daily_trade_returns(trades: DataFrame, by: Sequence[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Sum of trade pnl on the exit day over a full calendar, zero filled. The calendar is that of all exits unless it is given."""
    day = F.col("exit_ts").cast("date")
    d = trades.groupBy(*by, day.alias("day")).agg(F.sum("pnl").alias("pnl"))
    span = trades.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))  # one row
    low, high = (F.col("_a") if start is None else start), (F.col("_b") if end is None else end)
    grid = trades.select(*by).distinct().crossJoin(F.broadcast(span)).withColumn("day", F.explode(F.sequence(low, high, F.expr("INTERVAL 1 DAY")))).drop("_a", "_b")
    return grid.join(d, [*by, "day"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


# --- risk of returns -------------------------------------------------------------------------------
def var_suite(df: DataFrame, keys: Sequence[str], ret: str, confidence: float = 0.95, kurt_limit: float = 8.0) -> DataFrame:
    """Historical, normal and Cornish-Fisher value at risk and expected shortfall."""
    z = norm_ppf_value(1 - confidence)
    r = F.col(ret)
    g = df.filter(r.isNotNull()).groupBy(*keys).agg(
        F.percentile(r, 1 - confidence).alias("var_hist"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.skewness(r).alias("_g"), F.kurtosis(r).alias("_k"), F.count(r).alias("n"))
    s, k = F.col("_g"), F.col("_k")
    zc = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    g = g.withColumns({"var_normal": F.col("_m") + z * F.col("_s"),
                       "var_cf": F.when(F.abs(k) > kurt_limit, F.col("var_hist")).otherwise(F.col("_m") + zc * F.col("_s"))})
    tail = df.join(g.select(*keys, "var_hist"), list(keys)).filter(r <= F.col("var_hist")).groupBy(*keys).agg(F.avg(r).alias("cvar_hist"))
    return g.join(tail, list(keys)).drop("_m", "_s", "_g", "_k")


def garch_var(sigma: Col, confidence: float = 0.95, mu: float = 0.0) -> Column:
    return F.lit(mu) + norm_ppf_value(1 - confidence) * col(sigma)


def daily_cap(var_rows: DataFrame, by: Sequence[str], var: str = "var_hist", cap: float = 0.15) -> DataFrame:
    return var_rows.groupBy(*by).agg(F.least(F.percentile(F.abs(var), 0.5), F.lit(cap)).alias("daily_cap"))


def worst_days(df: DataFrame, keys: Sequence[str], ret: str, ns: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Mean of the n worst returns, from the n_max smallest kept by a bounded heap aggregate."""
    m = max(ns)
    w = Window.partitionBy(*keys).orderBy(F.col(ret))
    d = df.filter(F.col(ret).isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m)
    return d.groupBy(*keys).agg(*[F.avg(F.when(F.col("_r") <= n, F.col(ret))).alias(f"worst_{n}") for n in ns])


def vol_position(close: Col, vol: Col, cash: float, budget: float = 0.01, cap: float = 0.3, forecast: Col | None = None, blend: float = 0.5) -> Column:
    """Units from a risk budget over (optionally blended) volatility."""
    v = col(vol) if forecast is None else F.coalesce((1 - blend) * col(vol) + blend * col(forecast), col(vol))
    return F.least(F.try_divide(F.lit(budget), v), F.lit(cap)) * cash / col(close)


# --- bootstrap -------------------------------------------------------------------------------------
def bootstrap_sharpe(df: DataFrame, keys: Sequence[str], ret: str, order: Sequence[str] = ("ts",), samples: int = 200, seed: int = 7, periods: float = 252.0) -> DataFrame:
    """Percentile band of the Sharpe over resamples.

    Each row gets a Poisson(1) weight per resample from a seeded hash of its key and order (the
    distributed bootstrap): resampling is a projection with partial sums, no row is shuffled by draws.
    """
    ids = F.xxhash64(*[F.col(c) for c in (*keys, *order)])
    d = df.filter(F.col(ret).isNotNull()).select(*keys, F.col(ret).alias("_x"), ids.alias("_h"))
    d = d.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    u = (F.pmod(F.xxhash64("_h", "sample", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))
    # Cumulative Poisson(1) probabilities for 0, 1, 2, ... draws.
    cdf, total, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += term
        cdf.append(total)
        term /= k + 1
    weight = sum((F.when(F.col("_u") >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    d = d.withColumn("_u", u).withColumn("_w", weight)
    g = d.groupBy(*keys, "sample").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("a"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("b"))
    mean = div("a", "w")
    sd = F.sqrt(F.greatest(div(F.col("b") - F.col("a") * mean, F.col("w") - 1), F.lit(0.0)))
    g = g.withColumn("sharpe", div(mean, sd) * math.sqrt(periods))
    return g.groupBy(*keys).agg(
        F.percentile("sharpe", 0.05).alias("lo"), F.percentile("sharpe", 0.5).alias("median"), F.percentile("sharpe", 0.95).alias("hi"), F.count("sharpe").alias("samples"))


# --- scoring ---------------------------------------------------------------------------------------
# Composite weights; higher is better after orientation.
SCORE_WEIGHTS = {"sharpe": 0.35, "max_drawdown": 0.25, "psr": 0.25, "turnover": 0.15}


def composite_score(df: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS, lower_better: Sequence[str] = ("turnover",), by: Sequence[str] = (), flat: float = 1.0, missing: float | None = 0.0) -> DataFrame:
    """Min-max normalise each metric (a less negative drawdown scores higher) and weight them. ``flat``: what a metric that is
    the same in all rows counts (NaN: 0 / 0, as in SQL). ``missing``: what a null counts (None: the score is null)."""
    ends = df.groupBy(*by).agg(*[F.min(m).alias(f"_lo_{m}") for m in weights], *[F.max(m).alias(f"_hi_{m}") for m in weights])
    d = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))  # one row of extremes
    parts = {}
    for m in weights:
        unit = F.when(F.col(m).isNull(), F.lit(missing).cast("double")).otherwise(F.coalesce(div(F.col(m) - F.col(f"_lo_{m}"), F.col(f"_hi_{m}") - F.col(f"_lo_{m}")), F.lit(flat)))
        parts[m] = 1 - unit if m in lower_better else unit
    d = d.withColumn("composite_score", sum((parts[m] * v for m, v in weights.items()), F.lit(0.0)))
    return d.drop(*[f"_lo_{m}" for m in weights], *[f"_hi_{m}" for m in weights])


def rank_strategies(df: DataFrame, score: str = "composite_score", by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score))))


def gates_v1(df: DataFrame, min_sharpe: float = 1.0, max_dd: float = 0.15) -> DataFrame:
    """Failure list and pass flag."""
    fails = F.filter(F.array(
        F.when(~F.coalesce(F.col("sharpe") >= min_sharpe, F.lit(False)), F.lit("sharpe")),
        F.when(~F.coalesce(F.abs("max_drawdown") <= max_dd, F.lit(False)), F.lit("max_drawdown"))), lambda x: x.isNotNull())
    return df.withColumn("gate_failures", F.array_join(fails, ",")).withColumn("passes", F.col("gate_failures") == "")


def rank_sensitivity(df: DataFrame, schemes: Mapping[str, Mapping[str, float]], id_cols: Sequence[str], top: int = 2, **score) -> DataFrame:
    """Ranks under each weighting and in how many of them a row is in the top. ``score``: see ``composite_score``."""
    out: DataFrame | None = None
    for name, w in schemes.items():
        part = rank_strategies(composite_score(df, w, [m for m in w if m == "turnover"], **score)).select(*id_cols, F.lit(name).alias("scheme"), "rank")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out.groupBy(*id_cols).agg(F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.count_if(F.col("rank") <= top).alias("n_top"), F.count(F.lit(1)).alias("n_schemes"))


def leaderboard(df: DataFrame, by: Sequence[str], n: int | None = None, tie: str = "strategy", then: Sequence[str] = ("sharpe", "ann_return")) -> DataFrame:
    """Places by ``mar``, equal ones by the columns of ``then``, the last ties by ``tie``. NaN ranks above all numbers."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("mar"), *[F.desc_nulls_last(c) for c in then], tie)
    out = df.withColumn("place", F.row_number().over(w))
    return out if n is None else out.filter(F.col("place") <= n)


def select_distinct(df: DataFrame, by: Sequence[str], strategy: str, score: str, n: int = 2, tie: Sequence[str] = ()) -> DataFrame:
    """Best row of each strategy (equal ones by ``tie``), then the top n strategies."""
    one = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, strategy).orderBy(F.desc(score), *tie))).filter("_r = 1").drop("_r")
    return one.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), strategy))).filter(F.col("pick") <= n)


def sequential_gates(df: DataFrame, dsr: float = 0.95, pbo: float = 0.5, max_dd: float = 0.25, min_trades: int = 10) -> DataFrame:
    """Survivors after each gate; a missing DSR fails, a missing PBO passes."""
    a = F.coalesce(F.col("dsr") >= dsr, F.lit(False))
    b = a & F.coalesce(F.col("pbo") <= pbo, F.lit(True))
    c = b & F.coalesce(F.abs("max_drawdown") <= max_dd, F.lit(False))
    d = c & F.coalesce(F.col("n_trades") >= min_trades, F.lit(False))
    g = df.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(x).alias(n) for n, x in (("dsr", a), ("pbo", b), ("drawdown", c), ("trades", d))])
    return g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.lit(i).alias("step"), F.col(n).alias("survivors")) for i, n in enumerate(("all", "dsr", "pbo", "drawdown", "trades"))])).alias("_i")).select("_i.*")


def score_gate(measured: Col, threshold: Col, direction: str = "above", slack: float = 0.0) -> Column:
    """PASS / CONDITIONAL (within ``slack`` of the threshold) / FAIL; a missing value fails."""
    gap = col(measured) - col(threshold) if direction == "above" else col(threshold) - col(measured)
    return F.when(gap >= 0, "PASS").when(gap >= -slack, "CONDITIONAL").otherwise("FAIL")


def scorecard(parts: Sequence[tuple[str, DataFrame, str, float, str]], slack: float = 0.0) -> DataFrame:
    """One row per gate from (name, one-row table, column, threshold, direction)."""
    out: DataFrame | None = None
    for name, df, c, thr, direction in parts:
        row = df.select(F.lit(name).alias("gate"), F.col(c).cast("double").alias("measured"), F.lit(float(thr)).alias("threshold"), score_gate(c, F.lit(float(thr)), direction, slack).alias("status"))
        out = row if out is None else out.unionByName(row)
    assert out is not None
    return out


def paired_comparison(df: DataFrame, keys: Sequence[str], strategy: str, a: str, b: str, value: str = "sharpe", tol: float = 1e-9) -> DataFrame:
    """Win/loss/tie counts of two strategies over common keys, in one aggregate without a self join."""
    g = df.filter(F.col(strategy).isin(a, b)).groupBy(*keys).agg(F.max(F.when(F.col(strategy) == a, F.col(value))).alias("x"), F.max(F.when(F.col(strategy) == b, F.col(value))).alias("y"))
    d = F.col("x") - F.col("y")
    return g.filter(d.isNotNull()).agg(F.count_if(d > tol).alias("wins"), F.count_if(d < -tol).alias("losses"), F.count_if(F.abs(d) <= tol).alias("ties"), F.avg(d).alias("mean_delta"))


def paired_comparisons(df: DataFrame, pairs: DataFrame, keys: Sequence[str], strategy: str, value: str = "sharpe", tol: float = 1e-9) -> DataFrame:
    """Win/loss/tie counts of each listed pair (a, b) of strategies over their common keys: rows grow with the pairs that are asked for."""
    x = df.select(*keys, F.col(strategy).alias("a"), F.col(value).alias("_x"))
    y = df.select(*keys, F.col(strategy).alias("b"), F.col(value).alias("_y"))
    d = F.col("_x") - F.col("_y")
    j = pairs.filter("b IS NOT NULL").join(x, "a").join(y, ["b", *keys]).filter(d.isNotNull())
    return j.groupBy("a", "b").agg(F.count_if(d > tol).alias("wins"), F.count_if(d < -tol).alias("losses"), F.count_if(F.abs(d) <= tol).alias("ties"), F.avg(d).alias("mean_delta"))


def tail_score(baseline_worst5: Column) -> Column:
    improve = F.least(F.greatest(1 - F.try_divide(F.abs("worst_5"), F.abs(baseline_worst5)), F.lit(-1.0)), F.lit(1.0))
    return 0.4 * F.col("sharpe") + 0.3 * F.col("sortino") + 0.2 * (1 + F.col("calmar")) + 0.1 * F.coalesce(improve, F.lit(0.0))


def loss_caps(metrics_rows: DataFrame, by: Sequence[str], sizing: float = 0.1, buffer: float = 1.5, cap: float = 0.2) -> DataFrame:
    dd = F.avg(F.abs("max_drawdown"))
    return metrics_rows.groupBy(*by).agg(F.least(dd * sizing * buffer, F.lit(cap)).alias("daily_loss_cap"), F.least(dd * buffer, F.lit(2 * cap)).alias("drawdown_cap"))


def stress_windows(df: DataFrame, f: Frame, windows: Sequence[tuple[str, str, str]], ret: str) -> DataFrame:
    """Return and worst drawdown inside named date windows."""
    w = df.sparkSession.createDataFrame(windows, "window_name string, a string, b string").select("window_name", F.col("a").cast("date").alias("_a"), F.col("b").cast("date").alias("_b"))
    d = df.join(F.broadcast(w), F.col("ts").cast("date").between(F.col("_a"), F.col("_b")))
    d = with_equity(d, Frame((*f.keys, "window_name"), f.order), ret)
    return d.groupBy(*f.keys, "window_name").agg((growth(ret) - 1).alias("window_return"), F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("n_bars"))


# --- splits ----------------------------------------------------------------------------------------
def fold_of(rn: Col, n: Col, folds: int) -> Column:
    """Contiguous folds 0..k-1 of n rows; the first n mod k folds have one row more."""
    size, extra = F.floor(col(n) / folds), F.pmod(col(n), F.lit(folds))
    i = col(rn) - 1
    cut = extra * (size + 1)
    return F.when(i < cut, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - cut) / F.greatest(size, F.lit(1)))).cast("int")


def with_folds(df: DataFrame, f: Frame, folds: int) -> DataFrame:
    df = df.withColumns({"_rn": f.rn(), "_n": F.count(F.lit(1)).over(f.whole)})
    return df.withColumn("fold", fold_of("_rn", "_n", folds)).drop("_rn", "_n")


def purged_kfold(df: DataFrame, f: Frame, folds: int = 5, embargo: float = 0.01, t1: str = "t1", strict_before: bool = False) -> DataFrame:
    """(row, test_fold, role): test, train, purged (label overlaps the test span) or embargo.

    ``strict_before`` keeps the older rule: only labels that end before the test start may train.
    """
    ts = f.order[0]
    df = df.withColumns({"_rn": f.rn(), "_n": F.count(F.lit(1)).over(f.whole)}).withColumn("fold", fold_of("_rn", "_n", folds))
    spans = df.groupBy(*f.keys, F.col("fold").alias("test_fold")).agg(
        F.min(ts).alias("_s"), F.max(t1).alias("_e"), F.max("_rn").alias("_last"), F.first("_n").alias("_nn"))
    j = df.join(spans, list(f.keys))
    size = F.when(F.lit(embargo) > 0, F.greatest(F.floor(F.col("_nn") * embargo), F.lit(1))).otherwise(0)
    overlap = F.col(t1) > F.col("_s") if strict_before else (F.col(t1) > F.col("_s")) & (F.col(ts) <= F.col("_e"))
    role = F.when(F.col("fold") == F.col("test_fold"), "test").when(overlap, "purged").when(
        (F.col("_rn") > F.col("_last")) & (F.col("_rn") <= F.col("_last") + size), "embargo").otherwise("train")
    return j.withColumn("role", role).drop("_rn", "_n", "_s", "_e", "_last", "_nn")


def cpcv_combinations(spark: SparkSession, folds: int, k_test: int) -> DataFrame:
    """All C(folds, k) test sets as (combo, fold) rows."""
    rows = [(i, fold) for i, c in enumerate(combinations(range(folds), k_test)) for fold in c]
    return spark.createDataFrame(rows, "combo int, fold int")


def cpcv_sharpes(df: DataFrame, f: Frame, ret: str, folds: int = 6, k_test: int = 2, periods: float = 252.0) -> DataFrame:
    """Out-of-sample Sharpe of every test combination, merged from per-fold sums (rows are read once)."""
    d = with_folds(df.filter(F.col(ret).isNotNull()), f, folds)
    s = d.groupBy(*f.keys, "fold").agg(F.count(ret).alias("n"), F.sum(ret).alias("a"), F.sum(F.col(ret) * F.col(ret)).alias("b"))
    c = F.broadcast(cpcv_combinations(df.sparkSession, folds, k_test))
    g = s.join(c, "fold").groupBy(*f.keys, "combo").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    mean = F.col("a") / F.col("n")
    sd = F.sqrt((F.col("b") - F.col("a") * mean) / (F.col("n") - 1))
    return g.withColumn("oos_sharpe", div(mean, sd) * math.sqrt(periods)).select(*f.keys, "combo", "n", "oos_sharpe")


def walk_forward(df: DataFrame, keys: Sequence[str], insample: int, oos: int, ts: str = "ts") -> DataFrame:
    """Expanding calendar-year splits: train on years before the cut, test on the ``oos`` years after it."""
    years = df.groupBy(*keys).agg(F.min(F.year(ts)).alias("_a"), F.max(F.year(ts)).alias("_b"))
    cuts = years.filter(F.col("_b") >= F.col("_a") + insample).withColumn("cut", F.explode(F.sequence(F.col("_a") + insample, F.col("_b"), F.lit(oos))))
    return cuts.select(*keys, F.col("cut").alias("split"), F.make_date("_a", F.lit(1), F.lit(1)).alias("train_start"), F.make_date(F.col("cut") - 1, F.lit(12), F.lit(31)).alias("train_end"),
                       F.make_date("cut", F.lit(1), F.lit(1)).alias("test_start"), F.make_date(F.col("cut") + (oos - 1), F.lit(12), F.lit(31)).alias("test_end"))


def fixed_windows(df: DataFrame, windows: Sequence[tuple[str, str]], prefix: str = "split", ts: str = "ts") -> DataFrame:
    """Tag rows with the named date windows they fall in (a window list of literals, broadcast)."""
    rows = [(f"{prefix}_{i + 1}", a, b) for i, (a, b) in enumerate(windows)]
    w = df.sparkSession.createDataFrame(rows, "split string, a string, b string").select("split", F.col("a").cast("date").alias("_a"), F.col("b").cast("date").alias("_b"))
    return df.join(F.broadcast(w), F.col(ts).cast("date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def fold_metrics(df: DataFrame, keys: Sequence[str], ret: str, fold: str = "fold", periods: float = 365.0) -> DataFrame:
    return df.groupBy(*keys, fold).agg(sharpe(ret, periods).alias("sharpe"), (growth(ret) - 1).alias("total_return"), F.count(ret).alias("n"))


def fold_aggregate(folds: DataFrame, keys: Sequence[str], value: str = "sharpe") -> DataFrame:
    return folds.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("worst"), F.count(F.lit(1)).alias("n_folds"))


# --- strategy sweeps -------------------------------------------------------------------------------
def cost_scenarios(spark: SparkSession, fees: Sequence[float], slippage: Sequence[float], funding: Sequence[float] = (0.0,)) -> DataFrame:
    rows = [(float(a), float(b), float(c), float(a + b)) for a in fees for b in slippage for c in funding]
    return spark.createDataFrame(rows, "fee_bps double, slippage_bps double, funding_bps double, cost_bps double")


def sweep(positions: DataFrame, keys: Sequence[str], scenarios: DataFrame, periods: float = 252.0, ts: str = "ts") -> DataFrame:
    """Metrics of every (key, scenario): gross return and position change are computed once, and the
    scenario cost enters after the per-row step (scenario list is a few literals, broadcast)."""
    f = Frame(keys, (ts,))
    held = F.coalesce(f.lag("position"), F.lit(0)).cast("double")
    d = positions.withColumns({"_h": held, "_r": F.coalesce(f.pct("close"), F.lit(0.0))}).withColumn("_c", F.abs(F.coalesce(f.diff("_h"), F.lit(0.0))))
    d = d.select(*keys, ts, (F.col("_h") * F.col("_r")).alias("_g"), "_c").crossJoin(F.broadcast(scenarios)).withColumn("ret", F.col("_g") - F.col("_c") * F.col("cost_bps") * 1e-4)
    return d.groupBy(*keys, *scenarios.columns).agg(sharpe("ret", periods).alias("sharpe"), (growth("ret") - 1).alias("total_return"), F.avg("_c").alias("turnover"))


def cost_matrix(swept: DataFrame, by: Sequence[str], costs: Sequence[float]) -> DataFrame:
    """Sharpe by cost scenario in columns."""
    p = swept.groupBy(*by).pivot("cost_bps", [float(c) for c in costs]).agg(F.first("sharpe"))
    return p.select(*by, *[F.col(f"`{float(c)}`").alias(f"sharpe_{int(c)}bps") for c in costs])


# --- parity and attribution ------------------------------------------------------------------------
def slippage_bps(fills: DataFrame, signals: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    j = fills.join(signals.select(*keys, F.col("price").alias("signal_price")), list(keys))
    return j.groupBy(*by).agg((F.avg(F.abs(div(F.col("price") - F.col("signal_price"), "signal_price"))) * 1e4).alias("mean_slippage_bps"), F.count(F.lit(1)).alias("n"))


def parity(replay: DataFrame, backtest: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Matched and one-sided trades, price difference and pnl correlation of two runs."""
    from tideline.operators.asof import safe_corr

    j = replay.select(*keys, F.col("price").alias("rp"), F.col("pnl").alias("rl"), F.lit(1).alias("_r")).join(
        backtest.select(*keys, F.col("price").alias("bp"), F.col("pnl").alias("bl"), F.lit(1).alias("_b")), list(keys), "full")
    return j.groupBy(*by).agg(
        F.count_if(F.col("_r").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_b").isNull()).alias("only_replay"), F.count_if(F.col("_r").isNull()).alias("only_backtest"),
        (F.max(F.abs(div(F.col("rp") - F.col("bp"), "bp"))) * 1e4).alias("max_price_diff_bps"), safe_corr("rl", "bl").alias("pnl_corr"))


def attribution(steps: DataFrame, keys: Sequence[str], order: str = "step", value: str = "pnl") -> DataFrame:
    """Difference each step adds to the one before it, and its share of the total gap."""
    f = Frame(keys, (order,))
    d = steps.withColumn("delta", f.diff(value))
    ends = steps.groupBy(*keys).agg((F.max_by(value, order) - F.min_by(value, order)).alias("_gap"))
    return d.join(ends, list(keys)).withColumn("share", div("delta", "_gap")).drop("_gap")


