"""Descriptive statistics, correlations, portfolios of weights, profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Col, Frame, col, div
from tideline.functions.numeric import norm_cdf
from tideline.operators import gram
from tideline.operators.asof import best_lag, lagged_corr
from tideline.plans.incremental import in_slices
from tideline.plans.segments import SEGMENT_ROWS, number_rows, percentiles, running



def window_drawdown(f: Frame, x: str, n: int) -> Column:
    """Worst drop from a running peak inside the last n returns (one fold over the window's list)."""
    w = f.last_rows(n)
    start = F.struct(F.lit(1.0).alias("eq"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc: Column, r: Column) -> Column:
        eq = acc["eq"] * (1.0 + r)
        peak = F.greatest(acc["peak"], eq)
        return F.struct(eq.alias("eq"), peak.alias("peak"), F.least(acc["dd"], F.try_divide(eq, peak) - 1.0).alias("dd"))

    fold = F.aggregate(F.collect_list(x).over(w), start, step, lambda a: a["dd"])
    return F.when(F.count(x).over(w) >= n, fold)


def asset_stats(df: DataFrame, f: Frame, windows: Sequence[int] = (30, 60, 90, 252), tf_days: float = 1.0, rf: float = 0.0, x: str = "ret_arith", drawdown: bool = True) -> DataFrame:
    """Rolling mean, deviation, Sharpe, skewness, kurtosis and drawdown; expanding drawdown from the high."""
    ann = math.sqrt(365.0 / tf_days)
    df = df.withColumn("_eq", F.exp(F.sum(F.log1p(F.when(F.coalesce(x, F.lit(0.0)) > -1, F.coalesce(x, F.lit(0.0))))).over(f.cum)))
    df = df.withColumn("max_dd_from_ath", div("_eq", F.max("_eq").over(f.cum)) - 1).drop("_eq")
    cols: dict[str, Column] = {}
    for n in windows:
        skew, kurt = f.moments(x, n)
        cols |= {f"mean_ret_{n}": f.mean(x, n), f"std_ret_{n}": f.std(x, n), f"skew_{n}": skew, f"kurt_fisher_{n}": kurt}
        if drawdown:
            cols[f"max_dd_window_{n}"] = window_drawdown(f, x, n)
    df = df.withColumns(cols)
    return df.withColumns({f"sharpe_raw_{n}": div(F.col(f"mean_ret_{n}") - rf, f"std_ret_{n}") for n in windows} | {f"kurt_pearson_{n}": F.col(f"kurt_fisher_{n}") + 3.0 for n in windows}).withColumns(
        {f"sharpe_ann_{n}": F.col(f"sharpe_raw_{n}") * ann for n in windows})


def unordered_pairs(ids: DataFrame, key: str = "id") -> DataFrame:
    """All id pairs a < b of a distinct id list (a universe list, not the fact table)."""
    a = ids.select(F.col(key).alias("id_a")).distinct()
    b = ids.select(F.col(key).alias("id_b")).distinct()
    return a.join(b, F.col("id_a") < F.col("id_b"))


def paired(df: DataFrame, x: str, by: str = "ts", key: str = "id") -> DataFrame:
    """Rows of two ids on the same timestamp, a < b: an equi join on the timestamp."""
    a = df.select(by, F.col(key).alias("id_a"), F.col(x).alias("a"))
    b = df.select(by, F.col(key).alias("id_b"), F.col(x).alias("b"))
    return a.join(b, by).filter((F.col("id_a") < F.col("id_b")) & F.col("a").isNotNull() & F.col("b").isNotNull())


def rolling_pair_corr(pairs: DataFrame, n: int, ts: str = "ts", spearman: bool = True) -> DataFrame:
    """Rolling Pearson and Spearman correlation of each pair over full windows, with a t-based p-value."""
    f = Frame(("id_a", "id_b"), (ts,))
    df = running_corr(pairs, f, "a", "b", n, "pearson")
    if spearman:

        @F.pandas_udf(T.DoubleType())
        def rank_corr(a: pd.Series, b: pd.Series) -> pd.Series:
            out = np.full(len(a), np.nan)
            keep = [i for i in range(len(a)) if a.iloc[i] is not None and len(a.iloc[i]) == n]
            if keep:
                ra = pd.DataFrame(np.stack([a.iloc[i] for i in keep])).rank(axis=1).to_numpy()
                rb = pd.DataFrame(np.stack([b.iloc[i] for i in keep])).rank(axis=1).to_numpy()
                ra -= ra.mean(axis=1, keepdims=True)
                rb -= rb.mean(axis=1, keepdims=True)
                den = np.sqrt((ra**2).sum(axis=1) * (rb**2).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[keep] = (ra * rb).sum(axis=1) / den
            return pd.Series(out).where(np.isfinite(out), None)

        w = f.last_rows(n)
        full = F.count("a").over(w) == n
        df = df.withColumns({"_la": F.when(full, F.collect_list("a").over(w)), "_lb": F.when(full, F.collect_list("b").over(w))})
        df = df.withColumn("spearman", rank_corr("_la", "_lb")).drop("_la", "_lb")
    return df.withColumn("n_obs", F.when(F.col("pearson").isNotNull(), F.lit(n)))


def running_corr(df: DataFrame, f: Frame, a: str, b: str, n: int, out: str) -> DataFrame:
    """Rolling correlation of complete pairs from running sums: constant work per row for any n.

    Inputs are centred per key first, so differences of the running sums keep their digits; a window in
    which one side never changes is NULL, found by the length of the current run of equal values.
    """
    df = df.withColumns({"_a": F.col(a) - F.avg(a).over(f.whole), "_b": F.col(b) - F.avg(b).over(f.whole), "_rn": f.rn()})
    terms = {"a": F.col("_a"), "b": F.col("_b"), "aa": F.col("_a") * F.col("_a"), "bb": F.col("_b") * F.col("_b"), "ab": F.col("_a") * F.col("_b")}
    changed = lambda c: F.when(f.lag(c).isNull() | (f.lag(c) != F.col(c)), F.col("_rn"))
    df = df.withColumns({f"_c_{k}": F.sum(v).over(f.cum) for k, v in terms.items()} | {"_ra": changed(a), "_rb": changed(b)})
    moved = {f"_w_{k}": F.col(f"_c_{k}") - F.coalesce(f.lag(f"_c_{k}", n), F.lit(0.0)) for k in terms}
    df = df.withColumns(moved | {"_ra": F.last("_ra", ignorenulls=True).over(f.cum), "_rb": F.last("_rb", ignorenulls=True).over(f.cum)})
    w = {k: F.col(f"_w_{k}") for k in terms}
    cov = w["ab"] - w["a"] * w["b"] / n
    va, vb = w["aa"] - w["a"] * w["a"] / n, w["bb"] - w["b"] * w["b"] / n
    varies = (F.col("_rn") - F.col("_ra") + 1 < n) & (F.col("_rn") - F.col("_rb") + 1 < n) & (va > 0) & (vb > 0)
    value = F.when((F.col("_rn") >= n) & varies, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    return df.withColumn(out, value).drop("_a", "_b", "_rn", "_ra", "_rb", *moved, *[f"_c_{k}" for k in terms])


def market_corr(df: DataFrame, x: str, n: int = 30, high: float = 0.7, ts: str = "ts") -> DataFrame:
    """Average rolling pairwise correlation per date and whether it is high."""
    c = rolling_pair_corr(paired(df, x, ts), n, ts, spearman=False)
    return c.groupBy(ts).agg(F.avg("pearson").alias("avg_corr"), F.count("pearson").alias("n_pairs")).withColumn(
        "is_high_corr", F.coalesce(F.col("avg_corr") > high, F.lit(False)))


def funding_daily(rates: DataFrame, z: Sequence[int] = (30, 90), need: float = 0.8) -> DataFrame:
    """Mean funding across venues per (date, symbol), venue list and rolling z-scores."""
    d = rates.groupBy("symbol", "date").agg(
        F.avg("rate").alias("avg_rate"), F.count_distinct("venue").alias("n_venues"), F.array_join(F.array_sort(F.collect_set("venue")), ",").alias("venues"))
    f = Frame(("symbol",), ("date",))
    return d.withColumns({f"z_{n}": f.zscore("avg_rate", n, max(1, int(need * n))) for n in z})


def asset_macro_corr(df: DataFrame, x: str, macro: DataFrame, var: str, n: int = 60, need: int | None = None, ts: str = "ts") -> DataFrame:
    """Rolling correlation of each asset with a macro variable, its sign flips and a strength label."""
    j = df.join(macro.select(ts, var), ts)
    f = Frame(("id",), (ts,))
    j = j.withColumn("corr", f.corr(x, var, n, need))
    flip = F.signum("corr") != F.signum(f.lag("corr"))
    label = F.when(F.abs("corr") >= 0.5, "strong").when(F.abs("corr") >= 0.2, "moderate").when(F.col("corr").isNotNull(), "weak")
    return j.withColumns({"sign_flip": F.coalesce(flip, F.lit(False)), "corr_regime": label})


def two_series_corr(df: DataFrame, a: str, b: str, f: Frame, windows: Sequence[int] = (30, 60, 90, 180), blend: float = 0.3) -> DataFrame:
    """Correlation over several windows, volatility regime of a against b, short-vs-long divergence."""
    df = df.withColumns({f"corr_{n}": f.corr(a, b, n) for n in windows} | {"_va": f.std(a, windows[0]), "_vb": f.std(b, windows[0])})
    ratio = div("_va", "_vb")
    regime = F.when(ratio > 1.5, "a_volatile").when(ratio < 1 / 1.5, "b_volatile").when(ratio.isNotNull(), "balanced")
    gap = F.col(f"corr_{windows[0]}") - F.col(f"corr_{windows[-1]}")
    return df.withColumns({"vol_regime": regime, "divergence": F.coalesce(F.abs(gap) > blend, F.lit(False))}).drop("_va", "_vb")


def lead_lag_scan(df: DataFrame, features: Sequence[str], target: str, f: Frame, max_lag: int = 60) -> DataFrame:
    """Best lag per (key, feature); significant when |corr| > 2 / sqrt(n)."""
    out: DataFrame | None = None
    for name in features:
        part = best_lag(lagged_corr(df, f, target, name, max_lag), f.keys).withColumn("feature", F.lit(name))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out.withColumn("significant", F.abs("best_corr") > F.lit(2.0) / F.sqrt("n"))


# --- drift, attribution ----------------------------------------------------------------------------
def sharpe_daily(x: Col, periods: float = 365.0) -> Column:
    return div(F.avg(col(x)), F.stddev_samp(col(x))) * math.sqrt(periods)


def tracking_error(df: DataFrame, f: Frame, a: str, b: str, n: int, out: str) -> DataFrame:
    return df.withColumn("_d", F.col(a) - F.col(b)).withColumn(out, f.std("_d", n)).drop("_d")


def drift_metrics(paper: DataFrame, replay: DataFrame, keys: Sequence[str], te_limit: float = 0.015, ts: str = "ts") -> DataFrame:
    """Cumulative pnl of both runs, tracking error over the last 5 and 30 days, Sharpe gap, status."""
    j = paper.select(*keys, ts, F.col("pnl").alias("p")).join(replay.select(*keys, ts, F.col("pnl").alias("r")), [*keys, ts])
    f = Frame(keys, (ts,))
    j = tracking_error(tracking_error(j, f, "p", "r", 5, "te5"), f, "p", "r", 30, "te30")
    g = j.groupBy(*keys).agg(
        F.sum("p").alias("paper_pnl"), F.sum("r").alias("replay_pnl"), F.max_by("te5", ts).alias("te_5d"), F.max_by("te30", ts).alias("te_30d"),
        (sharpe_daily("p") - sharpe_daily("r")).alias("sharpe_gap"), F.count(F.lit(1)).alias("n_days"))
    return g.withColumns({"abs_pnl_diff": F.abs(F.col("paper_pnl") - F.col("replay_pnl")), "status": drift_status("te_5d", te_limit)})


def drift_status(te: Col, limit: float = 0.015, warn_share: float = 0.75) -> Column:
    return F.when(col(te) >= limit, "breach").when(col(te) >= limit * warn_share, "warning").otherwise("ok")


def data_snapshot(tables: dict[str, DataFrame], keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Newest timestamp and row count of each key in each table."""
    out: DataFrame | None = None
    for name, df in tables.items():
        part = df.groupBy(*keys).agg(F.max(ts).alias("max_ts"), F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def beta(y: Col, x: Col) -> Column:
    return F.regr_slope(col(y), col(x))


def class_attribution(df: DataFrame, bench: DataFrame, by: str, x: str, ts: str = "ts") -> DataFrame:
    """Per class: equal-weight daily return, beta against the benchmark, beta and alpha pnl."""
    daily = df.groupBy(by, ts).agg(F.avg(x).alias("r"))
    j = daily.join(bench.select(ts, F.col(x).alias("m")), ts)
    g = j.groupBy(by).agg(beta("r", "m").alias("beta"), F.sum("r").alias("total"), F.sum("m").alias("bench"), F.count(F.lit(1)).alias("n_days"))
    return g.withColumn("beta_pnl", F.col("beta") * F.col("bench")).withColumn("alpha_pnl", F.col("total") - F.col("beta_pnl"))


def equal_weight_returns(df: DataFrame, x: str, ts: str = "ts") -> DataFrame:
    """Mean return over the assets that have data that day."""
    return df.filter(F.col(x).isNotNull()).groupBy(ts).agg(F.avg(x).alias("ret"), F.count(F.lit(1)).alias("n_assets"))


def mark_to_market(fills: DataFrame, closes: DataFrame, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Daily pnl of the position held into each day plus cash of its fills, and Sharpe per key."""
    f = Frame(keys, (ts,))
    day = fills.groupBy(*keys, ts).agg(F.sum("qty").alias("dq"), F.sum(F.col("qty") * F.col("price")).alias("cost"))
    j = closes.select(*keys, ts, "close").join(day, [*keys, ts], "left").na.fill(0.0, ["dq", "cost"])
    j = j.withColumn("pos", F.sum("dq").over(f.cum))
    pnl = (F.col("pos") - F.col("dq")) * f.diff("close") + F.col("dq") * F.col("close") - F.col("cost")
    return j.withColumn("pnl", F.coalesce(pnl, F.lit(0.0)))


# --- profiles --------------------------------------------------------------------------------------
def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: rows, nulls, exact distinct count, min and max as text."""
    aggs = []
    for c in cols:
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count(c)).alias("n_null"),
                             F.count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in cols])).alias("_i")).select("_i.*")


def time_profile(df: DataFrame, ts: str, bucket: str) -> DataFrame:
    """Rows per hour/day/week/month including the empty buckets in between."""
    step = {"hour": "1 HOUR", "day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH"}[bucket]
    counts = df.groupBy(F.date_trunc(bucket, F.col(ts).cast("timestamp")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("bucket"))
    return grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("is_missing"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def free_aggregate(df: DataFrame, select: str, group_by: str = "", where: str = "", having: str = "", order_by: str = "", limit: int | None = None) -> DataFrame:
    """Ad-hoc group-by over a table by SQL text."""
    q = f"SELECT {select} FROM {{t}}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {group_by}" if group_by else "")
    q += (f" HAVING {having}" if having else "") + (f" ORDER BY {order_by}" if order_by else "") + (f" LIMIT {limit}" if limit else "")
    return df.sparkSession.sql(q, t=df)


def percentile_recent(df: DataFrame, by: Sequence[str], x: str, p: float, ts: str, as_of: Column, hours: int) -> DataFrame:
    recent = df.filter((F.col(ts) >= as_of - F.make_dt_interval(hours=F.lit(hours))) & F.col(x).isNotNull())
    n = recent.groupBy(*by).agg(F.count(x).alias("n"))
    return percentiles(recent, by, x, {"value": p}).join(n, list(by))


def degraded(df: DataFrame, by: Sequence[str], x: str, ts: str, split: Column, factor: float = 2.0) -> DataFrame:
    """Mean after ``split`` against the median before it."""
    base = percentiles(df.filter(F.col(ts) < split), by, x, {"baseline": 0.5})
    now = df.filter(F.col(ts) >= split).groupBy(*by).agg(F.avg(x).alias("current"))
    g = base.join(now, list(by), "full")
    return g.withColumn("degraded", F.coalesce(F.col("current") > F.col("baseline") * factor, F.lit(False)))


# --- weights ---------------------------------------------------------------------------------------
def shrunk_covariance(df: DataFrame, x: str, cutoff: float = 0.7, shrink: float = 0.5, ts: str = "ts") -> DataFrame:
    """Covariance per pair of ids; when the average correlation passes the cutoff, off-diagonals are shrunk."""
    c = gram.pair_covariance(df, x, ts)
    avg = c.agg(F.avg("corr").alias("avg_corr"))
    return c.crossJoin(F.broadcast(avg)).withColumn("cov_used", F.when(F.col("avg_corr") > cutoff, F.col("cov") * (1 - shrink)).otherwise(F.col("cov")))


def turnover_cost(old: DataFrame, new: DataFrame, by: Sequence[str], fee_bps: float = 10.0) -> DataFrame:
    """sum |dw|, buys, sells and cost of moving from old to new weights."""
    keys = [*by, "id"]
    j = old.select(*keys, F.col("weight").alias("o")).join(new.select(*keys, F.col("weight").alias("n")), keys, "full").na.fill(0.0, ["o", "n"])
    d = F.col("n") - F.col("o")
    return j.groupBy(*by).agg(
        F.sum(F.abs(d)).alias("turnover"), F.sum(F.greatest(d, F.lit(0.0))).alias("buys"), F.sum(F.greatest(-d, F.lit(0.0))).alias("sells"),
        F.count_if(d != 0).alias("n_trades")).withColumn("cost", F.col("turnover") * fee_bps / 1e4)


def cumulative_cost(costs: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Running cost over rebalance dates (one row per date and portfolio)."""
    return costs.withColumn("cum_cost", F.sum("cost").over(Frame(keys, (ts,)).cum))


def top_k(df: DataFrame, by: Sequence[str], score: str, k: int, tie: str = "id") -> DataFrame:
    """Top-k rows per group, selected in two steps so that no task ranks a whole group.

    A first ranking inside hashed slices of a group keeps k rows per slice; the second ranks those.
    """
    order = [F.desc(score), F.col(tie)]
    sliced = df.filter(F.col(score).isNotNull()).withColumn("_sl", F.pmod(F.xxhash64(tie), F.lit(64)))
    first = sliced.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_sl").orderBy(*order))).filter(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k).drop("_sl", "_r")


def topk_dropout(scores: DataFrame, portfolio: Sequence[str], ts: str, k: int, n_drop: int, edges: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """Holdings over rebalance dates: at most ``n_drop`` replacements, worst first (unscored ones last, by id), best replacements.

    A fold over dates for many portfolios at once. With ``edges`` it runs over the time slices between them; the ids held at the end of a
    slice are a state table in the shared ``folder`` (see ``in_slices``), so a task holds one slice of one portfolio, and a lost
    executor repeats a slice and no more. Only ids that are held before the slice or reach the top k in it can matter: the list
    of a date holds those, not the cross-section. Ties in score go to the smaller id.
    """
    keys = list(portfolio)
    fields = [scores.schema[c] for c in (*keys, ts)] + [T.StructField("id", scores.schema["id"].dataType), T.StructField("action", T.StringType())]
    schema = T.StructType(fields)

    def run(days: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        held, out = set(start["id"].tolist()), []
        for row in days.sort_values(ts).itertuples(index=False):
            ranked = [r["id"] if isinstance(r, dict) else r[1] for r in row.ranked]
            place = {a: i for i, a in enumerate(ranked)}
            top = ranked[:k]
            if held:
                below = sorted((a for a in held if a not in set(top)), key=lambda a: (a not in place, -place.get(a, 0), a))
                sell = below[:n_drop]
                buy = [a for a in top if a not in held][: len(sell)]
            else:
                sell, buy = [], top
            held = (held - set(sell)) | set(buy)
            base = [getattr(row, c) for c in keys] + [getattr(row, ts)]
            acts = {**{a: "hold" for a in held}, **{a: "buy" for a in buy}, **{a: "sell" for a in sell}}
            out += [(*base, a, v) for a, v in sorted(acts.items())]
        return pd.DataFrame(out, columns=[f.name for f in fields])

    def step(part: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        ever = top_k(part, [*keys, ts], "score", k).select(*keys, "id")
        before = part.sparkSession.createDataFrame([], T.StructType([part.schema[c] for c in (*keys, "id")])) if state is None else state
        matter = part.filter(F.col("score").isNotNull()).join(ever.unionByName(before).distinct(), [*keys, "id"], "left_semi")
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("id").alias("id"))))
        days = matter.groupBy(*keys, ts).agg(ranked.alias("ranked"))
        out = days.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(run, schema)
        last = out.groupBy(*keys).agg(F.max(ts).alias(ts))
        now = out.join(last, [*keys, ts]).filter("action <> 'sell'").select(*keys, "id")
        return out, now if state is None else state.join(last.select(*keys), keys, "left_anti").unionByName(now)

    if folder is None:
        return step(scores, None)[0]
    return in_slices(scores, Frame(keys, (ts,)), edges, step, folder)


def bet_size(prob: Col, side: Col, w: float = 2.0) -> Column:
    return col(side) * (2.0 * norm_cdf((col(prob) - 0.5) * w) - 1.0)


def scale_weights(df: DataFrame, by: Sequence[str], w: float = 2.0, min_confidence: float = 0.2) -> DataFrame:
    """weight x bet size, zero under the confidence floor, renormalised to the gross weight before."""
    sized = F.when(F.abs(bet_size("prob", "side", w)) >= min_confidence, F.col("weight") * bet_size("prob", "side", w)).otherwise(0.0)
    df = df.withColumn("scaled", sized)
    tot = df.groupBy(*by).agg(F.sum(F.abs("weight")).alias("_g"), F.sum(F.abs("scaled")).alias("_s"))
    return df.join(tot, list(by)).withColumn("final_weight", F.coalesce(div(F.col("scaled") * F.col("_g"), "_s"), F.lit(0.0))).drop("_g", "_s")


def weighted_composite(scores: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IC-IR weighted mean of signal scores per asset."""
    j = scores.join(weights, "signal")
    return j.groupBy(*keys).agg(div(F.sum(F.col("score") * F.col("weight")), F.sum(F.abs("weight"))).alias("composite"))


def scores_to_mu(composite: DataFrame, by: Sequence[str], ic_ir: float, vol: str = "vol") -> DataFrame:
    """Expected return = cross-section z of the composite x volatility x IC-IR."""
    s = composite.groupBy(*by).agg(F.avg("composite").alias("_m"), F.stddev_samp("composite").alias("_s"))
    return composite.join(s, list(by)).withColumn("mu", div(F.col("composite") - F.col("_m"), "_s") * F.col(vol) * ic_ir).drop("_m", "_s")


def weight_overrides(weights: DataFrame, overrides: DataFrame) -> DataFrame:
    """Multiply weights by the product of the active overrides of (signal, asset) and of the signal alone."""
    o = overrides.filter("active").groupBy("signal", "id").agg(F.exp(F.sum(F.log("factor"))).alias("_f"))
    return weights.join(o, ["signal", "id"], "left").withColumn("weight", F.col("weight") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def held_returns(holdings: DataFrame, rets: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Equal-weight next return of the held ids per date."""
    return holdings.join(rets, ["id", ts]).groupBy(*keys, ts).agg(F.avg("fwd_ret").alias("portfolio_ret"), F.count(F.lit(1)).alias("n_held"))


def status_counts(tables: Sequence[DataFrame], ts: str, start: Column, end: Column) -> DataFrame:
    out: DataFrame | None = None
    for t in tables:
        part = t.filter((F.col(ts) >= start) & (F.col(ts) < end)).select("status")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def round_trips(fills: DataFrame, keys: Sequence[str], order: Sequence[str], span: Column | None = None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Closed lots of signed fills (qty, price), first in, first out: keys, entry_n, exit_n, entry/exit of ``order[0]``, qty, prices, ret.

    The u-th unit bought and the u-th unit sold make a lot, whatever position is open between: long if the purchase came first, else
    short. With running totals of both sides a fill is an interval of units, and lots are the overlaps of buy and sell intervals.
    Totals run over segments of a key, and intervals meet in cells of about 16 mean fills, which a fill joins as often as it
    reaches into: n fills make some 2n cell rows, so neither a recursion nor a task for a whole key is needed. ``entry_n``
    and ``exit_n`` are the fills' numbers in their key. ``span``: a column that never falls in the order of a key (as its hour), by which
    a key of any size is numbered.
    """
    keys, when = list(keys), order[0]
    d = fills.filter(F.col("qty") != 0).select(*keys, *order, F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    d = number_rows(d, Frame(keys, order), F.lit(0) if span is None else span, "n")
    size = d.groupBy(*keys).agg((F.avg(F.abs("qty")) * 16).alias("_w"))
    side = lambda sign: F.when(F.signum("qty") == sign, F.abs("qty")).otherwise(0.0)
    d = running(d, Frame(keys, ("n",)), {"_b": ("sum", side(1)), "_s": ("sum", side(-1))}, "n", rows).join(size, keys)

    def intervals(sign: int, total: str, name: str) -> DataFrame:
        low = F.col(total) - F.abs("qty")
        cells = F.sequence(F.floor(low / F.col("_w")), F.floor(F.col(total) / F.col("_w")))
        x = d.filter(F.signum("qty") == sign)
        return x.select(*keys, F.col("n").alias(f"_n{name}"), F.col(when).alias(f"_t{name}"), F.col("price").alias(f"_p{name}"), low.alias(f"_l{name}"), F.col(total).alias(f"_h{name}"), "_w", F.explode(cells).alias("_cell"))

    j = intervals(1, "_b", "b").join(intervals(-1, "_s", "s").drop("_w"), [*keys, "_cell"])
    low, high = F.greatest("_lb", "_ls"), F.least("_hb", "_hs")
    j = j.filter((high - low > 1e-12) & (F.floor(low / F.col("_w")) == F.col("_cell")))  # once: in the cell where the overlap begins
    long = F.col("_nb") < F.col("_ns")
    first, last = (lambda c: F.when(long, F.col(f"_{c}b")).otherwise(F.col(f"_{c}s"))), (lambda c: F.when(long, F.col(f"_{c}s")).otherwise(F.col(f"_{c}b")))
    out = j.select(*keys, first("n").alias("entry_n"), last("n").alias("exit_n"), first("t").alias(f"entry_{when}"), last("t").alias(f"exit_{when}"), (high - low).alias("qty"),
                   first("p").alias("entry_price"), last("p").alias("exit_price"), F.when(long, 1.0).otherwise(-1.0).alias("side"))
    return out.withColumn("ret", F.col("side") * (F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1))


def fill_to_fill_sharpe(fills: DataFrame, group: Sequence[str], asset: str, order: Sequence[str], span: Column | None = None) -> DataFrame:
    """Per group: fills, pairs, mean return and days held, annualised Sharpe of the k-th purchase of an asset with its k-th sale.

    Pairs ignore quantities. The number of a fill among its side's is a running count over segments of the key, and pairs are an equi join on it.
    """
    keys, when = [*group, asset], order[0]
    d = number_rows(fills.filter(F.col("qty") != 0), Frame(keys, order), F.lit(0) if span is None else span, "n")
    buy = F.col("qty") > 0
    d = running(d, Frame(keys, ("n",)), {"_b": ("sum", F.when(buy, 1).otherwise(0)), "_s": ("sum", F.when(buy, 0).otherwise(1))}, "n")
    b = d.filter(buy).select(*keys, F.col("_b").alias("_k"), F.col("price").alias("_pb"), F.col(when).alias("_tb"))
    s = d.filter(~buy).select(*keys, F.col("_s").alias("_k"), F.col("price").alias("_ps"), F.col(when).alias("_ts"))
    pairs = b.join(s, [*keys, "_k"]).filter("_pb > 0")
    held = F.greatest(F.timestamp_diff("SECOND", F.col("_tb"), F.col("_ts")) / 86400.0, F.lit(1.0 / 24))
    pairs = pairs.withColumns({"_r": (F.col("_ps") - F.col("_pb")) / F.col("_pb"), "_d": held})
    g = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("_r").alias("mean_ret"), F.stddev_samp("_r").alias("_sd"), F.avg("_d").alias("mean_days"))
    sharpe = F.when((F.col("n_pairs") >= 2) & (F.col("_sd") > 1e-12), F.col("mean_ret") / F.col("_sd") * F.sqrt(252.0 / F.col("mean_days")))
    n = fills.filter(F.col("qty") != 0).groupBy(*group).agg(F.count(F.lit(1)).alias("n_fills"))
    return n.join(g, list(group), "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0))).withColumn("sharpe", sharpe).drop("_sd")
