"""Information coefficients, quintiles, multiple testing, selection and importance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Col, Frame, col, div
from tideline.functions.numeric import norm_ppf, norm_sf2
from tideline.operators import gram
from tideline.operators.asof import safe_corr
from tideline.operators.resample import bootstrap_correlations, permutation_test
from tideline.plans.segments import group_rank
from tideline.session import checkpoint_dir


def average_rank(x: Col, by: Sequence[str]) -> Column:
    """Average-tie rank within a bounded group by windows (use ``group_rank`` for large groups)."""
    w = Window.partitionBy(*by)
    r = F.rank().over(w.orderBy(col(x)))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, col(x)))
    return r + (ties - 1) / 2.0


def long_features(df: DataFrame, keys: Sequence[str], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    return df.select(*keys, *keep, F.explode(items).alias("_i")).select(*keys, *keep, "_i.*")


def with_forward(df: DataFrame, f: Frame, horizons: Sequence[int], types: Sequence[str] = ("arith",), close: str = "close") -> DataFrame:
    cols = {}
    for h in horizons:
        for t in types:
            cols[f"fwd_{t}_{h}"] = f.forward_return(close, h, log=t == "log")
    return df.withColumns(cols)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, min_obs: int = 20) -> DataFrame:
    """Spearman IC, t and p per group; ranks are split-group counts, so a group may be of any size."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    rx = group_rank(d, by, x).withColumnRenamed("rank_avg", "_rx").drop("rank_min", "group_n")
    ry = group_rank(rx, by, y).withColumnRenamed("rank_avg", "_ry").drop("rank_min", "group_n")
    g = ry.groupBy(*by).agg(safe_corr("_rx", "_ry").alias("ic"), F.count(F.lit(1)).alias("n_obs"))
    return ic_tests(g.withColumn("ic", F.when(F.col("n_obs") >= min_obs, F.col("ic"))))


def spearman_windows(df: DataFrame, by: Sequence[str], x: str, y: str, min_obs: int = 20) -> DataFrame:
    """Same by plain rank windows: cheaper when the group is a bar history of one key (calendar bound)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumns({"_rx": average_rank(x, by), "_ry": average_rank(y, by)})
    g = d.groupBy(*by).agg(safe_corr("_rx", "_ry").alias("ic"), F.count(F.lit(1)).alias("n_obs"))
    return ic_tests(g.withColumn("ic", F.when(F.col("n_obs") >= min_obs, F.col("ic"))))


def ic_tests(df: DataFrame) -> DataFrame:
    ic, n = F.col("ic"), F.col("n_obs")
    t = ic * F.sqrt(F.greatest(n - 2, F.lit(0))) / F.sqrt(F.greatest(1 - ic * ic, F.lit(1e-15)))
    df = df.withColumn("t_stat", F.when(ic.isNotNull(), t))
    return df.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), norm_sf2("t_stat")))


def ic_table(df: DataFrame, f: Frame, features: Sequence[str], horizons: Sequence[int], train: tuple[str, str], types: Sequence[str] = ("arith",), tf_days: int = 1, by: Sequence[str] = (), min_obs: int = 20) -> DataFrame:
    """IC per (key, extra groups, feature, horizon, return type) in one job.

    Forward returns come from the whole series; a row whose horizon ends after the train window is left
    out, as is everything outside the window.
    """
    ts = f.order[0]
    d = with_forward(df, f, horizons, types)
    end = F.lit(train[1]).cast("timestamp_ntz")
    d = d.filter((F.col(ts) >= F.lit(train[0]).cast("timestamp_ntz")) & (F.col(ts) <= end))
    tall = long_features(d, f.keys, features, [ts, *by, *[f"fwd_{t}_{h}" for t in types for h in horizons]])
    targets = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(t).alias("ret_type"), F.when(F.col(ts) + F.expr(f"INTERVAL {h * tf_days} DAYS") <= end, F.col(f"fwd_{t}_{h}")).alias("y"))
        for t in types for h in horizons])
    tall = tall.withColumn("_t", F.explode(targets)).select(*f.keys, *by, ts, "feature", "x", "_t.*")
    return spearman_windows(tall, [*f.keys, *by, "feature", "horizon", "ret_type"], "x", "y", min_obs)


def rolling_ic(df: DataFrame, f: Frame, x: str, y: str, n: int = 63) -> DataFrame:
    """Rank inside a window, then correlate the ranks over a window again (first value at row 2n-1)."""
    df = df.withColumns({"_rx": f.window_rank(x, n, n), "_ry": f.window_rank(y, n, n)})
    return df.withColumn("rolling_ic", f.corr("_rx", "_ry", n)).drop("_rx", "_ry")


def rolling_spearman(df: DataFrame, f: Frame, x: str, y: str, n: int = 63) -> DataFrame:
    """True Spearman of the last n pairs: ranks of both lists of the same window."""

    @F.pandas_udf(T.DoubleType())
    def corr(a: pd.Series, b: pd.Series) -> pd.Series:
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
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    full = F.count(F.when(both, 1)).over(w) == n
    df = df.withColumns({"_a": F.when(full, F.collect_list(x).over(w)), "_b": F.when(full, F.collect_list(y).over(w))})
    return df.withColumn("rolling_spearman", corr("_a", "_b")).drop("_a", "_b")


def ic_ir(df: DataFrame, keys: Sequence[str], ic: str = "rolling_ic", min_n: int = 5) -> DataFrame:
    g = df.filter(F.col(ic).isNotNull()).groupBy(*keys).agg(F.avg(ic).alias("ic_mean"), F.stddev_samp(ic).alias("ic_std"), F.count(ic).alias("n_ic"))
    ok = F.col("n_ic") >= min_n
    return g.withColumns({"ic_ir": F.when(ok, div("ic_mean", "ic_std")), "ic_ir_t": F.when(ok, div(F.col("ic_mean") * F.sqrt("n_ic"), "ic_std"))})


def feature_turnover(df: DataFrame, f: Frame, x: str, min_obs: int = 20) -> DataFrame:
    """1 - rank autocorrelation at lag 1 (ranks of the two shifted pieces are ranked again)."""
    d = df.filter(F.col(x).isNotNull()).withColumn("_p", f.lag(x))
    n = d.groupBy(*f.keys).agg(F.count(F.lit(1)).alias("_n"))
    s = spearman_windows(d.filter("_p IS NOT NULL"), f.keys, "_p", x, 2)
    return s.join(n, list(f.keys)).select(*f.keys, F.when(F.col("_n") >= min_obs, 1 - F.col("ic")).alias("turnover"))


# --- quintiles -------------------------------------------------------------------------------------
def quintile_returns(df: DataFrame, f: Frame, factor: str, horizon: int = 1, min_assets: int = 5, ts: str = "ts") -> DataFrame:
    """Mean forward return of each factor quintile per date, its compounding, and Q5 - Q1.

    The quintile of rank r of n is max(1, ceil(5 (r-1)/(n-1))), ties in id order.
    """
    d = df.withColumn("_fr", f.forward_return("close", horizon)).filter(F.col(factor).isNotNull())
    n = d.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(ts).orderBy(factor, *f.keys))).join(n, ts).filter(F.col("_n") >= min_assets)
    q = F.greatest(F.ceil(5.0 * (F.col("_r") - 1) / (F.col("_n") - 1)), F.lit(1)).cast("int")
    d = d.withColumn("quintile", q).filter("_fr IS NOT NULL")
    p = d.groupBy(ts).pivot("quintile", [1, 2, 3, 4, 5]).agg(F.avg("_fr"))
    p = p.select(ts, *[F.col(str(i)).alias(f"q{i}") for i in range(1, 6)]).dropna()
    return p


def cumulative_quintiles(p: DataFrame, ts: str = "ts") -> DataFrame:
    """Compounded quintile returns over dates (one row per date: bounded by the calendar)."""
    w = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grow = lambda c: F.exp(F.sum(F.log1p(F.when(F.col(c) > -1, F.col(c)))).over(w))
    out = p.withColumns({f"cum_q{i}": grow(f"q{i}") for i in range(1, 6)})
    return out.withColumn("long_short", F.col("cum_q5") - F.col("cum_q1"))


def monotonicity(cum: DataFrame) -> DataFrame:
    """Correlation of the quintile number and the rank of its growth; equal growths share their smallest rank, as ``rank()`` in SQL.

    Growths are compared by their logarithms: over many dates the compounded returns themselves leave the double range and would tie
    at infinity or zero. No date, or equal growth in all quintiles, gives NaN.
    """
    q = lambda i: F.col(f"q{i}")
    log = lambda i: F.when(q(i) > -1, F.log(1 + q(i))).otherwise(F.when(q(i) == -1, -math.inf).otherwise(math.nan))
    sums = cum.agg(F.array(*[F.sum(log(i)) for i in range(1, 6)]).alias("v"))
    rows = sums.select(F.posexplode("v").alias("pos", "x")).withColumn("_r", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.col("x").asc_nulls_last())))
    return rows.agg(F.coalesce(safe_corr("pos", "_r"), F.lit(math.nan)).alias("monotonicity"))


# --- tests -----------------------------------------------------------------------------------------
def fdr(df: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = (), block: int = 65_536) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within the family, for families of any size.

    Ranks come from the split counter; the minimum from the end runs inside rank blocks and over the few
    block minima.
    """
    by = [*by] or ["_family"]
    d = df.filter(F.col(p).isNotNull())
    if by == ["_family"]:
        d = d.withColumn("_family", F.lit(1))
    d = group_rank(d, by, p).withColumn("_k", 2 * F.col("rank_avg") - F.col("rank_min"))
    d = d.withColumns({"_q": F.col(p) * F.col("group_n") / F.col("_k"), "_blk": F.floor(F.col("_k") / block)})
    mins = d.groupBy(*by, "_blk").agg(F.min("_q").alias("_bm"))
    later = Window.partitionBy(*by).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    mins = mins.withColumn("_later", F.min("_bm").over(later)).drop("_bm")
    inner = Window.partitionBy(*by, "_blk").orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(mins, [*by, "_blk"]).withColumn("p_adj", F.least(F.min("_q").over(inner), "_later", F.lit(1.0)))
    return d.withColumn("significant", F.col("p_adj") <= alpha).drop("_k", "_q", "_blk", "_later", "_family", "rank_min", "rank_avg", "group_n")


def bh_gate(df: DataFrame, by: Sequence[str], alpha: float = 0.05, min_rate: float = 0.3) -> DataFrame:
    return fdr(df, by=by, alpha=alpha).groupBy(*by).agg(F.avg(F.col("significant").cast("double")).alias("pass_rate"), F.count(F.lit(1)).alias("n_tests")).withColumn(
        "promoted", F.col("pass_rate") >= min_rate)


def haircut_sharpe(sr: Col, n_trials: Col, n_obs: Col, periods: float = 252.0) -> Column:
    """Bonferroni haircut: the Sharpe whose p-value is n_trials times the observed one (zero if p >= 1)."""
    t = col(sr) / math.sqrt(periods) * F.sqrt(col(n_obs))
    p = F.least(norm_sf2(t) * col(n_trials), F.lit(1.0))
    back = norm_ppf(1 - p / 2)
    return F.when(p >= 1, F.lit(0.0)).otherwise(F.signum(col(sr)) * F.least(back, F.abs(t)) / F.sqrt(col(n_obs)) * math.sqrt(periods))


def permutation_ic(df: DataFrame, by: Sequence[str], x: str, y: str, order: Sequence[str] = ("ts",), perms: int = 10_000, seed: int = 11) -> DataFrame:
    """ic, n_obs, n_perms and the p-value of |IC| among permuted pairings ((hits + 1) / (perms + 1)).

    Rows are numbered in their group and never multiplied by the replicates: see ``resample.permutation_test``.
    """
    by = list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = d.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    g = permutation_test(d, by, "_pos", perms, seed)
    return g.select(*by, "ic", "n_obs", F.lit(perms).alias("n_perms"), ((F.round(F.col("p_value") * perms) + 1) / F.lit(perms + 1)).alias("perm_p"))


def block_bootstrap_ic(df: DataFrame, by: Sequence[str], x: str, y: str, order: Sequence[str] = ("ts",), boots: int = 1000, block: float = 10.0, seed: int = 5, level: float = 0.95) -> DataFrame:
    """Confidence band of the IC from a stationary block bootstrap: all replicates of a group (a bar history) in one pass."""
    by = list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    schema = T.StructType([d.schema[c] for c in by] + [T.StructField("ic_lo", T.DoubleType()), T.StructField("ic_hi", T.DoubleType()), T.StructField("n_boot", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        c = bootstrap_correlations(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), boots, block, seed)
        c = c[np.isfinite(c)]
        band = np.quantile(c, [(1 - level) / 2, (1 + level) / 2]).tolist() if len(c) else [None, None]
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in by} | {"ic_lo": [band[0]], "ic_hi": [band[1]], "n_boot": [len(c)]})

    return d.groupBy(*by).applyInPandas(run, schema)


def stability(df: DataFrame, f: Frame, x: str, y: str, windows: int = 5, max_flips: int = 1, max_cv: float = 2.0, min_obs: int = 20) -> DataFrame:
    """IC over contiguous pieces of the history: sign flips and coefficient of variation."""
    from tideline.operators.evaluate import with_folds

    d = with_folds(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), f, windows)
    ics = spearman_windows(d, [*f.keys, "fold"], x, y, min_obs).filter("ic IS NOT NULL")
    w = Frame(f.keys, ("fold",))
    ics = ics.withColumn("_fl", (F.signum("ic") != F.signum(w.lag("ic"))).cast("int"))
    g = ics.groupBy(*f.keys).agg(F.sum("_fl").alias("sign_flips"), F.avg("ic").alias("ic_mean"), F.abs(div(F.stddev_samp("ic"), F.avg("ic"))).alias("ic_cv"), F.count(F.lit(1)).alias("n_windows"))
    return g.withColumn("stable", F.coalesce((F.col("sign_flips") <= max_flips) & (F.col("ic_cv") <= max_cv), F.lit(False)))


# --- sweeps and selection --------------------------------------------------------------------------
def plateau(trials: DataFrame, params: Sequence[str], score: str, by: Sequence[str] = (), radius: float = 0.34, threshold: float = 0.8) -> DataFrame:
    """Share of the best point's grid neighbours whose score is within ``threshold`` of it."""
    w = Window.partitionBy(*by)
    d = trials
    for p in params:
        d = d.withColumn(f"_n_{p}", F.coalesce(div(F.col(p) - F.min(p).over(w), F.max(p).over(w) - F.min(p).over(w)), F.lit(0.0)))
    best = d.withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.abs(score)), *params))).filter("_r = 1").select(
        *by, *[F.col(f"_n_{p}").alias(f"_b_{p}") for p in params], F.col(score).alias("_bs"), *[F.col(p).alias(f"best_{p}") for p in params])
    j = d.join(F.broadcast(best), list(by)) if by else d.crossJoin(F.broadcast(best))
    dist = F.greatest(*[F.abs(F.col(f"_n_{p}") - F.col(f"_b_{p}")) for p in params], F.lit(0.0))
    near = j.withColumn("_d", dist).filter((F.col("_d") <= radius) & (F.col("_d") > 0))
    ok = (F.signum(score) == F.signum("_bs")) & (F.abs(score) >= threshold * F.abs("_bs"))
    return near.groupBy(*by, *[f"best_{p}" for p in params], F.col("_bs").alias("best_score")).agg(F.avg(ok.cast("double")).alias("plateau"), F.count(F.lit(1)).alias("n_neighbours"))


def window_sweep(df: DataFrame, f: Frame, x: str, y: str, lengths: Sequence[int], feature) -> DataFrame:
    """IC of a parametrised feature for every length: all variants are columns of one pass."""
    df = df.withColumns({f"_f{n}": feature(f, x, n) for n in lengths})
    items = F.array(*[F.struct(F.lit(n).alias("length"), F.col(f"_f{n}").alias("x")) for n in lengths])
    tall = df.select(*f.keys, *f.order, F.col(y).alias("y"), F.explode(items).alias("_i")).select(*f.keys, *f.order, "y", "_i.*")
    return spearman_windows(tall, [*f.keys, "length"], "x", "y")


def best_of_sweep(swept: DataFrame, keys: Sequence[str], param: str = "length", min_abs_ic: float = 0.0) -> DataFrame:
    d = swept.filter(F.abs("ic") >= min_abs_ic)
    return d.groupBy(*keys).agg(F.max_by(F.struct(param, "ic", "p_value"), F.struct(F.abs("ic"), -F.col(param))).alias("_b")).select(*keys, "_b.*")


def feature_tier(ic_ir_mean: Col, pass_rate: Col, stationary: Col, perm_p: Col, cutoff: float = 1.0) -> Column:
    """active / conditional / watch / archive."""
    need = F.when(col(stationary), F.lit(cutoff)).otherwise(cutoff * 1.5)
    v = F.abs(col(ic_ir_mean))
    tier = F.when((v >= need) & (col(pass_rate) >= 0.30), "active").when((v >= need) | ((v >= 0.5 * need) & (col(pass_rate) >= 0.30)), "conditional").when(v >= 0.10, "watch").otherwise("archive")
    return F.when(v.isNull(), "archive").when(col(perm_p) >= 0.15, "archive").when((col(perm_p) >= 0.05) & tier.isin("active", "conditional"), "watch").otherwise(tier)


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every column pair as rows, in one aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    g = df.groupBy(*by).agg(*[safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return g.select(*by, F.explode(items).alias("_i")).select(*by, "_i.*")


def redundant(matrix: DataFrame, limit: float = 0.9) -> DataFrame:
    return matrix.filter((F.col("a") < F.col("b")) & (F.abs("corr") >= limit))


def target_ranking(df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    g = df.groupBy(*by).agg(*[safe_corr(c, y).alias(c) for c in features])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in features])
    t = g.select(*by, F.explode(items).alias("_i")).select(*by, "_i.*")
    return t.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("corr")), "feature")))


def connected_features(pairs: DataFrame, names: DataFrame, limit: float) -> DataFrame:
    """Clusters of features linked by |corr| >= limit: the smallest label reachable.

    Rounds take the smallest label of the neighbours and then the label of that label, until no label changes; paths
    shrink by half each round. Nodes are features, not data rows. Each round is checkpointed once (it is read three
    times). Runs Spark jobs while it is called.
    """
    checkpoint_dir(pairs.sparkSession)
    e = pairs.filter(F.abs("corr") >= limit).select("a", "b")
    edges = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    lab = names.select(F.col("feature"), F.col("feature").alias("cluster")).checkpoint()
    while True:
        near = edges.join(lab.withColumnRenamed("feature", "b"), "b").groupBy(F.col("a").alias("feature")).agg(F.min("cluster").alias("_m"))
        step = lab.withColumnRenamed("cluster", "_old").join(near, "feature", "left").select("feature", "_old", F.least("_old", F.coalesce("_m", "_old")).alias("cluster"))
        jump = step.select(F.col("feature").alias("cluster"), F.col("cluster").alias("_j"))
        moved = step.join(jump, "cluster").select("feature", "_old", F.col("_j").alias("cluster")).checkpoint()
        lab = moved.select("feature", "cluster")
        if not moved.filter("cluster <> _old").limit(1).count():
            return lab


# --- decay and drift -------------------------------------------------------------------------------
def ic_staleness(df: DataFrame, f: Frame, features: Sequence[str], y: str, recent: int, decay: float = 0.5) -> DataFrame:
    """Recent IC against the whole history; a weight override of 0.5 where it decayed or flipped."""
    d = df.withColumn("_back", F.row_number().over(Window.partitionBy(*f.keys).orderBy(F.col(f.order[0]).desc())))
    tall = long_features(d, f.keys, features, [*f.order, y, "_back"])
    whole = spearman_windows(tall, [*f.keys, "feature"], "x", y).select(*f.keys, "feature", F.col("ic").alias("ic_long"))
    new = spearman_windows(tall.filter(F.col("_back") <= recent), [*f.keys, "feature"], "x", y).select(*f.keys, "feature", F.col("ic").alias("ic_recent"))
    j = whole.join(new, [*f.keys, "feature"], "left")
    stale = (F.signum("ic_recent") != F.signum("ic_long")) | (F.abs("ic_recent") < decay * F.abs("ic_long"))
    return j.withColumn("weight_factor", F.when(F.coalesce(stale, F.lit(False)), 0.5).otherwise(1.0))


def concordance(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Spearman between two rankings of the same features."""
    j = a.select(key, F.col(x).alias("_x")).join(b.select(key, F.col(y).alias("_y")), key).withColumn("g", F.lit(1))
    return spearman_windows(j, ["g"], "_x", "_y", 3).select("ic", "n_obs").withColumnRenamed("ic", "concordance")


def lead_lag_ic(df: DataFrame, f: Frame, x: str, horizons: Sequence[int], ts: str = "ts", min_obs: int = 20, per_block: int = 32) -> DataFrame:
    """IC of leader feature against follower forward return for every ordered pair and horizon, with FDR.

    Pairs of blocks of ids are ranked in a task (``gram.rank_ic``); rows of all ids never meet on a timestamp.
    """
    ys = [f"_y{h}" for h in horizons]
    d = df.select("id", ts, x, *[f.forward_return("close", h).alias(y) for h, y in zip(horizons, ys)])
    ic = gram.rank_ic(d, d, x, ys, horizons, ts, per_block)
    return fdr(ic_tests(ic.withColumn("ic", F.when(F.col("n_obs") >= min_obs, F.col("ic")))))


def coverage(expected: DataFrame, present: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of expected rows that are present."""
    have = present.select(*keys).distinct().withColumn("_h", F.lit(1))
    return expected.select(*keys).distinct().join(have, list(keys), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected"), F.count("_h").alias("present")).withColumn("coverage", div("present", "expected"))


def ljung_box_from_ic(df: DataFrame, f: Frame, ic: str, lags: int = 10) -> DataFrame:
    from tideline.operators.volatility import ljung_box

    return ljung_box(df, f, ic, (lags,))


def ndcg(df: DataFrame, by: Sequence[str], score: str, gain: str, k: int = 10) -> DataFrame:
    """Normalised discounted gain of the top k by score per date (gains shifted to be non-negative)."""
    w = Window.partitionBy(*by)
    d = df.filter(F.col(score).isNotNull() & F.col(gain).isNotNull()).withColumn("_g", F.col(gain) - F.min(gain).over(w))
    d = d.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(score), "id")), "_i": F.row_number().over(w.orderBy(F.desc("_g"), "id"))})
    disc = lambda r: F.lit(1.0) / F.log2(F.col(r) + 1.0)
    g = d.groupBy(*by).agg(F.sum(F.when(F.col("_r") <= k, F.col("_g") * disc("_r"))).alias("_dcg"), F.sum(F.when(F.col("_i") <= k, F.col("_g") * disc("_i"))).alias("_ideal"))
    return g.select(*by, div("_dcg", "_ideal").alias("ndcg"))


def compare_experiments(df: DataFrame, run: str, metric: str, value: str, runs: Sequence[str]) -> DataFrame:
    return df.groupBy(metric).pivot(run, list(runs)).agg(F.first(value))


def threshold_impact(df: DataFrame, prob: str, ret: str, thresholds: Sequence[float]) -> DataFrame:
    """Trades kept, hit rate and mean return for each probability threshold, in one aggregate."""
    aggs = []
    for i, t in enumerate(thresholds):
        keep = F.col(prob) >= t
        aggs.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(keep).alias("n_kept"), F.avg(F.when(keep, (F.col(ret) > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(keep, F.col(ret))).alias("mean_ret")).alias(f"t{i}"))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"t{i}") for i in range(len(thresholds))])).alias("_i")).select("_i.*")


