"""As-of, interval and cross-timeframe joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Frame, bool0, col, div, sign


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str = "ts",
    values: Sequence[str] = (),
    direction: str = "backward",
    split: Column | None = None,
) -> DataFrame:
    """Match each left row with the nearest right row of the key: one union, one shuffle, one sort.

    ``backward`` takes the newest right row at or before the left time, ``forward`` the oldest at or
    after, ``nearest`` the closer of both (backward on a tie). The result adds ``values`` and
    ``matched_ts``. ``split`` is a non-decreasing function of ``on`` (for example the day) that cuts a
    key of unbounded size into buckets; the value entering a bucket is carried by one row per bucket.
    """
    by = list(by)
    keep = [c for c in left.columns]
    payload = F.struct(F.col(on).alias("t"), *[F.col(v) for v in values])
    both = left.select(*keep, F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"), F.lit(1).alias("_side")).unionByName(
        right.select(*by, on, payload.alias("_p"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    parts = list(by)
    if split is not None:
        both = both.withColumn("_cell", split)
        parts.append("_cell")
        edge = both.filter("_side = 0").groupBy(*by, "_cell").agg(
            F.max_by("_p", on).alias("_hi"), F.min_by("_p", on).alias("_lo"))
        cells = both.select(*by, "_cell").distinct().join(edge, [*by, "_cell"], "left")
        w = Window.partitionBy(*by).orderBy("_cell")
        carried = cells.select(
            *by, "_cell",
            F.last("_hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_in_b"),
            F.first("_lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_in_f"),
        )
        both = both.join(carried, parts)
    out: dict[str, Column] = {}
    if direction in ("backward", "nearest"):
        w = Window.partitionBy(*parts).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        b = F.last("_p", ignorenulls=True).over(w)
        out["_b"] = b if split is None else F.coalesce(b, F.col("_in_b"))
    if direction in ("forward", "nearest"):
        w = Window.partitionBy(*parts).orderBy(F.col(on), F.col("_side").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        g = F.first("_p", ignorenulls=True).over(w)
        out["_f"] = g if split is None else F.coalesce(g, F.col("_in_f"))
    both = both.withColumns(out).filter("_side = 1")
    if direction == "backward":
        pick = F.col("_b")
    elif direction == "forward":
        pick = F.col("_f")
    else:
        back = F.abs(F.timestamp_diff("MICROSECOND", F.col("_b.t").cast("timestamp_ntz"), F.col(on).cast("timestamp_ntz")))
        ahead = F.abs(F.timestamp_diff("MICROSECOND", F.col(on).cast("timestamp_ntz"), F.col("_f.t").cast("timestamp_ntz")))
        pick = F.when(F.col("_f").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_f"))
    both = both.withColumn("_pick", pick)
    return both.select(*keep, F.col("_pick.t").alias("matched_ts"), *[F.col(f"_pick.{v}").alias(v) for v in values])


def interval_join(
    points: DataFrame, intervals: DataFrame, by: Sequence[str], on: str, start: str, end: str, unit: str = "month", how: str = "inner"
) -> DataFrame:
    """points whose time lies in [start, end], by an equi join on (key, calendar bucket).

    Each interval is copied to the buckets it covers, so a point meets only intervals of its bucket.
    """
    step = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH", "year": "1 YEAR"}[unit]
    cell = lambda c: F.date_trunc(unit, F.col(c).cast("timestamp"))
    spread = intervals.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end), F.expr(f"INTERVAL {step}"))))
    p = points.withColumn("_cell", cell(on))
    inside = F.col(on).between(F.col(start), F.col(end))
    if how == "inner":
        return p.join(spread, [*by, "_cell"]).filter(inside).drop("_cell")
    s = spread.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_cell").alias("_icell"), *[c for c in intervals.columns if c not in by])
    cond = [F.col(k) == F.col(f"_{k}") for k in by] + [F.col("_cell") == F.col("_icell"), inside]
    joined = p.join(s, cond, how)
    return joined.drop("_cell", "_icell", *[f"_{k}" for k in by])


def near_event(points: DataFrame, events: DataFrame, on: str, event_ts: str, hours: float) -> DataFrame:
    """Is the row within +-hours of any event? Semi join on the bucketed event window."""
    span = F.make_dt_interval(hours=F.lit(int(hours)))
    ranges = events.select((F.col(event_ts) - span).alias("_s"), (F.col(event_ts) + span).alias("_e")).withColumn("_g", F.lit(1))
    p = points.withColumn("_g", F.lit(1))
    hits = interval_join(p.select(on, "_g").distinct(), ranges, ["_g"], on, "_s", "_e", "day").select(on).distinct()
    return points.join(hits.withColumn("in_event_window", F.lit(True)), on, "left").withColumn(
        "in_event_window", bool0(F.col("in_event_window")))


# --- cross-timeframe features ----------------------------------------------------------------------
def slope(df: DataFrame, f: Frame, x: str, n: int, out: str) -> DataFrame:
    """Rolling OLS slope over the row position; windows from 2 rows on count."""
    return df.withColumn("_rn", f.rn()).withColumn(out, f.slope(x, "_rn", n, need=2)).drop("_rn")


def divergence(f: Frame, base: str, ref: str, n: int) -> Column:
    sd = f.std(base, n, need=n // 2)
    return div(F.col(base) - F.col(ref), F.when(sd > 1e-12, sd))


def agreement_flag(f: Frame, a: str, b: str, directional: bool) -> Column:
    """1 where both signs (or both moves) match, 0 where not, NULL without both inputs."""
    x, y = (col(a), col(b)) if directional else (f.diff(a), f.diff(b))
    return (sign(x) * sign(y) > 0).cast("double")


def agreement(df: DataFrame, f: Frame, a: str, b: str, n: int = 20, directional: bool = True, out: str = "agreement", need: int | None = None) -> DataFrame:
    need = min(n, max(5, n // 3)) if need is None else need
    return df.withColumn("_ag", agreement_flag(f, a, b, directional)).withColumn(out, f.mean("_ag", n, need)).drop("_ag")


def crossover(f: Frame, base: str, ref: str) -> Column:
    """+1 / -1 when base crosses above / below ref, 0 otherwise, NULL without a previous row."""
    now = F.col(base) > F.col(ref)
    before = f.lag(base) > f.lag(ref)
    return F.when(now.isNotNull() & before.isNotNull(), F.when(~before & now, 1.0).when(before & ~now, -1.0).otherwise(0.0))


def cross_timeframe(base: DataFrame, ref: DataFrame, keys: Sequence[str], indicator: str, directional: bool, slope_n: int = 5, div_n: int = 20, agree_n: int = 20, ts: str = "ts") -> DataFrame:
    """Align ref onto base as-of, then slopes, divergence, agreement and crossover in one partitioning."""
    aligned = asof_join(
        base.select(*keys, ts, F.col(indicator).alias("base_value")),
        ref.select(*keys, ts, F.col(indicator).alias("ref_value")),
        keys, ts, ["ref_value"],
    ).drop("matched_ts")
    f = Frame(keys, (ts,))
    df = slope(slope(aligned, f, "base_value", slope_n, "base_slope"), f, "ref_value", slope_n, "ref_slope")
    df = df.withColumn("divergence", divergence(f, "base_value", "ref_value", div_n))
    df = agreement(df, f, "base_value", "ref_value", agree_n, directional)
    cross = crossover(f, "base_value", "ref_value") if directional else F.lit(None).cast("double")
    return df.withColumn("crossover", cross)


# Base timeframes and the reference timeframes they are compared with.
CTF_PAIRS: dict[str, tuple[str, ...]] = {
    "1D": ("7D", "14D", "30D", "90D", "180D", "365D"),
    "2D": ("7D", "14D", "30D", "90D", "180D", "365D"),
    "3D": ("7D", "14D", "30D", "90D", "180D", "365D"),
    "7D": ("30D", "90D", "180D", "365D"),
    "14D": ("90D", "180D", "365D"),
    "30D": ("180D", "365D"),
}


def cross_timeframe_all(long: DataFrame, indicators: Mapping[str, bool], pairs: Mapping[str, Sequence[str]], keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Every (base_tf, ref_tf, indicator) of a table with a ``tf`` column as one job.

    The pair list (tens of rows) is broadcast; base and reference rows are keyed by (key, pair,
    indicator), so one as-of pass serves all combinations.
    """
    spark = long.sparkSession
    combos = spark.createDataFrame([(b, r) for b, rs in pairs.items() for r in rs], "base_tf string, ref_tf string")
    tall = long.select(*keys, ts, "tf", F.explode(F.array(*[
        F.struct(F.lit(i).alias("indicator"), F.lit(d).alias("directional"), F.col(i).cast("double").alias("v")) for i, d in indicators.items()
    ])).alias("_i")).select(*keys, ts, "tf", "_i.*").filter("v IS NOT NULL")
    base = tall.join(F.broadcast(combos), tall["tf"] == combos["base_tf"]).drop("tf")
    ref = tall.join(F.broadcast(combos), tall["tf"] == combos["ref_tf"]).drop("tf", "directional")
    k = (*keys, "base_tf", "ref_tf", "indicator")
    al = asof_join(base.withColumnRenamed("v", "base_value"), ref.withColumnRenamed("v", "ref_value"), k, ts, ["ref_value"]).drop("matched_ts")
    f = Frame(k, (ts,))
    df = slope(slope(al, f, "base_value", 5, "base_slope"), f, "ref_value", 5, "ref_slope")
    df = df.withColumn("divergence", divergence(f, "base_value", "ref_value", 20))
    df = df.withColumns({"_d": agreement_flag(f, "base_value", "ref_value", True), "_m": agreement_flag(f, "base_value", "ref_value", False)})
    df = df.withColumn("_ag", F.when(F.col("directional"), F.col("_d")).otherwise(F.col("_m")))
    return df.withColumns(
        {"agreement": f.mean("_ag", 20, 6), "crossover": F.when(F.col("directional"), crossover(f, "base_value", "ref_value"))}
    ).drop("_d", "_m", "_ag")


def ctf_wide(ctf: DataFrame, keys: Sequence[str], names: Sequence[str], values: Sequence[str] = ("ref_value", "divergence", "agreement"), ts: str = "ts") -> DataFrame:
    """Long cross-timeframe rows to one wide row per key and time; ``names`` are '<indicator>_<ref_tf>'."""
    named = ctf.withColumn("_name", F.concat_ws("_", "indicator", "ref_tf"))
    return named.groupBy(*keys, ts).pivot("_name", list(names)).agg(*[F.first(v).alias(v) for v in values])


# --- comovement ------------------------------------------------------------------------------------
def forward_split(df: DataFrame, agree: str, fwd: str, keys: Sequence[str] = ()) -> DataFrame:
    g = df.filter(F.col(agree).isNotNull() & F.col(fwd).isNotNull())
    return g.groupBy(*keys, agree).agg(
        F.count(F.lit(1)).alias("n"), F.avg(fwd).alias("mean"), F.percentile(fwd, 0.5).alias("median"), F.stddev_samp(fwd).alias("std"))


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; NULL for a constant side."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def lagged_corr(df: DataFrame, f: Frame, a: str, b: str, max_lag: int) -> DataFrame:
    """corr(a_t, b_{t-k}) per key for k in [-max_lag, max_lag]; lags are extra columns, not copies of rows."""
    lags = range(-max_lag, max_lag + 1)
    moved = {f"_b{k + max_lag}": (f.lag(b, k) if k > 0 else f.lead(b, -k) if k < 0 else F.col(b)) for k in lags}
    df = df.withColumns(moved)
    g = df.groupBy(*f.keys).agg(*[F.struct(safe_corr(a, c).alias("corr"), F.count(F.when(F.col(a).isNotNull() & F.col(c).isNotNull(), 1)).alias("n")).alias(c) for c in moved])
    items = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_b{k + max_lag}.corr").alias("corr"), F.col(f"_b{k + max_lag}.n").alias("n")) for k in lags])
    return g.select(*f.keys, F.explode(items).alias("_i")).select(*f.keys, "_i.*")


def best_lag(lagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag with the largest |corr|; the smallest lag wins a tie."""
    ranked = lagged.filter("corr IS NOT NULL")
    return ranked.groupBy(*keys).agg(
        F.max_by(F.struct("lag", "corr", "n"), F.struct(F.abs("corr"), -F.col("lag"))).alias("_m")
    ).select(*keys, F.col("_m.lag").alias("best_lag"), F.col("_m.corr").alias("best_corr"), F.col("_m.n").alias("n"))


def pairwise_columns(df: DataFrame, f: Frame, cols: Sequence[str], diff: int = 1) -> DataFrame:
    """Per column pair a<b: Pearson correlation of levels and share of equal direction of change."""
    df = df.withColumns({f"_s_{c}": sign(f.diff(c, diff)) for c in cols})
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    g = df.groupBy(*f.keys).agg(*[
        F.struct(safe_corr(a, b).alias("corr"), F.avg((F.col(f"_s_{a}") == F.col(f"_s_{b}")).cast("double")).alias("agree_rate")).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`.corr").alias("corr"), F.col(f"`{a}|{b}`.agree_rate").alias("agree_rate")) for a, b in pairs])
    return g.select(*f.keys, F.explode(items).alias("_i")).select(*f.keys, "_i.*")


def corr_hierarchy(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns ordered by mean |corr| with the others."""
    both = pairs.select(*keys, F.col("a").alias("col"), "corr").unionByName(pairs.select(*keys, F.col("b").alias("col"), "corr"))
    s = both.groupBy(*keys, "col").agg(F.avg(F.abs("corr")).alias("mean_abs_corr"))
    return s.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean_abs_corr"), "col")))


# --- feature store ---------------------------------------------------------------------------------
def feature_store(base: DataFrame, sources: Mapping[str, DataFrame], on: Sequence[str], max_gap_days: int = 1, ts: str = "ts") -> DataFrame:
    """bars LEFT JOIN each source on the same key; a column the row already has is not replaced."""
    out = base
    for df in sources.values():
        new = [c for c in df.columns if c not in out.columns]
        out = out.join(df.select(*on, *new), list(on), "left")
    f = Frame([k for k in on if k != ts], (ts,))
    flags = [c for c in out.columns if c.endswith("_is_outlier")]
    any_flag = F.coalesce(F.greatest(*[F.col(c) for c in flags], F.lit(False)), F.lit(False)) if flags else F.lit(False)
    return out.withColumns({"has_price_gap": bool0(F.datediff(ts, f.lag(ts)) > max_gap_days), "has_outlier": any_flag})


def source_watermarks(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Oldest of the newest timestamps of the sources: the start of the window that must be rebuilt."""
    out: DataFrame | None = None
    for name, df in sources.items():
        m = df.groupBy(*keys).agg(F.max(ts).alias("w")).withColumn("source", F.lit(name))
        out = m if out is None else out.unionByName(m)
    assert out is not None
    return out.groupBy(*keys).agg(F.min("w").alias("dirty_from"), F.count(F.lit(1)).alias("n_sources"), F.min_by("source", F.struct("w", "source")).alias("slowest"))


def sentiment_mean(long: DataFrame, x: str, by: Sequence[str] = ("ts",), min_assets: int = 3) -> DataFrame:
    m = long.groupBy(*by).agg(F.avg(x).alias("sentiment"), F.count(x).alias("n_assets"))
    return m.withColumn("sentiment", F.when(F.col("n_assets") >= min_assets, F.col("sentiment")))


def relative_value(long: DataFrame, x: str, by: Sequence[str] = ("ts",), min_assets: int = 3) -> DataFrame:
    """Cross-section z with the population deviation; statistics are aggregated, then joined."""
    s = long.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.count(x).alias("n_assets"))
    return long.join(s, list(by)).withColumn(
        "relative_value", F.when(F.col("n_assets") >= min_assets, div(F.col(x) - F.col("_m"), "_s"))).drop("_m", "_s")


def sentiment_pca(long: DataFrame, x: str, assets: Sequence[int] | None = None, by: str = "ts", widest: int = 2000) -> DataFrame:
    """First principal component over assets of the standardised panel (Spark ML on the ts x asset pivot).

    The assets are those of the data (or the given ones); more than ``widest`` raise an error, as the panel's width is the
    model's. A missing value counts as the asset's mean (0 after scaling). A fit: runs Spark jobs while it is called.
    """
    if assets is None:
        assets = sorted(r[0] for r in long.select("id").where("id IS NOT NULL").distinct().limit(widest + 1).collect())
        if len(assets) > widest:
            raise ValueError(f"more than {widest} assets: reduce them to groups first")
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stats = long.groupBy("id").agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    scaled = long.join(stats, "id").withColumn("_z", F.coalesce(div(F.col(x) - F.col("_m"), "_s"), F.lit(0.0)))
    wide = scaled.groupBy(by).pivot("id", list(assets)).agg(F.first("_z")).na.fill(0.0)
    cols = [str(a) for a in assets]
    vec = VectorAssembler(inputCols=cols, outputCol="_vec").transform(wide)
    model = PCA(k=1, inputCol="_vec", outputCol="_pc").fit(vec)
    flip = -1.0 if model.pc.toArray().sum() < 0 else 1.0
    return model.transform(vec).select(by, (vector_to_array("_pc")[0] * flip).alias("pc1"))


def promote_features(ctf_long: DataFrame, ic: DataFrame, min_abs_ic: float, keys: Sequence[str], names: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Keep features whose median |IC| passes, then pivot them into columns."""
    good = ic.groupBy("feature").agg(F.percentile(F.abs("ic"), 0.5).alias("m")).filter(F.col("m") >= min_abs_ic).select("feature")
    kept = ctf_long.join(F.broadcast(good), "feature", "left_semi")
    return kept.groupBy(*keys, ts).pivot("feature", list(names)).agg(F.first(value))


def update_columns(base: DataFrame, updates: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Overwrite some columns of existing rows where an update exists."""
    u = updates.select(*on, *[F.col(c).alias(f"_u_{c}") for c in cols])
    out = base.join(u, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) if c in base.columns else F.col(f"_u_{c}") for c in cols}).drop(*[f"_u_{c}" for c in cols])


def first_fresh_price(targets: DataFrame, tiers: Sequence[tuple[str, DataFrame]], by: Sequence[str], as_of: str, max_age_days: int) -> DataFrame:
    """First price in tier order that is not older than ``max_age_days`` at ``as_of``."""
    out = targets
    for name, df in tiers:
        latest = df.groupBy(*by).agg(F.max_by("price", "ts").alias(f"_p_{name}"), F.max("ts").alias(f"_t_{name}"))
        out = out.join(latest, list(by), "left")
    fresh = lambda n: F.when(F.datediff(as_of, f"_t_{n}") <= max_age_days, F.struct(F.lit(n).alias("tier"), F.col(f"_p_{n}").alias("price")))
    pick = F.coalesce(*[fresh(n) for n, _ in tiers])
    cols = [c for c in targets.columns]
    return out.withColumn("_k", pick).select(*cols, F.col("_k.tier").alias("tier"), F.col("_k.price").alias("price"))


def funding_with_fallback(wanted: DataFrame, rates: DataFrame, minutes: int = 30) -> DataFrame:
    """Exact (venue, symbol, ts) rate, else the mean over venues of the symbol within +-minutes."""
    exact = wanted.join(rates.select("venue", "symbol", "ts", F.col("rate").alias("_exact")), ["venue", "symbol", "ts"], "left")
    span = F.expr(f"INTERVAL {minutes} MINUTES")
    need = exact.filter("_exact IS NULL").select("venue", "symbol", "ts", (F.col("ts") - span).alias("_s"), (F.col("ts") + span).alias("_e"))
    near = interval_join(rates.select("symbol", F.col("ts").alias("_rts"), "rate"), need, ["symbol"], "_rts", "_s", "_e", "day")
    mean = near.groupBy("venue", "symbol", "ts").agg(F.avg("rate").alias("_mean"))
    return exact.join(mean, ["venue", "symbol", "ts"], "left").withColumns(
        {"rate": F.coalesce("_exact", "_mean"), "source": F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_mean").isNotNull(), "cross_venue")}
    ).drop("_exact", "_mean")


def funding_payments(positions: DataFrame, rates: DataFrame, by: Sequence[str], value: str = "position_value", is_short: Column | None = None, ts: str = "ts") -> DataFrame:
    """payment = -(position value) x (latest funding rate); the sign flips for a short."""
    al = asof_join(positions, rates.select(*by, ts, "rate"), by, ts, ["rate"])
    side = F.lit(1.0) if is_short is None else F.when(is_short, -1.0).otherwise(1.0)
    return al.withColumn("payment", -F.col(value) * F.coalesce("rate", F.lit(0.0)) * side)
