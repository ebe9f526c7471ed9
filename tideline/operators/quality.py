"""Checks over bar, EMA, return and feature tables; comparisons and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, bool0, col


def bar_violations(bars: DataFrame, keys: Sequence[str] = ("id", "tf"), ts: str = "ts", max_gap_days: int = 1, dim: DataFrame | None = None) -> DataFrame:
    """One row per (bar, reason): gaps, order, sequence, OHLC, length bounds and partial policy."""
    f = Frame(keys, (ts,))
    df = bars.withColumns({"_pts": f.lag(ts), "_pseq": f.lag("bar_seq"), "_prow": F.count(F.lit(1)).over(Window.partitionBy(*keys, ts))})
    rules: list[tuple[str, Column]] = [
        ("GAP", F.datediff(ts, "_pts") > max_gap_days),
        ("DUPLICATE_TS", F.col("_prow") > 1),
        ("BAR_SEQ_GAP", F.col("bar_seq") > F.col("_pseq") + 1),
        ("NON_MONOTONIC", F.col("bar_seq") < F.col("_pseq")),
        ("OHLC_INVALID", (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))),
    ]
    if "time_open" in bars.columns:
        rules.append(("OVERLAP", F.col("time_open") < F.col("_pts")))
    if dim is not None:
        d = F.broadcast(dim.select("tf", "tf_days_min", "tf_days_max", "allow_partial_start").dropDuplicates(["tf"]))
        df = df.join(d, "tf", "left")
        rules.append(("TF_DAYS_BOUNDS", ~F.col("tf_days").between(F.col("tf_days_min"), F.col("tf_days_max"))))
        if "is_partial_start" in bars.columns:
            rules.append(("PARTIAL_NOT_ALLOWED", F.col("is_partial_start") & ~F.col("allow_partial_start")))
    codes = F.filter(F.array(*[F.when(bool0(c), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return df.withColumn("reason", F.explode(codes)).select(*keys, ts, "reason")


def violation_summary(v: DataFrame, keys: Sequence[str] = ("id", "tf"), ts: str = "ts", examples: int = 3) -> DataFrame:
    """Count and the earliest examples per reason; examples are cut before they are collected."""
    counts = v.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col(ts).cast("string"))
    t = v.withColumns({"_k": key, "_sl": F.pmod(F.xxhash64(*keys), F.lit(32))})
    a = t.withColumn("_r", F.row_number().over(Window.partitionBy("reason", "_sl").orderBy("_k"))).filter(F.col("_r") <= examples)
    b = a.withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy("_k"))).filter(F.col("_r") <= examples)
    ex = b.groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("_k")), ";").alias("examples"))
    return counts.join(ex, "reason")


def unknown_timeframes(df: DataFrame, dim: DataFrame) -> DataFrame:
    return df.select("tf").distinct().join(dim.select("tf").distinct(), "tf", "left_anti")


def price_bounds(bars: DataFrame, keys: Sequence[str] = ("id",), lookback: int = 90, low: float = 0.5, high: float = 2.0, ts: str = "ts") -> DataFrame:
    last = bars.groupBy(*keys).agg(F.max(ts).alias("_m"))
    r = bars.join(last, list(keys)).filter(F.datediff("_m", ts) <= lookback)
    return r.groupBy(*keys).agg((F.min("close") * low).alias("lo"), (F.max("close") * high).alias("hi"))


def statistical_bounds(df: DataFrame, keys: Sequence[str], x: str, k: float = 3.0) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(x) - k * F.stddev_samp(x)).alias("slo"), (F.avg(x) + k * F.stddev_samp(x)).alias("shi"))


def ema_violations(df: DataFrame, x: str, bounds: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NULL, infinite, outside the price bounds or outside the statistical bounds."""
    j = df.join(bounds, list(keys), "left").join(stats, list(keys), "left")
    v = F.col(x)
    rules = [("null", v.isNull() | F.isnan(v)), ("infinite", F.abs(v) == float("inf")), ("price_bounds", (v < F.col("lo")) | (v > F.col("hi"))), ("statistical_bounds", (v < F.col("slo")) | (v > F.col("shi")))]
    codes = F.filter(F.array(*[F.when(bool0(c), F.lit(n)) for n, c in rules]), lambda c: c.isNotNull())
    return j.withColumn("violation", F.explode(codes)).select(*df.columns, "violation")


def expected_closes(start: Col, end: Col, tf_days: Col) -> Column:
    """Canonical closes of a tf_days grid inside an inclusive day span."""
    return F.floor((F.datediff(col(end), col(start)) + 1) / col(tf_days)).cast("bigint")


def rowcount_report(df: DataFrame, keys: Sequence[str], start: Column, end: Column, tf_days: str = "tf_days", canonical: Col | None = None) -> DataFrame:
    ok = F.lit(True) if canonical is None else col(canonical)
    g = df.groupBy(*keys).agg(F.count_if(ok).alias("actual"), F.first(tf_days).alias("_d"))
    g = g.withColumn("expected", expected_closes(start, end, "_d")).drop("_d")
    return g.withColumn("diff", F.col("actual") - F.col("expected")).withColumn("status", F.when(F.col("diff") == 0, "ok").when(F.col("diff") < 0, "missing").otherwise("extra"))


def status_of(value: Col, warn: float, fail: float) -> Column:
    return F.when(col(value) > fail, "FAIL").when(col(value) > warn, "WARN").otherwise("PASS")


def table_tests(df: DataFrame, keys: Sequence[str], unique: Sequence[str], not_null: Sequence[str], ranges: Mapping[str, tuple[float, float]], max_gap_days: int, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """PASS / WARN / FAIL rows with a JSON detail: key uniqueness, null rates, ranges, gaps.

    All counts of a ``by`` group come from two aggregates over the table.
    """
    f = Frame(keys, (ts,))
    d = df.withColumn("_g", F.datediff(ts, f.lag(ts)))
    dup = df.groupBy(*by, *[k for k in unique if k not in by]).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("dups"))
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_g") > max_gap_days).alias("gaps"), F.max("_g").alias("max_gap"),
        *[(F.count(F.lit(1)) - F.count(c)).alias(f"null_{c}") for c in not_null],
        *[F.count_if(~F.col(c).between(a, b)).alias(f"out_{c}") for c, (a, b) in ranges.items()])
    g = agg.join(dup, list(by))
    tests = [("unique_key", F.col("dups"), 0, 0), ("gaps", F.col("gaps"), 0, 10**9)]
    tests += [(f"not_null_{c}", F.col(f"null_{c}"), 0, 0) for c in not_null] + [(f"range_{c}", F.col(f"out_{c}"), 0, 0) for c in ranges]
    items = F.array(*[F.struct(F.lit(n).alias("test"), v.cast("bigint").alias("failing"), status_of(v, w, x).alias("status"), F.to_json(F.struct(F.col("n").alias("rows"), v.cast("bigint").alias("failing"))).alias("detail")) for n, v, w, x in tests])
    return g.select(*by, F.explode(items).alias("_i")).select(*by, "_i.*")


def anchor_boundary_misses(bars: DataFrame, keys: Sequence[str], start: str = "period_start", end: str = "period_end", ts: str = "ts") -> DataFrame:
    """Expected period starts between the first and last bar of a key that have no bar."""
    per = bars.select(*keys, start, end).distinct()
    f = Frame(keys, (start,))
    j = per.withColumn("_next", f.lead(start)).filter(F.col("_next") > F.date_add(end, 1))
    return j.select(*keys, F.date_add(end, 1).alias("gap_from"), F.date_sub("_next", 1).alias("gap_to"))


def weekly_delta(tests: DataFrame, ts: str, this_week: Column) -> DataFrame:
    """Status counts of this week and the week before, and their difference."""
    d = F.datediff(this_week, F.col(ts).cast("date"))
    g = tests.groupBy("status").agg(F.count_if((d >= 0) & (d < 7)).alias("this_week"), F.count_if((d >= 7) & (d < 14)).alias("last_week"))
    return g.withColumn("delta", F.col("this_week") - F.col("last_week"))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], abs_tol: float = 1e-6, rel_tol: float = 1e-5) -> DataFrame:
    """Per column: matches and mismatches within |a-b| <= abs + rel |b| (NULL equals NULL), one-sided rows."""
    j = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols], F.lit(1).alias("_a")).join(
        b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(1).alias("_b")), list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def bad(c: str) -> Column:
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        nulls = x.isNull() != y.isNull()
        return both & (nulls | bool0(F.abs(x - y) > abs_tol + rel_tol * F.abs(y)))

    g = j.agg(F.count_if(both).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
              *[F.count_if(bad(c)).alias(f"m_{c}") for c in cols], *[F.max(F.when(both, F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")))).alias(f"d_{c}") for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("mismatches"), F.col(f"d_{c}").alias("max_diff")) for c in cols])
    return g.select("n_both", "only_a", "only_b", F.explode(items).alias("_i")).select("n_both", "only_a", "only_b", "_i.*")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "table_name", value: str = "n_rows") -> DataFrame:
    j = old.select(key, F.col(value).alias("before")).join(new.select(key, F.col(value).alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return j.withColumns({"change": change, "delta": F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))})


def canonical_gate(bars: DataFrame, keys: Sequence[str], roll: str, close: str = "close", ts: str = "ts") -> DataFrame:
    """Failing counts only (no rows = pass): duplicate canonical rows, NULL canonical closes, bars never closed."""
    c = bars.filter(~F.col(roll))
    dup = c.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n")).withColumn("check_name", F.lit("duplicate_canonical"))
    nul = c.agg(F.count_if(F.col(close).isNull()).alias("n")).withColumn("check_name", F.lit("null_canonical_close"))
    w = Window.partitionBy(*keys)
    per = bars.groupBy(*keys, "bar_seq").agg(F.count_if(~F.col(roll)).alias("_c")).withColumn("_last", F.max("bar_seq").over(w))
    orphan = per.filter((F.col("_c") == 0) & (F.col("bar_seq") < F.col("_last"))).agg(F.count(F.lit(1)).alias("n")).withColumn("check_name", F.lit("preview_without_close"))
    return dup.unionByName(nul).unionByName(orphan).filter("n > 0").select("check_name", "n")


def set_differences(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit("only_a"))
    y = b.select(*cols).exceptAll(a.select(*cols)).withColumn("side", F.lit("only_b"))
    return x.unionByName(y)


def first_last_changes(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """NULL-safe comparison of each key's first and last row in two tables."""
    ends = lambda d, t: d.groupBy(*keys).agg(*[F.min_by(c, ts).alias(f"{t}f_{c}") for c in (*cols, ts)], *[F.max_by(c, ts).alias(f"{t}l_{c}") for c in (*cols, ts)])
    j = ends(a, "a").join(ends(b, "b"), list(keys), "full")
    same = lambda e: ~F.array_contains(F.array(*[F.col(f"a{e}_{c}").eqNullSafe(F.col(f"b{e}_{c}")) for c in (*cols, ts)]), False)
    return j.select(*keys, same("f").alias("first_same"), same("l").alias("last_same"))


def missing_days(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Calendar days between the first and last row of a key without a row: gaps are expanded, not the span."""
    f = Frame(keys, ("day",))
    d = df.select(*keys, F.col(ts).cast("date").alias("day")).distinct().withColumn("_n", f.lead("day"))
    g = d.filter(F.datediff("_n", "day") > 1)
    return g.select(*keys, F.explode(F.sequence(F.date_add("day", 1), F.date_sub("_n", 1), F.expr("INTERVAL 1 DAY"))).alias("missing_day"))


def grouped_names(df: DataFrame, by: Sequence[str], name: str, sep: str = ", ") -> DataFrame:
    """Ordered string aggregate of the distinct names of a group, for groups with more than one."""
    g = df.select(*by, name).distinct().groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(name)), sep).alias("names"), F.count(F.lit(1)).alias("n"))
    return g.filter("n > 1")


def edge_sample(df: DataFrame, keys: Sequence[str], begin_days: int, end_days: int, pct: float, seed: int = 1, ts: str = "ts") -> DataFrame:
    """Rows near both ends of each key plus a seeded share of the middle, tagged by stratum."""
    g = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.date_format(ts, "yyyy-MM-dd"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("bigint") % 10_000 / 10_000.0
    s = F.when(F.datediff(ts, "_a") < begin_days, "beginning").when(F.datediff("_b", ts) < end_days, "end").when(u < pct / 100.0, "random")
    return df.join(g, list(keys)).withColumn("stratum", s).filter("stratum IS NOT NULL").drop("_a", "_b")


def log_gap_audit(checks: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """(check, expected rows without a matching log row) per named pair of tables."""
    out: DataFrame | None = None
    for name, (expected, found, on) in checks.items():
        miss = expected.select(*on).distinct().join(found.select(*on).distinct(), list(on), "left_anti").agg(F.count(F.lit(1)).alias("n_missing")).withColumn("check_name", F.lit(name))
        out = miss if out is None else out.unionByName(miss)
    assert out is not None
    return out.withColumn("status", F.when(F.col("n_missing") == 0, "PASS").otherwise("FAIL"))


