"""Blocked pair statistics against plain loops over all pairs."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import gram as GM

LAGS = (1, 2)


def panel(spark, seed, ids=11, days=300, start=dt.date(1969, 11, 20)):
    """Gaps, nulls, NaN, ties, one constant id, one id with two rows, and rows without id or day."""
    rng = random.Random(seed)
    rows = [(None, start, 1.0), (1, None, 1.0)]
    for i in range(ids):
        for d in range(days):
            if rng.random() < 0.3 or (i == 3 and d > 1):
                continue
            v = 2.5 if i == 2 else float(rng.randrange(6)) if i == 4 else rng.gauss(1e3 * i, 1 + i)
            rows.append((i, start + dt.timedelta(d), rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.1 else v))
    return spark.createDataFrame(rows, "id int, ts date, x double").cache()


def wide(df, x="x"):
    p = df.filter("id IS NOT NULL AND ts IS NOT NULL").toPandas()
    return p.assign(**{x: p[x].where(np.isfinite(p[x].astype(float)))})


def corr(a, b):
    ok = a.notna() & b.notna()
    a, b = a[ok], b[ok]
    return len(a), (np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.nunique() > 1 and b.nunique() > 1 else np.nan)


@pytest.mark.parametrize("per_block", [1, 3, 100])
def test_leaders_equal_a_loop_over_pairs(spark, per_block):
    df = panel(spark, 5)
    got = {r.leader: (r.leader_score, r.n_followers) for r in GM.leader_scores(df, "x", LAGS, min_obs=20, per_block=per_block).collect()}
    p = wide(df).sort_values(["id", "ts"])
    for k in LAGS:
        p[f"l{k}"] = p.groupby("id").x.shift(k)
    by = {i: g.set_index("ts") for i, g in p.groupby("id")}
    for i, a in by.items():
        best = []
        for j, b in by.items():
            days = a.index.intersection(b.index)
            if i == j or not len(days):
                continue
            pairs = [corr(a.loc[days, f"l{k}"].astype(float), b.loc[days, "x"].astype(float)) for k in LAGS]
            best.append(max([0.0, *[abs(c) for n, c in pairs if n >= 20 and c == c]]))
        assert got[i] == (pytest.approx(np.mean(best), abs=1e-9), len(best))
    assert set(got) == set(by)


@pytest.mark.parametrize("per_block", [2, 100])
def test_covariances_equal_a_loop_over_pairs(spark, per_block):
    df = panel(spark, 6)
    clean = df.withColumn("x", F.when(F.abs("x") < float("inf"), F.col("x")))
    got = {(r.id_a, r.id_b): r for r in GM.pair_covariance(clean, "x", per_block=per_block).collect()}
    t = wide(clean).pivot(index="ts", columns="id", values="x").astype(float)
    n_pairs = 0
    for i in t:
        for j in t:
            ok = t[i].notna() & t[j].notna()
            if i >= j or not ok.sum():
                continue
            n_pairs += 1
            r, (n, c) = got[i, j], corr(t[i], t[j])
            assert r.n_obs == n == ok.sum()
            assert (r.corr is None) == (c != c) and (r.corr is None or r.corr == pytest.approx(c, abs=1e-8))
            if n > 1:
                assert r.cov == pytest.approx(np.cov(t[i][ok], t[j][ok])[0, 1], abs=1e-6)
    assert n_pairs == len(got)


@pytest.mark.parametrize("per_block", [2, 100])
def test_rank_correlations_equal_a_loop_over_pairs(spark, per_block):
    df = panel(spark, 7, 7, 200).withColumns({"y1": F.col("x") * F.pmod(F.col("id"), F.lit(3)) - F.dayofmonth("ts"), "y5": F.when(F.dayofmonth("ts") > 9, F.sin("x"))})
    got = {(r.leader, r.follower, r.horizon): (r.n_obs, r.ic) for r in GM.rank_ic(df, df, "x", ["y1", "y5"], (1, 5), per_block=per_block).collect()}
    p = df.filter("id IS NOT NULL AND ts IS NOT NULL").toPandas().replace([np.inf, -np.inf], np.nan)
    by = {i: g.set_index("ts").astype(float) for i, g in p.groupby("id")}
    seen = 0
    for i, a in by.items():
        for j, b in by.items():
            for h in (1, 5):
                m = pd.DataFrame({"x": a.x, "y": b[f"y{h}"]}).dropna()
                if i == j or m.empty:
                    assert (i, j, h) not in got
                    continue
                seen += 1
                n, c = corr(m.x.rank(), m.y.rank())
                assert got[i, j, h][0] == n
                assert (got[i, j, h][1] is None) == (c != c) and (c != c or got[i, j, h][1] == pytest.approx(c, abs=1e-9))
    assert seen == len(got)


def test_mean_correlation_by_date_equals_the_pairs(spark):
    df = panel(spark, 8, 9, 120).filter("id <> 3").withColumn("ts", F.date_trunc("week", "ts").cast("date"))
    df = df.filter("id IS NOT NULL AND ts IS NOT NULL AND abs(x) < 1e300").groupBy("id", "ts").agg(F.avg("x").alias("x"))
    df = df.filter("NOT (id = 5 AND month(ts) = 1)")
    got = {r.ts: (r.avg_corr, r.n_assets) for r in GM.market_corr_by_date(df, "x", 6).collect()}
    t = df.toPandas().pivot(index="ts", columns="id", values="x").astype(float)
    assert set(got) == set(t.index)
    for k, day in enumerate(t.index):
        w = t.iloc[max(0, k - 5):k + 1]
        keep = [i for i in t if len(w) == 6 and w[i].notna().all() and w[i].nunique() > 1]
        c = w[keep].corr().to_numpy()[np.triu_indices(len(keep), 1)]
        assert got[day][1] == len(keep)
        assert (got[day][0] is None) == (len(c) == 0) and (not len(c) or got[day][0] == pytest.approx(c.mean(), abs=1e-9))
    assert max(n for _, n in got.values()) > 4


def test_empty_panels_give_empty_results(spark):
    none = spark.createDataFrame([], "id string, ts timestamp_ntz, x double")
    assert GM.leader_scores(none, "x").count() == GM.pair_covariance(none, "x").count() == GM.rank_ic(none, none, "x", ["x"], (1,)).count() == GM.market_corr_by_date(none, "x").count() == 0


def test_a_text_id_and_one_series(spark):
    one = spark.createDataFrame([("a", dt.datetime(2024, 1, d), float(d)) for d in range(1, 9)], "id string, ts timestamp_ntz, x double")
    assert GM.leader_scores(one, "x").count() == 0 and GM.pair_covariance(one, "x").count() == 0


@pytest.mark.parametrize("per_block", [1, 4])
def test_series_are_not_copied_for_each_pair_of_blocks(spark, per_block):
    """Pairs of blocks read cells that were written once: nothing behind them is shuffled, and cells hold each row once."""
    df = panel(spark, 7, ids=9, days=40).filter("id <> 1 AND ts IS NOT NULL")
    plan = GM.pair_covariance(df, "x", per_block=per_block)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    rows = GM.packed(df, ["x"], "id", "ts")
    days = np.array(sorted({d for r in rows.collect() for d in r["_d"]}))
    blocks = [GM.Block(r["_cell"]) for r in GM.cells(rows, 5, days).collect()]
    assert sum(len(b.day) for b in blocks) == df.count() and sorted(i for b in blocks for i in b.ids) == [0, *range(2, 9)]


def test_a_month_costs_one_day(spark):
    """Days that no series has take no part in the products."""
    df = panel(spark, 8, ids=4, days=20).filter("ts IS NOT NULL").withColumn("ts", F.trunc("ts", "month")).dropDuplicates(["id", "ts"])
    rows = GM.packed(df, ["x"], "id", "ts")
    days = np.array(sorted({d for r in rows.collect() for d in r["_d"]}))
    assert len(days) <= 2
    assert {d for r in GM.cells(rows, 2, days).collect() for d in GM.Block(r["_cell"]).day} == set(range(len(days)))


def test_lags_share_the_sums_of_days_without_gaps():
    rng = np.random.default_rng(3)
    px, py = rng.random((5, 60)) < 0.6, rng.random((7, 60)) < 0.6
    x, y = np.where(px[:, :, None], rng.normal(size=(5, 60, 3)), np.nan), np.where(py, rng.normal(size=(7, 60)), np.nan)
    x[:, :4, 1], x[:, :9, 2], y[2, 30] = np.nan, np.nan, np.nan
    want = [GM.Sums(5, 7) for _ in range(3)]
    for k, one in enumerate(want):
        one.add(x[:, :, k], y)
    got, sizes = [GM.Sums(5, 7) for _ in range(3)], []

    class Seen(np.ndarray):
        def astype(self, *a, **b):
            sizes.append(self.shape[1])
            return np.asarray(self).astype(*a, **b)

    columns = lambda days: [np.ascontiguousarray(x[:, days, k]) for k in range(3)]
    both = GM.lagged(got, columns(slice(None)), px.view(Seen), y, py)
    assert (both == px.astype(int) @ py.T.astype(int)).all() and max(sizes) == 60 - 9 - 1
    for a, b in zip(got, want):
        np.testing.assert_allclose(a.s, b.s, atol=1e-12)
    some = [GM.Sums(5, 7) for _ in range(3)]
    for days in (slice(0, 9), slice(9, 20), slice(20, 60)):  # every day is odd, none is, one is
        GM.lagged(some, columns(days), px[:, days], y[:, days], py[:, days])
    for a, b in zip(some, want):
        np.testing.assert_allclose(a.s, b.s, atol=1e-12)
