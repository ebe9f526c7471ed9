"""One key holds most rows: split execution must equal the plain windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.functions.smoothing import ewm_span, span
from tideline.operators import asof as J
from tideline.plans import segments as S


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(4)
    n = 6000
    pdf = pd.DataFrame({"id": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 9, n)), "sec": np.sort(rng.integers(0, 40 * 3600, n)), "tie": np.arange(n), "x": np.round(rng.normal(100, 5, n), 1)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz"))
    return pdf, df


def test_numbering_sliding_running_ema_rank(spark, hot):
    pdf, df = hot
    f = Frame(("id",), ("ts", "tie"))
    d = S.number_rows(df, f, F.date_trunc("hour", F.col("ts")))
    d = S.ema(d, f, F.col("x"), {"e3": span(3), "e40": span(40)})
    d = S.running(d, f, {"cs": ("sum", F.col("x")), "mx": ("max", F.col("x")), "mn": ("min", F.col("x")), "c": ("count", F.col("x"))}, rows=256)
    d = S.sliding(d, f, 30, lambda q, fr: q.withColumns({"m": fr.mean("x", 31), "l": fr.lag("x", 30)}), rows=128)
    d = S.group_rank(d, ["id"], "x", splits=16)
    got = d.toPandas().sort_values(["id", "sec", "tie"]).reset_index(drop=True)
    want = pdf.sort_values(["id", "sec", "tie"]).reset_index(drop=True)
    g = want.groupby("id").x
    assert (got.n == g.cumcount() + 1).all()
    for col, ref in {
        "e3": g.transform(lambda v: v.ewm(span=3, adjust=False).mean()), "e40": g.transform(lambda v: v.ewm(span=40, adjust=False).mean()),
        "cs": g.cumsum(), "mx": g.cummax(), "mn": g.cummin(), "c": g.cumcount() + 1, "m": g.transform(lambda v: v.rolling(31).mean()), "l": g.shift(30), "rank_avg": g.rank(),
    }.items():
        np.testing.assert_allclose(got[col].astype(float), ref.astype(float), rtol=1e-9, err_msg=col)


def test_plain_ema_uses_no_python_and_one_shuffle(spark, hot):
    _, df = hot
    plan = ewm_span(df, Frame(("id",), ("ts", "tie")), "x", {"a": 9, "b": 200})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_split_equals_plain(spark, hot, direction):
    _, df = hot
    left = df.filter("tie % 3 = 0").select("id", "ts", "tie")
    right = df.filter("tie % 5 = 1").groupBy("id", "ts").agg(F.max("x").alias("v"))
    a = J.asof_join(left, right, ["id"], "ts", ["v"], direction)
    b = J.asof_join(left, right, ["id"], "ts", ["v"], direction, split=F.date_trunc("hour", F.col("ts")))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() == left.count()


def test_asof_matches_pandas(spark, hot):
    pdf, df = hot
    left, right = pdf[pdf.tie % 3 == 0], pdf[pdf.tie % 5 == 1].groupby(["id", "sec"], as_index=False).x.max().rename(columns={"x": "v"})
    want = pd.merge_asof(left.sort_values("sec"), right.sort_values("sec"), on="sec", by="id").sort_values("tie").v.to_numpy()
    got = J.asof_join(df.filter("tie % 3 = 0").select("id", "ts", "tie"), df.filter("tie % 5 = 1").groupBy("id", "ts").agg(F.max("x").alias("v")), ["id"], "ts", ["v"]).toPandas().sort_values("tie").v.to_numpy()
    np.testing.assert_allclose(got.astype(float), want)


def test_split_percentiles_equal_numpy(spark, hot):
    pdf, df = hot
    got = {r.id: r for r in S.percentiles(df, ["id"], "x", {"lo": 0.05, "mid": 0.5, "hi": 0.97}, splits=8).collect()}
    for i, g in pdf.groupby("id"):
        np.testing.assert_allclose([got[i].lo, got[i].mid, got[i].hi], np.percentile(g.x, [5, 50, 97]), rtol=1e-12)


def test_fdr_equals_step_up_loop(spark):
    from tideline.operators.research import fdr

    rng = np.random.default_rng(9)
    p = np.round(np.concatenate([rng.random(300), rng.random(60) * 0.01]), 3)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(p)), "p_value": p}))
    got = fdr(df, alpha=0.05, block=32).toPandas().sort_values("k").p_adj.to_numpy()
    order = np.argsort(p, kind="stable")
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1.0)
    want = np.empty(len(p))
    want[order] = q
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_long_conversation_diff(spark):
    from tideline.operators.text import conversation_diff

    n = 9000
    old = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    more = spark.range(n + 5).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    edit = old.withColumn("text", F.when(F.col("turn") == 8000, "x").otherwise(F.col("text")))
    status = lambda a, b: conversation_diff(a, b).first().status
    assert status(old, old) == "same"
    assert status(old, more) == "appended"
    assert status(more, old) == "truncated"
    assert status(old, edit) == "edited"
    assert status(old, old.filter("turn < 0")) == "removed"
