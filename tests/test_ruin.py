"""Losses of everything and of more: growth by logs, and the queries that compound it against their SQL."""

import datetime as dt
import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.operators import evaluate as E
from tideline.queries.catalog import REGISTRY

COMPOUNDED = (
    "eval_position_returns", "eval_metrics", "eval_funding_adjusted_equity", "eval_fold_metrics", "eval_gates_v1", "eval_loss_caps",
    "eval_rank_sensitivity", "eval_recovery_time", "eval_select_distinct", "eval_stress_windows", "eval_tail_score_caps", "eval_composite_rank",
    "eval_cost_sweep",
)


@pytest.fixture(scope="module")
def jumps(spark, tmp_path_factory):
    """Fourteen nations with three orders a day; in most of them short positions meet prices that rise a thousandfold."""
    rng = random.Random(9)
    folder = tmp_path_factory.mktemp("jumps")
    orders = []
    for nation in range(14):
        day = dt.date(1996, 1, 2)
        for k in range(120):
            day += dt.timedelta(rng.choice((1, 1, 2, 9)))
            for _ in range(3):
                price = rng.uniform(100, 900) * (1000 if nation > 1 and k % 40 == 20 + nation else 1)
                orders.append((len(orders) + 1, nation + 1, day, price, f"{1 + len(orders) % 5}-X"))
    cols = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"]
    o = pd.DataFrame(orders, columns=cols).astype({"o_orderkey": "int64", "o_custkey": "int64"})
    o["o_orderdate"] = pd.to_datetime(o.o_orderdate).astype("datetime64[us]")
    o.to_parquet(folder / "orders.parquet")
    pd.DataFrame({"c_custkey": range(1, 15), "c_nationkey": pd.Series(range(14), dtype="int32")}).to_parquet(folder / "customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


def agrees(spark, jumps, name):
    folder, con = jumps
    df = REGISTRY[name].run(spark, folder)
    floats = {c for c, t in df.dtypes if t == "double"}
    cols = sorted(df.columns, key=lambda c: (c in floats, c))
    got = df.select(*cols).collect()
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({REGISTRY[name].sql})").fetchall()
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert all(map(same, a, b)), (a, b)
    return got


@pytest.mark.parametrize("name", COMPOUNDED)
def test_compounded_losses_match_sql(spark, jumps, name):
    agrees(spark, jumps, name)


def test_the_data_holds_ruin(spark, jumps):
    got = {r.id: r.ann_return for r in REGISTRY["eval_metrics"].run(spark, jumps[0]).collect()}
    assert {i for i, v in got.items() if math.isnan(v)} and {i for i, v in got.items() if not math.isnan(v)}


def test_growth_of_total_and_greater_losses(spark):
    rows = [("all", 1, 0.5), ("all", 2, -1.0), ("all", 3, 0.1), ("more", 1, 0.5), ("more", 2, -1.5), ("more", 3, 0.1), ("gap", 1, None), ("gap", 2, 0.5)]
    df = spark.createDataFrame(rows, "id string, ts int, r double")
    eq = {i: [r.equity for r in E.with_equity(df, Frame(), "r").filter(F.col("id") == i).orderBy("ts").collect()] for i in ("all", "more", "gap")}
    assert eq["all"] == pytest.approx([1.5, 0.0, 0.0]) and eq["gap"] == pytest.approx([1.0, 1.5])
    assert eq["more"][0] == pytest.approx(1.5) and all(map(math.isnan, eq["more"][1:]))
    g = {r.id: r.g for r in df.groupBy("id").agg(E.growth("r").alias("g")).collect()}
    assert g["all"] == 0.0 and math.isnan(g["more"]) and g["gap"] == pytest.approx(1.5)


def test_leaderboard_of_undefined_returns_matches_sql(spark, jumps):
    agrees(spark, jumps, "eval_leaderboard")
