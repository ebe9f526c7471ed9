"""Nations without a drawdown: never in a position, only gains, or ruined by their first trade; the queries of equity against their SQL."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from tests.test_ruin import agrees

NAMES = ("eval_position_returns", "eval_metrics", "eval_funding_adjusted_equity", "eval_recovery_time", "eval_stress_windows", "eval_tail_score_caps")


@pytest.fixture(scope="module")
def calm(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("calm")
    orders = []
    for nation in range(4):
        price = 100.0
        for k in range(60):
            day = dt.date(1996, 1, 2) + dt.timedelta(k)
            if nation == 3:
                price *= 1.05 if k % 2 else 0.97
            prices = [price] if nation == 0 else [price, price * 1.1]  # one order: no position; close above open: long
            if nation == 1:
                price *= 1.2
            if nation == 2:
                prices = [price, price, price] if k == 0 else [price * 1000] * 3  # short, then a thousandfold price
            orders += [(len(orders) + i + 1, nation + 1, day, x, "1-X") for i, x in enumerate(prices)]
    o = pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"]).astype({"o_orderkey": "int64", "o_custkey": "int64"})
    o["o_orderdate"] = pd.to_datetime(o.o_orderdate).astype("datetime64[us]")
    o.to_parquet(folder / "orders.parquet")
    pd.DataFrame({"c_custkey": range(1, 5), "c_nationkey": pd.Series(range(4), dtype="int32")}).to_parquet(folder / "customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_equity_without_drawdowns_matches_sql(spark, calm, name):
    agrees(spark, calm, name)
