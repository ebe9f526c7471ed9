"""Registered queries against their SQL on DuckDB, several at a time.

Every third query and the ones of ``RECENT`` run; TIDELINE_SHARE=1 runs all. Queries of ``LARGER`` rank or test values that are tied or
too few on the smallest tables (any order of ties is right there), so they run on the next size.
"""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from tideline.queries.catalog import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITH_SQL = [n for n, q in REGISTRY.items() if q.sql is not None]
RECENT = ("regime", "strategy", "ema_timeframes_c", "ama_long", "indicator_pack", "volatility_table", "feature_template", "risk_user", "asof_", "research_feature", "promote", "composite_lead", "source_parquet", "bars_split", "rsi_suppliers", "obv_users", "outliers", "text_category", "quality_edge")
LARGER = {
    "lead_lag_best", "eval_psr_probability", "eval_min_track_record", "eval_var_cornish_fisher", "eval_hard_stop_sweep", "eval_trailing_stop_sweep", "eval_best_stop",
    "eval_composite_rank", "eval_leaderboard", "eval_sequential_gates", "research_target_ranking", "research_lead_lag_ic",
}
SHARE = int(os.environ.get("TIDELINE_SHARE", "3"))
CHOSEN = [n for i, n in enumerate(WITH_SQL) if i % SHARE == 0 or n.startswith(RECENT)]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


@pytest.fixture(scope="module")
def results(spark, sf, request):
    """Both sides of every chosen query, computed ahead by a few threads."""
    sizes = {False: sf, True: sf.replace("sf0.001", "sf0.01")}
    cons = {}
    for larger, folder in sizes.items():
        cons[larger] = duckdb.connect()
        for t in TABLES:
            cons[larger].execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")

    def both(name):
        con = cons[name in LARGER]
        df = REGISTRY[name].run(spark, sizes[name in LARGER])
        cols = sorted(df.columns)
        got = [tuple(map(norm, r)) for r in df.select(*cols).collect()]
        cur = con.cursor().execute(REGISTRY[name].sql)
        names = [d[0] for d in cur.description]
        idx = [names.index(c) for c in cols if c in names]
        return cols, got, sorted(names), [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]

    wanted = {i.callspec.params["name"] for i in request.session.items if hasattr(i, "callspec") and i.originalname == "test_query_matches_sql"}
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(both, name) for name in CHOSEN if name in wanted}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(results, name):
    cols, got, names, want = results[name].result()
    assert names == cols
    assert len(got) == len(want)
    key = lambda r: tuple((v is None, "" if v is None else (f"{v:.3f}" if isinstance(v, float) else str(v))) for v in r)
    exact = [i for i, c in enumerate(cols) if got and not any(isinstance(r[i], float) for r in got)]
    order = lambda r: (tuple((r[i] is None, str(r[i])) for i in exact), key(r))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_names_and_wiring():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 300


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
