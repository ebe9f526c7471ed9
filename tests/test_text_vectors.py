"""Text and vector operators against brute force on a small fixture."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.expressions import evaluate
from tideline.functions.frames import Frame
from tideline.operators import text as X
from tideline.sources import market as M
from tideline.sources import vendor as V


def test_near_duplicates_find_every_similar_pair(spark, sf):
    docs = M.table(spark, sf, "documents").select("doc_id", "text")
    seen = {}
    for d in docs.orderBy("doc_id").collect():
        n = re.sub(r"\s+", " ", d.text.lower()).strip()
        seen.setdefault(n, d.doc_id)
    sets = {}
    for n, i in seen.items():
        w = n.split(" ")
        sets[i] = (len(n), {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))})
    ids = sorted(sets)
    want = set()
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            (la, x), (lb, y) = sets[ids[a]], sets[ids[b]]
            inter = len(x & y)
            if min(la, lb) >= 0.7 * max(la, lb) and inter and inter / (len(x) + len(y) - inter) >= 0.7:
                want.add((ids[a], ids[b]))
    got = {(r.id_a, r.id_b) for r in X.near_duplicates(docs).collect()}
    assert got == want


def test_a_huge_group_of_copies_is_one_text(spark):
    """Copies make no pairs; 51 different texts that are all alike keep all their links."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, base) for i in range(500)] + [(1000 + i, base + f" tail{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert X.duplicate_groups(df).collect()[0].copies == 500
    assert X.near_duplicates(df).count() == 51 * 50 // 2
    classes = X.duplicate_classes(df).groupBy("class_id", "rep_id").count().collect()
    assert {r.class_id for r in classes} == {0} and len(classes) == 51


def test_conflicts_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(6, 16))
    m = np.concatenate([c[i % 6] + rng.normal(0, 0.15, 16) for i in range(120)]).reshape(120, 16)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(120), "embedding": list(m.astype("float32"))}))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.9}
    got = {(r.id_a, r.id_b) for r in X.conflicts(df, 0.9, dims=16, block=16).collect()}
    assert got == want


def test_top_matches_in_blocks_equal_one_block(spark, sf):
    e = M.table(spark, sf, "embeddings")
    q = e.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    a = X.top_matches(q, e, 4, 0.0).select("query_id", "vec_id", "rank").collect()
    b = X.top_matches(q, e, 4, 0.0, max_queries=2).select("query_id", "vec_id", "rank").collect()
    assert sorted(a) == sorted(b) and len(a) == 28
    assert all(r.query_id == r.vec_id for r in a if r.rank == 1)


def test_parsers(spark):
    r = spark.createDataFrame([("$35.9 T", "-1.15%", "dir/BINANCE_BTCUSDT, 1D_ab.csv"), ("n/a", "", "x")], "a string, b string, n string")
    r = r.withColumns(V.parse_file_name("n")).withColumns({"x": V.parse_number("a"), "y": V.parse_percent("b")}).collect()
    assert r[0].x == 35.9e12 and r[0].y == -1.15 and (r[0].venue, r[0].ticker, r[0].tf) == ("BINANCE", "BTCUSDT", "1D")
    assert r[1].x is None and r[1].y is None


def test_expression_whitelist(spark):
    df = spark.createDataFrame([(1, 1, 2.0)], "id int, ts int, close double")
    with pytest.raises(ValueError):
        evaluate("Mean($secret, 3)", df, Frame())
    assert evaluate("(Mean(($close + 1) * 2, 3))", df, Frame()).first().factor == 6.0


@pytest.mark.parametrize("block", [7, 1000])
def test_conflicts_are_all_pairs(spark, block):
    """Low similarities too, which share no hyperplane bucket for sure; null, zero and shorter vectors; nothing shuffled for each pair."""
    rng = np.random.default_rng(12)
    m = rng.standard_normal((60, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(m)] + [(60, None), (61, [0.0] * 8), (62, [1.0, 2.0]), (63, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = X.conflicts(df, 0.1, block=block)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {(r.id_a, r.id_b): r.similarity for r in out.collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j): u[i] @ u[j] for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.1} | {(62, 63): 1.0}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
