"""Fast similarity sketches, conversation repair and whitening against brute force, and their defined results."""

import hashlib
import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann, repair, similar, whiten
from tideline.llm.common import space_words
from tideline.llm.queries import QUERIES
from tests.llm.test_edge_cases import N, by_id, empty, odd, rows  # noqa: F401


def word_sets(texts, size=4):
    out = []
    for t in texts:
        w = space_words(t)
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute_components(ids, sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        low[find(i)].append(d)
    return {d: min(low[find(i)]) for i, d in enumerate(ids)}


@pytest.mark.parametrize("n", [1, 2, 5, 60, 3000])
def test_every_coordinate_fills_and_agrees_as_the_sets_do(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
    a, b = similar.sketch(h[: n + n // 2]), similar.sketch(h[n // 2 :])
    assert (a != similar.NONE).all() and (similar.sketch(h[::-1]) == similar.sketch(h)).all()
    assert set(similar.bands(a).tolist()) & set(similar.bands(a.copy()).tolist())
    agree = [np.mean(similar.sketch(h[: n + n // 2], 1024) == similar.sketch(h[n // 2 :], 1024))]
    alike = len(set(h[: n + n // 2]) & set(h[n // 2 :])) / len(set(h))
    assert abs(np.mean(agree) - alike) < 0.08  # five deviations of 1,024 coordinates
    assert len(b) == similar.SIZE


def test_small_buckets_of_many_kinds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 60)  # blocks and split leads on few rows
    monkeypatch.setattr(similar, "MEMBERS", 3)
    rng = random.Random(3)
    texts = []
    for _ in range(12):  # families around the limit: copies with a few words changed, chains, short texts
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 5, 8, 40]))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(t))
            if rng.random() < 0.4:
                base = t
    texts += ["", None, " \t", texts[0], texts[0].upper()]
    ids = list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in similar.near_duplicates(docs).collect()}
    sets = word_sets(texts)
    assert {d: r.component_id for d, r in found.items()} == brute_components(ids, sets)
    assert [found[d].n_shingles for d in ids] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_links_between_components_of_a_bucket(spark):
    """The smallest node of a bucket is near none of the others; these are linked all the same."""
    words = [f"w{i}" for i in range(60)]
    a = " ".join(words[:40])
    b, c = " ".join(words[12:50]), " ".join(words[12:52])  # near each other, not to a
    ids = [1, 2, 3]
    sets = [np.array(sorted(similar.shingle_set(t, 4).tolist()), np.uint64) for t in (a, b, c)]
    label = similar.across(sets, np.arange(3))
    assert label.tolist() == [0, 1, 1]
    rows_ = spark.createDataFrame([(7, i, len(s), i) for i, s in zip(ids, sets)], "key long, node long, n long, root long")
    packed = spark.createDataFrame([(i, s.tobytes()) for i, s in zip(ids, sets)], "id long, h binary")
    assert [tuple(r) for r in similar.crossing(rows_, packed).collect()] == [(3, 2)]


def test_chain_far_below_the_limit_stays_apart(spark):
    """Neighbours at 0.56 share buckets all along the chain, yet nothing is linked or compared outside its bucket."""
    texts = [" ".join(f"c{j}" for j in range(8 * i, 8 * i + 32)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in similar.near_duplicates(docs).collect())


def test_op11_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([r.doc_id for r in docs], word_sets([r.text for r in docs]))
    assert {r.doc_id: r.component_id for r in QUERIES["op11_minhash_near_duplicates"](spark, sf).collect()} == want


def test_op11_odd_rows(spark, odd):  # noqa: F811
    found = rows(spark, "op11_minhash_near_duplicates", odd)
    assert len(found) == N
    assert {(r["n_shingles"], r["component_id"], r["kept"]) for i in (2, 3, 4) for r in by_id(found, i)} == {(0, 2, True), (0, 3, True), (0, 4, True)}
    assert by_id(found, 7)[0]["component_id"] == 6 and not by_id(found, 7)[0]["kept"]
    assert by_id(found, None)[0]["component_id"] == 8 and by_id(found, None)[0]["kept"] is False
    assert [r["kept"] for r in by_id(found, 1)] == [True, True] and by_id(found, 10)[0]["n_shingles"] == 1


def cheapest(symbols):
    """(cost, audit) by Dijkstra over whole audits."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(symbols) and q in repair.ENDS:
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        heapq.heappush(heap, (cost + 5, audit + "I", i, repair.NEXT[q]))
        if i < len(symbols):
            s = symbols[i]
            extra = 5 if s.isupper() else 0
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if s != "-":
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, repair.NEXT[q]))
                to = {("s", 0): 1, ("a", 2): 3, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2}.get((s.lower(), q))
                if to is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to))


def test_auction_finds_the_least_audit():
    rng = random.Random(5)
    for _ in range(4000):
        s = "".join(rng.choice("uasxUASX--") for _ in range(rng.randrange(10)))
        audits, costs, _ = repair.solved(s, None, 1)
        assert (costs[0], audits[0]) == cheapest(s), s


def test_prices_are_dual_feasible_and_tight_along_the_path():
    arcs = repair.lattice("uuaSx-aU", None)
    price = repair.auction(arcs)
    assert all(price[i] <= cost + price[j] for i, some in enumerate(arcs) for _, cost, j in some)
    assert price[0] == repair.trace(arcs, price, 0)[1]


@pytest.mark.parametrize("segment", [1, 3, 7])
def test_split_conversations_equal_whole_ones(spark, segment):
    rng = random.Random(segment)
    turns = []
    for conv in range(25):
        for turn in range(rng.randrange(1, 30)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            turns.append((conv, turn, role, rng.choice(["Fine.", "Yes!", "cut", "", " ", f"text {turn}?", f"t {turn}"])))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    plain, cut = ({r.c: r for r in repair.repair(repair.damaged(df), s).collect()} for s in (4096, segment))
    assert plain == cut and len(plain) > 20


def test_op12_odd_rows(spark, odd):  # noqa: F811
    found = {r["conv_id"]: r for r in rows(spark, "op12_conversation_repair", odd)}
    assert set(found) == {None, 1, 2, 3}
    for r in found.values():
        assert r["cost"] >= 0 and all(r[c] is not None for c in r if c != "conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[2]["repaired_sha256"] == nothing and found[2]["audit"] in ("", "D")  # one empty text


def numpy_whitened(vectors, most):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(e)[::-1][:most]
    return x, centred @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(400, 9)) @ np.diag([1, 1, 1, 5, 5, 30, 90, 90, 0])).astype(np.int64)
    whole, left, right = whiten.Spectrum(9), whiten.Spectrum(9), whiten.Spectrum(9)
    for i, row in enumerate(x):
        whole.add(row, 1)
        (left if i % 3 else right).add(row, 1)
    left.merge(right)
    twice = whiten.Spectrum(9)
    for row in x:
        twice.add(row, 2)
    scatter = np.cov(x.T, bias=True) * len(x)
    for s, times in ((whole, 1), (left, 1), (twice, 2)):
        assert np.abs(s.basis.T @ s.basis - np.eye(9)).max() < 1e-12
        assert np.abs(s.basis * s.values @ s.basis.T - times * scatter).max() < 1e-11 * times * scatter.max()
        assert (s.total == times * x.sum(axis=0)).all() and s.n == times * len(x)


def test_secular_roots():
    d, w = np.array([0.0, 1.0, 1.5, 7.0]), np.array([1e-12, 2.0, 1e-6, 3.0])
    origin, offset = whiten.secular(d, w)
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(w), np.sqrt(w)))
    assert np.allclose(np.sort(d[origin] + offset), want, rtol=1e-13, atol=1e-13)


def test_op13_equals_numpy(spark, sf):
    stored = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()]
    x, want, explained = numpy_whitened(stored, 32)
    found = QUERIES["op13_embedding_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    got = np.array([r.whitened for r in found]).reshape(len(x), 32)
    got *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-9
    assert np.allclose([r.explained for r in found[:32]], explained, rtol=1e-9)
    n, total = len(x), x.sum(axis=0)
    assert [r.deviation for r in found[::32]] == [int(v) for v in ((n * x - total) ** 2).sum(axis=1)]
    assert {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9


def test_op13_odd_rows(spark, odd):  # noqa: F811
    found = rows(spark, "op13_embedding_whitening", odd)
    # vectors of length 3: (1,0,0) three times, (2,0,0), (0,1,0), (1,1,0), (0,0,0) twice; the lone (1,1) and the empty one have no component
    assert len(found) == 16 and {r["n"] for r in found} == {8} and {r["component"] for r in found} == {1, 2}
    assert sum(r["vec_id"] is None for r in found) == 2 and sum(r["vec_id"] == 0 for r in found) == 4
    assert all(r["identity_error"] < 1e-9 for r in found) and abs(sum(r["explained"] for r in found) / 8 - 1) < 1e-9


def test_deviations_beyond_a_long_are_null():
    y = np.array([[1 << 40], [0]])
    assert whiten.deviations(y, 3, np.array([1 << 40])) == [None, None]
    assert whiten.deviations(np.array([[5], [0]]), 2, np.array([5])) == [25, 25]


def test_spectra_of_many_partitions(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(500, 4)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(40)
    found = whiten.whiten(df).groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("whitened") ** 2).alias("s")).collect()
    assert len(found) == 4 and all(r.n == 500 and abs(r.s - 500) < 1e-6 for r in found)


def test_every_query_gets_all_it_can(spark):
    """Two lengths and lone vectors: min(k, candidates) neighbours for every query, the rare length exact."""
    rng = np.random.default_rng(11)
    close = rng.normal(size=(4000, 32)) * 0.02 + rng.normal(size=(40, 32)).repeat(100, axis=0)
    vectors = [v.tolist() for v in close] + [(-5 * close[:100].mean(axis=0)).tolist()] + [v.tolist() for v in rng.normal(size=(12, 16))] + [[1.0, 2.0, 3.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = ann.nearest(df, (F.col("id") % 50 == 0) | (F.col("id") >= 4000)).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(got[q]) == 5 for q in [*range(0, 4000, 50), *range(4000, 4013)]) and 4013 not in got
    for q in range(4001, 4013):
        u = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in range(4001, 4013)}
        assert got[q] == sorted((i for i in u if i != q), key=lambda i: (-float(u[i] @ u[q]), i))[:5]
