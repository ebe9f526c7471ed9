"""Sets join without copies: tokens of prefixes meet in place, marks screen the pairs, and only sets that are asked for move."""

import random

import numpy as np
import pytest

from tideline.operators import setjoin as J
from tideline.operators import text as X


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def family(spark):
    """Near copies, and sets that share their rarest token (in every prefix) with many others and nothing else."""
    rng = random.Random(4)
    sets = []
    for g in range(30):
        base = rng.sample(range(-(2**61), 2**61), rng.choice((1, 3, 40, 200)))
        sets += [{t if rng.random() > 0.08 else rng.randrange(2**62) for t in base} for _ in range(4)]
    for g in range(60):
        sets.append({g % 3, *rng.sample(range(2**62), 90)})
    sets += [set(), {7}, {7}]
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id long, tokens array<long>").cache()
    return sets, df


@pytest.mark.parametrize("block", [5, 4096])
def test_links_are_those_of_brute_force(spark, family, monkeypatch, block):
    sets, df = family
    monkeypatch.setattr(J, "BLOCK", block)
    want = {(a, b): jaccard(sets[a], sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.7}
    met = [tuple(r) for r in J.candidates(df, 0.7).collect()]
    assert len(met) == len(set(met)) and set(met) >= set(want)
    got = {(r.id_a, r.id_b): r.similarity for r in J.similar_sets(df, 0.7).collect()}
    assert got == pytest.approx(want)


def test_candidates_meet_without_a_join(spark, family):
    plan = J.candidates(family[1], 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_marks_drop_what_shares_little_and_no_link(spark, family):
    sets, df = family
    like = lambda x, y: x and y and min(len(x), len(y)) >= 0.7 * max(len(x), len(y))
    all_pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if like(sets[a], sets[b])]
    left = {tuple(r) for r in J.screened(spark.createDataFrame(all_pairs, "id_a long, id_b long"), df, 0.7).collect()}
    assert left >= {p for p in all_pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.7}
    assert not {p for p in left if len(sets[p[0]]) > 50 and jaccard(sets[p[0]], sets[p[1]]) < 0.4}


def test_marks_fold_to_those_of_fewer_slots():
    rng = np.random.default_rng(2)
    few = rng.integers(-(2**62), 2**62, 100)
    for more in (100, 130, 190, 300):
        tokens = np.concatenate([few, rng.integers(-(2**62), 2**62, more - 100)])
        x, y = (np.frombuffer(J.marks(t), np.uint8) for t in (few, tokens))
        assert len(y) * 8 >= J.MARKS * more
        assert int(np.bitwise_count(J.folded(x, len(x)) ^ J.folded(y, len(x))).sum()) <= more - 100


def test_sets_nobody_asks_for_stay(spark, family):
    _, df = family
    pairs = spark.createDataFrame([(1, 2), (2, 9)], "id_a long, id_b long")
    left = sorted(r.id for r in J.asked(df, pairs).collect())
    assert set(left) >= {1, 2, 9} and len(left) < 6


def test_texts_with_a_common_passage_are_not_compared_whole(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, notice = [[word() for _ in range(120)] for _ in range(8)], [f"n{i}" for i in range(20)]
    texts = [*base, *[[w if i % 60 else word() for i, w in enumerate(b)] for b in base], *[[*notice, *[word() for _ in range(80)]] for _ in range(40)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, cells = [], J.cells
    monkeypatch.setattr(J, "cells", lambda pairs: (seen.append(pairs.count()), cells(pairs))[1])
    # tokens ordered by hash alone, so that the frequent ones of the passage stand in prefixes
    monkeypatch.setattr(J, "counts", lambda sets: [np.zeros(1 << J.BITS, np.int64)] * 2)
    links = {(r.id_a, r.id_b) for r in X.near_duplicates(docs).collect()}
    grams = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    assert links == {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(grams[a], grams[b]) >= 0.7} and len(links) == 8
    assert len(seen) == 2 and seen[0] > 16 and seen[1] == 8
