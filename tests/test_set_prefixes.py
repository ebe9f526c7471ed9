"""Prefixes of a set join: counts of fixed size, and one shuffle of prefix tokens alone."""

import random
from collections import Counter

import numpy as np

from tideline.operators import setjoin as J


def test_prefixes_need_no_shuffle_of_other_tokens(spark):
    rng = random.Random(6)
    sets = [sorted({rng.choice((rng.randrange(40), rng.randrange(-9000, 9000))) for _ in range(rng.randrange(30))}) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<long>")
    true = Counter(t for s in sets for t in s)
    first, second = J.counts(df)
    assert first.sum() == second.sum() == sum(true.values())
    tokens = np.array(sorted(true), np.int64)
    at = J.slots(tokens)
    assert (np.minimum(first[at[0]], second[at[1]]) >= np.array([true[int(t)] for t in tokens])).all()
    found = J.prefixes(df, 0.7)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = found.collect()
    assert all(r.token in sets[r.id] and r.n == len(sets[r.id]) and 1 <= r.pos <= r.n - np.ceil(0.7 * r.n - 1e-9) + 1 and r.times > 1 for r in rows)
    assert max(Counter((r.id, r.pos) for r in rows).values()) == 1


def test_sets_of_copies_meet_in_one_cell(spark):
    names = list(range(0, 300, 3))
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b] + [(1, 2), (2, 4)], "id_a long, id_b long")
    rows = J.cells(pairs).collect()
    assert len(rows) == len(names) * (len(names) - 1) / 2 + 2
    used = {(r._c, r._qa, r._qb, i) for r in rows for i in (r.id_a, r.id_b)}
    assert len(used) <= len(names) + 4  # each set goes once to a cell, not once for each of its pairs


def test_small_and_large_counts_add_up(spark):
    """A token of 70,000 sets and one of 300, next to single ones, over several tasks."""
    df = spark.range(0, 70_000, 1, 5).selectExpr("id", "IF(id < 300, array(7, 11, id + 100), array(7, id + 100)) AS tokens")
    first, second = J.counts(df)
    assert first.sum() == second.sum() == 140_300
    at = J.slots(np.array([7, 11], np.int64))
    for a, total in zip(at, (first, second)):
        assert total[a[0]] >= 70_000 and 300 <= total[a[1]] < 2_000
