"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, rule=H.Rule()):
    v = [(i, label, [math.floor(256 * x) for x in e]) for i, e, label in rows if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (a, label, q) in enumerate(v):
        if a % every:
            continue
        ranked = sorted((-dot(q, e), i, other) for m, (i, other, e) in enumerate(v) if m != n)
        for s, p, _ in [x for x in ranked if x[2] == label][: rule.positives]:
            fits = [x for x in ranked if x[2] != label and rule.share * -s <= 100 * -x[0] <= 100 * -s][: rule.negatives]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def single(values):
    return [None if x is None else float(np.float32(x)) for x in values]


def table(kind, n=160, seed=5):
    r = random.Random(seed)
    near = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        if kind == "spread":
            e = [r.gauss(0, 0.3) for _ in range(6)]
        elif kind == "groups":
            e = [x + r.gauss(0, 0.05) for x in r.choice(near)]
        elif kind == "coarse":  # many ties
            e = [r.choice([0.0, 0.004, -0.004, 0.008]) for _ in range(3)]
        else:  # a third of all rows is one vector
            e = [0.5, 0.25, -0.5] if i % 3 == 0 else [r.gauss(0, 0.3) for _ in range(r.choice([2, 3, 5]))]
        rows.append((i, single(e), r.randrange(3)))
    return rows


ODD = [(None, [0.1, 0.2], 1), (10, None, 1), (20, [0.1, None], 1), (30, [float("nan"), 1.0], 1), (40, [float("inf")], 2), (50, [0.3, 0.1], None), (60, [], 1), (70, [0.0, 0.0], 2), (-10, [0.7, 0.1, 0.3], 0)]


def mine(spark, rows, every, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, f"id % {every} = 0", **how).collect())


@pytest.mark.parametrize("kind", ["spread", "groups", "coarse", "hot"])
def test_against_brute_force(spark, kind):
    rows = table(kind)
    rows += [(i, single(e) if e else e, label) for i, e, label in ODD] + rows[:25] + [(0, rows[5][1], rows[5][2])]
    got = mine(spark, rows, 10, cell_bytes=300, n_pivots=5, rings=6, first=1)
    assert got == brute(rows, 10) and (got or kind == "coarse")


def test_waves_and_other_rules(spark):
    rows, rule = table("groups", 90), H.Rule(positives=2, negatives=3, share=50)
    assert mine(spark, rows, 3, rule=rule, wave_bytes=900, cell_bytes=500, n_pivots=3) == brute(rows, 3, rule) != []


def test_scores_near_64_bits(spark):
    big = [(i, single([4e6 * (1 + i % 5 / 10), 1e6 * (i % 5)]), i % 2) for i in range(20)]
    assert mine(spark, big, 5) == brute(big, 5) != []
    with pytest.raises(Exception, match="64-bit"):
        mine(spark, [(0, [3e9], 1), (1, [3e9], 1), (2, [1.0], 0)], 5)


def test_scans_stop_early(spark):
    """Far groups: no query looks at the cells of all, and the answers are whole."""
    r = random.Random(1)
    rows = [(i, single([(10 if j == i % 8 else 0) + r.gauss(0, 0.02) for j in range(8)]), r.randrange(2)) for i in range(400)]
    asked = []
    real = H.search

    def watched(queries, index, space, *a, **k):
        asked.append(len(space.cell))
        return real(queries, index, space, *a, **k)

    H.search = watched
    try:
        got = mine(spark, rows, 50, n_pivots=8, cell_bytes=64 * 50, first=1)
    finally:
        H.search = real
    assert got == brute(rows, 50) != [] and asked[0] >= 8
    space = H.Space(np.eye(3), 1.0, np.arange(3), np.zeros(3), np.full(3, 0.1), np.arange(3), np.arange(3) + 1)
    top, low = space.bounds(np.array([[1, 0]]))
    assert top[0, 0] > 1 and low[0, 0] < 1 and top[0, 1] < top[0, 0]


def test_empty_and_clashing(spark):
    assert mine(spark, [], 10) == [] and mine(spark, [(0, [0.5], 1)], 10) == [] and mine(spark, [(1, [0.5], 1), (2, [0.4], 0)], 10) == []
    rows = table("groups", 60)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("?").alias(c) for c in ("id", "vec", "cell", "query", "slot", "score", "_row", "norm")))
    assert sorted(tuple(r) for r in H.hard_negatives(df, "id % 10 = 0").collect()) == brute(rows, 10)
