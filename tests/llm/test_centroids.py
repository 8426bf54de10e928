import hashlib
import math
import random

import numpy as np
import pytest

from quayside.llm import centroids as cn

SCHEMA = "vec_id long, embedding array<float>, row long, own string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], v) for i, v in rows
            if v is not None and len(v) == size
            and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(
        f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centre = [q for _, q, _ in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        own = [nearest(q)[1] for _, q, _ in kept]
        centre = [[sum(kept[i][1][d] for i in mine) // len(mine) for d in range(size)]
                  if (mine := [i for i, o in enumerate(own) if o == j]) else c
                  for j, c in enumerate(centre)]
    got = [(i, *nearest(q)[::-1]) for i, q, _ in kept]
    total = sum(g[2] for g in got)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, c, d, sum(g[2] for g in got if g[1] == c), total, name[c])
                   for i, c, d in got), key=repr)


def answer(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                          "centroid_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (5, 0)])
def test_equals_brute_force(spark, k, rounds):
    rnd = random.Random(k)
    rows = [(i, [rnd.gauss(rnd.choice([-1, 0, 2]), 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, list(rows[7][1])) for i in range(150)]     # a common vector: ties
    got = cn.cluster(table(spark, rows).repartition(3), k=k, rounds=rounds, size=6)
    assert answer(got) == brute(rows, k, rounds, 6)


def test_awkward_rows(spark):
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (0, [2.0, 2.0]), (1, None), (2, [1.0, None]),
            (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, []), (6, [0.5]), (7, [0.5, 0.25, 9.0]),
            (None, [1.0, 1.0]), (None, None), (8, [0.0, 0.0]), (9, [-1.0, 1.0]), (9, [-1.0, 1.0])]
    for k in (2, 4, 40):
        assert answer(cn.cluster(table(spark, rows), k=k, size=2)) == brute(rows, k, 10, 2)


def test_empty_tables(spark):
    assert answer(cn.cluster(table(spark, []), size=2)) == []
    assert answer(cn.cluster(table(spark, [(1, None), (2, [1.0])]), size=2)) == []


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [1e6 + i, -2e6 + 3 * i]) for i in range(40)]
    assert answer(cn.cluster(table(spark, rows), k=3, size=2)) == brute(rows, 3, 10, 2)
    same = [(i, [3e38, 1.0]) for i in range(3)]
    assert answer(cn.cluster(table(spark, same), k=1, size=2)) == brute(same, 1, 10, 2)
    with pytest.raises(Exception, match="fit a long"):
        cn.cluster(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0])]), k=1, size=2)


def test_bounds_hold_and_save_work():
    """Stored distances, loosened by the total displacement, bound the true
    ones; on separate clusters most distances are never evaluated again."""
    rnd = np.random.default_rng(1)
    rows = (np.repeat(rnd.normal(0, 3000, (8, 16)), 200, axis=0)
            + rnd.normal(0, 100, (1600, 16))).astype(np.int64)
    centre = [rows[i * 200].tolist() for i in range(8)]
    history, state = [centre], cn.Bounds.first(rows, centre)
    for _ in range(8):
        history.append([(rows[state.own == c].sum(axis=0) // max(1, (state.own == c).sum()))
                        .tolist() for c in range(8)])
        state.update(rows, history)
        exact = np.column_stack([cn.squared(rows, c) for c in history[-1]])
        assert (state.own == exact.argmin(axis=1)).all()
        for c in range(8):
            drift = [math.dist(h[c], history[-1][c]) for h in history]
            loose = np.array(drift)[state.epoch[:, c]]
            assert (np.abs(np.sqrt(exact[:, c]) - state.seen[:, c]) <= loose + 1e-6).all()
    assert state.evaluated < 0.2 * 9 * rows.size / 16 * 8


def test_total_displacement_is_tighter_than_summed_drifts():
    """A centroid that goes away and comes back loosens nothing."""
    rows = np.array([[0, 0], [100, 0], [50, 1]], dtype=np.int64)
    here, there = [[0, 0], [100, 0]], [[40, 0], [60, 0]]
    state = cn.Bounds.first(rows, here)
    before = state.evaluated
    state = cn.Bounds(state.seen[:2], state.epoch[:2], state.own[:2])
    state.update(rows[:2], [here, there, here])
    assert state.evaluated == 0 and before == 6


def test_vectors_are_joined_without_a_shuffle(spark):
    df = spark.range(1000).selectExpr("id AS row", "id * 2 AS v")
    a, b = (cn.Bucketed(df.repartition(4, "row"), "t", 4) for _ in range(2))
    plan = a.read().join(b.read().hint("shuffle_hash"), "row")._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    a.drop(), b.drop()
