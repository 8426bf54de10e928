import math
import random
import sys

import numpy as np
import pytest

from quayside.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, rank string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def f32(v):
    return [float(np.float32(x)) for x in v]


def brute(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    q = lambda v: [math.floor(1024 * x) for x in f32(v)]
    base = [(i, q(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for a, x in {(i, tuple(q(v))) for i, v in queries if i is not None and ok(v)}:
        hits = sorted(((-sum(s * t for s, t in zip(x, y)), b) for b, y in base if b != a))[:k]
        out += [(a, n + 1, b, -s) for n, (s, b) in enumerate(hits)]
    return sorted(out)


def answer(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("step,block", [(32, 8192), (1, 64), (1000, 50)])
def test_equals_brute_force(spark, step, block):
    rnd = random.Random(step)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, list(rows[7][1])) for i in range(120)]     # a common vector: ties
    df = table(spark, rows)
    got = topk.search(df, df.where("vec_id % 20 = 0"), step=step, block_rows=block, query_rows=4)
    assert answer(got) == brute(rows, [r for r in rows if r[0] % 20 == 0], 10)


def test_awkward_rows(spark):
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]),
            (4, [math.inf, 1.0]), (5, []), (6, [0.5]), (7, [0.5, 0.25, 9.0]), (None, [1.0, 1.0]),
            (8, [0.0, 0.0]), (9, [-1.0, 1.0]), (9, [-1.0, 1.0])]
    df = table(spark, rows)
    assert answer(topk.search(df, df, k=4)) == brute(rows, rows, 4)


def test_huge_components_are_exact_or_refused(spark):
    rows = [(0, [1e6, 1.0]), (1, [9e5, -1.0]), (2, [2e5, 3.0]), (3, [-1e6, 0.5]), (4, [1.0, 2.0])]
    df = table(spark, rows)
    assert answer(topk.search(df, df)) == brute(rows, rows, 10)
    far = table(spark, [(0, [3e38, 1.0]), (1, [3e38, -1.0])])
    with pytest.raises(Exception, match="fit a long"):
        topk.search(far, far).collect()
    one = [(0, [0.0, 2.0]), (1, [3e38, -1.0]), (2, [1e38, 1.0])]   # scores that do fit
    assert answer(topk.search(table(spark, one), table(spark, one[:1]))) == brute(one, one[:1], 10)


def test_few_candidates_and_empty_tables(spark):
    one = table(spark, [(0, [1.0])])
    assert topk.search(one, one).collect() == []
    none = table(spark, [])
    assert topk.search(none, none).collect() == []
    assert topk.search(none, one).collect() == []
    assert topk.search(one, none).collect() == []


def test_reading_stops_early_on_proof():
    rnd = np.random.default_rng(0)
    rows = np.minimum(1000, (rnd.pareto(1.0, (4000, 8)) * 20)).astype(np.int64)
    index = topk.BlockIndex.from_bytes(topk.BlockIndex(np.arange(4000), rows, 16).to_bytes())
    query = np.array([900, 500, 0, 0, 0, 3, 0, 0])
    ids, scores = index.search(query, -1, 5)
    assert scores.tolist() == sorted((rows @ query).tolist(), reverse=True)[:5]
    assert index.read < 0.6 * index.postings


def test_most_rows_of_unrelated_vectors_are_ruled_out():
    """Without structure little is left unread, but few rows are rescored."""
    rnd = np.random.default_rng(1)
    rows = (rnd.normal(0, 128, (4000, 64))).astype(np.int64)
    index = topk.BlockIndex(np.arange(4000), rows, 8)
    for i in range(20):
        ids, scores = index.search(rows[i], i, 10)
        exact = rows @ rows[i]
        exact[i] = -1 << 60
        assert scores.tolist() == sorted(exact.tolist(), reverse=True)[:10]
    assert index.read < index.postings


def test_interpreted_steps_do_not_grow_with_segments():
    """A search of 64 dimensions with some 1600 segments, or one a value."""
    rnd = np.random.default_rng(2)
    rows = (rnd.normal(0, 128, (4000, 64))).astype(np.int64)
    for step in (32, 1):
        index = topk.BlockIndex(np.arange(4000), rows, step)
        index.search(rows[0], 0, 10)
        lines = 0

        def trace(frame, event, arg):
            nonlocal lines
            lines += event == "line"
            return trace

        old = sys.gettrace()
        sys.settrace(trace)
        try:
            index.search(rows[1], 1, 10)
        finally:
            sys.settrace(old)
        assert lines < 6000


def test_a_known_score_spares_reading_and_loses_nothing():
    rnd = np.random.default_rng(3)
    far = 128 / (1 + np.arange(8000) % 8)     # vectors of later blocks are shorter
    rows = (rnd.normal(0, 1, (8000, 64)) * far[:, None]).astype(np.int64)
    blocks = [topk.BlockIndex(np.arange(8000)[b::8], rows[b::8], 32) for b in range(8)]
    read = {False: 0, True: 0}
    for carried in read:
        for block in blocks:
            block.read, block.first = 0, 8
        for i in range(30):
            hits, known = [], None
            for block in blocks:
                ids, scores = block.search(rows[i], i, 10, known if carried else None)
                hits = sorted(hits + list(zip((-scores).tolist(), ids.tolist())))[:10]
                known = -hits[-1][0]
            exact = rows @ rows[i]
            assert hits == sorted((-int(s), j) for j, s in enumerate(exact) if j != i)[:10]
        read[carried] = sum(block.read for block in blocks)
    assert read[True] < 0.6 * read[False]


def test_bounds_hold_for_sums_doubles_cannot_hold():
    """Scores near 2 ** 61 that differ by little, far from zero."""
    rnd = np.random.default_rng(4)
    for spread in (1, 3, 1 << 20):
        rows = (1 << 30) - rnd.integers(0, spread + 1, (600, 2))
        query = np.array([(1 << 28) + 1, (1 << 28) - 1])
        index = topk.BlockIndex(np.arange(600), rows, 32)
        for q in (query, -query, query * [1, -1]):
            exact = sorted((-int(s), j) for j, s in enumerate(
                (rows.astype(object) * q.astype(object)).sum(axis=1)) if j != 5)[:10]
            ids, scores = index.search(q, 5, 10)
            assert list(zip((-scores).tolist(), ids.tolist())) == exact
            ids, scores = index.search(q, 5, 10, -exact[-1][0])
            assert list(zip((-scores).tolist(), ids.tolist())) == exact


def test_equals_brute_force_over_many_blocks_of_a_task(spark):
    """Query rows under one id with different vectors share its list."""
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(16)]) for i in range(400)]
    twice = rows[:40] + [(i, [-x for x in rows[i][1]]) for i in range(0, 40, 2)]
    got = topk.search(table(spark, rows).coalesce(1), table(spark, rows[:40]).coalesce(1),
                      block_rows=16, query_rows=64)
    assert answer(got) == brute(rows, rows[:40], 10)
    both = answer(topk.search(table(spark, rows), table(spark, twice), block_rows=16, query_rows=64))
    for i in range(40):
        hits = sorted((-s, b) for v in [v for j, v in twice if j == i]
                      for _, _, b, s in brute(rows, [(i, v)], 10))[:10]
        assert [(-s, b) for a, _, b, s in both if a == i] == hits
