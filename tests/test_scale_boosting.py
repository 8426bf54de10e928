"""Boosting reads its rows once a level, and bins and counts them in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import boosting

FEATS = ["x1", "x2", "x3", "x4"]


def test_a_level_of_boosting_reads_the_rows_once(spark, planted, monkeypatch):
    plans = []
    real = boosting._histogram

    def spy(*args):
        out = real(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(boosting, "_histogram", spy)
    edges = [[i / 8 for i in range(1, 8)]] * 4
    boosting.boosted_trees_fit(planted, FEATS, "label", rounds=1, max_depth=3, edges=edges)
    # the level's own pass over the rows; those of the levels above are persisted
    own = [p.split("InMemoryRelation")[0].count("MapInArrow") for p in plans]
    assert own == [1] * len(plans) and len(plans) == 3


def test_siblings_have_the_sums_of_their_rows(spark, planted):
    edges = [[i / 8 for i in range(1, 8)]] * 4
    m = boosting.boosted_trees_fit(planted, FEATS, "label", rounds=1, max_depth=2, edges=edges)
    (levels, leaf), = m.trees
    x = np.array(planted.select(*FEATS).collect())
    y = np.array([r[0] for r in planted.select("label").collect()])
    node = boosting.node_of(levels, 0, boosting._views(boosting.binned(x, edges), m.missing))
    for n in np.unique(node):
        g, h = (0.5 - y[node == n]).sum(), 0.25 * (node == n).sum()
        assert leaf[n] == pytest.approx(-0.3 * g / (h + 1.0), abs=1e-8)


@pytest.mark.parametrize("many", [1, 40, 300])
def test_bins_in_numpy_are_those_of_the_bucketizer(spark, many):
    rng = np.random.default_rng(many)
    edges = [sorted({float(v) for v in rng.normal(size=many)}), [], [0.0]]
    values = [*edges[0], -1e300, 1e300, 0.0, float("nan"), float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(v, v, v) for v in values], "a double, b double, c double")
    want, names = boosting.bin_columns(rows, ["a", "b", "c"], edges)
    x = np.array([[np.nan if v is None else v] * 3 for v in values])
    assert boosting.binned(x, edges).tolist() == [list(r) for r in want.select(*names).collect()]


def test_quantile_edges_are_those_of_the_rows_counted_one_by_one(spark):
    rows = spark.createDataFrame(
        [(float(i % 37) - 5, None if i % 7 == 0 else 1.5 ** (i % 90) - 3, float("nan"), 0.0)
         for i in range(3000)], "a double, b double, c double, d double").repartition(5)
    edges = boosting.quantile_edges(rows, ["a", "b", "c", "d"], 16)
    assert edges[2:] == [[], []]
    for col, found in zip("ab", edges):
        v = np.sort([r[0] for r in rows.select(col).where(F.col(col).isNotNull()).collect()])
        # the values here are further apart than a bucket is wide
        last = np.searchsorted(v, np.unique(v), side="right")
        first = np.searchsorted(v, np.unique(v), side="left")
        want = np.unique(v)[(last * 16 // len(v) > first * 16 // len(v)) & (last < len(v))]
        assert found == want.tolist()
