"""Physical-plan checks: pruning and pushdown at the scan, no cross joins."""

import numpy as np

import quayside.operators.knn as K
from quayside.sources import order_lines
from quayside.operators.split import split

from conftest import SF_SMALL

CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_lines_prunes_columns_and_pushes_filters(spark):
    plan = _plan(order_lines(spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int" in plan
    assert "l_suppkey" not in plan and "l_linestatus" not in plan   # unused columns pruned
    assert "PushedFilters: [IsNotNull(l_orderkey), IsNotNull(l_partkey)]" in plan
    for c in CROSS:
        assert c not in plan


def test_split_adds_no_exchange(spark):
    lines = order_lines(spark, SF_SMALL)
    train, _ = split(lines)
    assert _plan(train).count("Exchange") == _plan(lines).count("Exchange")


def test_knn_search_is_equi_joins(spark, monkeypatch):
    plans = []
    real = K.checkpoint

    def spy(df, eager=True):
        plans.append(_plan(df))
        return real(df, eager)
    monkeypatch.setattr(K, "checkpoint", spy)
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, p), float(i % 2)) for i, p in enumerate(rng.normal(size=(200, 4)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double")
    last = K.knn_predict(df, df, ["a", "b", "c", "d"], 3, train_id="id", query_id="id",
                         exclude_self=True)
    last.collect()
    assert plans
    for p in [*plans, _plan(last)]:
        for c in CROSS:
            assert c not in p
