"""The forest with hash-drawn bags against a row-by-row forest."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quayside.operators import bagged_forest as B
from quayside.operators.metrics import confusion, poisson_cuts
from quayside.operators.tasks import balanced

COLS = ["x1", "x2", "x3", "x4"]
EDGES = [[0.2, 0.4, 0.6, 0.8]] * 4


def by_hand(rows, trees, depth, k, seed):
    """Splits and leaves, one tree and node after the other."""
    splits, leaves = [], []

    def gini(ys):
        n = sum(w for _, w in ys)
        return 1 - sum((sum(w for y, w in ys if y == c) / n) ** 2 for c in (0, 1)) if n else 0.0

    def grow(t, node, part, left):
        ys = [(y, w) for _, y, w in part]
        n, best = sum(w for _, w in ys), None
        if left and gini(ys) > 0:
            for f in sorted(range(4), key=lambda f: (B._u32(seed, t, node, f, "pick"), f))[:k]:
                for cut in sorted({x[f] for x, _, _ in part})[:-1]:
                    a = [(y, w) for x, y, w in part if x[f] <= cut]
                    b = [(y, w) for x, y, w in part if x[f] > cut]
                    na, nb = (sum(w for _, w in s) for s in (a, b))
                    gain = round(gini(ys) - na / n * gini(a) - nb / n * gini(b), 12)
                    if gain > 0 and (best is None or (-gain, f, cut) < best):
                        best = (-gain, f, cut)
        if best is None:
            leaves.append((t, node, [sum(w for y, w in ys if y == c) / n for c in (0, 1)]))
            return
        _, f, cut = best
        splits.append((t, node, f, cut))
        grow(t, 2 * node + 1, [r for r in part if r[0][f] <= cut], left - 1)
        grow(t, 2 * node + 2, [r for r in part if r[0][f] > cut], left - 1)

    for t in range(trees):
        drawn = [(x, y, sum(B._u32(seed, key, t) >= c for c in poisson_cuts())) for key, x, y in rows]
        grow(t, 0, [r for r in drawn if r[2]], depth)
    return sorted(splits), sorted(leaves)


@pytest.mark.parametrize("cells", [1 << 20, 64])     # all nodes at once, and one or two a job
def test_trees_of_a_row_by_row_forest(spark, planted, monkeypatch, cells):
    monkeypatch.setattr(B, "CELLS", cells)
    df = planted.where("id < 600").withColumn("label", (F.col("x1") + F.col("x2") > 1.1).cast("double"))
    rows = [(r["id"], [sum(r[c] >= e for e in EDGES[0]) for c in COLS], int(r["label"]))
            for r in df.collect()]
    m = B.bagged_forest_fit(df, COLS, ["id"], num_trees=3, max_depth=3, k_features=2, edges=EDGES)
    splits, leaves = by_hand(rows, 3, 3, 2, 7)
    assert m.splits == splits
    assert [(t, n) for t, n, _ in m.leaves] == [(t, n) for t, n, _ in leaves]
    for (_, _, a), (_, _, b) in zip(m.leaves, leaves):
        assert a == pytest.approx(b, abs=1e-12)


def test_partitions_do_not_matter(spark, planted):
    fits = [B.bagged_forest_fit(planted.repartition(n), COLS, ["id"], num_trees=4, max_depth=4)
            for n in (1, 3, 9)]
    assert fits[0] == fits[1] == fits[2]


def test_deep_trees_fit_the_rule(spark, planted):
    m = B.bagged_forest_fit(planted, COLS, ["id"], num_trees=8, max_depth=16, k_features=2)
    assert max((n + 1).bit_length() - 1 for _, n, _ in m.leaves) >= 8
    assert confusion(m.transform_columns(planted, COLS, "prediction")).first()["f1"] > 0.9


def test_stage_saves_and_loads(spark, planted, tmp_path):
    stages = [VectorAssembler(inputCols=COLS, outputCol="features"),
              B.bagged_forest(keyCols=["order_key"], numTrees=5, maxDepth=5).setWeightCol("weight")]
    model = Pipeline(stages=stages).fit(balanced(planted))
    model.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = ([r["prediction"] for r in x.transform(planted).orderBy("id").collect()]
            for x in (model, again))
    assert a == b
    # classes that weigh the same leave few of the rare one unseen
    assert confusion(model.transform(planted)).first()["recall"] > 0.9


def test_defined_cases(spark):
    rows = [(1, 0.1, 0.0), (2, None, 1.0), (3, math.nan, 1.0), (4, 0.2, 0.0), (None, 0.9, 1.0)] * 20
    df = spark.createDataFrame(rows, "k long, x double, label double")
    m = B.bagged_forest_fit(df, ["x"], ["k"], num_trees=9, max_depth=2, edges=[[0.5]])
    got = {r["label"]: r["p"] for r in m.transform_columns(df, ["x"], "p").collect()}
    assert got == {0.0: 0.0, 1.0: 1.0}          # missing lies above every cut
    assert m.transform_columns(df.limit(0), ["x"], "p").collect() == []
    one = B.bagged_forest_fit(df.where("label = 1"), ["x"], ["k"], num_trees=2, edges=[[0.5]])
    assert one.splits == []
    with pytest.raises(Exception, match="null"):
        B.bagged_forest_fit(df.withColumn("label", F.lit(None).cast("double")), ["x"], ["k"],
                            edges=[[0.5]])
    with pytest.raises(ValueError):
        B.bagged_forest_fit(df, ["x"], ["k"], max_bins=500)
