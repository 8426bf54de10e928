"""Row and class weights, missing values, weighted quantile summaries, paired
intervals and orthogonal least squares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside.operators import sketch
from quayside.operators.boosting import boosted_trees, boosted_trees_fit
from quayside.operators.discriminant import discriminant, discriminant_fit
from quayside.operators.extra_trees import extra_trees
from quayside.operators.knn import knn
from quayside.operators.metrics import bootstrap, confusion, poisson_cuts
from quayside.operators.naive_bayes import SqlNaiveBayes
from quayside.operators.regression import ols_fit
from quayside.operators.tasks import balanced, detect_fraud

FEATS = ["x1", "x2", "x3", "x4"]


@pytest.mark.parametrize("name,make,floor", [
    ("discriminant", discriminant, 0.9), ("knn", lambda: knn(k=9), 0.9),
    ("extra", lambda: extra_trees(numTrees=10, maxDepth=5), 0.8),
    ("boosted", lambda: boosted_trees(rounds=8, maxDepth=3), 0.9),
    ("bayes", SqlNaiveBayes, 0.9)])
def test_class_weights_raise_the_recall_of_the_rare_class(spark, planted, name, make, floor):
    X = planted.withColumn("fraud", F.col("label"))
    got = {b: confusion(detect_fraud(X, make(), numeric=FEATS, categorical=[], balance=b)).first()
           for b in (False, True)}
    assert got[True]["recall"] >= max(floor, got[False]["recall"])


def test_integer_weights_equal_repeated_rows(spark, planted):
    rows = planted.withColumn("w", (F.col("id") % 3 + 1).cast("double"))
    again = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("copy"))
    a, b = (discriminant_fit(df, FEATS, "label", weight=w) for df, w in ((rows, "w"), (again, None)))
    # only differences between the classes' scores mean anything
    assert np.allclose(a.coef[1] - a.coef[0], b.coef[1] - b.coef[0], rtol=1e-9)
    assert np.isclose(a.intercept[1] - a.intercept[0], b.intercept[1] - b.intercept[0], rtol=1e-9)
    edges = [[i / 16 for i in range(1, 16)]] * 4
    a, b = (boosted_trees_fit(df, FEATS, "label", rounds=2, max_depth=3, edges=edges, weight=w)
            for df, w in ((rows, "w"), (again, None)))
    for (la, wa), (lb, wb) in zip(a.trees, b.trees):
        assert [lv.feature for lv in la] == [lv.feature for lv in lb]
        assert [lv.threshold for lv in la] == [lv.threshold for lv in lb]
        assert np.allclose(wa, wb, atol=1e-7)


def test_weights_that_are_none_are_refused(spark, planted):
    rows = planted.withColumn("w", F.when(F.col("id") > 0, 1.0))
    with pytest.raises(ValueError):
        boosted_trees_fit(rows, FEATS, "label", rounds=1, weight="w")
    with pytest.raises(ValueError):
        knn(k=3).setWeightCol("w").fit(rows.withColumn("features", _vector()))
    assert balanced(planted).agg(F.count(F.when(F.col("weight").isNull(), 1))).first()[0] == 0


def _vector():
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.array(*FEATS))


def _brute_best(b, y, miss, lam=1.0):
    """Best (gain, feature, bin, to_left) at the root with margin 0."""
    g, h = 0.5 - y, np.full(len(y), 0.25)
    best = (0.0,)
    for f in range(b.shape[1]):
        for cut in sorted(set(b[:, f]) - {miss}):
            for to_left in (False, True):
                gone = b[:, f] == miss
                if to_left and not gone.any():
                    continue
                left = (b[:, f] <= cut) & ~gone | (gone & to_left)
                GL, HL, G, H = g[left].sum(), h[left].sum(), g.sum(), h.sum()
                if HL < 1 or H - HL < 1:
                    continue
                gain = 0.5 * (GL**2 / (HL + lam) + (G - GL)**2 / (H - HL + lam) - G**2 / (H + lam))
                if gain > best[0] + 1e-12:
                    best = (gain, f, cut, to_left)
    return best


@pytest.mark.parametrize("share", [(0.7, 0.1), (0.1, 0.7)])
def test_default_direction_is_the_better_one(spark, share):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.random((n, 2))
    y = (x[:, 0] > 0.6).astype(float)
    x[rng.random(n) < np.where(y == 1, *share), 0] = np.nan
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y})
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    edges = [[i / 8 for i in range(1, 8)]] * 2
    m = boosted_trees_fit(df, ["a", "b"], "label", rounds=3, max_depth=2, edges=edges)
    bins = np.where(np.isnan(x), 8, np.floor(np.nan_to_num(x) * 8)).astype(int)
    gain, f, cut, to_left = _brute_best(bins, y, 8)
    root = m.trees[0][0][0]
    assert (root.feature[0], root.threshold[0]) == (f + (2 if to_left else 0), float(cut))
    pred = m.transform_columns(df, ["a", "b"], "prediction")
    nan = m.transform_columns(df.withColumn("a", F.coalesce("a", F.lit(float("nan")))), ["a", "b"],
                              "prediction")
    assert confusion(pred).first() == confusion(nan).first()
    assert confusion(pred).first()["accuracy"] > 0.8


def test_front_end_takes_missing_values(spark, planted):
    X = planted.withColumn("late", F.col("label")).withColumn(
        "x1", F.when(F.col("id") % 5 > 0, F.col("x1")))
    from quayside.operators.features import FeatureFront
    front = FeatureFront(FEATS, [])
    model = front.fit(X)
    assert model.names == FEATS + ["x1 missing"]
    row = model.transform(X.where("id = 0")).first()["features"]
    assert abs(row[0]) < 1e-12 and row[4] == 1.0
    kept = FeatureFront(FEATS, [], missing="keep").fit(X)
    assert np.isnan(kept.transform(X.where("id = 0")).first()["features"][0])
    # nulls that training did not have count as the mean
    clean = FeatureFront(FEATS, []).fit(planted)
    assert clean.names == FEATS and abs(clean.transform(X.where("id = 0")).first()["features"][0]) < 1e-12


@pytest.mark.parametrize("parts", [1, 7, 70])
def test_summary_ranks_are_within_the_error(spark, parts):
    rng = np.random.default_rng(3)
    n, size = 40_000, 256
    v = np.concatenate([rng.normal(size=n // 2), rng.integers(0, 5, n // 2)])
    w = rng.integers(0, 9, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w})).repartition(parts)
    shares = [i / 20 for i in range(1, 20)]
    got = sketch.weighted_quantiles(df, ["v"], "w", shares, size)["v"]
    total = w.sum()
    for s, q in zip(shares, got):
        lo, hi = w[v < q].sum() / total, w[v <= q].sum() / total
        assert lo - 4 / size <= s <= hi + 4 / size
    rows = sketch.summaries(df, ["v"], "w", size).collect()
    assert len(rows) <= size + 1
    for r in rows:      # the true rank lies between the bounds
        assert r["lo"] - 1e-6 <= w[v < r["v"]].sum() and w[v <= r["v"]].sum() <= r["hi"] + 1e-6


def test_summary_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (2.0, 0.0)], "v double, w double")
    assert sketch.weighted_quantiles(df, ["v"], "w", [0.5]) == {"v": []}
    assert sketch.weighted_edges(df.where("false"), ["v"], "w") == [[]]


def _draws(keys, replicates, seed=11):
    import hashlib
    cuts = poisson_cuts()
    u = lambda k, r: int(hashlib.md5(f"{seed}|{k}|{r}".encode()).hexdigest()[:8], 16)
    return {k: [sum(u(k, r) >= c for c in cuts) for r in range(replicates)] for k in keys}


def test_intervals_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 60, 400), "label": rng.integers(0, 2, 400).astype(float)})
    pdf["a"] = np.where(rng.random(400) < 0.8, pdf.label, 1 - pdf.label)
    pdf["b"] = np.where(rng.random(400) < 0.7, pdf.label, 1 - pdf.label)
    df = spark.createDataFrame(pdf)
    preds = {("t", m): df.select("k", "label", F.col(m).alias("prediction")) for m in "ab"}
    got = {(r["model"], r["against"], r["metric"]): r for r in
           bootstrap(preds, "k", replicates=50, digits=None).collect()}
    assert len(got) == 9
    w = _draws(pdf.k.unique(), 50)
    acc = {m: [np.average(pdf.label == pdf[m], weights=[w[k][r] for k in pdf.k]) for r in range(50)]
           for m in "ab"}
    for key, v in ((("a", "", "accuracy"), acc["a"]),
                   (("a", "b", "accuracy"), np.subtract(acc["a"], acc["b"]))):
        assert np.isclose(got[key]["low"], np.quantile(v, 0.025))
        assert np.isclose(got[key]["high"], np.quantile(v, 0.975))
    assert np.isclose(got["a", "", "accuracy"]["estimate"], (pdf.label == pdf.a).mean())
    same = {("t", m): preds["t", "a"] for m in ("a", "c")}
    zero = [r for r in bootstrap(same, "k", replicates=20).collect() if r["against"]]
    assert all(r["low"] == r["high"] == 0 for r in zero)    # paired: no spread


def test_poisson_weights_have_mean_and_variance_one():
    p = np.diff([0, *poisson_cuts(), 2 ** 32]) / 2 ** 32
    k = np.arange(len(p))
    assert abs((p * k).sum() - 1) < 1e-6 and abs((p * k * k).sum() - 2) < 1e-6


@pytest.mark.parametrize("parts", [1, 5, 130])
def test_least_squares_on_a_nearly_collinear_design(spark, planted, parts):
    df = planted.select("id", "x1", (F.col("x1") + 1e-8 * (F.col("x2") - 0.5)).alias("x2"), "x3")
    df = df.withColumn("t", 3 * F.col("x1") - 2 * F.col("x2") + 0.5 * F.col("x3")).repartition(parts)
    m = ols_fit(df, ["x1", "x2", "x3"], "t")
    assert np.allclose(m.coef, [3, -2, 0.5], atol=1e-6) and abs(m.intercept) < 1e-6


def test_least_squares_defined_cases(spark, planted):
    twice = planted.withColumn("again", F.col("x1"))
    m = ols_fit(twice.withColumn("t", 2 * F.col("x1") + 1), ["x1", "again"], "t")
    assert np.allclose(m.coef, [1, 1]) and np.isclose(m.intercept, 1)
    with pytest.raises(ValueError):
        ols_fit(planted.where("false"), ["x1"], "target")
    with pytest.raises(ValueError):
        ols_fit(planted.withColumn("x1", F.when(F.col("id") > 3, F.col("x1"))), ["x1"], "target")
