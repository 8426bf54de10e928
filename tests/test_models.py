"""Planted-signal checks for the classifiers and regressors, and model
identities (determinism under repartitioning, exactness against brute force)."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from quayside.operators import classifiers as C
from quayside.operators.boosting import boosted_trees, boosted_trees_fit
from quayside.operators.discriminant import discriminant, discriminant_fit
from quayside.operators.extra_trees import extra_trees, extra_trees_fit
from quayside.operators.features import feature_stages
from quayside.operators.knn import knn, knn_predict
from quayside.operators.metrics import confusion
from quayside.operators.naive_bayes import gaussian_nb
from quayside.operators.regression import ols_fit
from quayside.operators.split import split

FEATS = ["x1", "x2", "x3", "x4"]

ZOO = {
    "logistic": (lambda: C.logistic(), 0.8),
    # a rare class cut off by a corner is far from LDA's Gaussian model:
    # it beats the majority rule (F1 0) but stays low; see the numpy check
    "discriminant": (lambda: discriminant(), 0.1),
    "naive_bayes": (lambda: C.gaussian_nb(), 0.4),
    "svm": (lambda: C.linear_svm(regParam=0.001), 0.6),
    "knn": (lambda: knn(k=5), 0.6),
    "forest": (lambda: C.random_forest(numTrees=20, maxDepth=6), 0.6),
    "extra_trees": (lambda: extra_trees(numTrees=10, maxDepth=8, kFeatures=2), 0.5),
    "boosted": (lambda: boosted_trees(rounds=10, maxDepth=3, eta=0.5), 0.6),
    "tree": (lambda: C.decision_tree(maxDepth=6), 0.6),
}


@pytest.mark.parametrize("name", sorted(ZOO))
def test_classifier_finds_planted_rule(spark, planted, name):
    factory, floor = ZOO[name]
    train, test = split(planted, "order_key")
    model = Pipeline(stages=feature_stages(FEATS, [], scale=True) + [factory()]).fit(train)
    r = confusion(model.transform(test)).first()
    assert r.f1 >= floor, (name, r)


def test_sql_naive_bayes_matches_spark_ml(spark, planted):
    from pyspark.ml.feature import VectorAssembler
    train, test = split(planted, "order_key")
    mine = gaussian_nb(train, FEATS, "label").transform(test)
    va = VectorAssembler(inputCols=FEATS, outputCol="features")
    ml = C.gaussian_nb().fit(va.transform(train)).transform(va.transform(test))
    a = mine.select("id", F.col("prediction").alias("p1"))
    b = ml.select("id", F.col("prediction").alias("p2"))
    j = a.join(b, "id")
    assert j.count() == test.count()
    assert j.where("p1 != p2").count() <= 2   # Spark adds a tiny variance term


def test_discriminant_matches_numpy(spark, planted):
    pdf = planted.select(*FEATS, "label").toPandas()
    X, y = pdf[FEATS].to_numpy(), pdf["label"].to_numpy()
    m = discriminant_fit(planted, FEATS, "label", ridge=0.0)
    mus = [X[y == k].mean(0) for k in (0.0, 1.0)]
    S = sum(((X[y == k] - mu).T @ (X[y == k] - mu)) for k, mu in zip((0.0, 1.0), mus)) / (len(y) - 2)
    # scores are defined up to a class-independent term: compare differences
    a = [np.linalg.solve(S, mu) for mu in mus]
    b = [-0.5 * mu @ ai + math.log((y == k).mean()) for mu, ai, k in zip(mus, a, (0.0, 1.0))]
    assert np.allclose(m.coef[1] - m.coef[0], a[1] - a[0], rtol=1e-6)
    assert abs((m.intercept[1] - m.intercept[0]) - (b[1] - b[0])) < 1e-6 * max(1, abs(b[1] - b[0]))


def test_ols_recovers_planted_weights(spark, planted):
    m = ols_fit(planted, FEATS, "target")
    assert np.allclose(m.coef, [3.0, -2.0, 0.5, 0.0], atol=0.01)
    assert abs(m.intercept - 1.0) < 0.01


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 6, size=(300, 3)).astype(float)   # many duplicates
    pts[:100] = [2.0, 2.0, 2.0]                             # one hot vector
    labels = rng.integers(0, 3, size=300).astype(float)
    train = spark.createDataFrame(
        [(i, *map(float, p), float(l)) for i, (p, l) in enumerate(zip(pts, labels))],
        "tid long, a double, b double, c double, label double")
    q = spark.createDataFrame([(1000 + i, *map(float, p)) for i, p in
                               enumerate(rng.uniform(-1, 7, size=(40, 3)))] +
                              [(2000, 2.0, 2.0, 2.0)],
                              "qid long, a double, b double, c double")
    k = 5
    got = {r.qid: r.prediction for r in
           knn_predict(train, q, ["a", "b", "c"], k, "label", train_id="tid", query_id="qid",
                       pivots=12, block_rows=20).collect()}
    for r in q.collect():
        x = np.array([r.a, r.b, r.c])
        d = np.sqrt(((pts - x) ** 2).sum(1))
        order = sorted(range(300), key=lambda i: (d[i] ** 2, labels[i], i))[:k]
        votes = {}
        for rank, i in enumerate(order, 1):
            c, s = votes.get(labels[i], (0, 0))
            votes[labels[i]] = (c + 1, s + rank)
        best = sorted(votes.items(), key=lambda kv: (-kv[1][0], kv[1][1], kv[0]))[0][0]
        assert got[r.qid] == best, r.qid


def _forest_signature(model):
    return [(lv.feature, [round(c, 9) for c in lv.threshold]) for lv in model.levels]


def test_extra_trees_independent_of_partitioning(spark, planted):
    a = extra_trees_fit(planted.repartition(2), FEATS, "label", num_trees=4, max_depth=4, seed=11)
    b = extra_trees_fit(planted.repartition(9), FEATS, "label", num_trees=4, max_depth=4, seed=11)
    assert _forest_signature(a) == _forest_signature(b)


def _brute_extra_trees(X, y, seed, trees, depth, k):
    """The forest grown row by row: {(tree, node): (feature, cut)}."""
    import hashlib
    u = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:8], 16)
    gini = lambda v: 1 - ((v == 0).mean() ** 2 + (v == 1).mean() ** 2) if len(v) else 0.0
    out = {}
    for t in range(trees):
        nodes = {0: np.arange(len(y))}
        for _ in range(depth):
            nxt = {}
            for node, rows in nodes.items():
                x, v = X[rows], y[rows]
                if len(v) < 2 or len(set(v)) < 2:
                    continue
                free = [f for f in range(X.shape[1]) if x[:, f].max() > x[:, f].min()]
                drawn = sorted(free, key=lambda f: (u(seed, t, node, f, "pick"), f))[:k]
                best = None
                for f in drawn:
                    lo, hi = x[:, f].min(), x[:, f].max()
                    cut = lo + u(seed, t, node, f) / 2 ** 32 * (hi - lo)
                    left = x[:, f] <= cut
                    gain = gini(v) - left.mean() * gini(v[left]) - (~left).mean() * gini(v[~left])
                    if best is None or (-round(gain, 12), f) < best[0]:
                        best = ((-round(gain, 12), f), f, cut, left)
                if best:
                    out[t, node] = best[1], round(best[2], 9)
                    nxt[2 * node + 1], nxt[2 * node + 2] = rows[best[3]], rows[~best[3]]
            nodes = nxt
    return out


def test_extra_trees_equal_brute_force(spark, planted):
    pdf = planted.select(*FEATS, "label").toPandas()
    m = extra_trees_fit(planted, FEATS, "label", num_trees=3, max_depth=3, seed=5, k_features=2)
    got = {}
    for lv in m.levels:
        width = 2 ** lv.depth
        for i, f in enumerate(lv.feature):
            if f >= 0:
                got[i // width, i % width + width - 1] = f, round(lv.threshold[i], 9)
    assert got == _brute_extra_trees(pdf[FEATS].to_numpy(), pdf["label"].to_numpy(), 5, 3, 3, 2)


def test_tree_walk_equals_the_column_form(spark, planted):
    m = extra_trees_fit(planted, FEATS, "label", num_trees=3, max_depth=3, seed=5)
    from quayside.operators.trees import node_of
    X = planted.select(*FEATS).toPandas().to_numpy()
    x = F.array(*FEATS)
    node = F.lit(0)
    for lv in m.levels:
        node = lv.step(node, F.lit(1), x)
    got = [r[0] for r in planted.select(node).collect()]
    assert got == node_of(m.levels, 1, X).tolist()


def _log_loss(model, df):
    p = 1 / (1 + F.exp(-F.col("m")))
    loss = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return model.with_margin(df, FEATS, "m").agg(F.avg(loss)).first()[0]


def test_boosting_loss_falls_every_round(spark, planted):
    m = boosted_trees_fit(planted, FEATS, "label", rounds=5, max_depth=2, eta=0.3, refresh=2)
    from quayside.operators.boosting import BoostedTreesModel
    losses = [_log_loss(BoostedTreesModel(m.edges, m.trees[:n], 0.0), planted) for n in range(6)]
    assert all(b < a for a, b in zip(losses, losses[1:])), losses


def test_boosting_does_not_depend_on_partitions_or_refresh(spark, planted):
    models = [boosted_trees_fit(planted.repartition(n), FEATS, "label", rounds=3, max_depth=2,
                                refresh=r) for n, r in ((2, 10), (5, 1), (9, 2))]
    sig = lambda m: (m.edges, [[(lv.feature, lv.threshold) for lv in levels]
                               for levels, _ in m.trees])
    assert sig(models[0]) == sig(models[1]) == sig(models[2])
    for other in models[1:]:
        for (_, l1), (_, l2) in zip(models[0].trees, other.trees):
            assert np.allclose(l1, l2, rtol=1e-8)


def test_quantile_edges_are_near_the_quantiles(spark, planted):
    from quayside.operators.boosting import quantile_edges
    v = planted.select("x1").toPandas()["x1"].to_numpy()
    (edges,) = quantile_edges(planted.select("x1"), ["x1"], 8)
    assert np.allclose(edges, np.quantile(v, np.arange(1, 8) / 8), atol=0.01)
    same = planted.select(F.lit(3.0).alias("x1"))
    assert quantile_edges(same, ["x1"], 8) == [[]]


def test_boosting_without_any_split(spark, planted):
    flat = planted.select(F.lit(1.0).alias("x1"), "label")
    m = boosted_trees_fit(flat, ["x1"], "label", rounds=2)
    assert m.transform_columns(flat, ["x1"], "p").where("p = 1").count() == 0


def test_compare_classifiers_one_row_per_model(spark):
    from quayside.operators.tasks import compare_classifiers
    from quayside.sources import order_lines
    from conftest import SF_SMALL
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    out = compare_classifiers(order_lines(spark, SF_SMALL),
                              {"nb": C.gaussian_nb, "lr": lambda: C.logistic(maxIter=10)},
                              "late", ["order_day", "l_quantity"], [])
    rows = {r.model: r for r in out.collect()}
    assert set(rows) == {"nb", "lr"}
    assert all(r.task == "late" and r.n == rows["nb"].n > 0 for r in rows.values())
    assert rows["nb"].accuracy > 0.6
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before   # features released


def test_front_end_has_full_rank_and_drops_a_level(spark):
    rows = [(float(i % 7), "abcde"[i % 5], "uv"[i % 3 % 2], 1.0) for i in range(210)]
    df = spark.createDataFrame(rows, "n double, c string, d string, label double")
    front = Pipeline(stages=feature_stages(["n"], ["c", "d"])).fit(df)
    out = np.array([r[0].toArray() for r in front.transform(df).select("features").collect()])
    assert out.shape[1] == 1 + 4 + 1
    design = np.column_stack([np.ones(len(out)), out])
    assert np.linalg.matrix_rank(design) == design.shape[1]
    assert set(np.unique(out[:, 1:])) == {0.0, 1.0}     # dummies are not scaled
    new = spark.createDataFrame([(1.0, "unseen", None, 1.0)], df.schema)
    assert front.transform(new).first()["features"].toArray()[1:].tolist() == [0.0] * 5


def test_detect_fraud_on_the_planted_rule(spark, planted):
    from quayside.operators.tasks import detect_fraud
    X = planted.withColumn("fraud", F.col("label").cast("int"))
    floors = {"logistic": 0.6, "naive_bayes": 0.4, "forest": 0.5, "tree": 0.5, "boosted": 0.6}
    for name, floor in floors.items():
        pred = detect_fraud(X, ZOO[name][0](), numeric=FEATS, categorical=[])
        r = confusion(pred).first()
        assert r.f1 >= floor and r.recall >= 0.6, (name, r)


def test_revenue_and_quantity_find_planted_weights(spark, planted):
    from quayside.operators.regression import linear_regression, regression_metrics
    from quayside.operators.tasks import predict_quantity, predict_revenue
    for run, goal in ((predict_revenue, "revenue"), (predict_quantity, "quantity")):
        pred = run(planted.withColumn(goal, F.col("target")), linear_regression(),
                   numeric=FEATS, categorical=[])
        assert regression_metrics(pred).first().r2 > 0.999


def test_logistic_gradient_is_zero_at_the_fit(spark, planted):
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=FEATS, outputCol="features").transform(planted)
    m = C.logistic(regParam=0.0, tol=1e-12, maxIter=500).fit(df)
    pdf = planted.select(*FEATS, "label").toPandas()
    X, y = pdf[FEATS].to_numpy(), pdf["label"].to_numpy()
    p = 1 / (1 + np.exp(-(X @ m.coefficients.toArray() + m.intercept)))
    assert abs((p - y).mean()) < 1e-5 and np.abs(((p - y)[:, None] * X).mean(axis=0)).max() < 1e-5


def test_knn_with_an_outlier_and_a_dense_cell(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0, 1e-3, (400, 3)), rng.uniform(0, 1, (200, 3)),
                          [[1e6, 0, 0]]])
    rows = [(i, *map(float, p), float(i % 2)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    from quayside.operators.knn import knn_neighbors
    got = knn_neighbors(df, df, ["a", "b", "c"], 4, train_id="id", query_id="id",
                        exclude_self=True, pivots=20, block_rows=64).collect()
    near = {}
    for r in got:
        near.setdefault(r.id, []).append((r.rank0, r.tid))
    for i, p in enumerate(pts):
        d = ((pts - p) ** 2).sum(axis=1)
        d[i] = np.inf
        order = sorted(range(len(pts)), key=lambda j: (d[j], j % 2, j))[:4]
        assert [t for _, t in sorted(near[i])] == order, i


def test_knn_pivots_prune(spark, monkeypatch):
    """With clusters far apart, each query meets its own cluster's items only."""
    import quayside.operators.knn as K
    met = []
    real = K._search

    def spy(items, visits, k, exclude_self, **kw):
        sizes = items.groupBy("block").count()
        met.append(visits.join(sizes, "block").agg(F.sum("count")).first()[0] or 0)
        return real(items, visits, k, exclude_self, **kw)
    monkeypatch.setattr(K, "_search", spy)
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(100 * c, 1, (60, 2)) for c in range(10)] + [[[1e7, 1e7]]])
    df = spark.createDataFrame([(i, *map(float, p), 1.0) for i, p in enumerate(pts)],
                               "id long, a double, b double, label double")
    K.knn_neighbors(df, df, ["a", "b"], 3, train_id="id", query_id="id", exclude_self=True,
                    pivots=40).count()
    assert 0 < sum(met) < 0.35 * len(pts) ** 2


def test_knn_vectors_of_any_length_and_empty_training(spark):
    rows = [(i, [float(i % 4), 0.0, float(i)] + [0.5] * 70, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = knn_predict(df, df, "v", 1, train_id="id", query_id="id", exclude_self=True)
    assert got.count() == 30
    none = knn_predict(df.where("id < 0"), df, "v", 3, train_id="id", query_id="id")
    assert none.columns == ["id", "prediction"] and none.count() == 0


def test_knn_lsh_recall(spark):
    from quayside.operators.knn import knn_neighbors
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 8)) * 4
    pts = centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 8)) * 0.3
    df = spark.createDataFrame([(i, [float(x) for x in p], float(i % 2)) for i, p in enumerate(pts)],
                               "id long, v array<double>, label double")
    a, b = ({(r.id, r.tid) for r in knn_neighbors(
        df, df, "v", 5, train_id="id", query_id="id", exclude_self=True, method=m).collect()}
        for m in ("exact", "lsh"))
    assert len(a) == len(b) == 900 * 5
    assert len(a & b) >= 0.9 * len(a)


def test_vectors_of_different_lengths_are_refused(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([1.0]), 0.0), (Vectors.dense([1.0, 2.0]), 1.0)],
                               ["features", "label"])
    with pytest.raises(ValueError):
        knn(k=1).fit(df)


def test_tree_fits_leave_no_checkpoint_files(spark, planted):
    import os
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    count = lambda: sum(len(files) for _, _, files in os.walk(folder))
    before = count()
    extra_trees_fit(planted, FEATS, "label", num_trees=2, max_depth=2)
    boosted_trees_fit(planted, FEATS, "label", rounds=3, max_depth=2, refresh=2)
    assert count() <= before
