"""The four prediction goals on order lines.

Each goal is: take ``order_lines``, choose a label or target, split by
order key, fit the feature front end and the model on the training side
only, and predict the held-out side.  The labels are proxies built from the
test tables (see ``sources.tables.order_lines``).
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.wrapper import JavaEstimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ORDER_LINE_CATEGORICAL, ORDER_LINE_NUMERIC
from .features import feature_stages
from .split import split, split_sides

TASK_LABEL = {"fraud": "fraud", "late": "late", "revenue": "revenue",
              "quantity": "quantity"}

# Features per goal: nothing known only after the order (ship date), no
# price for revenue beyond the list price, no quantity for quantity.
TASK_NUMERIC = {
    "fraud": ORDER_LINE_NUMERIC,
    "late": ORDER_LINE_NUMERIC,
    "revenue": ORDER_LINE_NUMERIC,
    "quantity": [c for c in ORDER_LINE_NUMERIC if c != "l_quantity"],
}


def labelled(lines: DataFrame, task: str) -> DataFrame:
    """order_lines with ``label`` (double) set to the goal's column."""
    return lines.withColumn("label", F.col(TASK_LABEL[task]).cast("double"))


def balanced(train: DataFrame, name: str = "weight") -> DataFrame:
    """``train`` with a weight that gives both classes the same total: a rare
    class is then not drowned by the other."""
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    total, weight = sum(sizes.values()), F.lit(1.0)
    for y, n in sizes.items():
        weight = F.when(F.col("label") == y, F.lit(total / (len(sizes) * n))).otherwise(weight)
    return train.withColumn(name, weight)


def weighted(estimator, name: str = "weight"):
    """The estimator reading row weights, if it can (all nine do)."""
    return estimator.setWeightCol(name) if estimator.hasParam("weightCol") else estimator


#: Which side of the split a held row is on.
TEST = "__test"


def chosen_lines(X: DataFrame, task: str, numeric=None, categorical=None,
                 key: str = "order_key") -> DataFrame:
    """The columns of ``X`` that a goal's models use, with the side of each row."""
    numeric = list(numeric if numeric is not None else TASK_NUMERIC[task])
    categorical = list(categorical if categorical is not None else ORDER_LINE_CATEGORICAL)
    cols = dict.fromkeys([key, TASK_LABEL[task], *numeric, *categorical])
    return split_sides(X.select(*cols), key).withColumn(TEST, F.col("side") == "test").drop("side")


def held_lines(X: DataFrame, task: str, numeric=None, categorical=None,
               key: str = "order_key") -> DataFrame:
    """``chosen_lines``, persisted: read, joined and split once for training, judging
    and all models.  The caller unpersists them when the results are in."""
    return chosen_lines(X, task, numeric, categorical, key).persist()


def sides(X: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, by the held side if there is one."""
    if TEST not in X.columns:
        return split(X, key)
    return X.where(~F.col(TEST)).drop(TEST), X.where(TEST).drop(TEST)


def fit_predict(X: DataFrame, estimator, numeric=None, categorical=None,
                key: str = "order_key", scale: bool = True, task: str = "late",
                balance: bool = False):
    """Split ``X`` by ``key``, fit front end + estimator on train, predict test.

    Returns (test predictions, fitted PipelineModel).  The training columns
    are persisted (memory, spilling to disk) while fitting, because the front
    end and iterative learners read them several times, unless ``X`` is held
    already (``held_lines``, or stored).  With ``balance`` the
    training rows carry class weights for estimators that take them.
    """
    numeric = list(numeric if numeric is not None else TASK_NUMERIC[task])
    categorical = list(categorical if categorical is not None else ORDER_LINE_CATEGORICAL)
    held = TEST in X.columns
    cols = [key, "label"] + numeric + categorical
    train, test = sides(X.select(*cols, *([TEST] if held else [])), key)
    if not held:
        train = train.persist()
    if balance:
        estimator = weighted(estimator)
    model = Pipeline(stages=feature_stages(numeric, categorical, scale) + [estimator]).fit(
        balanced(train) if balance else train)
    pred = model.transform(test)
    if not held:
        train.unpersist()
    return pred, model


def detect_fraud(X: DataFrame, classifier, **kw) -> DataFrame:
    """Predict the fraud label on held-out lines, classes weighted."""
    return fit_predict(labelled(X, "fraud"), classifier, task="fraud",
                       **{"balance": True, **kw})[0]


def predict_late(X: DataFrame, classifier, **kw) -> DataFrame:
    """Predict late delivery on held-out lines."""
    return fit_predict(labelled(X, "late"), classifier, task="late", **kw)[0]


def predict_revenue(X: DataFrame, regressor, **kw) -> DataFrame:
    """Predict line revenue on held-out lines."""
    return fit_predict(labelled(X, "revenue"), regressor, task="revenue", **kw)[0]


def predict_quantity(X: DataFrame, regressor, **kw) -> DataFrame:
    """T4: predict ordered quantity on held-out lines."""
    return fit_predict(labelled(X, "quantity"), regressor, task="quantity", **kw)[0]


def compare_classifiers(X: DataFrame, classifiers: dict, task: str, numeric=None,
                        categorical=None, key: str = "order_key",
                        balance: bool = False, parallelism: int = 4) -> DataFrame:
    """Train every classifier on one shared front end, judge on held-out rows.

    The source is read and joined once: the columns that the models use are
    persisted before the front end is fitted, then the assembled features
    are, and every classifier reads those.  ``parallelism`` fits run at a time, as
    in Spark ML's ``CrossValidator``: while one plans its next small job, the cores
    work for another.  The models built here come first: they run the longest rows of
    small jobs, which would else end alone.  The metrics table (one row per model) is checkpointed
    before all that is released.
    """
    from ..session import checkpoint
    from .metrics import compare
    numeric = list(numeric if numeric is not None else TASK_NUMERIC[task])
    categorical = list(categorical if categorical is not None else ORDER_LINE_CATEGORICAL)
    rows = held_lines(X, task, numeric, categorical, key)
    train, test = sides(labelled(rows, task), key)
    front = Pipeline(stages=feature_stages(numeric, categorical)).fit(train)
    tr = front.transform(train).select(key, "label", "features")
    tr = (balanced(tr) if balance else tr).persist()
    te = front.transform(test).select(key, "label", "features").persist()
    for side in (tr, te):
        side.count()        # held before several fits ask for it

    def predicted(est):
        return (weighted(est) if balance else est).fit(tr).transform(te)

    made = {name: make() for name, make in classifiers.items()}
    order = sorted(made, key=lambda name: isinstance(made[name], JavaEstimator))
    target = inheritable_thread_target(X.sparkSession)(predicted)
    with ThreadPool(max(1, min(parallelism, len(order)))) as pool:
        found = dict(zip(order, pool.map(target, [made[name] for name in order], chunksize=1)))
    preds = {(task, name): found[name] for name in classifiers}
    out = checkpoint(compare(preds))
    for held in (rows, tr, te):
        held.unpersist()
    return out
