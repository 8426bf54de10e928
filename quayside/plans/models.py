"""Registered model queries: the nine classifiers and the regressors.

These train on the md5 training side of the whole table and report metrics
on the held-out side.  Full model fits have no plain-SQL form, so they have
no oracle string; their single steps are checked against SQL in
``queries.py`` (extra_trees_level1, boost_round1_gain, tree_split_gain,
gaussian_nb_confusion, discriminant_2d_confusion, knn_exact).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifiers as C
from ..operators.boosting import boosted_trees
from ..operators.discriminant import discriminant
from ..operators.extra_trees import extra_trees
from ..operators.knn import knn
from ..operators.metrics import confusion
from ..operators.regression import linear_regression, poisson_regression, regression_metrics
from ..operators.tasks import (chosen_lines, compare_classifiers, detect_fraud, held_lines,
                               predict_late, predict_quantity, predict_revenue)
from ..session import checkpoint, stored
from ..sources.tables import order_lines
from .queries import register


def classifier_zoo() -> dict:
    """The nine classifiers with the parameters used in the registered runs."""
    return {
        "logistic_regression": lambda: C.logistic(maxIter=100),
        "linear_discriminant": lambda: discriminant(),
        "gaussian_naive_bayes": lambda: C.gaussian_nb(),
        "linear_svm": lambda: C.linear_svm(maxIter=50, regParam=0.01),
        "k_nearest_neighbours": lambda: knn(k=5),
        "random_forest": lambda: C.random_forest(numTrees=20, maxDepth=6),
        "extra_trees": lambda: extra_trees(numTrees=10, maxDepth=6),
        "boosted_trees": lambda: boosted_trees(rounds=10, maxDepth=3),
        "decision_tree": lambda: C.decision_tree(maxDepth=6),
    }


#: Models whose rows are stored, not persisted, while they are fitted: what these find
#: does not depend on the partitions of their rows, as Spark's forests do.
STORED = {"k_nearest_neighbours"}

RUN = {"late": predict_late, "fraud": detect_fraud}


def task_predictions(spark, sf_dir, task: str, model: str):
    """Held-out predictions of one model on all order-time features."""
    return RUN[task](order_lines(spark, sf_dir), classifier_zoo()[model]())


def _classifier_query(task: str, model: str):
    def q(spark, sf_dir):
        lines = order_lines(spark, sf_dir)
        if model in STORED:
            lines, drop = stored(chosen_lines(lines, task), "lines")
        else:
            lines = held_lines(lines, task)
            drop = lines.unpersist
        pred = RUN[task](lines, classifier_zoo()[model]())
        out = checkpoint(confusion(pred).select(F.lit(task).alias("task"),
                                                F.lit(model).alias("model"), "*"))
        drop()
        return out
    q.__doc__ = f"{model} on the {task} label: held-out accuracy, recall and F1."
    return q


for _m in classifier_zoo():
    register(f"late_{_m}")(_classifier_query("late", _m))


@register("late_compare")
def q_late_compare(spark, sf_dir):
    """E1 on late delivery: all nine classifiers, one metrics row each."""
    return compare_classifiers(order_lines(spark, sf_dir), classifier_zoo(), "late")


@register("fraud_compare")
def q_fraud_compare(spark, sf_dir):
    """E1 on the fraud proxy, classes weighted: all nine classifiers, one
    metrics row each."""
    return compare_classifiers(order_lines(spark, sf_dir), classifier_zoo(), "fraud",
                               balance=True)


def _regression_query(task: str, estimator):
    def q(spark, sf_dir):
        run = {"revenue": predict_revenue, "quantity": predict_quantity}[task]
        pred = run(order_lines(spark, sf_dir), estimator())
        return regression_metrics(pred).select(F.lit(task).alias("task"), "*")
    return q


register("revenue_regression")(_regression_query("revenue", linear_regression))
register("quantity_regression")(_regression_query("quantity", poisson_regression))
