"""``compare_classifiers`` fits several models at a time."""

import threading

from pyspark.ml import Estimator, Model
from pyspark.sql import functions as F

from quayside.operators.tasks import compare_classifiers

FEATS = ["x1", "x2", "x3", "x4"]


class _Waiting(Estimator):
    """Fits only while another one fits."""

    def __init__(self, barrier, value):
        super().__init__()
        self.barrier, self.value = barrier, value

    def _fit(self, dataset):
        self.barrier.wait(timeout=30)
        return _Constant(self.value)


class _Constant(Model):
    def __init__(self, value):
        super().__init__()
        self.value = value

    def _transform(self, dataset):
        return dataset.withColumn("prediction", F.lit(self.value))


def test_classifiers_are_fitted_side_by_side(spark, planted):
    barrier = threading.Barrier(2)
    zoo = {n: lambda v=v: _Waiting(barrier, v) for n, v in (("none", 0.0), ("all", 1.0))}
    out = compare_classifiers(planted.withColumn("late", F.col("label")), zoo, "late",
                              numeric=FEATS, categorical=[]).collect()
    got = {r["model"]: r for r in out}
    assert got["none"]["tp"] == 0 and got["all"]["fn"] == 0 and got["all"]["tp"] > 0
    assert got["none"]["n"] == got["all"]["n"]
