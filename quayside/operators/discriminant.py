"""Linear discriminant analysis (Fisher, pooled covariance).

Fit is two aggregates: the global mean of each feature, then per class the
count and the sums and cross-products of the *centred* features (centring
keeps the cross-products from losing digits).  Only K x d(d+1)/2 numbers
reach the driver, where the d x d pooled covariance is solved with numpy.
Scoring is one linear expression per class plus an arg-max: a narrow,
codegen'd projection.

Each partition forms its cross-product matrices with numpy and the partials
are summed per class, for any number of features.
(Spark's ``ml.clustering.LDA`` is a topic model, hence the name here.)
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax_label
from .base import ColumnEstimator
from .moments import cross_moments
from .saved import core


@core("discriminant")
@dataclass
class DiscriminantModel:
    features: list[str]
    labels: list[float]
    coef: np.ndarray        # K x d
    intercept: np.ndarray   # K

    def scores(self, cols=None) -> dict:
        cols = cols or self.features
        out = {}
        for k, lab in enumerate(self.labels):
            s = F.lit(float(self.intercept[k]))
            for j, c in enumerate(cols):
                s = s + F.col(c) * F.lit(float(self.coef[k, j]))
            out[lab] = s
        return out

    def predict_column(self, cols=None):
        return argmax_label(self.scores(cols)).cast("double")

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predict_column())

    def transform_columns(self, df, cols, prediction):
        return df.withColumn(prediction, self.predict_column(cols))

    def state(self, spark):
        return {"features": self.features, "labels": self.labels, "coef": self.coef.tolist(),
                "intercept": self.intercept.tolist()}, {}

    @classmethod
    def restored(cls, header, tables):
        return cls(header["features"], header["labels"], np.array(header["coef"]),
                   np.array(header["intercept"]))


def discriminant_fit(df: DataFrame, cols: list[str], label: str = "label",
                     ridge: float = 1e-9, weight: str | None = None) -> DiscriminantModel:
    """Means, pooled covariance and priors; by the rows' weights if there are any."""
    d = len(cols)
    mean, stats = cross_moments(df, cols, label, weight)
    labels = sorted(stats)
    n_total = sum(stats[k][0] for k in labels)
    K = len(labels)
    within = np.zeros((d, d))
    mus = {}
    for k in labels:
        n, s, cp = stats[k]
        mu = s / n
        mus[k] = mu
        within += cp - n * np.outer(mu, mu)
    S = within / max(n_total - K, 1)
    # a one-hot block or a constant column makes S singular: add a ridge
    S = S + np.eye(d) * ridge * max(np.trace(S) / d, 1e-12)
    coef = np.zeros((K, d))
    intercept = np.zeros(K)
    for i, k in enumerate(labels):
        a = np.linalg.solve(S, mus[k])
        coef[i] = a
        # score on raw x: (x - m).a - 0.5 mu.a + log prior
        intercept[i] = -mean @ a - 0.5 * mus[k] @ a + math.log(stats[k][0] / n_total)
    return DiscriminantModel(list(cols), labels, coef, intercept)


class Discriminant(ColumnEstimator):
    """C2 as a Pipeline stage (``discriminant().fit(X)``)."""

    def __init__(self, featuresCol="features", labelCol="label",
                 predictionCol="prediction", ridge: float = 1e-9):
        super().__init__(featuresCol, labelCol, predictionCol)
        self.ridge = ridge

    def fit_columns(self, df, cols, label):
        return discriminant_fit(df, cols, label, self.ridge, self.weight)


def discriminant(**kw) -> Discriminant:
    return Discriminant(**kw)
