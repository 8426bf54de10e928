"""Gaussian naive Bayes.

Two forms.  ``gaussian_nb`` fits from one ``groupBy(label)`` of counts,
means and population variances (each task sends K x d partial moments), and
scores with plain column expressions, so prediction is a narrow, codegen'd
projection with no join; ``SqlNaiveBayes`` wraps it as a Pipeline stage.
``classifiers.gaussian_nb`` is Spark ML's ``NaiveBayes(modelType='gaussian')``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax_label
from .base import ColumnEstimator, class_weights
from .saved import core


@core("gaussian_nb")
@dataclass
class GaussianNBModel:
    features: list[str]
    labels: list[float]
    log_prior: dict
    means: dict
    variances: dict

    def log_likelihoods(self) -> dict:
        """Joint log density per class, as Columns."""
        out = {}
        for k in self.labels:
            s = F.lit(self.log_prior[k])
            for j, c in enumerate(self.features):
                mu, var = self.means[k][j], self.variances[k][j]
                s = s + F.lit(-0.5 * math.log(2 * math.pi * var)) \
                    - (F.col(c) - F.lit(mu)) * (F.col(c) - F.lit(mu)) / F.lit(2 * var)
            out[k] = s
        return out

    def predict_column(self) -> Column:
        return argmax_label(self.log_likelihoods()).cast("double")

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predict_column())

    def transform_columns(self, df, cols, prediction):
        return replace(self, features=list(cols)).transform(df, prediction)

    def state(self, spark):
        return {"features": self.features, "labels": self.labels,
                **{n: [getattr(self, n)[k] for k in self.labels]
                   for n in ("log_prior", "means", "variances")}}, {}

    @classmethod
    def restored(cls, header, tables):
        labels = header["labels"]
        return cls(header["features"], labels, *[dict(zip(labels, header[n]))
                                                 for n in ("log_prior", "means", "variances")])


def gaussian_nb(train: DataFrame, features: list[str], label: str = "label",
                var_smoothing: float = 1e-9, weight: str | None = None) -> GaussianNBModel:
    """Fit class priors, means and variances with one aggregate.  ``weight``
    must be constant within a class: it then changes the priors, and the
    overall variance, only.

    ``var_smoothing`` adds that fraction of the largest overall feature
    variance to every variance (guards against a zero variance).
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in features:
        aggs += [F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")]
    rows = train.groupBy(F.col(label).cast("double").alias("y")).agg(*aggs).collect()
    rows = [r.asDict() for r in sorted(rows, key=lambda r: r["y"])]
    if weight is not None:
        by = class_weights(train, label, weight)
        for r in rows:
            r["n"] *= by[r["y"]]
    n = sum(r["n"] for r in rows)
    # overall variance of each feature from the class moments
    overall = []
    for c in features:
        m = sum(r["n"] * r[f"m_{c}"] for r in rows) / n
        overall.append(sum(r["n"] * (r[f"v_{c}"] + (r[f"m_{c}"] - m) ** 2)
                           for r in rows) / n)
    eps = var_smoothing * max(overall)
    labels = [r["y"] for r in rows]
    return GaussianNBModel(
        features=list(features), labels=labels,
        log_prior={r["y"]: math.log(r["n"] / n) for r in rows},
        means={r["y"]: [r[f"m_{c}"] for c in features] for r in rows},
        variances={r["y"]: [r[f"v_{c}"] + eps for c in features] for r in rows})


class SqlNaiveBayes(ColumnEstimator):
    """The SQL form as a Pipeline stage."""

    def fit_columns(self, df, cols, label):
        return gaussian_nb(df, cols, label, weight=self.weight)
