"""T3/T4 regressors: ordinary least squares and a Poisson GLM.

``ols_fit`` is a tall-skinny QR: every task keeps the triangular factor of its
rows, factors are stacked and factored again in groups of 64, and the driver
solves the last one.  It never forms cross-products, which square the
condition number.  ``linear_regression`` is Spark
ML's ``LinearRegression(solver='normal')`` for Pipelines;
``poisson_regression`` suits counts such as ordered quantity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_array

FAN_IN = 64


@dataclass
class OLSModel:
    features: list[str]
    coef: np.ndarray
    intercept: float

    def predict_column(self, cols=None):
        cols = cols or self.features
        s = F.lit(float(self.intercept))
        for c, w in zip(cols, self.coef):
            s = s + F.col(c) * F.lit(float(w))
        return s

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predict_column())


def ols_fit(df: DataFrame, cols: list[str], target: str, ridge: float = 0.0) -> OLSModel:
    """Least squares with intercept: one pass for the means, which centre the
    rows, and one for the factor.  Of the solutions of a singular design, the
    one with the least weights (of columns scaled alike) is taken.  Rows with a
    null or NaN fail."""
    d = len(cols)
    first = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*cols, target])]).first()
    if any(m is None for m in first):
        raise ValueError("no rows to fit")
    mean = np.array(first, dtype=float)
    r = triangle(df, [*cols, target], mean)
    if not np.isfinite(r).all():
        raise ValueError("rows with nulls, NaN or infinite values")
    a, b = r[:, :d + 1], r[:, d + 1]        # the last column of a is the intercept's
    if ridge:
        a = np.vstack([a, math.sqrt(ridge) * np.eye(d, d + 1)])
        b = np.concatenate([b, np.zeros(d)])
    size = np.sqrt((a * a).sum(axis=0))
    size[size == 0] = 1.0
    w = np.linalg.lstsq(a / size, b, rcond=np.finfo(float).eps * (d + 2))[0] / size
    return OLSModel(list(cols), w[:d], float(mean[d] - mean[:d] @ w[:d] + w[d]))


def triangle(df: DataFrame, cols: list[str], mean: np.ndarray) -> np.ndarray:
    """R of the QR factors of the rows (``cols`` less ``mean``, and a column of
    ones before the last): tasks' factors are combined in a tree of fan-in 64."""
    d = len(cols)

    def factor(x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(x, mode="r") if np.isfinite(x).all() else np.full((1, d + 1), np.nan)

    def rows_of(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(r), pa.int64()), pa.array(r.tolist(), pa.list_(pa.float64()))],
            names=["part", "row"])

    def first(batches):
        r, part = np.zeros((0, d + 1)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1)[0].as_py()
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            x = x.reshape(-1, d) - mean
            x = np.hstack([x[:, :-1], np.ones((len(x), 1)), x[:, -1:]])
            r = factor(np.vstack([r, x]))
        if part is not None:
            yield rows_of(part, r)

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")       # factors in one order, whatever came first
        r = np.array(table.column("row").combine_chunks().flatten().to_numpy()).reshape(-1, d + 1)
        return pa.Table.from_batches([rows_of(table.column("part")[0].as_py() // FAN_IN, factor(r))])

    schema = "part long, row array<double>"
    rows = df.select(as_array(cols).alias("x"), F.spark_partition_id().cast("long").alias("part"))
    out, left = rows.mapInArrow(first, schema), rows.rdd.getNumPartitions()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        out = out.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(
            combine, schema)
    out = out.groupBy(F.lit(0).alias("group")).applyInArrow(combine, schema)
    return np.array([r["row"] for r in out.collect()], dtype=float).reshape(-1, d + 1)


def linear_regression(features="features", label="label", regParam=0.0):
    return LinearRegression(solver="normal", regParam=regParam,
                            featuresCol=features, labelCol=label)


def poisson_regression(features="features", label="label", regParam=0.0):
    return GeneralizedLinearRegression(family="poisson", link="log", regParam=regParam,
                                       featuresCol=features, labelCol=label)


def regression_metrics(pred: DataFrame, label: str = "label",
                       prediction: str = "prediction", by=(), digits: int | None = 6):
    """n, rmse, mae and r2 from one aggregate (R² = 1 - SSE/SST)."""
    e = F.col(label) - F.col(prediction)
    g = pred.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"),
        (F.var_pop(label) * F.count(F.lit(1))).alias("sst"))
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return g.select(*by, "n",
                    rnd(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"),
                    rnd(F.col("sae") / F.col("n")).alias("mae"),
                    rnd(F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
                        .otherwise(F.lit(0.0))).alias("r2"))
