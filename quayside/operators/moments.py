"""Counts, sums and cross-products of numeric columns, by class.

Each partition forms its partial matrices with numpy and the partials are
summed per class and entry, so a task sends classes x d(d+1) numbers whatever
its rows, and d is not limited by the size of generated code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_array

#: Classes a label may have; their names and moments reach the driver.
MAX_CLASSES = 10_000


def class_labels(df: DataFrame, label: str) -> list[float]:
    """Distinct labels in order; too many (a continuous target) is an error."""
    rows = df.select(F.col(label).cast("double")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    if any(r[0] is None for r in rows):
        raise ValueError(f"{label} has nulls")
    return sorted(r[0] for r in rows)


def cross_moments(df: DataFrame, cols: list[str], label: str | None = None,
                  weight: str | None = None):
    """(means of ``cols``, {class: (n, sums, cross-products)}), both sums of
    columns centred by the overall means, which keeps their digits.  Without
    ``label`` all rows are class 0.  With ``weight``, n is the class's weight
    and each row counts in the sums by its weight (the means that centre are
    plain ones)."""
    d = len(cols)
    first = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if any(first[f"m{i}"] is None for i in range(d)):
        raise ValueError("no rows to take moments of")
    mean = np.array([first[f"m{i}"] for i in range(d)], dtype=float)
    y = F.lit(0.0) if label is None else F.col(label).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    data = df.select(y.alias("y"), as_array(cols).alias("x"), w.alias("w"))

    def partial(batches):
        total: dict[float, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, d) - mean
            ys, ws = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(ys).tolist():
                part, by = x[ys == k], ws[ys == k]
                at = total.setdefault(k, [0, np.zeros(d), np.zeros((d, d))])
                at[0] += by.sum()
                at[1] += by @ part
                at[2] += (part * by[:, None]).T @ part
        for k, (n, s, c) in total.items():
            v = np.concatenate([[n], s, c.ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(v), pa.float64()), pa.array(range(len(v)), pa.int64()),
                 pa.array(v)], names=["y", "i", "v"])

    rows = (data.mapInArrow(partial, "y double, i long, v double")
            .groupBy("y", "i").agg(F.sum("v").alias("v")).collect())
    out: dict[float, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["y"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return mean, {k: (float(v[0]), v[1:1 + d], v[1 + d:].reshape(d, d)) for k, v in out.items()}
