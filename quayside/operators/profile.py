"""Per-class profile of a labelled table (class balance and moments)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, label: str, cols: list[str],
            covariances: bool = True) -> DataFrame:
    """One row per class: n, share of rows, and per-column mean, population
    variance, min and max, plus pairwise population covariances.

    A single ``groupBy`` with partial aggregation: each task ships a few
    numbers per class to the shuffle, whatever the table size.  The class
    share needs the total, taken by a window over the (tiny) result.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.var_pop(c).alias(f"var_{c}"),
                 F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    if covariances:
        aggs += [F.covar_pop(a, b).alias(f"cov_{a}_{b}")
                 for a, b in combinations(cols, 2)]
    out = df.groupBy(F.col(label).alias("label")).agg(*aggs)
    from pyspark.sql import Window
    return out.withColumn(
        "share", F.col("n") / F.sum("n").over(Window.partitionBy()))
