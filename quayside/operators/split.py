"""train/test split keyed by a column (all lines of an order together)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket


def split(df: DataFrame, key: str = "order_key", test_buckets: int = 2,
          buckets: int = 10) -> tuple[DataFrame, DataFrame]:
    """Split by md5 bucket of ``key``: buckets >= buckets-test_buckets are test.

    Unlike ``randomSplit`` the side of a row depends on its key only, so it
    is stable under repartitioning and recomputation; the filter is a narrow
    operation (no shuffle) that Catalyst fuses into the scan stage.
    """
    b = md5_bucket(F.col(key), buckets)
    cut = buckets - test_buckets
    return df.where(b < cut), df.where(b >= cut)


def split_sides(df: DataFrame, key: str = "order_key", test_buckets: int = 2,
                buckets: int = 10) -> DataFrame:
    """Label each row with its side ('train' / 'test')."""
    b = md5_bucket(F.col(key), buckets)
    return df.withColumn(
        "side", F.when(b < buckets - test_buckets, "train").otherwise("test"))
