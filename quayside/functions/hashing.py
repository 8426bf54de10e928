"""Deterministic pseudo-random numbers from md5.

These replace ``rand``/``randomSplit``: the value depends only on the key,
never on partitioning or task retries, so a recomputed partition after an
executor loss draws the same numbers, and DuckDB can reproduce them with
``('0x' || substr(md5(s), 1, 8))::ubigint``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def md5_u32(*parts) -> Column:
    """First 32 bits of md5 of the parts joined by '|', as a bigint."""
    s = (_col(parts[0]).cast("string") if len(parts) == 1 else
         F.concat_ws("|", *[_col(p).cast("string") for p in parts]))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def md5_uniform(*parts) -> Column:
    """A uniform double in [0, 1) from md5 of the parts."""
    return md5_u32(*parts) / F.lit(4294967296.0)


def md5_bucket(key, buckets: int = 10) -> Column:
    """Bucket 0..buckets-1 of a key (used by the train/test split)."""
    return F.pmod(md5_u32(key), F.lit(buckets))
