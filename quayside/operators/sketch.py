"""Weighted quantile summaries that merge and prune (Chen & Guestrin, 2016).

A summary of weighted values is a list of entries (value, rmin, rmax, w): the
least and the largest rank (weight of all smaller values, and with the value's
own weight) that the value can have, and the weight known to sit on it.

* A task's first summary is exact: equal values are added up.
* Summaries **merge** by adding, for each value, the other's rank bounds there.
* A summary is **pruned** to ``size`` entries by querying ``size`` evenly spaced
  ranks, which widens its rank bounds by at most 1 / size of its weight.

A task summarises a buffer at a time and merges two summaries of equal level
into one of the next (four times as large as what it sends); then 64 tasks'
summaries are merged and pruned in one group, 64 of those in the next, and so
on.  With b buffers a task and p tasks, a value's rank is known within
(log2(b) / 4 + 1 + log64(p)) / size, rounded up, of the weight, for any
partitioning; nothing is lost where a column has at most ``size`` distinct values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_array

SUMMARY = "feature int, part long, v double, lo double, hi double, w double"
FAN_IN = 64


def exact_summary(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Entries (value, rmin, rmax, w) of raw values, as columns of one array."""
    values, at = np.unique(v, return_inverse=True)
    own = np.bincount(at, w, len(values))
    upto = np.cumsum(own)
    return np.stack([values, upto - own, upto, own])


def _bounds(s: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What summary ``s`` says of ``values``: (rmin, rmax, w) of each."""
    v, lo, hi, w = s
    if not len(v):
        return np.zeros((3, len(values)))
    at = np.searchsorted(v, values)
    same = (at < len(v)) & (v[np.minimum(at, len(v) - 1)] == values)
    # a value between two entries has more before it than the entry below with
    # its weight, and no more than the entry above without its own
    below = np.where(at > 0, lo[at - 1] + w[at - 1], 0.0)
    next_ = np.minimum(at, len(v) - 1)
    above = np.where(at < len(v), hi[next_] - w[next_], hi[-1])
    return np.stack([np.where(same, lo[next_], below), np.where(same, hi[next_], above),
                     np.where(same, w[next_], 0.0)])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    values = np.union1d(a[0], b[0])
    return np.vstack([values, _bounds(a, values) + _bounds(b, values)])


def prune(s: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` + 1 entries: those nearest to evenly spaced ranks, and
    the least and the largest value."""
    if s.shape[1] <= size + 1:
        return s
    total = s[2, -1]
    ranks = np.arange(1, size) * (total / size)
    return s[:, np.unique(np.concatenate([[0], query(s, ranks), [s.shape[1] - 1]]))]


def query(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The entry at each rank: the smallest value that has this weight at or
    below it, where a rank between two entries' bounds goes to the nearer."""
    cuts = (s[1, :-1] + s[3, :-1] + s[2, 1:] - s[3, 1:]) / 2
    return np.searchsorted(np.maximum.accumulate(cuts), ranks)


def _batch(feature: int, part: int, s: np.ndarray) -> pa.RecordBatch:
    n = s.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, feature, np.int32)), pa.array(np.full(n, part, np.int64)),
         *(pa.array(c) for c in s)], names=["feature", "part", "v", "lo", "hi", "w"])


def summaries(df: DataFrame, cols: list[str], weight: str | None = None,
              size: int = 2048) -> DataFrame:
    """One summary a feature (rows of SUMMARY), over all rows of ``df``.  Nulls
    and NaN are left out, and so are rows of weight zero."""
    d, buffer = len(cols), 1 << 18
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(as_array(cols).alias("x"), w.alias("w"), F.spark_partition_id().alias("part"))

    def first(batches):
        stack: list = []        # (level, a summary per feature), levels falling
        held: list = [[], []]
        part, many = None, 0

        def flush():
            x, ws = np.concatenate(held[0]), np.concatenate(held[1])
            new = []
            for f in range(d):
                known = ~np.isnan(x[:, f]) & (ws > 0)
                new.append(prune(exact_summary(x[known, f], ws[known]), 4 * size))
            level = 0
            while stack and stack[-1][0] == level:
                new = [prune(merge(a, b), 4 * size) for a, b in zip(stack.pop()[1], new)]
                level += 1
            stack.append((level, new))
            held[0].clear()
            held[1].clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            held[0].append(values.reshape(-1, d))
            held[1].append(batch.column(1).to_numpy())
            many += batch.num_rows
            if many * d >= buffer:
                flush()
                many = 0
        if held[0]:
            flush()
        if part is not None:
            for f in range(d):
                out = np.zeros((4, 0))
                for _, one in stack:
                    out = merge(out, one[f])
                yield _batch(f, part, prune(out, size))

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("v", "ascending")])
        parts = table.column("part").to_numpy()
        s = np.stack([table.column(c).to_numpy() for c in ("v", "lo", "hi", "w")])
        out = np.zeros((4, 0))
        for one in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
            out = merge(out, s[:, one])
        return pa.Table.from_batches([_batch(table.column("feature")[0].as_py(),
                                             int(parts[0]) // FAN_IN, prune(out, size))])

    out = rows.mapInArrow(first, SUMMARY)
    left = rows.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN_IN)
        group = F.floor(F.col("part") / FAN_IN) if left > 1 else F.lit(0).cast("long")
        out = out.groupBy("feature", group.alias("group")).applyInArrow(combine, SUMMARY)
        if left <= 1:
            return out


def _collected(df, cols, weight, size) -> list[np.ndarray]:
    """The summaries (size + 1 entries a column); empty without known values."""
    found: list[list] = [[] for _ in cols]
    for r in summaries(df, cols, weight, size).collect():
        found[r["feature"]].append((r["v"], r["lo"], r["hi"], r["w"]))
    return [np.array(sorted(s)).reshape(-1, 4).T for s in found]


def weighted_quantiles(df: DataFrame, cols: list[str], weight: str | None, shares: list[float],
                       size: int = 2048) -> dict[str, list[float]]:
    """Per column the values at these shares of the weight; only the summaries
    reach the driver.  A column without a known value has none."""
    return {c: s[0, query(s, np.asarray(shares) * s[2, -1])].tolist() if s.size else []
            for c, s in zip(cols, _collected(df, cols, weight, size))}


def weighted_edges(df: DataFrame, cols: list[str], weight: str | None, max_bins: int = 32,
                   size: int = 2048) -> list[list[float]]:
    """Interior bin edges at the weighted quantiles i / max_bins.  The least
    value is none: nothing lies below it."""
    shares = np.arange(1, max_bins) / max_bins
    return [sorted(set(s[0, query(s, shares * s[2, -1])].tolist()) - {s[0, 0]}) if s.size else []
            for s in _collected(df, cols, weight, size)]
