"""Exact quantiles per class by distributed selection.

No row is sorted or shuffled.  A double's bits, read as an ordered whole
number, are taken ``DIGIT`` at a time from the top.  Each pass counts, in every
task and with numpy, the rows of each wanted prefix by their next digit, and one
``groupBy`` adds the tasks' counts; running sums then say in which digit each
wanted rank lies.  A cell also carries its least and greatest value, and a rank
is settled when its cell holds one value only.  There are at most 64 / ``DIGIT``
passes (two or three on whole numbers), whatever the distribution, and a task
sends at most 2^``DIGIT`` counts for each prefix: model-sized, as the ranks are.

Defined cases: null values are not counted; NaN is above all numbers; -0.0 is
0.0; a class or column without values has no rows in the result; rows with a
null label form a class of their own, as in ``profile``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_array
from .moments import MAX_CLASSES

DIGIT = 11
BLOCK = 65_536
_CELL = "g long, prefix long, digit long, n long, lo long, hi long"


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order (NaN last)."""
    v = np.where(np.isnan(values), np.nan, values + 0.0)      # one NaN, one zero
    bits = v.view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def value_of(key: int) -> float:
    """The double of an ordered number."""
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], dtype=np.uint64).view(float)[0])


def _signed(keys: np.ndarray) -> np.ndarray:
    """Ordered numbers as longs in the same order, for Spark."""
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def _cells(rows: DataFrame, classes: int, wanted: dict[int, list[int]], bits: int) -> DataFrame:
    """Counts by (group, prefix, next digit) of the wanted prefixes of ``bits``
    bits; a group is column * classes + class."""
    take = min(DIGIT, 64 - bits)
    shipped = rows.sparkSession.sparkContext.broadcast(
        {g: np.array(sorted(p), dtype=np.uint64) for g, p in wanted.items()})

    def run(batches):
        found: dict[int, tuple] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                cls = part.column(1).to_numpy()
                x = part.column(0).flatten()
                there = x.is_valid().to_numpy(zero_copy_only=False).reshape(len(cls), -1)
                x = x.to_numpy(zero_copy_only=False).astype(float).reshape(len(cls), -1)
                for g, prefixes in shipped.value.items():
                    col, c = divmod(g, classes)
                    keys = ordered(x[(cls == c) & there[:, col], col])
                    if bits:
                        head = keys >> np.uint64(64 - bits)
                        at = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                        here = prefixes[at] == head
                        keys, at = keys[here], at[here]
                    else:
                        at = np.zeros(len(keys), dtype=np.int64)
                    if not len(keys):
                        continue
                    digit = (keys >> np.uint64(64 - bits - take)) & np.uint64((1 << take) - 1)
                    cell = (at << take) + digit.astype(np.int64)
                    order = np.argsort(cell, kind="stable")
                    cell, keys = cell[order], keys[order]
                    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    if g not in found:
                        size = len(prefixes) << take
                        found[g] = (np.zeros(size, np.int64), np.full(size, ~np.uint64(0)),
                                    np.zeros(size, np.uint64))
                    n, lo, hi = found[g]
                    cell = cell[begin]
                    n[cell] += np.diff(np.r_[begin, len(keys)])
                    lo[cell] = np.minimum(lo[cell], np.minimum.reduceat(keys, begin))
                    hi[cell] = np.maximum(hi[cell], np.maximum.reduceat(keys, begin))
        for g, (n, lo, hi) in found.items():
            cell = np.flatnonzero(n)
            prefix = shipped.value[g][cell >> take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.astype(np.int64)) for v in (
                    np.full(len(cell), g), prefix, cell & ((1 << take) - 1), n[cell],
                    _signed(lo[cell]), _signed(hi[cell]))],
                names=["g", "prefix", "digit", "n", "lo", "hi"])

    return (rows.mapInArrow(run, _CELL).groupBy("g", "prefix", "digit")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def class_quantiles(df: DataFrame, label: str, cols: list[str],
                    shares: list[float]) -> DataFrame:
    """One row per class, column and share: label, column, share, n (values that
    are not null), value.  Between two ranks the value is interpolated."""
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    found = df.select(label).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    labels = sorted((r[0] for r in found), key=lambda v: (v is None, v))
    number = F.lit(None).cast("int")
    for i, y in enumerate(labels):
        number = F.when(F.col(label).eqNullSafe(F.lit(y)), i).otherwise(number)
    rows = df.select(as_array(cols).alias("x"), number.alias("c")).persist()

    classes = len(labels)
    sizes: dict[int, int] = {}
    settled: dict[tuple[int, int], float] = {}       # (group, rank) -> value
    # (group, prefix) -> [(rank in the group, rank among the prefix's rows)]
    open_ranks = {(col * classes + c, 0): [] for col in range(len(cols)) for c in range(classes)}
    bits = 0
    while open_ranks:
        wanted: dict[int, list[int]] = {}
        for g, prefix in open_ranks:
            wanted.setdefault(g, []).append(prefix)
        cells: dict[tuple, list] = {}
        for r in _cells(rows, classes, wanted, bits).collect():     # ranks x 2^DIGIT at most
            cells.setdefault((r["g"], r["prefix"]), []).append((r["digit"], r["n"], r["lo"], r["hi"]))
        take, after = min(DIGIT, 64 - bits), {}
        for (g, prefix), mine in cells.items():
            if not bits:
                sizes[g] = sum(n for _, n, *_ in mine)
                exact = {int(f((sizes[g] - 1) * s)) for s in shares for f in (np.floor, np.ceil)}
                open_ranks[g, prefix] = [(r, r) for r in exact]
            before = 0
            ranks = sorted(open_ranks[g, prefix], key=lambda r: r[1])
            for digit, n, lo, hi in sorted(mine):
                while ranks and ranks[0][1] < before + n:
                    whole, inner = ranks.pop(0)
                    if lo == hi:
                        settled[g, whole] = value_of(lo + (1 << 63))
                    else:
                        after.setdefault((g, prefix << take | digit), []).append((whole, inner - before))
                before += n
        open_ranks, bits = after, bits + take
    rows.unpersist()

    out = []
    for g, n in sorted(sizes.items()):
        col, c = divmod(g, classes)
        for s in shares:
            at = (n - 1) * s
            low, high = settled[g, int(np.floor(at))], settled[g, int(np.ceil(at))]
            value = low if low == high else low + (high - low) * (at - np.floor(at))
            out.append((labels[c], cols[col], float(s), n, float(value)))
    kind = dict(df.dtypes)[label]
    return df.sparkSession.createDataFrame(
        out, f"label {kind}, column string, share double, n long, value double")
