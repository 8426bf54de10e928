"""Clustering by Lloyd's rounds with ns-bounds (norm of the sum of drifts).

A row keeps, for every centroid, its distance to that centroid as it was when
it was last evaluated, and the round of that evaluation.  The history of all
centroids is kept too, so a stored distance is loosened by the norm of the
centroid's total displacement since that round, which is never more than the
sum of its drifts round by round.  A centroid whose loosened distance stays
above the row's own (loosened) distance cannot be nearer.  Where that fails,
the own distance is evaluated first, and what still fails is evaluated
exactly, in integers.

Vectors are rounded to integers, floor(scale * x), and never move: they are
written once, bucketed by row, and each round joins them with the rows' bounds
(also bucketed by row) without a shuffle.  A round writes the new bounds and
what its rows add to and take from the clusters' sums; only these sums and
the centroids reach the driver.  The table of a round is dropped when the next
one is written.

Defined cases: vectors that are null, of another length than ``size``, or
hold null or non-finite components take no part; a null id takes part and is
chosen as a starting centroid last; repeated rows take part each by itself
(rows repeated in id are ordered by vector where starting centroids are
chosen); equal distances go to the smaller centroid; an empty cluster keeps
its centroid; fewer than ``k`` vectors are as many centroids; an empty table
gives no rows; a distance or total that does not fit a long is an error.  Only
the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, removed, scratch, written

LONG = (1 << 63) - 1
LIMB = 10 ** 18
STATE = "row long, own int, seen binary, epoch binary, delta string"


class Bucketed:
    """A scratch table bucketed by ``row``; joins of two need no shuffle."""

    def __init__(self, df: DataFrame, label: str, buckets: int):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, label)
        self.name = f"{label}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, "row").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        removed(self.spark, self.path)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as exact integers: of 64 bits where squared distances
    of such numbers fit them, else Python's own."""
    q = np.floor(scale * x.astype(np.float64))
    largest = float(np.abs(q).max()) if q.size else 0.0
    if not math.isfinite(largest):
        raise ValueError("a component is too large to be scaled")
    if q.shape[-1] * (2 * largest + 1) ** 2 < 2 ** 62:
        return q.astype(np.int64)
    return np.array([int(v) for v in q.ravel().tolist()], dtype=object).reshape(q.shape)


def comparable(rows: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """The rows, as Python's integers if a centroid is too far for others."""
    far = max(abs(v) for c in centroids for v in c)
    return rows.astype(object) if rows.shape[-1] * (2 * far + 1) ** 2 >= 2 ** 62 else rows


def squared(rows: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of (comparable) rows to one centroid."""
    gap = rows - np.array(centroid, dtype=rows.dtype)
    return (gap * gap).sum(axis=1)


def _root(values) -> np.ndarray:
    return np.sqrt(np.asarray(values, dtype=np.float64))


class Bounds:
    """The state of some rows: ``seen[i, k]``, the distance of row i to
    centroid k as of round ``epoch[i, k]``, and the row's cluster ``own``."""

    def __init__(self, seen: np.ndarray, epoch: np.ndarray, own: np.ndarray):
        self.seen, self.epoch, self.own = seen, epoch, own
        self.evaluated = 0

    @classmethod
    def first(cls, rows: np.ndarray, centroids: list[list[int]]) -> "Bounds":
        rows = comparable(rows, centroids)
        exact = np.column_stack([squared(rows, c) for c in centroids])
        got = cls(_root(exact), np.zeros(exact.shape, np.uint8), exact.argmin(axis=1))
        got.evaluated = exact.size
        return got

    def update(self, rows: np.ndarray, history: list[list[list[int]]]) -> None:
        """Move to the newest centroids of ``history``."""
        now, k = len(history) - 1, self.seen.shape[1]
        rows = comparable(rows, history[now])
        # norm of the total displacement since each round, by centroid
        moved = np.array([[math.sqrt(sum((a - b) ** 2 for a, b in zip(c, was)))
                           for c, was in zip(history[now], past)] for past in history])
        columns = np.arange(k)

        def failing(at: np.ndarray) -> np.ndarray:
            seen, drift = self.seen[at], moved[self.epoch[at], columns]
            mine = (np.arange(len(at)), self.own[at])
            upper = (seen[mine] + drift[mine])[:, None]
            # room for the rounding of roots and sums
            out = ~(seen - drift > upper + 1e-9 * (seen + drift + upper))
            out[mine] = False
            return out

        def evaluate(at: np.ndarray, c: int) -> np.ndarray:
            exact = squared(rows[at], history[now][c])
            self.seen[at, c], self.epoch[at, c] = _root(exact), now
            self.evaluated += len(at)
            return exact

        at = np.flatnonzero(failing(np.arange(len(rows))).any(axis=1))
        own, best = self.own.copy(), np.zeros(len(rows), dtype=rows.dtype)
        for c in range(k):
            mine = at[own[at] == c]
            if len(mine):
                best[mine] = evaluate(mine, c)
        fails = failing(at)
        for c in range(k):
            other = at[fails[:, c]]
            if len(other):
                exact = evaluate(other, c)
                # ties go to the smaller centroid; centroids come in order
                nearer = (exact < best[other]) | ((exact == best[other]) & (c < own[other]))
                best[other[nearer]], own[other[nearer]] = exact[nearer], c
        self.own = own


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _stored(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def _binary(values: np.ndarray) -> pa.Array:
    size = values.dtype.itemsize * values.shape[1]
    raw = values.tobytes()
    return pa.array([raw[i:i + size] for i in range(0, len(raw), size)], pa.binary())


def _delta(rows: np.ndarray, was: np.ndarray | None, own: np.ndarray, k: int) -> str:
    """Count and sum by cluster of what came, less what went."""
    out = np.zeros((k, rows.shape[1] + 1), dtype=object)
    for c in range(k):
        came = own == c if was is None else (own == c) & (was != c)
        for sign, at in ((1, came), *(((-1, (was == c) & (own != c)),) if was is not None else ())):
            if at.any():
                out[c, 0] += sign * int(at.sum())
                out[c, 1:] += sign * rows[at].sum(axis=0).astype(object)
    return " ".join(str(v) for v in out.ravel())


def _round(history: list, scale: int, size: int) -> Callable:
    """One round over rows joined with their state (none in round 0)."""
    k = len(history[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = whole_numbers(_matrix(batch.column(1), size), scale)
            if len(history) == 1:
                state, was = Bounds.first(rows, history[0]), None
            else:
                was = batch.column(2).to_numpy().astype(np.int64)
                state = Bounds(_stored(batch.column(3), "<f8", k),
                               _stored(batch.column(4), "u1", k), was)
                state.update(rows, history)
            delta = [None] * batch.num_rows
            delta[0] = _delta(rows, was, state.own, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(state.own, pa.int32()), _binary(state.seen),
                 _binary(state.epoch), pa.array(delta, pa.string())],
                names=["row", "own", "seen", "epoch", "delta"])
    return run


def _final(history: list, scale: int, size: int) -> Callable:
    """The last assignment, with exact distances."""
    k = len(history[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = whole_numbers(_matrix(batch.column(1), size), scale)
            state = Bounds(_stored(batch.column(3), "<f8", k), _stored(batch.column(4), "u1", k),
                           batch.column(2).to_numpy().astype(np.int64))
            state.update(rows, history)
            exact = np.zeros(len(rows), dtype=object)
            rows = comparable(rows, history[-1])
            for c in range(k):
                mine = np.flatnonzero(state.own == c)
                if len(mine):
                    exact[mine] = squared(rows[mine], history[-1][c])
            if max(exact) > LONG:
                raise ValueError("a squared distance does not fit a long")
            yield pa.RecordBatch.from_arrays(
                [batch.column(5), pa.array(state.own, pa.int32()),
                 pa.array(exact.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])
    return run


def _sums(state: DataFrame) -> list[int]:
    """The deltas of all rows, added up."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total = total + np.array([int(v) for v in text.split()], dtype=object)
        out: list = []
        for place, v in enumerate([] if isinstance(total, int) else total.tolist()):
            rest, limb = abs(v), 0
            while rest or not limb:    # numbers of any length, by limbs
                rest, low = divmod(rest, LIMB)
                out.append((place, limb, low if v >= 0 else -low))
                limb += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], t) for i, t in enumerate(
                (pa.int32(), pa.int32(), pa.int64()))], names=["place", "limb", "part"])

    rows = (state.where("delta IS NOT NULL").select("delta")
            .mapInArrow(add, "place int, limb int, part long").groupBy("place", "limb")
            .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect())
    out: dict[int, int] = {}
    for r in rows:    # (size + 1) * k numbers
        out[r["place"]] = out.get(r["place"], 0) + int(r["total"]) * LIMB ** r["limb"]
    return [out[i] for i in range(len(out))]


def starting(kept: DataFrame, k: int, salt: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``salt:id``."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k)
    return [[int(v) for v in whole_numbers(np.array([r["x"]], dtype=np.float64), scale)[0]]
            for r in rows.collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", size: int = 64, scale: int = 1024,
            salt: int = 3) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256 (of the cluster's final centroid)."""
    if rounds > 255:
        raise ValueError("rounds are numbered in a byte")
    spark: SparkSession = vectors.sparkSession
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                      & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    kept = written(vectors.where(x.isNotNull() & (F.size(x) == size)
                                 & F.coalesce(finite, F.lit(False)))
                   .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")), "vectors")
    count = kept.count()
    schema = "vec_id long, cluster int, distance long"
    centroids = starting(kept, k, salt, scale)
    if not centroids:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, "
                                                  "centroid_sha256 string")
    # a bucket's bounds are the hash side of its join: about 25 MB
    buckets = max(parts_for(count, 250_000),
                  min(parts_for(count, 4096), spark.sparkContext.defaultParallelism))
    base = Bucketed(kept.withColumn("row", F.monotonically_increasing_id())
                    .repartition(buckets, "row"), "rows", buckets)
    history, sums, state = [centroids], None, None
    for _ in range(rounds):
        rows = base.read()
        if state is None:
            joined = rows.select("row", "x")
        else:
            joined = rows.join(state.read().hint("shuffle_hash"), "row").select(
                "row", "x", "own", "seen", "epoch")
        after = Bucketed(joined.mapInArrow(_round(history, scale, size), STATE), "bounds", buckets)
        if state is not None:
            state.drop()
        state = after
        change = _sums(state.read())
        sums = change if sums is None else [a + b for a, b in zip(sums, change)]
        width = size + 1
        parts = [sums[c * width:(c + 1) * width] for c in range(len(centroids))]
        # // rounds down, also below zero
        history.append([[v // p[0] for v in p[1:]] if p[0] else old
                        for p, old in zip(parts, history[-1])])
    if state is None:   # no rounds: one assignment to the starting centroids
        state = Bucketed(base.read().select("row", "x").mapInArrow(
            _round(history, scale, size), STATE), "bounds", buckets)
    joined = base.read().join(state.read().hint("shuffle_hash"), "row").select(
        "row", "x", "own", "seen", "epoch", "vec_id")
    out = written(joined.mapInArrow(_final(history, scale, size), schema), "assigned")
    state.drop()
    base.drop()
    per = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = sum(per.values())
    if total > LONG:
        raise ValueError("the inertia does not fit a long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1]]
    place = F.col("cluster") + 1
    return out.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[F.lit(per.get(c, 0)).cast("long") for c in range(len(names))]),
                     place).alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.lit(n) for n in names]), place).alias("centroid_sha256"))
