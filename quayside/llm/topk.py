"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are rounded to integers, floor(scale * x).  They are dealt into
blocks of about ``block_rows``; each block has its own index: for every
dimension the postings in order of value, cut into segments of equal
quantised impact (value // ``step``).  A negative query weight reads its
dimension from the other end.

Queries meet every block, some ``query_rows`` at a time.  For one query and
block, segments of all dimensions are processed by descending weighted impact
and add their postings' impacts to accumulators, a share of all postings at a
time.  A row's score is at most its accumulator plus, for each dimension it has
not been read in, the best impact left unread there.  The rows of the highest
bounds are scored exactly, and rows whose bound is below the k-th best score
known, of these or of the blocks a task met before, are proven not to be
members; reading stops when few enough others remain, or at the end, and those
are rescored exactly.

Where components are so large that sums could leave 64 bits, a query and block
are scored in Python's integers, row by row.

Defined cases: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part; a score among the best that does not
fit a long is an error; shorter vectors count as continued by zeros; an empty
vector scores 0; a query's own id is no candidate of it; repeated rows of
other ids are candidates each, repeated query rows are one query (rows of one
id with different vectors share its list); ties go to the smaller id; fewer
candidates than k are all returned; an empty table gives no rows.  Only the id and vector
columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, written

LONG = (1 << 63) - 1
SHARES = 16     # bounds are looked at when so many equal shares of the postings are read


def taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the vector x, of the rows that take part."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                     & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False))
                    ).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def whole_numbers(vectors, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of doubles as a matrix, shorter rows continued
    by zeros: of 64 bits if the numbers are small enough, else of Python's."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    q = np.floor(scale * out)
    if q.size == 0 or float(np.abs(q).max()) < 2 ** 52:
        return q.astype(np.int64)
    if not np.isfinite(q).all():
        raise ValueError("a component is too large to be scaled")
    return np.array([int(v) for v in q.ravel().tolist()], dtype=object).reshape(q.shape)


class BlockIndex:
    """Impact-ordered postings of one block of integer vectors: for every
    dimension the rows in order of value, and the values."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, step: int, order=None):
        self.ids, self.rows, self.step = ids, rows, step
        if rows.dtype == object:
            return
        if order is None:
            order = np.argsort(rows, axis=0, kind="stable").T.astype(
                np.uint16 if len(ids) <= 1 << 16 else np.int64)
        self.order = order
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        self.sides: dict[tuple, tuple] = {}
        self.read = self.postings = 0     # of all searches
        self.first = SHARES // 2          # share of the postings read before the first bound

    def _side(self, d: int, negative: bool) -> tuple:
        """Postings of a dimension by descending impact, their impacts and a
        zero after the last, and end and quantised impact of the segments."""
        got = self.sides.get((d, negative))
        if got is None:
            part = np.ascontiguousarray(self.order[d] if negative else self.order[d][::-1])
            impact = (self.high[d] - self.rows[part, d] if negative
                      else self.rows[part, d] - self.low[d])
            level = impact // self.step
            cuts = np.flatnonzero(np.diff(level)) + 1
            impact = np.append(impact, 0)
            impact = impact.astype(np.int32 if impact[0] < 1 << 31 else np.float64)
            got = self.sides[d, negative] = (part, impact, np.append(cuts, len(part)),
                                             level[np.append(0, cuts)])
        return got

    def search(self, query: np.ndarray, own: int, k: int,
               known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, without those of id ``own``, and
        maybe without those that score below ``known``."""
        width = self.rows.shape[1]
        weights = np.zeros(width, query.dtype)
        weights[:len(query[:width])] = query[:width]
        mine = self.ids == own
        far = float(max((abs(int(w)) for w in weights), default=0))
        if (self.rows.dtype == object or query.dtype == object or not width or 2 * width * far
                * float(max(np.abs(self.low).max(), np.abs(self.high).max())) >= 2 ** 62):
            rows = np.flatnonzero(~mine)
            score = (self.rows[rows].astype(object) * weights.astype(object)).sum(axis=1)
        else:
            rows = np.flatnonzero(self._possible(weights, mine, k, known))
            score = self.rows[rows] @ weights
        if width == 0:
            score = np.zeros(len(rows), np.int64)
        best = sorted(range(len(rows)), key=lambda i: (-score[i], self.ids[rows[i]]))[:k] \
            if score.dtype == object else np.lexsort((self.ids[rows], -score))[:k]
        score = score[best]
        if any(abs(int(v)) > LONG for v in score):
            raise ValueError("a score does not fit a long")
        return self.ids[rows][best], score.astype(np.int64)

    def _possible(self, weights: np.ndarray, mine: np.ndarray, k: int,
                  known: int | None) -> np.ndarray:
        """Mask of the rows not proven to be outside the k best or below ``known``."""
        n = len(mine)
        dims = np.flatnonzero(weights)
        possible = ~mine
        if not len(dims) or n - int(mine.sum()) <= k:
            return possible
        sides = [self._side(d, bool(weights[d] < 0)) for d in dims.tolist()]
        size = np.abs(weights[dims])
        worst = int((weights[dims] * np.where(weights[dims] < 0, self.high[dims],
                                              self.low[dims])).sum())
        ends = np.concatenate([s[2] for s in sides])
        begin = np.cumsum([0] + [len(s[2]) for s in sides])    # of a dimension's segments
        which = np.repeat(np.arange(len(dims)), np.diff(begin))
        plan = np.argsort(-size[which] * np.concatenate([s[3] for s in sides]), kind="stable")
        length = np.diff(ends, prepend=0)
        length[begin[:-1]] = ends[begin[:-1]]
        upto = np.cumsum(length[plan])
        total = n * len(dims)
        # what doubles may lose in a bound: it may be too high, never too low
        slip = float((size * (self.high - self.low)[dims]).sum()) * (len(dims) + 8) * 4.5e-16
        self.postings += total
        share = self.first
        while True:
            segments = np.searchsorted(upto, total * share // SHARES) + 1
            done = np.bincount(which[plan[:segments]], minlength=len(dims))
            stop = np.where(done > 0, ends[begin[:-1] + done - 1], 0)
            # the best impact left unread, and what the impacts read exceed it by
            rest = np.array([s[1][b] for s, b in zip(sides, stop)], np.float64)
            read = np.concatenate([s[1][:b] for s, b in zip(sides, stop)], dtype=np.float64)
            read -= np.repeat(rest, stop)
            read *= np.repeat(size, stop)
            above = np.bincount(np.concatenate([s[0][:b] for s, b in zip(sides, stop)],
                                               dtype=np.int64), read, n)
            self.read += len(read)
            bound = above + (float((size * rest).sum()) + slip)   # of the score less the worst
            seeds = np.argpartition(np.where(mine, -np.inf, bound), -min(4 * k, n))[-min(4 * k, n):]
            seeds = seeds[~mine[seeds]]
            least = int(np.sort(self.rows[seeds] @ weights)[-k]) if len(seeds) >= k else None
            for v in (least, known):
                if v is not None:
                    possible &= bound >= float(v - worst)
            left = int(possible.sum())
            if left <= max(4 * k, n // 4) or share == SHARES:
                # the block's next query begins a share earlier if this one read plenty
                self.first = max(1, share - (left <= max(4 * k, n // 16)))
                return possible
            share = min(SHARES, share + (1 if left < n // 2 else 2))

    def to_bytes(self) -> bytes:
        """The index as it is searched: postings in order."""
        if self.rows.dtype == object:
            return pickle.dumps((self.ids, self.rows, self.step, None))
        return pickle.dumps((self.ids, self.rows, self.step, self.order))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "BlockIndex":
        return cls(*pickle.loads(raw))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding", scale: int = 1024, step: int = 32,
           block_rows: int = 8192, query_rows: int = 256) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` (both with
    the id and vector columns): query_id, rank, vec_id, score."""
    base = written(taking_part(vectors, id_col, vector_col), "vectors")
    asked = written(taking_part(queries, id_col, vector_col).distinct(), "queries")
    blocks = parts_for(base.count(), block_rows)
    query_blocks = parts_for(asked.count(), query_rows)

    def build(key, rows):
        import pandas as pd
        index = BlockIndex(rows["vec_id"].to_numpy(), whole_numbers(rows["x"].to_list(), scale), step)
        return pd.DataFrame({"block": [int(key[0])], "index": [index.to_bytes()]})

    dealt = base.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    index = dealt.groupBy("block").applyInPandas(build, "block long, index binary")
    batches = (asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
               .groupBy("part").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("batch"))
               .select("part", "batch", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        best = {}     # of a part of the queries: each one's k best scores in the task's blocks so far
        for record in rows:
            for block, raw, part, batch in zip(*(record.column(i) for i in range(4))):
                if block.as_py() != at:   # rows of a block come together
                    at, found = block.as_py(), BlockIndex.from_bytes(raw.as_py())
                out = [[], [], []]
                had = best.setdefault(part.as_py(), np.full((len(batch), k), -LONG - 1))
                for q, top in zip(batch.as_py(), had):
                    known = int(top[0]) if top[0] >= -LONG else None
                    ids, scores = found.search(whole_numbers([q["x"]], scale)[0], q["vec_id"], k,
                                               known)
                    top[:] = np.sort(np.append(top, scores))[-k:]
                    out[0].append(np.full(len(ids), q["vec_id"], np.int64))
                    out[1].append(ids)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out],
                    names=["query_id", "vec_id", "score"])

    hits = (index.join(batches.withColumn("block", F.col("block").cast("long")), "block")
            .select("block", "index", "part", "batch")
            .mapInArrow(answer, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
