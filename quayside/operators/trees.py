"""Shared pieces of the level-wise tree growers.

Nodes are numbered heap-style: the root is 0 and node n has children 2n+1
(x <= threshold) and 2n+2.  Nodes of depth L are 2**L - 1 .. 2**(L+1) - 2.
A level's splits are two dense arrays over those nodes (feature index, or
-1 for a node that does not split, and threshold): model-sized.  In a fit,
tasks walk their rows down the levels grown so far with numpy; in scoring,
the arrays are folded literals and the walk is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import array_literal


#: Rows walked at once: their values stay in the processor's cache.
WALKED = 1 << 13


def level_range(depth: int) -> tuple[int, int]:
    return 2 ** depth - 1, 2 ** (depth + 1) - 2


@dataclass
class LevelSplits:
    """Splits of one depth for ``trees`` trees: dense over (tree, node)."""
    depth: int
    trees: int
    feature: list = field(default_factory=list)    # -1 = no split
    threshold: list = field(default_factory=list)

    @classmethod
    def empty(cls, depth: int, trees: int):
        width = 2 ** depth
        return cls(depth, trees, [-1] * (width * trees), [0.0] * (width * trees))

    def set(self, tree: int, node: int, feature: int, threshold: float):
        i = tree * 2 ** self.depth + (node - (2 ** self.depth - 1))
        self.feature[i] = int(feature)
        self.threshold[i] = float(threshold)

    def step(self, node: Column, tree: Column, values: Column) -> Column:
        """Next node id for a row currently at ``node`` of ``tree``.

        ``values`` is the row's feature array (0-based feature indexes).
        Rows at other depths, or at a node without a split, keep their node.
        """
        lo, hi = level_range(self.depth)
        idx = tree * F.lit(2 ** self.depth) + (node - F.lit(lo)) + F.lit(1)
        feats = array_literal(self.feature, "int")
        cuts = array_literal(self.threshold, "double")
        # try_element_at: rows at other depths index outside the arrays -> null
        f = F.try_element_at(feats, idx.cast("int"))
        fi = (F.greatest(f, F.lit(0)) + F.lit(1)).cast("int")
        go_left = F.try_element_at(values, fi) <= F.try_element_at(cuts, idx.cast("int"))
        at_level = (node >= F.lit(lo)) & (node <= F.lit(hi))
        return F.when(at_level & f.isNotNull() & (f >= 0),
                      F.when(go_left, node * 2 + 1).otherwise(node * 2 + 2)).otherwise(node)

    def walk(self, node: np.ndarray, tree: int, x: np.ndarray) -> np.ndarray:
        """The same step for arrays: nodes of the rows of ``x`` in one tree."""
        lo, hi = level_range(self.depth)
        width = 2 ** self.depth
        feature = np.asarray(self.feature[tree * width:(tree + 1) * width], dtype=np.int32)
        cut = np.asarray(self.threshold[tree * width:(tree + 1) * width], dtype=float)
        # ``take`` of flat values, and no lists of rows where all are here and split
        x = np.ascontiguousarray(x)
        flat, begin = x.reshape(-1), np.arange(len(x), dtype=np.int32) * x.shape[1]
        at = node - lo
        if len(node) and feature.min() >= 0 and at.min() >= 0 and at.max() < width:
            return 2 * node + 2 - (flat.take(begin + feature.take(at)) <= cut.take(at))
        here = (at >= 0) & (at < width)
        at = np.where(here, at, 0)
        here &= feature.take(at) >= 0
        left = flat.take(begin + np.maximum(feature.take(at), 0)) <= cut.take(at)
        return np.where(here, 2 * node + 2 - left, node)


SPLITS = "tree int, depth int, node long, feature int, cut double"


def split_rows(trees: list[tuple[int, list[LevelSplits]]]) -> list[tuple]:
    """The splits of (number of the first tree, levels) as rows of SPLITS."""
    return [(first + t, lv.depth, 2 ** lv.depth - 1 + i,
             lv.feature[t * 2 ** lv.depth + i], lv.threshold[t * 2 ** lv.depth + i])
            for first, levels in trees for lv in levels for t in range(lv.trees)
            for i in range(2 ** lv.depth) if lv.feature[t * 2 ** lv.depth + i] >= 0]


def levels_from(rows, trees: int) -> list[LevelSplits]:
    """Levels of ``trees`` trees from rows of SPLITS (trees numbered from 0)."""
    levels: list[LevelSplits] = []
    for r in sorted(rows, key=lambda r: r["depth"]):
        while len(levels) <= r["depth"]:
            levels.append(LevelSplits.empty(len(levels), trees))
        levels[r["depth"]].set(r["tree"], r["node"], r["feature"], r["cut"])
    return levels


def held(blocks: DataFrame) -> DataFrame:
    """Packed blocks, persisted, in at least as many partitions as there are
    cores: a small input (one file, one row group) is one task otherwise, at
    every level of a fit."""
    blocks = blocks.persist()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    if blocks.rdd.getNumPartitions() >= cores:
        return blocks
    spread = blocks.repartition(cores).persist()
    spread.count()
    blocks.unpersist()
    return spread


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """The values of all blocks of a packed column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of a matrix; a null in them is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def node_of(levels: list[LevelSplits], tree: int, x: np.ndarray) -> np.ndarray:
    """Where the levels grown so far put each row of ``x``."""
    out = np.zeros(len(x), dtype=np.int64)
    for a in range(0, len(x) if levels else 0, WALKED):
        node, part = np.zeros(len(x[a:a + WALKED]), dtype=np.int32), x[a:a + WALKED]
        for level in levels:
            node = level.walk(node, tree, part)
        out[a:a + WALKED] = node
    return out
