"""C6 with bags that can be repeated: a random forest of hash-drawn rows.

Spark ML's forest draws rows from generators seeded by partition, so its trees
depend on how the rows are dealt.  Here md5(seed|key|tree) says how often a row
is in a tree's bag (Poisson with mean 1, Chamandy et al.'s form of Breiman's
bootstrap) and md5(seed|tree|node|feature|'pick') which ``k_features`` of a
node's features are tried, so the forest is the same for any partitioning or
retry, and a plain query can repeat it.  Rows of one key are drawn together.

Features are binned once, and rows are kept as packed bytes: a byte a feature
and a byte a tree.  The forest grows one level at a time for all trees:

* each task walks its rows down the levels grown so far and counts the bags by
  (tree, node, drawn feature, bin, class) with numpy; one ``groupBy`` adds the
  tasks' counts.  Nodes are taken in groups of at most ``CELLS`` counters, so
  memory is bounded at any depth;
* running sums over the bins give each cut's counts, and a rank-limited window
  keeps the best cut of each node: by Gini decrease (rounded to 12 digits), then
  the smaller feature, then the smaller bin;
* counts of the children follow from the chosen cut, so leaves need no pass.

Trees are sparse tables of the nodes that exist, not arrays over 2^depth.

Defined cases: a null or NaN feature lies above every cut; a null label fails;
a null key part is left out of the key; a tree whose bag is empty has no vote;
if no tree has one, the smallest label is predicted.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import ColumnEstimator, ColumnModel, as_array, class_weights, spread, vector_size
from .boosting import quantile_edges
from .metrics import poisson_cuts
from .moments import class_labels
from .saved import core
from .trees import held, unpacked

#: Counters of one histogram job in a task (8 bytes each).
CELLS = 1 << 20
BLOCK = 1024

#: A level: tree -> (node numbers in order, feature, last bin on the left).
Level = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _u32(*parts) -> int:
    """As ``functions.hashing.md5_u32``."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: how many edges are not above it (all, if missing)."""
    out = np.empty(x.shape, dtype=np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(np.asarray(e, dtype=float), x[:, f], side="right")
    return out


def places(levels: list[Level], tree: int, bins: np.ndarray) -> np.ndarray:
    """The node of each row in a tree."""
    node = np.zeros(len(bins), dtype=np.int64)
    for level in levels:
        if tree not in level:
            break
        nodes, feature, cut = level[tree]
        at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        here = np.flatnonzero(nodes[at] == node)
        at = at[here]
        left = bins[here, feature[at]] <= cut[at]
        node[here] = 2 * node[here] + np.where(left, 1, 2)
    return node


def _packed(df: DataFrame, cols, label, key, edges, labels, num_trees, seed) -> DataFrame:
    """Blocks of rows: bins (``b``), class numbers (``y``), copies by tree (``w``)."""
    cuts = np.array(poisson_cuts())

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False)
                x = x.astype(float).reshape(part.num_rows, -1)
                y = np.searchsorted(labels, part.column(1).to_numpy()).astype(np.uint8)
                keys, where = np.unique(np.array(part.column(2).to_pylist(), dtype=object),
                                        return_inverse=True)
                u = np.array([[_u32(seed, k, t) for t in range(num_trees)] for k in keys])
                w = np.searchsorted(cuts, u, side="right").astype(np.uint8)[where]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes()], pa.binary()) for v in (binned(x, edges), y, w)],
                    names=["b", "y", "w"])

    known = F.coalesce(F.col(label).cast("double"),
                       F.raise_error(F.lit(f"null in {label}")).cast("double"))
    return (df.select(as_array(cols).alias("x"), known.alias("y"),
                      F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("k"))
            .mapInArrow(run, "b binary, y binary, w binary"))


def _unpack(batch: pa.RecordBatch, d: int, num_trees: int):
    b, y, w = (unpacked(c, "u1") for c in batch.columns)
    return b.reshape(len(y), d), y, w.reshape(len(y), num_trees)


def _bag_counts(data: DataFrame, d: int, n_labels: int, num_trees: int) -> dict[int, list[int]]:
    """Class counts of every tree's bag."""
    def run(batches):
        total = np.zeros((num_trees, n_labels), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                _, y, w = _unpack(batch, d, num_trees)
                for c in range(n_labels):
                    total[:, c] += w[y == c].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(num_trees), pa.int64()), *[pa.array(c) for c in total.T]],
            names=["tree", *[f"c{i}" for i in range(n_labels)]])

    cls = [f"c{i}" for i in range(n_labels)]
    rows = (data.mapInArrow(run, ", ".join(f"{n} long" for n in ("tree", *cls)))
            .groupBy("tree").agg(*[F.sum(c).alias(c) for c in cls]).collect())
    return {r["tree"]: [r[c] for c in cls] for r in rows if sum(r[c] for c in cls)}


def _histogram(data: DataFrame, levels: list[Level], drawn: dict, d: int, n_bins: int,
               n_labels: int, num_trees: int) -> DataFrame:
    """Bag counts by (tree, node, feature, bin, class) of the ``drawn`` nodes:
    tree -> (node numbers in order, features drawn for each)."""
    shipped = data.sparkSession.sparkContext.broadcast((levels, drawn))
    names = ["tree", "node", "feature", "bin", *[f"c{i}" for i in range(n_labels)]]

    def run(batches):
        grown, wanted = shipped.value
        found = {t: np.zeros((*features.shape, n_bins, n_labels), dtype=np.int64)
                 for t, (_, features) in wanted.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, w = _unpack(batch, d, num_trees)
            for t, (nodes, features) in wanted.items():
                rows = np.flatnonzero(w[:, t])
                node = places(grown, t, bins[rows])
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                here = nodes[at] == node
                rows, at = rows[here], at[here]
                flat = found[t].reshape(-1)
                for j in range(features.shape[1]):
                    cell = ((at * features.shape[1] + j) * n_bins
                            + bins[rows, features[at, j]]) * n_labels + y[rows]
                    flat += np.bincount(cell, weights=w[rows, t],
                                        minlength=len(flat)).astype(np.int64)
        for t, (nodes, features) in wanted.items():
            m, j, b = np.nonzero(found[t].any(axis=3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(v, dtype=np.int64)) for v in (
                    np.full(len(m), t), nodes[m], features[m, j], b, *found[t][m, j, b].T)],
                names=names)

    return (data.mapInArrow(run, ", ".join(f"{n} long" for n in names))
            .groupBy(*names[:4]).agg(*[F.sum(c).alias(c) for c in names[4:]]))


def _gini(counts, n):
    share = sum(((c / n) * (c / n) for c in counts), F.lit(0.0))
    return F.when(n > 0, 1 - share).otherwise(F.lit(0.0))


def _best_cuts(hist: DataFrame, weights: list[float], min_rows: int) -> DataFrame:
    """Best cut of each node: tree, node, feature, bin, node counts t* and counts
    l* on the left."""
    cls = range(len(weights))
    group = Window.partitionBy("tree", "node", "feature")
    run = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cuts = hist.select("tree", "node", "feature", "bin",
                       *[F.sum(f"c{i}").over(run).alias(f"l{i}") for i in cls],
                       *[F.sum(f"c{i}").over(group).alias(f"t{i}") for i in cls])
    left, total = ([F.col(f"{p}{i}") for i in cls] for p in "lt")
    n, nl = sum(total, F.lit(0)), sum(left, F.lit(0))
    wl, wt = ([c.cast("double") * w for c, w in zip(cs, weights)] for cs in (left, total))
    wr = [t - l for t, l in zip(wt, wl)]
    sl, st, sr = (sum(cs, F.lit(0.0)) for cs in (wl, wt, wr))
    gain = _gini(wt, st) - sl / st * _gini(wl, sl) - sr / st * _gini(wr, sr)
    cuts = (cuts.where((nl >= min_rows) & (n - nl >= min_rows))
            .withColumn("gain", F.round(gain, 12)).where("gain > 0"))
    best = Window.partitionBy("tree", "node").orderBy(F.desc("gain"), "feature", "bin")
    return cuts.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def _groups(nodes: list[tuple[int, int]], seed: int, d: int, k: int, cells: int):
    """The nodes in groups of at most CELLS counters, with the features drawn."""
    size = max(1, CELLS // cells)
    for a in range(0, len(nodes), size):
        by_tree: dict[int, list] = {}
        for t, node in nodes[a:a + size]:
            order = sorted(range(d), key=lambda f: (_u32(seed, t, node, f, "pick"), f))
            by_tree.setdefault(t, []).append((node, order[:k]))
        yield {t: (np.array([n for n, _ in rows]), np.array([f for _, f in rows]))
               for t, rows in by_tree.items()}


@core("bagged_forest")
@dataclass
class BaggedForestModel:
    labels: list[float]
    num_trees: int
    edges: list[list[float]]
    splits: list[tuple]     # (tree, node, feature, bin), as they were grown
    leaves: list[tuple]     # (tree, node, class shares)

    def _tables(self):
        by: dict[tuple, list] = {}
        for t, node, f, b in self.splits:
            by.setdefault(((node + 1).bit_length() - 1, t), []).append((node, f, b))
        levels: list[Level] = [{} for _ in range(1 + max((d for d, _ in by), default=-1))]
        for (depth, t), rows in by.items():
            levels[depth][t] = tuple(np.array(c) for c in zip(*sorted(rows)))
        leaves: dict[int, list] = {}
        for t, node, share in self.leaves:
            leaves.setdefault(t, []).append((node, share))
        return levels, {t: (np.array([n for n, _ in sorted(rows)]),
                            np.array([s for _, s in sorted(rows)]))
                        for t, rows in leaves.items()}

    def transform_columns(self, df, cols, prediction):
        """The class with the largest mean leaf share (rounded to 9 digits); a tie
        goes to the smaller label."""
        shipped = df.sparkSession.sparkContext.broadcast(
            (*self._tables(), self.edges, np.array(self.labels)))

        @F.pandas_udf("double")
        def vote(x: pd.Series) -> pd.Series:
            levels, leaves, edges, labels = shipped.value
            if not len(x):
                return pd.Series([], dtype=float)
            bins = binned(np.stack([np.asarray(v, dtype=float) for v in x]), edges)
            score = np.zeros((len(x), len(labels)))
            for t, (nodes, share) in leaves.items():
                score += share[np.searchsorted(nodes, places(levels, t, bins))]
            return pd.Series(labels[np.argmax(np.round(score / max(1, len(leaves)), 9), axis=1)])

        return df.withColumn(prediction, vote(as_array(cols)))

    def state(self, spark):
        return ({"labels": self.labels, "trees": self.num_trees}, {
            "edges": spark.createDataFrame(list(enumerate(self.edges)),
                                           "feature int, edges array<double>"),
            "splits": spark.createDataFrame(self.splits,
                                            "tree int, node long, feature int, bin int"),
            "leaves": spark.createDataFrame(self.leaves,
                                            "tree int, node long, share array<double>")})

    @classmethod
    def restored(cls, header, tables):
        rows = {n: [tuple(r) for r in tables(n).collect()]     # the size of the model
                for n in ("edges", "splits", "leaves")}
        return cls(header["labels"], header["trees"], [e for _, e in sorted(rows["edges"])],
                   rows["splits"], rows["leaves"])


def bagged_forest_fit(df: DataFrame, cols: list[str], key: list[str], label: str = "label",
                      num_trees: int = 20, max_depth: int = 6, k_features: int | None = None,
                      max_bins: int = 32, min_rows: int = 1, seed: int = 7,
                      edges: list[list[float]] | None = None,
                      weight: str | None = None) -> BaggedForestModel:
    """Grow the forest.  ``key`` names the columns that rows are drawn by,
    ``min_rows`` the least drawn rows in a child, ``weight`` a column of class
    weights: counts stay whole, gains and leaf shares take them times the weight."""
    if not 2 <= max_bins <= 256 or any(len(e) > 255 for e in edges or []):
        raise ValueError("a feature has 2 to 256 bins")
    if max_depth > 60:
        raise ValueError("node numbers end at depth 60")
    labels = sorted(float(y) for y in class_labels(df, label))
    by = class_weights(df, label, weight) if weight else {}
    weights = [by.get(y, 1.0) for y in labels]
    edges = edges if edges is not None else quantile_edges(df, cols, max_bins)
    d, k = len(cols), min(len(cols), k_features or max(1, math.isqrt(len(cols))))
    n_bins = 1 + max(len(e) for e in edges)
    data = held(_packed(df, cols, label, key, edges, np.array(labels), num_trees, seed))

    counts = {(t, 0): c for t, c in _bag_counts(data, d, len(labels), num_trees).items()}
    live, levels, splits = sorted(counts), [], []
    for _ in range(max_depth):
        live = [at for at in live if sum(c > 0 for c in counts[at]) > 1]
        level: dict[int, list] = {}
        for drawn in _groups(live, seed, d, k, k * n_bins * len(labels)):
            hist = _histogram(data, levels, drawn, d, n_bins, len(labels), num_trees)
            for r in _best_cuts(hist, weights, min_rows).collect():      # a row per node
                t, node = r["tree"], r["node"]
                level.setdefault(t, []).append((node, r["feature"], r["bin"]))
                splits.append((t, node, r["feature"], r["bin"]))
                left = [r[f"l{i}"] for i in range(len(labels))]
                whole = counts.pop((t, node))
                counts[t, 2 * node + 1] = left
                counts[t, 2 * node + 2] = [a - b for a, b in zip(whole, left)]
        if not level:
            break
        levels.append({t: tuple(np.array(c) for c in zip(*sorted(rows)))
                       for t, rows in level.items()})
        live = sorted((t, child) for t, rows in level.items() for node, *_ in rows
                      for child in (2 * node + 1, 2 * node + 2))
    data.unpersist()
    leaves = []
    for (t, node), c in sorted(counts.items()):
        shares = [n * w for n, w in zip(c, weights)]
        leaves.append((t, node, [s / sum(shares) for s in shares]))
    return BaggedForestModel(labels, num_trees, edges, sorted(splits), leaves)


class BaggedForest(ColumnEstimator):
    """C6 as a Pipeline stage; ``keyCols`` are columns of the rows beside the
    features (without them a row is drawn by its features and label)."""

    def __init__(self, keyCols: list[str] | None = None, numTrees: int = 20, maxDepth: int = 6,
                 kFeatures: int | None = None, maxBins: int = 32, minRows: int = 1, seed: int = 7,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__(featuresCol, labelCol, predictionCol)
        self.keys = list(keyCols or [])
        self.params_ = dict(num_trees=numTrees, max_depth=maxDepth, k_features=kFeatures,
                            max_bins=maxBins, min_rows=minRows, seed=seed)

    def _fit(self, dataset: DataFrame):
        features, label = self.getFeaturesCol(), self.getLabelCol()
        d = vector_size(dataset, features)
        keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(self.keys)]
        extra = [self.weight] if self.weight else []
        wide, cols = spread(dataset.select(features, label, *extra, *keys), features, d)
        model = bagged_forest_fit(wide, cols, [f"__k{i}" for i in range(len(keys))]
                                  or [*cols, label], label, weight=self.weight, **self.params_)
        return ColumnModel(model, features, d, self.getPredictionCol())


def bagged_forest(**kw) -> BaggedForest:
    return BaggedForest(**kw)
