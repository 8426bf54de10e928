"""Second-order gradient-boosted trees for binary labels.

The objective is the logistic loss with its gradient g = p - y and hessian
h = p(1 - p) (Chen & Guestrin, 2016).  Features are binned once from
quantiles (edges are model-sized); each round grows one tree level by level:

* each task walks its rows down the trees grown so far and sums g and h by
  (node, feature, bin) with numpy; one ``groupBy`` adds the tasks' sums.
  The sums are whole numbers of 2**-32 (of the largest row weight), so their
  order cannot change them and the trees do not depend on partitioning;
* below the root only the lighter child of each split is summed from rows.
  Its sibling is the parent less that child, in the same ``groupBy``: the
  parent's sums go in as they are and the child's once more, negated;
* on that small histogram a running ``Window`` sum over bins gives G_L and
  H_L, and gain = ½[G_L²/(H_L+λ) + G_R²/(H_R+λ) - G²/(H+λ)] - γ;
* a missing value (null or NaN) has a bin of its own after the others.  Each
  cut is scored with the missing rows right and with them left, and the better
  side becomes the split's default direction (right if equal, and right where
  training had none missing).  A split on feature f that sends them left is
  stored as feature f + d: features d.. are views in which missing comes first;
* the best split per node (rank-limited window) reaches the driver, at most
  2**depth rows; leaves get weight -η·G/(H+λ).

Rows keep their margin as of the last ``refresh`` rounds; later trees are
walked.  Row weights multiply g and h, and bin edges are then quantiles of the
weight.  It is a second-order booster in the published sense, not a
bit-for-bit replica of any particular library.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import array_literal
from .base import ColumnEstimator, as_array
from .saved import core
from .sketch import weighted_edges
from .trees import (SPLITS, LevelSplits, held, level_range, levels_from, matrix, node_of,
                    split_rows, unpacked)

UNIT = float(1 << 32)
#: Packed blocks (of 1024 rows) that a task sums at once.
BLOCKS = 1 << 10


def quantile_edges(df: DataFrame, cols: list[str], max_bins: int = 32,
                   accuracy: float = 0.0005) -> list[list[float]]:
    """Interior bin edges per feature: values at the quantiles i / max_bins.

    Values are counted in buckets of equal logarithmic width, so a quantile is
    off by at most ``accuracy`` of its own value; the edge is the bucket's
    largest value.  Counts do not depend on the order of rows, and a feature
    has some ten thousand buckets at most over any usual range."""
    width = math.log1p(accuracy)
    v = F.col("v")
    bucket = F.signum(v) * F.ceil(F.log(F.greatest(F.abs(v), F.lit(1e-300))) / width + 2e6)

    def distinct(batches):
        """Each batch's distinct values and how often they come."""
        for batch in batches:
            x = matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 0))
            for f, column in enumerate(x.T):
                values, n = np.unique(column[~np.isnan(column)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), f, np.int32)), pa.array(values), pa.array(n)],
                    names=["feature", "v", "n"])

    counts = (df.select(as_array(cols).alias("x"))
              .mapInArrow(distinct, "feature int, v double, n long")
              .groupBy("feature", F.when(v == 0, 0.0).otherwise(bucket).alias("bucket"))
              .agg(F.sum("n").alias("n"), F.max("v").alias("top")))
    run = Window.partitionBy("feature").orderBy("bucket")
    total = Window.partitionBy("feature")
    ranked = counts.select(
        "feature", "top", F.sum("n").over(run).alias("upto"), F.col("n"),
        F.sum("n").over(total).alias("all"))
    # a bucket that holds a quantile's row gives an edge
    first = F.floor((F.col("upto") - F.col("n")) * max_bins / F.col("all"))
    last = F.floor(F.col("upto") * max_bins / F.col("all"))
    rows = ranked.where((last > first) & (F.col("upto") < F.col("all"))).collect()
    edges: list[set] = [set() for _ in cols]
    for r in rows:
        edges[r["feature"]].add(r["top"])
    return [sorted(e) for e in edges]


def bin_columns(df: DataFrame, cols: list[str], edges: list[list[float]],
                prefix: str = "__b") -> tuple[DataFrame, list[str]]:
    """Bin index per feature.  Bin i holds edges[i-1] <= x < edges[i]; a split
    at bin b sends bins 0..b, that is x < edges[b], to the left.  Nulls and NaN
    get bin len(edges) + 1."""
    outs = [f"{prefix}{i}" for i in range(len(cols))]
    splits = [[float("-inf")] + list(e) + [float("inf")] for e in edges]
    # Bucketizer wants an inner edge: a feature without any has one bin
    some = [i for i, e in enumerate(edges) if e]
    if some:
        b = Bucketizer(splitsArray=[splits[i] for i in some], inputCols=[f"__v{i}" for i in some],
                       outputCols=[outs[i] for i in some], handleInvalid="keep")
        df = b.transform(df.select("*", *[_value(cols[i]).alias(f"__v{i}") for i in some]))
        df = df.drop(*[f"__v{i}" for i in some])
    bins: list[Column] = [F.col(o).cast("int").alias(o) if edges[i] else
                          F.isnan(_value(cols[i])).cast("int").alias(o)
                          for i, o in enumerate(outs)]
    return df.select(*[c for c in df.columns if c not in outs], *bins), outs


def bin_kind(edges: list) -> str:
    """The least integers that number the bins, that of missing values included."""
    most = max(map(len, edges), default=0) + 1
    if most >= (1 << 15) - 1:
        raise ValueError("bins are numbered in two bytes")
    return "<i1" if most < 1 << 7 else "<i2"


def binned(x: np.ndarray, edges: list) -> np.ndarray:
    """The bins that ``bin_columns`` gives, of rows of doubles."""
    out = np.empty(x.shape, bin_kind(edges))
    for f, inner in enumerate(edges):
        column = x[:, f]
        at = np.searchsorted(np.asarray(inner, dtype=float), column, side="right")
        out[:, f] = np.where(np.isnan(column), len(inner) + 1, at)
    return out


def _value(col: str) -> Column:
    return F.coalesce(F.col(col).cast("double"), F.lit(float("nan")))


def _views(bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """The bins, and beside them the bins with missing values first."""
    at = bins == missing.astype(bins.dtype)
    return np.hstack([bins, np.where(at, -1, bins)]) if at.any() else np.hstack([bins, bins])


def histogram_gains(hist: DataFrame, lam: float, gamma: float) -> DataFrame:
    """Gain of every cut 'bin <= b' from a (node, feature, bin, g, h) table."""
    run = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, 0)
    tot = Window.partitionBy("node", "feature")
    h = (hist.withColumn("GL", F.sum("g").over(run)).withColumn("HL", F.sum("h").over(run))
         .withColumn("G", F.sum("g").over(tot)).withColumn("H", F.sum("h").over(tot)))
    GR, HR = F.col("G") - F.col("GL"), F.col("H") - F.col("HL")
    sq = lambda a: a * a
    gain = 0.5 * (sq(F.col("GL")) / (F.col("HL") + lam) + sq(GR) / (HR + lam)
                  - sq(F.col("G")) / (F.col("H") + lam)) - gamma
    return h.withColumn("HR", HR).withColumn("gain", gain)


@core("boosted_trees")
@dataclass
class BoostedTreesModel:
    edges: list
    trees: list           # per round: (list[LevelSplits], leaf weights dense)
    base_margin: float

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges], dtype=np.int64)

    def margins(self, bins: np.ndarray, views: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(bins), self.base_margin)
        if self.trees:
            bins = _views(bins, self.missing) if views is None else views
        for levels, leaf in self.trees:
            out += np.asarray(leaf)[node_of(levels, 0, bins)]
        return out

    def with_margin(self, df: DataFrame, cols: list[str], name: str) -> DataFrame:
        """``df`` and its margin (log-odds); a vectorised function walks the
        trees, so the plan does not grow with the rounds."""
        shipped = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def margin(x: pa.Array) -> pa.Array:
            model = shipped.value
            return pa.array(model.margins(binned(matrix(x), model.edges)))

        return df.withColumn(name, margin(as_array(cols)))

    def state(self, spark):
        edges = [(f, i, v) for f, found in enumerate(self.edges) for i, v in enumerate(found)]
        leaves = [(t, node, w) for t, (_, leaf) in enumerate(self.trees)
                  for node, w in enumerate(leaf)]
        splits = split_rows([(t, levels) for t, (levels, _) in enumerate(self.trees)])
        return ({"base": self.base_margin, "trees": len(self.trees), "features": len(self.edges)},
                {"edges": spark.createDataFrame(edges, "feature int, place int, edge double"),
                 "splits": spark.createDataFrame(splits, SPLITS),
                 "leaves": spark.createDataFrame(leaves, "tree int, node long, weight double")})

    @classmethod
    def restored(cls, header, tables):
        edges: list[list[float]] = [[] for _ in range(header["features"])]
        for r in tables("edges").orderBy("feature", "place").collect():
            edges[r["feature"]].append(r["edge"])
        splits: list[list[dict]] = [[] for _ in range(header["trees"])]
        for r in tables("splits").collect():      # the size of the model
            splits[r["tree"]].append({**r.asDict(), "tree": 0})
        leaf: list[list[float]] = [[] for _ in range(header["trees"])]
        for r in tables("leaves").orderBy("tree", "node").collect():
            leaf[r["tree"]].append(r["weight"])
        return cls(edges, [(levels_from(s, 1), w) for s, w in zip(splits, leaf)], header["base"])

    def transform_columns(self, df, cols, prediction):
        out = self.with_margin(df, cols, "__margin")
        return out.withColumn(prediction, F.when(F.col("__margin") > 0, 1.0).otherwise(0.0)) \
                  .drop("__margin")


def _best_per_node_feature(hist: DataFrame, lam: float, gamma: float,
                           min_child_weight: float, edges: list) -> DataFrame:
    """Best cut per (node, feature), missing values on their better side, with
    the sums left of it and the node totals G and H.

    Both windows share the (node, feature) partitioning of the histogram,
    so this adds no exchange beyond the aggregate's; the result has at most
    nodes x features rows and the driver picks among features per node.
    """
    last = F.element_at(array_literal([len(e) + 1 for e in edges], "int"),
                        (F.col("feature") + 1).cast("int"))
    tot = Window.partitionBy("node", "feature")
    here = F.col("bin") == last
    # before the gains, whose G and H hide g and h
    missing = [F.coalesce(F.sum(F.when(here, F.col(c))).over(tot), F.lit(0.0)).alias(f"{c}_missing")
               for c in "gh"]
    gains = histogram_gains(hist.select("*", *missing), lam, gamma)

    def side(extra_g, extra_h, gain, allowed):
        GL, HL = F.col("GL") + extra_g, F.col("HL") + extra_h
        ok = (HL >= min_child_weight) & (F.col("H") - HL >= min_child_weight) & allowed
        return F.struct(F.when(ok, gain(GL, HL)).alias("gain"), GL.alias("GL"), HL.alias("HL"))

    def second_order(GL, HL):
        GR, HR = F.col("G") - GL, F.col("H") - HL
        return 0.5 * (GL * GL / (HL + lam) + GR * GR / (HR + lam)
                      - F.col("G") * F.col("G") / (F.col("H") + lam)) - gamma

    right = side(F.lit(0.0), F.lit(0.0), lambda *_: F.col("gain"), ~here)
    left = side(F.col("g_missing"), F.col("h_missing"), second_order,
                ~here & (F.col("h_missing") > 0))
    cuts = gains.select("node", "feature", "bin", "G", "H", right.alias("right"),
                        left.alias("left"))
    better = F.coalesce(F.col("left.gain") > F.col("right.gain"), F.col("left.gain").isNotNull())
    cuts = cuts.withColumn("to_left", better).withColumn(
        "best", F.when(better, F.col("left")).otherwise(F.col("right")))
    w = Window.partitionBy("node", "feature").orderBy(F.desc_nulls_last("best.gain"), "bin")
    return (cuts.withColumn("__r", F.row_number().over(w)).where("__r = 1")
            .select("node", "feature", "bin", "to_left", "best.gain", "best.GL", "best.HL",
                    "G", "H"))


def _histogram(data: DataFrame, levels: list, depth: int, trees: list, edges: list,
               unit: float, parents: DataFrame | None, lighter: set) -> DataFrame:
    """Whole sums of g and h (in ``unit``) by (node, feature, bin) at ``depth``.

    ``data`` has bins b, label y, margin and weight, ``trees`` are those since.
    Below the root, rows are summed for the ``lighter`` children; their
    siblings follow from ``parents``, the sums of the level above."""
    lo, hi, kind = *level_range(depth), bin_kind(edges)
    shipped = data.sparkSession.sparkContext.broadcast(
        (levels, BoostedTreesModel(edges, trees, 0.0)))
    wanted = np.zeros(hi - lo + 1, dtype=bool)
    wanted[[n - lo for n in lighter] if depth else [0]] = True

    def reduce(batches):
        grown, model = shipped.value
        total: dict[int, np.ndarray] = {}
        for batch in (whole.slice(a, BLOCKS) for whole in batches
                      for a in range(0, whole.num_rows, BLOCKS)):
            b, y, margin, w = _block(batch, kind)
            views = _views(b, model.missing) if grown or model.trees else b
            if model.trees:
                margin = margin + model.margins(b, views)
            p = 1 / (1 + np.exp(-margin))
            g = np.rint((p - y) * w * unit)
            h = np.rint(p * (1 - p) * w * unit)
            node = node_of(grown, 0, views)
            here = (node >= lo) & (node <= hi)
            here[here] = wanted[node[here] - lo]
            if not here.any():
                continue
            place, gh, tops = node[here] - lo, (g[here], h[here]), b.max(axis=0)
            columns = b[here].T.astype(np.int64, order="C")
            for f in range(b.shape[1]):
                size = int(tops[f]) + 1
                at = place * size + columns[f]
                n = (hi - lo + 1) * size
                # at most 2**20 rows of up to 2**32 each: the doubles are exact
                new = np.stack([np.bincount(at, v, n).astype(np.int64).reshape(-1, size)
                                for v in gh] + [np.bincount(at, minlength=n).reshape(-1, size)])
                old = total.get(f)
                if old is not None:
                    size = max(size, old.shape[2])
                    grow = lambda v: np.pad(v, ((0, 0), (0, 0), (0, size - v.shape[2])))  # noqa: E731,B023
                    new = grow(old) + grow(new)
                total[f] = new
        out = [(int(nd) + lo, f, int(bn), *(int(s) for s in v[:, nd, bn]))
               for f, v in total.items() for nd, bn in zip(*np.nonzero(v[2]))]
        if depth:       # to be taken from the parent for the sibling: 2p + 1 beside 2p + 2
            out += [(n + 1 if n % 2 else n - 1, f, bn, *(-s for s in sums))
                    for n, f, bn, *sums in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)],
            names=["node", "feature", "bin", "g", "h", "n"])

    sums = data.select("b", "y", "margin", "w").mapInArrow(
        reduce, "node long, feature long, bin long, g long, h long, n long")
    if parents is not None and lighter:
        heavy = F.create_map(*[F.lit(v).cast("bigint") for n in sorted(lighter)
                               for v in ((n - 1) // 2, n + 1 if n % 2 else n - 1)])
        whole = parents.select(F.try_element_at(heavy, F.col("node")).alias("node"), "feature",
                               "bin", *"ghn").where(F.col("node").isNotNull())
        sums = sums.unionByName(whole)
    return (sums.groupBy("node", "feature", "bin")
            .agg(*[F.sum(c).alias(c) for c in "ghn"]).where(F.col("n") > 0))


def _packed(rows: DataFrame, edges: list, weighted: bool, block: int = 1024) -> DataFrame:
    """Rows (x, y, w) as binary blocks of bins b, y, margin and w.  Margins are
    empty while they are all 0, and so are weights that are all 1."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                x, y, w = batch.slice(a, block).columns
                cols = [binned(matrix(x), edges), y.to_numpy(zero_copy_only=False),
                        np.zeros(0), w.to_numpy(zero_copy_only=False) if weighted else np.zeros(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes()], pa.binary()) for c in cols],
                    names=["b", "y", "margin", "w"])

    return rows.mapInArrow(run, "b binary, y binary, margin binary, w binary")


def _block(batch: pa.RecordBatch, kind: str) -> tuple:
    """b, y, margin and w of all blocks of a batch of packed rows."""
    y, margin, w = (unpacked(batch.column(i), "<f8") for i in (1, 2, 3))
    return (unpacked(batch.column(0), kind).reshape(len(y), -1), y,
            margin if len(margin) else np.zeros(len(y)), w if len(w) else np.ones(len(y)))


def _reals(hist: DataFrame, unit: float) -> DataFrame:
    return hist.select("node", "feature", "bin", (F.col("g") / unit).alias("g"),
                       (F.col("h") / unit).alias("h"))


def boosted_trees_fit(df: DataFrame, cols: list[str], label: str = "label",
                      rounds: int = 20, max_depth: int = 3, eta: float = 0.3,
                      lam: float = 1.0, gamma: float = 0.0, min_child_weight: float = 1.0,
                      max_bins: int = 32, edges: list | None = None,
                      refresh: int = 10, weight: str | None = None) -> BoostedTreesModel:
    """Fit ``rounds`` trees.  ``weight`` names a column of row weights, zero or
    more and finite; a null weight fails."""
    unit = UNIT
    if weight is not None:
        top = df.agg(F.min(weight), F.max(weight), F.count(F.when(F.col(weight).isNull(), 1))).first()
        if top[0] is not None and (top[2] or not (top[0] >= 0 and 0 < top[1] < float("inf"))):
            raise ValueError(f"{weight} holds nulls, or numbers that are no weights")
        unit = UNIT / 2.0 ** max(0, math.ceil(math.log2(top[1] or 1.0)))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if edges is None:
        edges = (quantile_edges(df, cols, max_bins) if weight is None else
                 weighted_edges(df, cols, weight, max_bins))
    first = held(_packed(df.select(as_array(cols).alias("x"),
                                   F.col(label).cast("double").alias("y"), w.alias("w")),
                         edges, weight is not None))
    data, newer = first, None
    trees, since = [], []
    for rnd in range(rounds):
        levels, leaf_gh = [], {}
        hist, lighter = None, set()
        for depth in range(max_depth):
            above, hist = hist, _histogram(data, levels, depth, since, edges, unit, hist,
                                           lighter).persist()
            best = {}
            for r in _best_per_node_feature(_reals(hist, unit), lam, gamma, min_child_weight,
                                            edges).collect():
                node = r["node"]
                leaf_gh[node] = (r["G"], r["H"])
                if r["gain"] is not None and r["gain"] > 0:
                    key = (-r["gain"], r["feature"], r["bin"])
                    if node not in best or key < best[node][0]:
                        best[node] = (key, r)
            if above is not None:
                above.unpersist()
            if not best:
                break
            lv, lighter = LevelSplits.empty(depth, 1), set()
            for node, (_, r) in best.items():
                lv.set(0, node, r["feature"] + (len(cols) if r["to_left"] else 0), float(r["bin"]))
                lighter.add(2 * node + (1 if r["HL"] <= r["H"] - r["HL"] else 2))
                # the children's sums come with the split
                leaf_gh[2 * node + 1] = (r["GL"], r["HL"])
                leaf_gh[2 * node + 2] = (r["G"] - r["GL"], r["H"] - r["HL"])
                leaf_gh.pop(node, None)
            levels.append(lv)
        if hist is not None:
            hist.unpersist()
        leaf = [0.0] * (2 ** (len(levels) + 1) - 1)
        for node, (G, H) in leaf_gh.items():
            if node < len(leaf):
                leaf[node] = -eta * G / (H + lam)
        trees.append((levels, leaf))
        since.append((levels, leaf))
        if len(since) == refresh and rnd + 1 < rounds:
            nxt = _with_margin(data, since, edges).persist()
            nxt.count()
            if newer is not None:
                newer.unpersist()
            data, newer, since = nxt, nxt, []
    if newer is not None:
        newer.unpersist()
    first.unpersist()
    return BoostedTreesModel(edges, trees, 0.0)


def _with_margin(data: DataFrame, trees: list, edges: list) -> DataFrame:
    """``data`` with the trees' leaves added to its margins."""
    shipped = data.sparkSession.sparkContext.broadcast(BoostedTreesModel(edges, trees, 0.0))
    kind = bin_kind(edges)

    def add(batches):
        for batch in batches:
            margin = []
            for block in range(batch.num_rows):
                b, _, old, _ = _block(batch.slice(block, 1), kind)
                margin.append((old + shipped.value.margins(b)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(margin, pa.binary()), batch.column(3)],
                names=["b", "y", "margin", "w"])

    return data.select("b", "y", "margin", "w").mapInArrow(add, data.schema)


class BoostedTrees(ColumnEstimator):
    """C8 as a Pipeline stage."""

    def __init__(self, rounds: int = 20, maxDepth: int = 3, eta: float = 0.3,
                 lam: float = 1.0, gamma: float = 0.0, maxBins: int = 32,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__(featuresCol, labelCol, predictionCol)
        self.params_ = dict(rounds=rounds, max_depth=maxDepth, eta=eta, lam=lam,
                            gamma=gamma, max_bins=maxBins)

    def fit_columns(self, df, cols, label):
        return boosted_trees_fit(df, cols, label, weight=self.weight, **self.params_)


def boosted_trees(**kw) -> BoostedTrees:
    return BoostedTrees(**kw)
