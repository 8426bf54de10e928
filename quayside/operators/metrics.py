"""Accuracy, recall and F1 from one conditional-sum aggregate.

The kernel is a ``groupBy(by...)`` with four conditional sums (TP, FP, FN,
TN); partial aggregation means every task sends four numbers per group to
the shuffle.  Ratios with an empty denominator are 0.0 by definition.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_u32


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion(pred: DataFrame, label: str = "label",
              prediction: str = "prediction", positive: float = 1.0,
              by: list[str] | tuple = (), digits: int | None = 6) -> DataFrame:
    """Binary confusion counts and ratios for the ``positive`` class.

    Columns: *by, n, tp, fp, fn, tn, accuracy, precision, recall, f1 and
    f1_weighted (the support-weighted mean of both classes' F1, which is
    what Spark's ``MulticlassClassificationEvaluator`` calls ``f1``).
    """
    # a null label or prediction would belong to no cell: fail on it
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.raise_error(
        F.lit(f"null in {c}")).cast("double"))
    y = known(label) == positive
    p = known(prediction) == positive
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    g = pred.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        cnt(y & p).alias("tp"), cnt(~y & p).alias("fp"),
        cnt(y & ~p).alias("fn"), cnt(~y & ~p).alias("tn"))
    tp, fp, fn, tn, n = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn", "n"))
    f1_pos = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_neg = _ratio(2 * tn, 2 * tn + fn + fp)
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return g.select(
        *by, "n", "tp", "fp", "fn", "tn",
        rnd(_ratio(tp + tn, n)).alias("accuracy"),
        rnd(_ratio(tp, tp + fp)).alias("precision"),
        rnd(_ratio(tp, tp + fn)).alias("recall"),
        rnd(f1_pos).alias("f1"),
        rnd(_ratio((tp + fn) * f1_pos + (tn + fp) * f1_neg, n)).alias("f1_weighted"))


def accuracy(pred: DataFrame, label: str = "label",
             prediction: str = "prediction") -> float:
    return confusion(pred, label, prediction, digits=None).first()["accuracy"]


def recall(pred: DataFrame, label: str = "label",
           prediction: str = "prediction", positive: float = 1.0) -> float:
    return confusion(pred, label, prediction, positive, digits=None).first()["recall"]


def f1(pred: DataFrame, label: str = "label", prediction: str = "prediction",
       positive: float = 1.0) -> float:
    return confusion(pred, label, prediction, positive, digits=None).first()["f1"]


def compare(predictions: dict, label: str = "label",
            prediction: str = "prediction", task: str = "task",
            digits: int | None = 6) -> DataFrame:
    """One metrics row per (task, model) over a union of predictions.

    ``predictions`` maps (task, model) -> a DataFrame holding ``label`` and
    ``prediction``.  The union is narrow; the only shuffle carries the four
    partial counts per (task, model) and task.
    """
    parts = [df.select(F.lit(t).alias("task"), F.lit(m).alias("model"),
                       F.col(label).cast("double").alias("label"),
                       F.col(prediction).cast("double").alias("prediction"))
             for (t, m), df in predictions.items()]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return confusion(both, "label", "prediction", by=["task", "model"],
                     digits=digits)


def poisson_cuts() -> list[int]:
    """Where a 32-bit number starts to mean one copy more: floor(2^32 P(X <= j))
    for X Poisson distributed with mean 1, while that is below 2^32."""
    cuts, p, total = [], math.exp(-1), 0.0
    for j in range(1, 20):
        total += p
        if int(total * 2 ** 32) >= 2 ** 32 - 1:
            break
        cuts.append(int(total * 2 ** 32))
        p /= j
    return cuts


def bootstrap(predictions: dict, key: str, label: str = "label", prediction: str = "prediction",
              replicates: int = 200, seed: int = 11, level: float = 0.95,
              digits: int | None = 6) -> DataFrame:
    """Intervals of accuracy, recall and F1, and of their differences
    between the models of a task, by a paired Poisson bootstrap over ``key``.

    All rows of a key (an order) are drawn together, and as often for every
    model: md5(seed|key|replicate) says how often, so the draw needs no join and
    does not depend on partitioning.  A replicate that draws no key at all (of
    very few) is left out.  Counts are added up by key first; a task
    then weighs its keys for all replicates and ships four sums per model and
    replicate.  Rows whose key is null are drawn together as one key.

    ``predictions`` maps (task, model) -> a DataFrame with ``key``, ``label`` and
    ``prediction``.  Columns: task, model, against ('' for the model alone),
    metric, estimate (on the rows as they are), low, high.
    """
    tasks: dict[str, list] = {}
    for t, m in predictions:
        tasks.setdefault(t, []).append(m)
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.raise_error(
        F.lit(f"null in {c}")).cast("double"))
    outs = []
    for task, models in tasks.items():
        rows = reduce(lambda a, b: a.unionByName(b), [
            predictions[task, m].select(
                F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.lit(i).alias("m"),
                (known(label) == 1.0).alias("y"), (known(prediction) == 1.0).alias("p"))
            for i, m in enumerate(models)])
        y, p = F.col("y"), F.col("p")
        cells = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}
        names = [f"{c}{i}" for i in range(len(models)) for c in cells]
        keys = rows.groupBy("k").agg(*[
            F.count(F.when((F.col("m") == i) & cell, 1)).alias(f"{c}{i}")
            for i in range(len(models)) for c, cell in cells.items()])
        # drawn in the array that is exploded: a plain column would be worked out
        # anew wherever ``w`` compares it
        draws = F.transform(F.sequence(F.lit(-1), F.lit(replicates - 1)), lambda r: F.struct(
            r.alias("r"), md5_u32(F.lit(seed), "k", r).alias("u")))
        drawn = keys.select(*names, F.explode(draws).alias("d")).select(*names, "d.r", "d.u")
        u = F.col("u")
        copies = sum((F.when(u >= c, 1).otherwise(0) for c in poisson_cuts()), F.lit(0))
        drawn = drawn.withColumn("w", F.when(F.col("r") < 0, 1).otherwise(copies)).where("w > 0")
        sums = drawn.groupBy("r").agg(*[F.sum(F.col("w") * F.col(c)).cast("double").alias(c)
                                        for c in names])
        found: dict[tuple, Column] = {}
        for i, m in enumerate(models):
            tp, fp, fn, tn = (F.col(f"{c}{i}") for c in cells)
            found[m, "", "accuracy"] = _ratio(tp + tn, tp + fp + fn + tn)
            found[m, "", "recall"] = _ratio(tp, tp + fn)
            found[m, "", "f1"] = _ratio(2 * tp, 2 * tp + fp + fn)
        for a, b in combinations(models, 2):
            for metric in ("accuracy", "recall", "f1"):
                found[a, b, metric] = found[a, "", metric] - found[b, "", metric]
        long = sums.select("r", F.explode(F.array(*[
            F.struct(*[F.lit(v).alias(n) for v, n in zip(at, ("model", "against", "metric"))],
                     value.alias("value")) for at, value in found.items()])).alias("s"))
        value, draw = F.col("s.value"), F.col("r") >= 0
        tail = (1 - level) / 2
        outs.append(long.groupBy("s.model", "s.against", "s.metric").agg(
            F.max(F.when(~draw, value)).alias("estimate"),
            F.percentile(F.when(draw, value), tail).alias("low"),
            F.percentile(F.when(draw, value), 1 - tail).alias("high"))
            .select(F.lit(task).alias("task"), "model", "against", "metric", *[
                (F.round(c, digits) if digits is not None else F.col(c)).alias(c)
                for c in ("estimate", "low", "high")]))
    return reduce(lambda a, b: a.unionByName(b), outs)
