"""Feature front end: dummy-code, scale and assemble, fitted on train.

Fitting takes one aggregate for the numeric means and deviations and one
distinct count per categorical column; applying is one narrow projection.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .saved import SavedModel

#: A categorical column with more levels than this is refused, not cut: its
#: dummies would be a feature vector of that length in every row.
MAX_LEVELS = 10_000
#: Up to so many dummies of a column are written out, which Spark compiles; a
#: longer list is walked by a lambda, row by row.
WRITTEN_OUT = 64


class FeatureFront(Estimator):
    """Numeric columns (standardised if ``scale``) and categorical dummies.

    The first level in order is the reference and has no dummy, so the
    dummies and an intercept are not collinear.  A level unseen in training,
    and null, get all-zero dummies like the reference.  Dummies are left
    unscaled.  A numeric column without variance becomes 0.

    A null or NaN in a numeric column counts as the training mean, and columns
    with some in training get an indicator after the dummies.  With
    ``missing='keep'`` it stays NaN instead, for boosted trees, which learn a
    side for it."""

    def __init__(self, numeric: list[str], categorical: list[str] = (), scale: bool = True,
                 output: str = "features", missing: str = "mean"):
        super().__init__()
        if missing not in ("mean", "keep"):
            raise ValueError(f"missing is 'mean' or 'keep', not {missing!r}")
        self.missing = missing
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.scale, self.output = scale, output

    def _fit(self, dataset: DataFrame) -> "FeatureModel":
        moments, fills, flags = [], [], []
        if self.numeric:
            known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
                     for c in self.numeric]
            r = dataset.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(known) for n, f in (
                ("m", F.avg), ("s", F.stddev_samp),
                ("gone", lambda c: F.count(F.when(c.isNull(), 1))))]).first()
            fills = [r[f"m{i}"] or 0.0 for i in range(len(self.numeric))]
            moments = [(m, r[f"s{i}"] or 0.0) if self.scale else (0.0, 1.0)
                       for i, m in enumerate(fills)]
            flags = [c for i, c in enumerate(self.numeric) if r[f"gone{i}"]]
        if self.missing == "keep":
            fills, flags = [None] * len(self.numeric), []
        levels = {}
        for c in self.categorical:
            found = [r[0] for r in dataset.select(F.col(c).cast("string")).where(
                F.col(c).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} levels; hash or group them")
            levels[c] = sorted(found)
        return FeatureModel(self.numeric, moments, levels, self.output, fills, flags)


class FeatureModel(SavedModel):
    def __init__(self, numeric, moments, levels, output, fills, flags):
        super().__init__()
        self.numeric, self.moments, self.levels, self.output = numeric, moments, levels, output
        self.fills, self.flags = fills, flags

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{c}={v}" for c, found in self.levels.items() for v in found[1:]] \
            + [f"{c} missing" for c in self.flags]

    def state(self, spark):
        rows = [(c, i, v) for c, found in self.levels.items() for i, v in enumerate(found)]
        return ({"numeric": self.numeric, "moments": self.moments, "output": self.output,
                 "categorical": list(self.levels), "fills": self.fills, "flags": self.flags},
                {"levels": spark.createDataFrame(rows, "col string, place int, level string")})

    @classmethod
    def restored(cls, header, tables):
        levels = {c: [] for c in header["categorical"]}
        for r in tables("levels").orderBy("col", "place").collect():    # MAX_LEVELS a column
            levels[r["col"]].append(r["level"])
        return cls(header["numeric"], [tuple(m) for m in header["moments"]], levels,
                   header["output"], header["fills"], header["flags"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        nan = F.lit(float("nan"))
        value = {c: F.coalesce(F.col(c).cast("double"), nan) for c in self.numeric}
        full = {c: value[c] if fill is None else F.nanvl(value[c], F.lit(fill))
                for c, fill in zip(self.numeric, self.fills)}
        parts = [F.array(*[(full[c] - m) / s if s else full[c] * 0.0
                           for c, (m, s) in zip(self.numeric, self.moments)])]
        parts += [_dummies(F.col(c), found) for c, found in self.levels.items() if len(found) > 1]
        if self.flags:
            parts.append(F.array(*[F.isnan(value[c]).cast("double") for c in self.flags]))
        vector = array_to_vector(F.concat(*parts))
        meta = {"ml_attr": {"num_attrs": len(self.names)}}
        return dataset.withColumn(self.output, vector.alias(self.output, metadata=meta))


def _dummies(value, levels):
    if len(levels) <= WRITTEN_OUT:
        return F.array(*[F.coalesce((value.cast("string") == v).cast("double"), F.lit(0.0))
                         for v in levels[1:]])
    return F.transform(F.array(*[F.lit(v) for v in levels[1:]]), lambda v: F.coalesce(
        (v == value.cast("string")).cast("double"), F.lit(0.0)))


def feature_stages(numeric: list[str], categorical: list[str] = (),
                   scale: bool = True, output: str = "features", missing: str = "mean") -> list:
    """Stages turning numeric and categorical columns into one vector."""
    return [FeatureFront(numeric, categorical, scale, output, missing)]
