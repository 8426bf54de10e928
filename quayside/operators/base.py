"""Base classes so the DataFrame-built classifiers plug into ``Pipeline``.

The classifiers Spark ML lacks work on numeric *columns* or on one
``array<double>`` column; these wrappers go from the assembled ``features``
vector to either form with a narrow projection.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol,
                                     HasWeightCol)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .saved import SavedModel, core_class


def vector_size(df: DataFrame, col: str) -> int:
    """Length of a vector column, from its metadata or else from all rows.
    Rows of different lengths are an error."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    n = F.size(vector_to_array(F.col(col)))
    row = df.agg(F.min(n).alias("lo"), F.max(n).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError(f"no rows to take the length of {col} from")
    if row["lo"] != row["hi"]:
        raise ValueError(f"{col} has vectors of {row['lo']} to {row['hi']} values")
    return int(row["hi"])


def spread(df: DataFrame, col: str, d: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    arr = vector_to_array(F.col(col))
    names = [f"__{prefix}{i}" for i in range(d)]
    return df.select("*", *[arr[i].alias(n) for i, n in enumerate(names)]), names


def as_array(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def class_weights(df: DataFrame, label: str, weight: str) -> dict[float, float]:
    """The weight of each class, for models that count rows by class.  Weights
    that differ within a class are refused: such counts cannot carry them."""
    from .moments import MAX_CLASSES
    rows = (df.groupBy(F.col(label).cast("double").alias("y"))
            .agg(F.min(weight).alias("lo"), F.max(weight).alias("hi"),
                 F.count(F.when(F.col(weight).isNull(), 1)).alias("nulls"))
            .limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    if any(r["nulls"] or r["lo"] != r["hi"] or not r["lo"] > 0 for r in rows):
        raise ValueError(f"{weight} must be one positive number for each class of {label}")
    return {r["y"]: float(r["lo"]) for r in rows}


class ColumnEstimator(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol):
    """An estimator whose core fit works on numeric columns.

    ``setWeightCol`` names a column of row weights; unset, all rows count alike."""

    def __init__(self, featuresCol="features", labelCol="label",
                 predictionCol="prediction"):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol,
                  predictionCol=predictionCol)

    def setWeightCol(self, name: str):
        return self._set(weightCol=name)

    @property
    def weight(self) -> str | None:
        return self.getWeightCol() if self.isSet("weightCol") else None

    def fit_columns(self, df: DataFrame, cols: list[str], label: str):
        raise NotImplementedError

    def _fit(self, dataset: DataFrame):
        fcol = self.getFeaturesCol()
        d = vector_size(dataset, fcol)
        extra = [self.weight] if self.weight else []
        wide, cols = spread(dataset.select(fcol, self.getLabelCol(), *extra), fcol, d)
        core = self.fit_columns(wide, cols, self.getLabelCol())
        return ColumnModel(core, fcol, d, self.getPredictionCol())


class ColumnModel(SavedModel):
    """Applies a column-level model's prediction expression to a vector."""

    def __init__(self, core, featuresCol: str, d: int, predictionCol: str):
        super().__init__()
        self.core, self.fcol, self.d, self.pcol = core, featuresCol, d, predictionCol

    def state(self, spark):
        header, tables = self.core.state(spark)
        return {"features": self.fcol, "size": self.d, "prediction": self.pcol,
                "core": self.core.saved_as, "state": header}, tables

    @classmethod
    def restored(cls, header, tables):
        core = core_class(header["core"]).restored(header["state"], tables)
        return cls(core, header["features"], header["size"], header["prediction"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = dataset.columns
        wide, cols = spread(dataset, self.fcol, self.d)
        out = self.core.transform_columns(wide, cols, self.pcol)
        return out.select(*keep, self.pcol)
