"""Saving and loading of the models written here.

A saved model is a folder in Spark ML's layout: ``metadata`` (class, uid and
the small header of the model as JSON) and one Parquet table for each part
that grows with the training: trees, leaves, levels, training items.  They mix
with Spark ML's own stages, so a whole fitted pipeline is saved by
``PipelineModel.write()`` and loaded by ``PipelineModel.load`` in another
session, which reads nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.ml import Model
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession

Tables = Callable[[str], DataFrame]


class SavedModel(Model, MLWritable, MLReadable):
    """A model that gives its state as a JSON header and tables."""

    def state(self, spark: SparkSession) -> tuple[dict, dict[str, DataFrame]]:
        raise NotImplementedError

    @classmethod
    def restored(cls, header: dict, tables: Tables) -> "SavedModel":
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SavedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        header, tables = self.model.state(self.sparkSession)
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"state": header})
        for name, table in tables.items():
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type[SavedModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SavedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls.restored(metadata["state"],
                                  lambda name: self.sparkSession.read.parquet(f"{path}/{name}"))
        model._resetUid(metadata["uid"])
        return model


#: The modules of the cores that a ``ColumnModel`` can hold, by the name they
#: are saved under; a session that only loads has not imported them.
CORES = {"discriminant": "discriminant", "gaussian_nb": "naive_bayes",
         "extra_trees": "extra_trees", "boosted_trees": "boosting",
         "bagged_forest": "bagged_forest"}
_FOUND: dict[str, type] = {}


def core(name: str):
    """Register a column-level model with ``state(spark)`` and ``restored``."""
    def keep(cls: type) -> type:
        cls.saved_as = name
        _FOUND[name] = cls
        return cls
    return keep


def core_class(name: str) -> type:
    import_module(f"{__package__}.{CORES[name]}")
    return _FOUND[name]
