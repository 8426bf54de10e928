"""Scoring arriving order lines with a fitted model (Structured Streaming).

Detection is most useful as lines arrive.  A fitted ``PipelineModel`` whose
stages are column expressions (the feature front end and the logistic,
SVM, naive Bayes, tree, forest, discriminant, extra-trees and boosted
models) applies to a streaming DataFrame unchanged.  The k-NN model runs a
multi-level search with actions and is batch-only: score its micro-batches
through ``foreachBatch``.

The stream of lines is the lineitem folder read with ``readStream`` and
joined to the static orders, customer and part tables (stream-static inner
joins need no state).  Running metrics are a streaming aggregate with four
conditional sums per (task, model), so the state is a handful of numbers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import confusion
from ..sources.tables import order_lines, read_table


def order_line_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """``order_lines`` with lineitem read as a stream of Parquet files."""
    schema = read_table(spark, sf_dir, "lineitem").schema
    path = os.path.join(sf_dir, "lineitem.parquet")
    # a stream source watches a folder; a single-file table is watched
    # through its folder with a name filter
    if os.path.isdir(path):
        reader = spark.readStream.schema(schema)
    else:
        reader = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
        path = sf_dir
    li = reader.option("maxFilesPerTrigger", max_files).parquet(path)
    return order_lines(spark, sf_dir, lineitem=li)


def score_stream(model, stream: DataFrame, label: str | None = None) -> DataFrame:
    """Apply a fitted model to a streaming DataFrame (stateless)."""
    out = model.transform(stream if label is None else
                          stream.withColumn("label", F.col(label).cast("double")))
    return out


def running_confusion(scored: DataFrame, task: str, model: str) -> DataFrame:
    """Streaming confusion counts (complete mode) for one model."""
    named = scored.select(F.lit(task).alias("task"), F.lit(model).alias("model"), "label",
                          "prediction")
    return confusion(named, by=["task", "model"]).select("task", "model", "n", "tp", "fp", "fn",
                                                         "tn")
