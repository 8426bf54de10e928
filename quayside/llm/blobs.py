"""Whole binary files through Spark's own writer and reader.

A row is one file.  The text writer stores the bytes of a string column as
they are and ends each row with ``lineSep``; with one record per file, a
format whose files end in a constant lets that constant be the separator.
Spark's commit protocol then covers task retries and lost executors, and any
file system Spark knows can hold the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(df: DataFrame, column: str, path: str, ending: str) -> None:
    """Write each row's binary ``column`` followed by ``ending`` as one file.
    The folder must be new."""
    (df.select(F.col(column).cast("string").alias("value")).write
     .option("lineSep", ending).option("maxRecordsPerFile", 1).text(path))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder: path, content (without any that are hidden)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
