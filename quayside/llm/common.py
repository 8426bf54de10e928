"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import ensure_checkpoint_dir

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the
    application ends (through Hadoop's file system, so any store works)."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back.

    This cuts the lineage in a way that outlives executors, and later readers
    scan only the columns they use."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name not used by ``df`` (Spark names ignore case)."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` under names that any function over whole rows can resolve;
    ``toDF(*df.columns)`` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
