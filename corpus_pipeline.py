"""The corpus pipeline: each stage reads what the one before it wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All stages but the last return the columns of
``documents``; the last returns the packed pieces.

1. quality: the weak-label classifier's rejects go.
2. near_copies: one document of each SimHash component stays.
3. pii: personal data is replaced in the text.
4. mix: sources are brought to their target weights.
5. pack: the documents' tokens are packed into windows.

Defined cases, for every stage: null and empty texts have no words (quality
judges them by their features, they share fingerprint zero, hold no personal
data, and are not taken by the mix); null ids, languages and sources are values
of their own; repeated rows are near copies of each other, so one stays; very
long texts are read whole; an empty table gives an empty one; further columns
of any name and type pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import mixing, packing, pii, simhash, weakquality
from quayside.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weakquality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, shingle=3, radius=3)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, n_chars_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, n_chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [("quality", quality), ("near_copies", near_copies), ("pii", redact), ("mix", mix),
          ("pack", pack)]

#: Classifiers, fingerprints, the field and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
