"""Table sources (D1): Parquet scans with a fixed, checked schema.

``order_lines`` is the supply-chain input every model trains on: one row per
order line joined with its order, customer and part.  The joins are plain
inner equi-joins written so that Catalyst can prune columns into the scans
and pick the strategy: small dimension sides go out as broadcasts only when
their (estimated, and under AQE measured) size is under
``spark.sql.autoBroadcastJoinThreshold``; large ones are sort-merge joins on
the key, and AQE splits a hot key's partitions.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns each input table must provide (name -> Spark simple type string).
TABLE_COLUMNS: dict[str, dict[str, str]] = {
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint",
                 "l_linenumber": "int", "l_quantity": "double",
                 "l_extendedprice": "double", "l_discount": "double",
                 "l_tax": "double", "l_returnflag": "string",
                 "l_shipdate": "timestamp_ntz"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "customer": {"c_custkey": "bigint", "c_acctbal": "double",
                 "c_mktsegment": "string"},
    "part": {"p_partkey": "bigint", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>",
                   "label": "int"},
}

# Features known when the order is placed (no ship date, no price for T3).
ORDER_LINE_NUMERIC = ["order_day", "l_quantity", "l_discount", "l_tax",
                      "p_size", "p_retailprice", "c_acctbal"]
ORDER_LINE_CATEGORICAL = ["o_orderpriority", "c_mktsegment", "p_type"]

EPOCH = "1995-01-01"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` and fail fast on a missing column or
    one of another type."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    want = TABLE_COLUMNS.get(name, {})
    have = dict(df.dtypes)
    missing = [c for c in want if c not in have]
    if missing:
        raise ValueError(f"table {name} lacks columns {missing}")
    other = {c: have[c] for c, t in want.items() if have[c] != t}
    if other:
        raise ValueError(f"table {name} has columns of other types: {other}")
    return df


def order_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ part, one row per line.

    Derived columns: ``order_key`` (the split key), ``order_day`` (days since
    1995-01-01), ``late`` (ship date more than 30 days after the order),
    ``fraud`` (returned line; a stand-in label with no real signal),
    ``revenue`` and ``quantity`` (regression targets).  The labels are
    proxies built from the test tables; they say nothing about real fraud
    or real deliveries.

    The orders side is joined to customer first: it is a quarter of the
    line count, so the customer-key shuffle (if one is needed) moves the
    smaller table, and lines then meet orders on the order key.
    ``lineitem`` replaces the stored lines, for example by a stream of them.
    """
    li = (read_table(spark, sf_dir, "lineitem") if lineitem is None else lineitem).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment")
    p = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_size", "p_retailprice")

    oc = o.join(c, o.o_custkey == c.c_custkey, "inner")
    lines = (li.join(oc, li.l_orderkey == oc.o_orderkey, "inner")
               .join(p, li.l_partkey == p.p_partkey, "inner"))
    odate = F.col("o_orderdate").cast("date")
    sdate = F.col("l_shipdate").cast("date")
    return lines.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.datediff(odate, F.lit(EPOCH).cast("date")).alias("order_day"),
        F.when(F.datediff(sdate, odate) > 30, 1).otherwise(0).alias("late"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("fraud"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.col("l_quantity").alias("quantity"),
        "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice",
        "c_acctbal", "o_orderpriority", "c_mktsegment", "p_type",
    )
