"""SQL-checked rows of the per-class quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.quantiles import class_quantiles
from ..sources.tables import order_lines
from .queries import ORDER_LINES_SQL, register

COLUMNS = ["order_day", "l_quantity", "l_discount", "revenue", "c_acctbal"]
SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _quantiles_sql() -> str:
    parts = [f"SELECT late AS label, '{c}' AS column_name, {s}::DOUBLE AS share, "
             f"CAST(count({c}) AS BIGINT) AS n, round(quantile_cont(CAST({c} AS DOUBLE), {s}), 6) AS value "
             "FROM ol GROUP BY late" for c in COLUMNS for s in SHARES]
    return f"WITH ol AS ({ORDER_LINES_SQL}) " + " UNION ALL ".join(parts)


@register("profile_quantiles", _quantiles_sql())
def q_profile_quantiles(spark, sf_dir):
    """Exact quantiles of the lines' numbers, late or not, by selection."""
    found = class_quantiles(order_lines(spark, sf_dir), "late", COLUMNS, SHARES)
    return found.select("label", F.col("column").alias("column_name"), "share", "n",
                        F.round("value", 6).alias("value"))
