import os
import tempfile

import pytest

from quayside.session import ensure_checkpoint_dir
from quayside.sources import order_lines, read_table

from conftest import SF_SMALL


def test_read_table_rejects_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="quayside-src-")
    spark.read.parquet(os.path.join(SF_SMALL, "part.parquet")).drop("p_size") \
        .write.parquet(os.path.join(d, "part.parquet"))
    with pytest.raises(ValueError, match="p_size"):
        read_table(spark, d, "part")


def test_order_lines_schema_and_labels(spark):
    ol = order_lines(spark, SF_SMALL)
    types = dict(ol.dtypes)
    assert types["order_key"] == "bigint" and types["order_day"] == "int"
    assert types["late"] == "int" and types["fraud"] == "int" and types["revenue"] == "double"
    r = ol.selectExpr("min(late) AS a", "max(late) AS b", "min(fraud) AS c", "max(fraud) AS d").first()
    assert (r.a, r.b, r.c, r.d) == (0, 1, 0, 1)


def test_checkpoint_dir_is_kept(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert ensure_checkpoint_dir(spark) == before


def test_read_table_rejects_other_types(spark, tmp_path):
    spark.read.parquet(os.path.join(SF_SMALL, "part.parquet")) \
        .selectExpr("* except (p_size)", "cast(p_size as string) AS p_size") \
        .write.parquet(str(tmp_path / "part.parquet"))
    with pytest.raises(ValueError, match="p_size"):
        read_table(spark, str(tmp_path), "part")
