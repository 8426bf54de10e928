"""The front end writes out the dummies of a column with few levels."""

from pyspark.sql import functions as F

from quayside.operators import features
from quayside.operators.features import FeatureFront


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_few_dummies_are_written_out_and_equal_the_many(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i), None if i == 3 else f"k{i % 5}") for i in range(9)],
                                 "id int, a double, k string")
    front = FeatureFront(["a"], ["k"]).fit(rows)
    few = front.transform(rows)
    assert "lambda" not in _plan(few)
    unseen = rows.withColumn("k", F.lit("other"))
    a = [r["features"] for df in (rows, unseen) for r in front.transform(df).orderBy("id").collect()]
    monkeypatch.setattr(features, "WRITTEN_OUT", 0)
    many = front.transform(rows)
    assert "lambda" in _plan(many)
    assert a == [r["features"] for df in (rows, unseen)
                 for r in front.transform(df).orderBy("id").collect()]
