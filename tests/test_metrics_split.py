from pyspark.sql import functions as F

from quayside.operators.metrics import compare, confusion
from quayside.operators.profile import profile
from quayside.operators.split import split, split_sides
from quayside.sources import order_lines

from conftest import SF_SMALL


def test_confusion_counts(spark):
    rows = [(1.0, 1.0)] * 3 + [(0.0, 1.0)] * 1 + [(1.0, 0.0)] * 2 + [(0.0, 0.0)] * 4
    df = spark.createDataFrame(rows, "label double, prediction double")
    r = confusion(df).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n) == (3, 1, 2, 4, 10)
    assert r.accuracy == 0.7
    assert r.recall == 0.6
    assert abs(r.f1 - 2 * 3 / (2 * 3 + 1 + 2)) < 1e-6


def test_empty_denominator_is_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 5, "label double, prediction double")
    r = confusion(df).first()
    assert r.recall == 0.0 and r.precision == 0.0 and r.f1 == 0.0 and r.accuracy == 1.0


def test_compare_one_row_per_model(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    out = compare({("t", "a"): df, ("t", "b"): df.withColumn("prediction", F.lit(0.0))})
    got = {r.model: (r.tp, r.fp) for r in out.collect()}
    assert got == {"a": (1, 1), "b": (0, 0)}


def test_split_keeps_orders_whole(spark):
    lines = order_lines(spark, SF_SMALL)
    s = split_sides(lines)
    per_order = s.groupBy("order_key").agg(F.countDistinct("side").alias("k"))
    assert per_order.where("k > 1").count() == 0
    train, test = split(lines)
    assert train.count() + test.count() == lines.count() == 6000


def test_split_is_partition_independent(spark):
    lines = order_lines(spark, SF_SMALL)
    a = split(lines.repartition(3))[1].select("order_key").distinct()
    b = split(lines.repartition(7))[1].select("order_key").distinct()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_profile_shares_sum_to_one(spark):
    p = profile(order_lines(spark, SF_SMALL), "late", ["order_day"]).collect()
    assert abs(sum(r.share for r in p) - 1.0) < 1e-9
    assert sum(r.n for r in p) == 6000


def test_null_predictions_fail(spark):
    import pytest
    df = spark.createDataFrame([(1.0, None), (0.0, 1.0)], "label double, prediction double")
    with pytest.raises(Exception, match="null in prediction"):
        confusion(df).collect()


def _lines(spark, days):
    return spark.createDataFrame([(i, 1, d, i % 2) for i, d in enumerate(days)],
                                 "order_key long, line_number int, order_day int, late int")


def test_split_gain_has_every_cut(spark, monkeypatch):
    from quayside.plans import queries as Q
    for days in ([10 + i % 400 for i in range(300)],              # early orders only
                 [i % 400 for i in range(200)] + [1000 + i for i in range(200)]):   # a gap
        monkeypatch.setattr(Q, "order_lines", lambda s, d, days=days: _lines(s, days))
        rows = Q.q_tree_split_gain(spark, "").collect()
        assert sorted(r.cut for r in rows) == Q.TREE_EDGES
        assert all(0 <= r.impurity <= 0.5 for r in rows)
