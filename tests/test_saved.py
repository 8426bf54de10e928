"""Fitted pipelines are saved, loaded in another process, and predict alike."""
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from quayside.operators import classifiers as C
from quayside.operators.boosting import boosted_trees
from quayside.operators.discriminant import discriminant
from quayside.operators.extra_trees import extra_trees
from quayside.operators.features import feature_stages
from quayside.operators.knn import knn
from quayside.operators.naive_bayes import SqlNaiveBayes

ZOO = {
    "logistic": C.logistic, "discriminant": discriminant, "gaussian_nb": C.gaussian_nb,
    "svm": lambda: C.linear_svm(maxIter=5), "knn": lambda: knn(k=3),
    "forest": lambda: C.random_forest(numTrees=3, maxDepth=3),
    "extra_trees": lambda: extra_trees(numTrees=3, maxDepth=4),
    "boosted": lambda: boosted_trees(rounds=3, maxDepth=3),
    "tree": lambda: C.decision_tree(maxDepth=3), "sql_nb": SqlNaiveBayes,
}


def rows(planted):
    return planted.limit(900).select(
        "id", "x1", "x2", "x3", "label",
        F.when(F.col("x4") < 0.3, "a").when(F.col("x4") < 0.8, "b o'c").alias("kind"))


def test_loaded_models_predict_alike_in_a_new_process(spark, planted, tmp_path):
    data = rows(planted).persist()
    data.coalesce(1).write.parquet(str(tmp_path / "data"))
    for name, make in ZOO.items():
        stages = feature_stages(["x1", "x2", "x3"], ["kind"]) + [make()]
        fitted = Pipeline(stages=stages).fit(data)
        fitted.write().save(str(tmp_path / name))
        fitted.write().overwrite().save(str(tmp_path / name))     # a second time over it
        fitted.transform(data).select("id", "prediction").write.parquet(
            str(tmp_path / f"{name}-before"))
    data.unpersist()
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark.ml import PipelineModel
        from quayside.session import local_session
        spark = local_session(cores=2, shuffle_partitions=2, memory="2g")
        at = {str(tmp_path)!r}
        data = spark.read.parquet(at + "/data")
        for name in {list(ZOO)!r}:
            model = PipelineModel.load(at + "/" + name)
            model.transform(data).select("id", "prediction").write.parquet(
                at + "/" + name + "-after")
        spark.stop()
    """)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=600)
    for name in ZOO:
        before, after = ({r["id"]: r["prediction"] for r in
                          spark.read.parquet(str(tmp_path / f"{name}-{when}")).collect()}
                         for when in ("before", "after"))
        assert before == after and len(after) == 900, name


def test_trees_are_tables(spark, planted, tmp_path):
    data = rows(planted)
    fitted = Pipeline(stages=feature_stages(["x1", "x2"]) + [extra_trees(numTrees=2, maxDepth=3)]
                      ).fit(data)
    fitted.save(str(tmp_path / "m"))
    stage = next(p for p in (tmp_path / "m" / "stages").iterdir() if p.name.startswith("1_"))
    splits = spark.read.parquet(str(stage / "splits"))
    assert splits.columns == ["tree", "depth", "node", "feature", "cut"] and splits.count() > 0
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.stages[1].core == fitted.stages[1].core
    assert again.stages[0].names == fitted.stages[0].names and again.uid == fitted.uid


def test_saving_over_a_model_is_refused(spark, planted, tmp_path):
    fitted = Pipeline(stages=feature_stages(["x1"]) + [discriminant()]).fit(rows(planted))
    fitted.save(str(tmp_path / "m"))
    with pytest.raises(Exception, match="overwrite|already exists"):
        fitted.save(str(tmp_path / "m"))
