import os
import tempfile

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from quayside.operators import classifiers as C
from quayside.operators.features import feature_stages
from quayside.operators.metrics import confusion
from quayside.operators.split import split
from quayside.sources import order_lines
from quayside.streaming import order_line_stream, running_confusion, score_stream

from conftest import SF_SMALL

FEATS = ["order_day", "l_quantity", "l_discount", "l_tax"]


def test_stream_scores_equal_batch_scores(spark):
    lines = order_lines(spark, SF_SMALL).withColumn("label", F.col("late").cast("double"))
    train, _ = split(lines)
    model = Pipeline(stages=feature_stages(FEATS) + [C.logistic(maxIter=20)]).fit(train)
    stream = order_line_stream(spark, SF_SMALL)
    counts = running_confusion(score_stream(model, stream, "late"), "late", "logistic")
    ckpt = tempfile.mkdtemp(prefix="quayside-stream-")
    q = (counts.writeStream.outputMode("complete").format("memory").queryName("stream_conf")
         .option("checkpointLocation", os.path.join(ckpt, "state")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT n, tp, fp, fn, tn FROM stream_conf").first()
    want = confusion(model.transform(lines)).first()
    assert (got.n, got.tp, got.fp, got.fn, got.tn) == (want.n, want.tp, want.fp, want.fn, want.tn)
