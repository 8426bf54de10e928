import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from quayside.session import DEFAULT_CONF
    b = (SparkSession.builder.master("local[4]").appName("quayside-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "8g")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.driver.bindAddress", "127.0.0.1"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # tests set their own checkpoint folder only where none is configured
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quayside-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def planted(spark):
    """Planted-signal fixture: md5 uniforms, a rare rule label, a linear target."""
    from pyspark.sql import functions as F
    from quayside.functions.hashing import md5_uniform
    n = 6000
    df = spark.range(n).select(
        "id", *[md5_uniform(F.lit("planted"), "id", F.lit(i)).alias(f"x{i}") for i in range(1, 5)])
    df = df.withColumn("label", F.when(F.col("x1") + F.col("x2") > 1.72, 1.0).otherwise(0.0))
    noise = md5_uniform(F.lit("noise"), "id") - 0.5
    df = df.withColumn("target", 3.0 * F.col("x1") - 2.0 * F.col("x2") + 0.5 * F.col("x3")
                       + 1.0 + 0.01 * noise)
    return df.withColumn("order_key", F.col("id"))
