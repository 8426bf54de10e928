"""Session helpers: local sessions for tests/bench and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session should carry.  AQE re-plans joins from runtime
# sizes (sort-merge -> broadcast when a side turns out small) and splits
# skewed shuffle partitions, which is what keeps hot keys off one task.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8,
                  app: str = "quayside", memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", memory)
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.driver.bindAddress", "127.0.0.1"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only a local-mode session without one (tests, the bench, the
    smoke check) gets a fresh scratch folder; a cluster session without the
    setting is an error rather than a silent machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is unset; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="quayside-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder, removed when the
    application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df, label: str):
    """``df`` written to compressed Parquet below the shared checkpoint folder and
    read from there, and a function that deletes it.

    For rows that are read many times: repeated values take a few bits, where
    persisted rows hold every number in full, and nothing refers to the shuffles
    that made them, which go with the driver's garbage."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    # small row groups: a task reads whole ones
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    spark.sparkContext._jvm.System.gc()

    def drop() -> None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    return spark.read.schema(df.schema).parquet(path), drop


def checkpoint(df, eager: bool = True):
    """Reliable checkpoint that cuts lineage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
