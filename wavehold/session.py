"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "wavehold", cores: str | None = None) -> SparkSession:
    """Session for tests and local measurement; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # wide rows: keep Arrow batches small enough for executor memory
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        .config("spark.driver.extraJavaOptions", "-Dlog4j.logLevel=ERROR")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local master may go without one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of the executors that made it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A checked small table as a local one: Spark then knows its size when it plans a join, and leaves the large side where it is."""
    df = cut(df)
    if df.count() > most:
        return df
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
