"""Helpers that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a local master without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow table in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a wide table to the shared folder and read it back: columnar and compressed, unlike a checkpoint."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query planned and run in here go when it has ended; what it returns must lie elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def word_count(col: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.regexp_count(text_or_empty(col), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
