"""Window caches, manifests, content hashes and null-safe results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder in the shared checkpoint area (private only where none is named)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_window_cache(windows: DataFrame, path: str, dataset: str) -> DataFrame:
    """Windows by dataset, and one manifest row per recording read back from the cache."""
    windows.write.partitionBy(dataset).mode("errorifexists").parquet(path)
    cached = windows.sparkSession.read.schema(windows.schema).parquet(path)
    return cached.groupBy(dataset, "recording_id").agg(
        F.count("*").alias("windows"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


def cache_faults(manifest: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Recordings whose cached counts differ from what was sent."""
    e = expected.select(*keys, F.col("windows").alias("_want"))
    return manifest.join(e, keys, "full_outer").where(~F.col("windows").eqNullSafe(F.col("_want")))


def feature_manifest(windows: DataFrame, keys: list[str], channels: dict[str, str], rate_hz: float) -> DataFrame:
    """One row per exported window: ids, channel ranges and duration."""
    ranges = [f(F.col(c)).cast("double").alias(f"{name}_{tag}") for name, c in channels.items() for tag, f in (("min", F.array_min), ("max", F.array_max))]
    length = F.size(next(iter(channels.values())))
    return windows.select(*keys, *ranges, (length / F.lit(rate_hz)).alias("duration_s"))


def export_summary(available: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    done = exported.groupBy(key).agg(F.count("*").alias("exported"))
    return available.join(done, key, "left").na.fill(0, ["exported"])


def row_hash(columns: list[str]) -> Column:
    """Hash of a row's fields in the given order, each with its length; null and empty differ."""
    text = lambda c: F.col(c).cast("string")
    parts = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free hash of a table: a hash tree over sorted row hashes, with the row count.

    Levels group by 6, then 3, then 0 leading digits, so no group gathers the table and the
    root depends on content alone. Fields such as timestamps are left out by not naming them.
    """
    level = rows.select(row_hash(columns).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    level = level.select(F.sha2(F.concat_ws("|", "h", F.col("n").cast("string")), 256).alias("t"), F.substring("h", 1, 6).alias("k"), "n")
    for digits in (6, 3, 0):
        level = level.groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("_t"), F.sum("n").alias("n"))
        shorter = {6: 3, 3: 0, 0: 0}[digits]
        level = level.select(F.sha2(F.concat_ws("", "_t"), 256).alias("t"), F.substring("k", 1, shorter).alias("k"), "n")
    return level.select(F.col("n").alias("rows"), F.col("t").alias("sha256"))


def write_relations(relations: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Store relations sorted inside their files; count and hash come from what was written."""
    relations.select(*columns).sortWithinPartitions(*columns).write.mode("errorifexists").parquet(path)
    return content_hash(relations.sparkSession.read.parquet(path), columns)


def null_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column; columns in name order."""
    def fix(field):
        c = F.col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c).alias(field.name)
        return c
    return df.select(*[fix(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])
