"""Structured Streaming forms of the window operators.

Results go to a versioned sink: each micro-batch writes its updates under its own batch id
(overwriting that folder on a retry, so a replayed batch changes nothing) and a reader takes
the newest row per key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources.sinks import scratch

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Events as a file stream.

    A backlog is one micro-batch: files come in order of modification, not of event time, so
    that a backlog in many batches would move the watermark past rows of later files.
    """
    reader = spark.readStream.schema(EVENTS)
    raw = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
    return raw.select(
        F.col("user_id").cast("string").alias("recording_id"), (F.col("user_id") % 2).alias("label"),
        F.concat(F.lit("d"), (F.floor(F.col("user_id") / 2) % 3).cast("string")).alias("domain"),
        "ts", "event_id", F.col("value").alias("v"))


class Drained(NamedTuple):
    rows: DataFrame
    dropped: int
    state_rows: list[int]  # groups held after each micro-batch


def drain(query: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """Newest rows of a query over everything available; rows behind the watermark are lost, see drain_counted."""
    return drain_counted(query, keys, name, mode).rows


def drain_whole(query: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """As drain, but an error when the watermark dropped a row."""
    out = drain_counted(query, keys, name, mode)
    if out.dropped:
        raise RuntimeError(f"{name}: {out.dropped} rows came behind the watermark")
    return out.rows


def drain_counted(query: DataFrame, keys: list[str], name: str, mode: str = "update") -> Drained:
    """Run a stateful query over everything available; its newest rows, and how many aggregated
    rows its operators dropped as late.

    ``append`` returns only groups the watermark has closed; the rest stays in state.
    """
    spark = query.sparkSession
    # every batch's progress is needed for the count
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1000000")
    base = scratch(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    q = query.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    held = [sum(op.numRowsTotal for op in p.stateOperators) for p in q.recentProgress if p.stateOperators]
    return Drained(newest(spark.read.parquet(f"{base}/out"), keys), dropped, held)


def newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in versions.columns if c not in (*keys, "batch_id")]
    g = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return g.select(*keys, "_v.*")


def frame_windows(stream: DataFrame, length: str, hop: str, late: str, *aggregates: Column) -> DataFrame:
    """Fixed-length windows every hop; rows later than the watermark are dropped by Spark."""
    d = stream.withWatermark("ts", late).groupBy(F.window("ts", length, hop).alias("_w"), "recording_id", "domain").agg(*aggregates)
    return d.select("recording_id", "domain", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in d.columns if c not in ("_w", "recording_id", "domain")])


PART = ["recording_id", "part"]


def _parts(stream: DataFrame, length: str, late: str, *aggregates: Column) -> DataFrame:
    """One row per (recording, stretch of event time): state that Spark drops once the watermark has passed.

    A key without time would be held forever, one group for each recording ever seen.
    """
    d = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("_w"), "recording_id").agg(*aggregates)
    return d.withColumn("part", F.col("_w.start")).drop("_w")


def first_sample_parts(stream: DataFrame, length: str, late: str) -> DataFrame:
    """Earliest sample per recording and stretch, whatever the arrival order; merged by first_sample."""
    return _parts(stream, length, late, F.min(F.struct("ts", "event_id", "v")).alias("first"))


def first_sample(parts: DataFrame) -> DataFrame:
    """Earliest sample per recording from the sink's newest parts."""
    return parts.groupBy("recording_id").agg(F.min("first").alias("_f")).select("recording_id", "_f.*")


def detection_parts(stream: DataFrame, score: Column, length: str, late: str) -> DataFrame:
    """Sum and count of scores per recording and stretch; merged by running_detection. Null scores count as samples only."""
    return _parts(stream, length, late, F.sum(score).alias("total"), F.count(score).alias("scored"), F.count("*").alias("samples"))


def running_detection(parts: DataFrame, threshold: float) -> DataFrame:
    """Mean score and decision per recording from the sink's newest parts."""
    d = parts.groupBy("recording_id").agg((F.sum("total") / F.nullif(F.sum("scored"), F.lit(0))).alias("score"), F.sum("samples").alias("samples"))
    return d.select("recording_id", "score", "samples", (F.col("score") >= threshold).alias("detected"))


def energy_windows(stream: DataFrame, references: DataFrame, length: str, late: str) -> DataFrame:
    """Window power against a frozen per-domain reference (stream-static join)."""
    d = frame_windows(stream, length, length, late, F.avg(F.col("v") * F.col("v")).alias("power"))
    return d.join(references, "domain").withColumn("energy", F.log1p(F.greatest(F.col("power"), F.lit(0.0)) / F.col("reference"))).drop("reference")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Continuity blocks: samples with no gap longer than ``gap``."""
    d = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("_w"), "recording_id").agg(F.count("*").alias("samples"))
    return d.select("recording_id", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "samples")


class Ledger:
    """Append-only record of how much of a fixed set of recordings has been read.

    Each micro-batch writes its samples per recording under its own batch id (a retry overwrites
    only that folder), and a recording's samples are the sum over batches. A recording is complete
    when the sum reaches the ``sample_count`` frozen with the set, or, in a set without counts, once
    the set has been committed. Complete recordings are skipped on resume; the set may not change;
    a commit needs all of it.
    """

    COUNTS = "recording_id string, samples bigint, batch_id int"

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def frozen(self) -> DataFrame:
        return self.spark.read.schema("recording_id string, sample_count bigint").parquet(f"{self.base}/set")

    def begin(self, recordings: DataFrame) -> None:
        count = F.max("sample_count").cast("long") if "sample_count" in recordings.columns else F.max(F.lit(None).cast("long"))
        ids = recordings.groupBy(F.col("recording_id").cast("string").alias("recording_id")).agg(count.alias("sample_count"))
        if not self._exists("set"):
            ids.write.parquet(f"{self.base}/set")
            return
        frozen = self.frozen()
        if not (ids.exceptAll(frozen).isEmpty() and frozen.exceptAll(ids).isEmpty()):
            raise PermissionError("the recording set may not change while resuming")

    def counts(self) -> DataFrame:
        if not self._exists("done"):
            return self.spark.createDataFrame([], self.COUNTS)
        return self.spark.read.schema(self.COUNTS).parquet(f"{self.base}/done")

    def done(self) -> DataFrame:
        """Samples read so far of each recording."""
        return self.counts().groupBy("recording_id").agg(F.sum("samples").alias("samples"))

    def _complete(self, before: DataFrame) -> DataFrame:
        if self._exists("complete"):
            return self.spark.read.schema("recording_id string").parquet(f"{self.base}/complete")
        sums = before.groupBy("recording_id").agg(F.sum("samples").alias("samples"))
        return sums.join(self.frozen(), "recording_id").where("samples >= sample_count").select("recording_id")

    def record(self, batch: DataFrame, batch_id: int) -> None:
        """Idempotent: a retried batch overwrites only itself."""
        earlier = self.counts().where(F.col("batch_id") != batch_id)
        fresh = batch.groupBy("recording_id").agg(F.count("*").alias("samples")).join(self.frozen(), "recording_id", "left_semi")
        fresh = fresh.join(self._complete(earlier), "recording_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.base}/done/batch_id={batch_id}")

    def commit(self) -> DataFrame:
        read = self.frozen().join(self.done(), "recording_id", "left")
        short = F.col("samples").isNull() | (F.col("samples") != F.coalesce("sample_count", "samples"))
        if not read.where(short).isEmpty():
            raise RuntimeError("an incomplete recording set cannot be committed")
        if not self._exists("complete"):
            read.select("recording_id").write.parquet(f"{self.base}/complete")
        return read.select("recording_id", "samples", F.lit("complete").alias("status"))


def ledgered_stream(stream: DataFrame, recordings: DataFrame, base: str) -> DataFrame:
    """Read a frozen recording set once, resumable at recording granularity."""
    ledger = Ledger(stream.sparkSession, f"{base}/ledger")
    ledger.begin(recordings)
    q = stream.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(ledger.record).trigger(availableNow=True).start()
    q.awaitTermination()
    return ledger.commit()
