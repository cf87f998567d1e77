"""Recording manifests, raw signal files, label files, hashes and listings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RECORDING = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("is_background", T.BooleanType()),
    T.StructField("sample_rate_hz", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
MANIFEST = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("recordings", T.ArrayType(RECORDING)),
])


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Recordings of one or many manifest files; the schema is declared, never inferred."""
    docs = spark.read.schema(MANIFEST).option("multiLine", multi_line).json(path)
    return docs.select("schema_version", F.explode("recordings").alias("r")).select("schema_version", "r.*")


def repeated_recordings(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("recording_id").agg(F.count("*").alias("n")).where("n > 1")


def require_unique(recordings: DataFrame) -> DataFrame:
    """Stop on a repeated recording id."""
    bad = repeated_recordings(recordings).limit(5).collect()
    if bad:
        raise ValueError(f"repeated recording ids: {[r['recording_id'] for r in bad]}")
    return recordings


def read_signal_slice(chunks: DataFrame, first: int, last: int, chunk: int) -> DataFrame:
    """Samples [first, last) of every recording; only the chunks holding them are read."""
    near = chunks.where(F.col("chunk_no").between(first // chunk, (last - 1) // chunk))
    d = near.select("recording_id", "chunk_no", F.posexplode("x").alias("_k", "v"))
    return d.withColumn("n", F.col("chunk_no") * chunk + F.col("_k")).where(
        (F.col("n") >= first) & (F.col("n") < last)).select("recording_id", "n", "v")


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def ingest_interleaved(files: DataFrame, chunk: int = 4096) -> DataFrame:
    """Raw interleaved little-endian float32 I/Q content -> chunk rows (path, chunk_no, i, q)."""
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("chunk_no", T.LongType()),
        T.StructField("i", T.ArrayType(T.FloatType())), T.StructField("q", T.ArrayType(T.FloatType())),
    ])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column(1)[k].as_buffer()
                if len(content) % 8:
                    raise ValueError(f"{batch.column(0)[k]} does not hold whole I/Q pairs")
                pairs = np.frombuffer(content, dtype="<f4").reshape(-1, 2)
                for first in range(0, len(pairs), 256 * chunk):
                    part = pairs[first : first + 256 * chunk]
                    edges = pa.array(np.append(np.arange(0, len(part), chunk), len(part)).astype(np.int32))
                    rows = len(edges) - 1
                    lists = [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(part[:, side]))) for side in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(rows, k))), pa.array(first // chunk + np.arange(rows)), *lists], names=["path", "chunk_no", "i", "q"])

    return files.select("path", "content").mapInArrow(run, schema)


def inventory(files: DataFrame) -> DataFrame:
    """One row per path and content: a path with two contents has two rows. Content over the
    reader's size limit arrives as parts (``part_no``); it is hashed per part, then over the ordered
    part hashes, and a part seen with two contents counts with the smaller hash."""
    if "part_no" not in files.columns:
        return files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).distinct()
    parts = files.select("path", "part_no", F.struct(F.sha2("content", 256).alias("h"), F.length("content").alias("b")).alias("_c"))
    parts = parts.groupBy("path", "part_no").agg(F.min("_c").alias("_c")).select("path", "part_no", "_c.b", "_c.h")
    g = parts.groupBy("path").agg(F.sum("b").alias("bytes"), F.array_sort(F.collect_list(F.struct("part_no", "h"))).alias("_p"))
    return g.select("path", "bytes", F.sha2(F.concat_ws("", F.col("_p.h")), 256).alias("sha256"))


def checksum_faults(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded files that changed or are gone."""
    drift = recorded.join(found.select("path", F.col("sha256").alias("_now")), "path").where("sha256 <> _now").select("path", F.lit("changed").alias("fault"))
    gone = recorded.join(found.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("fault"))
    return drift.unionByName(gone)


# The three file-name layouts.
CLASS_SEGMENT = r"^(T[0-9]+)(?:_D([0-9]+))?_S([0-9]+)[.]mat$"
SLICE = r"^([A-Za-z][A-Za-z0-9]*?)(?:_(IN|OUT))?(?:_S([0-9]+))?_slice_([0-9]+)[.]mat$"
UNIT_DAY = r"^(.+)_([A-Za-z]+)_c([0-9]+)_u([0-9]+)_d([0-9]+)[.]mat$"


def parse_capture_path(name: Column) -> Column:
    """Struct of the fields a capture's file name carries; what is absent stays null."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    layout = F.when(name.rlike(CLASS_SEGMENT), "class_segment").when(name.rlike(SLICE), "slice").when(name.rlike(UNIT_DAY), "unit_day")
    return F.struct(
        layout.alias("layout"),
        F.coalesce(part(CLASS_SEGMENT, 1), part(SLICE, 1), part(UNIT_DAY, 1)).alias("class_code"),
        part(CLASS_SEGMENT, 2).alias("distance"),
        F.coalesce(part(CLASS_SEGMENT, 3), part(SLICE, 3)).alias("segment"),
        F.coalesce(part(SLICE, 2), part(UNIT_DAY, 2)).alias("state"),
        part(SLICE, 4).alias("slice_no"),
        part(UNIT_DAY, 3).alias("channel"),
        part(UNIT_DAY, 4).alias("unit"),
        part(UNIT_DAY, 5).alias("day"),
    )


def join_anonymous_labels(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``original_name anonymous_id`` lines give anonymous files their identity back."""
    cut = F.split(F.trim(F.col("value")), "\\s+")
    names = lines.select(F.get(cut, F.lit(1)).alias("anonymous_id"), F.get(cut, F.lit(0)).alias("original_name"))
    return files.join(names, "anonymous_id", "left")


PARTIAL = ".aria2"


def partial_files(listing: DataFrame, excluded: DataFrame) -> DataFrame:
    """Listed files with a download sidecar beside them, exclusions removed first."""
    kept = listing.where(~F.col("path").endswith(PARTIAL)).join(excluded, "path", "left_anti")
    sidecars = listing.where(F.col("path").endswith(PARTIAL)).select(
        F.expr(f"substr(path, 1, length(path) - {len(PARTIAL)})").alias("path")).distinct()
    return kept.join(sidecars, "path", "left_semi")


def require_complete(listing: DataFrame, excluded: DataFrame) -> DataFrame:
    bad = partial_files(listing, excluded).limit(5).collect()
    if bad:
        raise RuntimeError(f"unfinished downloads: {[r['path'] for r in bad]}")
    return listing


CONTRACT = T.StructType([T.StructField("datasets", T.MapType(T.StringType(), T.StructType([
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("binary_subsets", T.ArrayType(T.StringType())),
    T.StructField("license_verified", T.BooleanType()),
    T.StructField("adjacency_verified", T.BooleanType()),
])))])


def label_contract(documents: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Label map (dataset, name, canonical) and flags (dataset, ...) of JSON contracts."""
    d = documents.select(F.from_json(column, CONTRACT).alias("c")).select(F.explode("c.datasets").alias("dataset", "d"))
    labels = d.select("dataset", F.explode("d.labels").alias("name", "canonical"))
    return labels, d.select("dataset", "d.license_verified", "d.adjacency_verified", "d.binary_subsets")
