"""Result tables and their validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import metrics as m


def prediction_faults(recordings: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Rows that break the result contract, one row per fault."""
    total = F.expr("aggregate(probs, 0.0D, (t, p) -> t + p)")
    row = recordings.select(*keys, F.explode(F.array_compact(F.array(
        F.when(F.abs(total - 1.0) > 1e-9, F.lit("probabilities_do_not_sum_to_one")),
        F.when(F.exists("probs", lambda p: p < 0), F.lit("negative_probability")),
        F.when(F.exists("probs", lambda p: F.isnan(p) | p.isNull()), F.lit("nonfinite_probability")),
        F.when(F.size("probs") != classes, F.lit("class_count")),
        F.when(m.argmax("probs") != F.col("pred"), F.lit("prediction_is_not_argmax")),
    ))).alias("fault"))
    twice = recordings.groupBy(*keys, "recording_id").agg(F.count("*").alias("n")).where("n > 1").select(
        *keys, F.lit("recording_repeated").alias("fault"))
    return row.unionByName(twice)


def compare_stored(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Stored values that a recomputation does not reproduce, and rows on one side only."""
    a = stored.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("stored")) for c in columns])).alias("_s")).select(*keys, "_s.*")
    b = fresh.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("fresh")) for c in columns])).alias("_s")).select(*keys, "_s.*")
    d = a.join(b, [*keys, "field"], "full_outer")
    off = F.abs(F.col("stored") - F.col("fresh")) > tolerance
    return d.where(off | (F.col("stored").isNull() != F.col("fresh").isNull()))


def provenance_faults(files: DataFrame, key: str, digest: str, roles: int) -> DataFrame:
    """Missing or malformed hashes and artifacts whose role count is off."""
    faults = F.array_compact(F.array(
        F.when(F.col(digest).isNull(), F.lit("hash_missing")),
        F.when(~F.col(digest).rlike("^[0-9a-f]{64}$"), F.lit("hash_malformed")),
        F.when(F.col("n_roles") != roles, F.lit("role_count")),
    ))
    return files.select(key, F.explode(faults).alias("fault"))


SERIES = ("series_id", "panel_id", "x", "y", "ci95_low", "ci95_high", "recording_support", "held_domain")


def series(df: DataFrame, panel: str, **columns: Column) -> DataFrame:
    """Long plot rows in the registered field order; absent fields are null."""
    types = {"series_id": "string", "panel_id": "string", "held_domain": "string", "recording_support": "bigint"}
    given = {"panel_id": F.lit(panel), **columns}
    return df.select(*[given.get(c, F.lit(None)).cast(types.get(c, "double")).alias(c) for c in SERIES])
