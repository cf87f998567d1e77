"""Deployment cost and budget arithmetic. Latencies are measured elsewhere and read as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .transforms import Config


def transform_count(config: Config) -> int:
    """FFT-sized terms of one configuration."""
    terms = 0
    if "W" in config.families:
        first = max(config.j * config.q, 1)
        second = sum(max(config.j - k // max(config.q, 1) - 1, 0) for k in range(first))
        terms += 2 * first + second
    if "C" in config.families:
        terms += config.cyclic
    return terms + ("S" in config.families)


def cost_columns(configs: list[Config]) -> Column:
    """Array of per-config constants to explode next to the window length ``n``."""
    return F.array(*[
        F.struct(
            F.lit(c.stable_id).alias("config_id"), F.lit(len(c.families)).alias("channels"), F.lit(c.bins).alias("bins"),
            F.lit(transform_count(c)).alias("ffts"), F.lit(1 if "E" in c.families else 0).alias("pointwise"))
        for c in configs
    ])


def representation_cost(lengths: DataFrame, configs: list[Config]) -> DataFrame:
    d = lengths.withColumn("_c", F.explode(cost_columns(configs))).select("n", "_c.*")
    cells = F.col("channels") * F.col("bins") * F.col("bins")
    macs = (
        F.col("ffts") * F.col("n") * F.log2(F.greatest(F.col("n"), F.lit(2)).cast("double")) * 5.0
        + F.col("pointwise") * F.col("n") + cells * 8
    )
    return d.select("config_id", "n", (cells * 4).cast("double").alias("bytes_per_sample"), macs.alias("estimated_macs"))


BUDGET = {"bytes_per_sample": 4096.0, "batch1_latency_ms": 100.0, "estimated_macs": 1.0e8}


def budget_check(costs: DataFrame, budget: dict[str, float] = BUDGET) -> DataFrame:
    """Failure names per row; feasible iff there is none."""
    tests = [F.when(~F.col("measurement_valid"), F.lit("invalid_batch1_latency_measurement"))]
    tests += [F.when(F.col(name) > limit, F.lit(name)) for name, limit in budget.items()]
    d = costs.withColumn("failures", F.array_compact(F.array(*tests)))
    return d.withColumn("feasible", F.size("failures") == 0)


def ensemble_cost(per_seed: DataFrame, keys: list[str]) -> DataFrame:
    """Models add up, the shared representation is charged once, memory is the maximum."""
    return per_seed.groupBy(*keys).agg(
        F.sum("parameters").alias("parameters"),
        (F.sum("model_macs") + F.avg("representation_macs")).alias("macs"),
        F.avg("bytes_per_sample").alias("bytes_per_sample"),
        (F.sum("model_ms") + F.avg("representation_ms")).alias("median_ms"),
        F.max("peak_bytes").alias("peak_bytes"),
        F.bool_and("valid").alias("measurement_valid"),
        F.count("*").alias("ensemble_size"),
    )
