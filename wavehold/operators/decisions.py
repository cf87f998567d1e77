"""Decision rules, keyed by experiment so one query decides many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.resampling import holm


def intersection_union(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A candidate needs every comparison; the family pays a Bonferroni factor for choosing.

    An infeasible candidate has p = 1 but still counts. One invalid measurement makes the
    whole experiment untestable.
    """
    worst = F.greatest("p_instability_vs_w", "p_instability_vs_stft", "p_f1_vs_w", "p_f1_vs_stft")
    d = candidates.withColumn("p_iut", F.when(F.col("feasible"), worst).otherwise(1.0))
    g = d.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.min("p_iut").alias("_p"), F.bool_and("measurement_valid").alias("_ok"))
    return g.select(
        *keys, "candidates", F.when(F.col("_ok"), "ok").otherwise("untestable").alias("status"),
        F.when(F.col("_ok"), F.least(F.lit(1.0), F.col("candidates") * F.col("_p"))).alias("raw_p"))


def deletion(components: DataFrame, keys: list[str]) -> DataFrame:
    """Largest p over deleted families; 1 if any deletion leaves the representation unchanged."""
    degenerate = (F.col("cosine") >= 0.995) & (F.col("nmae") <= 0.010)
    g = components.groupBy(*keys).agg(
        F.max("raw_p").alias("_p"), F.count_if(degenerate).alias("degenerate_families"), F.count("*").alias("_n"))
    return g.select(
        *keys, "degenerate_families", F.lit("ok").alias("status"),
        F.when(F.col("degenerate_families") > 0, 1.0).otherwise(F.col("_p")).alias("raw_p"))


def cost_tradeoff(rows: DataFrame) -> DataFrame:
    """Both costs must fall strictly; then the larger of the two p-values."""
    testable = F.col("measurement_valid") & F.col("p_latency").isNotNull()
    gate = F.col("bytes_reduced") & F.col("macs_reduced")
    return rows.withColumn("status", F.when(testable, "ok").otherwise("untestable")).withColumn(
        "raw_p", F.when(testable, F.when(gate, F.greatest("p_performance", "p_latency")).otherwise(1.0)))


def mechanism_state(rows: DataFrame) -> DataFrame:
    """untestable -> negative -> supported -> partial, in this precedence."""
    covered = (F.col("relation_recordings") >= 20) & F.coalesce(F.col("min_coverage") >= 0.5, F.lit(False))
    ready = F.col("eligible") & F.col("integrity") & F.col("calibration") & covered & F.col("compute_valid")
    compute = (F.col("parameter_ratio") <= 1.10) & (F.col("mac_ratio") <= 1.10) & (F.col("latency_ratio") <= 1.25)
    firm = (F.col("gate_low") > 0) & (F.col("shuffle_low") > 0) & (F.col("worst_low") > -0.01) & compute
    return rows.withColumn(
        "state",
        F.when(~ready, "untestable")
        .when((F.col("delta_gate") <= 0) | (F.col("delta_shuffle") <= 0), "negative")
        .when(firm, "supported")
        .otherwise("partial"))


def finalize(raw: DataFrame, keys: list[str], needed: int = 4, alpha: float = 0.05) -> DataFrame:
    """Holm over the hypotheses of an experiment, only if all of them are testable."""
    ready = raw.groupBy(*keys).agg((F.count_if(F.col("status") == "ok") == needed).alias("_ready"))
    d = holm(raw.join(ready, keys), keys, "hypothesis", "raw_p")
    decided = F.when(F.col("holm_p") <= alpha, "supported").otherwise("negative")
    return d.select(
        *keys, "hypothesis", F.when(F.col("_ready"), F.col("raw_p")).alias("raw_p"),
        F.when(F.col("_ready"), F.col("holm_p")).alias("holm_p"),
        F.when(F.col("_ready"), decided).otherwise("untestable").alias("status"))
