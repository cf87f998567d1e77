"""Domain views over the supplied tables (the tables stand in for recordings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rng
from ..operators.windows import number_samples
from ..plans.ranking import blocked_row_number, id_block

CLASSES = 10
CONDITIONS = {"full": 0.55, "control": 0.35}
SEEDS = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def windows(spark: SparkSession, sf: str, starts: bool = False, classes: int = 2) -> DataFrame:
    """Signal windows: 2 classes x 12 recordings, or 10 classes x 6."""
    per_class = 12 if classes == 2 else 6
    label = F.col("label") % 2 if classes == 2 else F.col("label")
    w = table(spark, sf, "embeddings").select(
        "vec_id",
        label.cast("int").alias("cls"),
        label.cast("string").alias("label"),
        F.concat_ws("-", label.cast("string"), (F.col("vec_id") % per_class).cast("string")).alias("recording_id"),
        F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string")).alias("domain"),
        F.col("embedding").alias("x"),
    ).withColumn("group_id", F.col("recording_id"))
    if not starts:
        return w
    ranked = blocked_row_number(w, ["recording_id"], ["vec_id"], id_block("vec_id"), "rank")
    return ranked.withColumn("start", (F.col("rank") - 1) * 64).drop("rank")


def iq_windows(spark: SparkSession, sf: str, starts: bool = False) -> DataFrame:
    """Complex windows of 32 samples: first half of the vector is I, second half Q."""
    w = windows(spark, sf, starts)
    return w.select("*", F.slice("x", 1, 32).alias("i"), F.slice("x", 33, 32).alias("q")).drop("x")


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf).groupBy("recording_id", "group_id", "domain", "label").agg(
        F.count("*").alias("n_windows")
    )


def samples(spark: SparkSession, sf: str, position: bool = True) -> DataFrame:
    """Long signals: one sample per event, ordered by time inside a user's recording."""
    s = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("recording_id"),
        (F.col("user_id") % 2).cast("string").alias("label"),
        F.concat(F.lit("d"), (F.floor(F.col("user_id") / 2) % 3).cast("string")).alias("domain"),
        "ts",
        "event_id",
        F.col("value").alias("v"),
    )
    if not position:
        return s
    return number_samples(s, ["recording_id"], ["ts", "event_id"])


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Binary detection scores: y, score and a domain."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("recording_id"),
        F.col("lang").alias("domain"),
        F.col("toxic").cast("int").alias("y"),
        F.round(1.0 - F.exp(-F.col("n_chars") / 5000.0), 3).alias("score"),
    )


def window_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Per-window class probabilities of two conditions x three seeds."""
    w = windows(spark, sf, classes=CLASSES)
    variants = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("condition"), F.lit(s).alias("seed"), F.lit(h).alias("hit"))
                for c, h in CONDITIONS.items()
                for s in range(SEEDS)
            ]
        )
    )
    d = w.withColumn("_v", variants).select(
        "vec_id", "recording_id", "domain", F.col("cls").alias("truth"), "_v.*", "x"
    )
    bonus = F.when(rng.uniform(F.col("condition"), F.col("seed"), F.col("vec_id")) < F.col("hit"), 1.1).otherwise(0.0)
    d = d.withColumn("_bonus", bonus).withColumn("_x", F.expr(f"slice(x, 1 + {CLASSES} * seed, {CLASSES})"))
    d = d.withColumn(
        "_e",
        F.expr("transform(_x, (v, k) -> exp(8 * cast(v as double) + if(k = truth, _bonus, cast(0 as double))))"),
    ).withColumn("_s", F.expr("aggregate(_e, cast(0 as double), (a, v) -> a + v)"))
    return d.select(
        "condition", "seed", F.col("domain").alias("fold"), "recording_id", "vec_id", "truth",
        F.expr("transform(_e, v -> v / _s)").alias("probs"),
    )


def objectives(spark: SparkSession, sf: str) -> DataFrame:
    """Five objectives per brand; one row per stable id."""
    j = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey"
    )
    return j.groupBy(F.col("p_brand").alias("stable_id")).agg(
        F.round(F.avg("l_discount"), 6).alias("sensitivity"),
        F.round(F.avg("l_tax") * 10, 6).alias("macro_f1"),
        F.round(F.avg("l_quantity"), 6).alias("latency_ms"),
        F.round(F.avg("p_size"), 6).alias("bytes_per_sample"),
        F.round(F.avg("l_extendedprice"), 6).alias("macs"),
        (F.avg("l_quantity") <= F.lit(25.6)).alias("feasible"),
    )
