"""Instability against degradation over a fixed bank of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.rng import hash_order, uniform
from ..operators import metrics as m
from ..session import cut
from . import resampling as rs

ETA = 1e-10


def small_midrank(keys: list[str], value: str):
    """Average rank inside a bank (about a dozen rows)."""
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2.0


def rank_residuals(bank: DataFrame, keys: list[str], targets: list[str], controls: list[str]) -> DataFrame:
    """Midranks of targets, with the span of [1, midranks of controls] projected out.

    Orthogonalises the controls one after another with window sums over each small bank; all
    windows share one partitioning, so this is a single shuffle however many draws there are.
    A control already inside the span adds nothing.
    """
    whole = Window.partitionBy(*keys)
    d = bank
    for c in [*controls, *targets]:
        d = d.withColumn(f"_{c}", small_midrank(keys, c))
    for c in [*controls, *targets]:
        d = d.withColumn(f"_{c}", F.col(f"_{c}") - F.avg(f"_{c}").over(whole))
    for k, control in enumerate(controls):
        base = f"_{control}"
        size = F.sum(F.col(base) * F.col(base)).over(whole)
        for other in [*controls[k + 1 :], *targets]:
            share = F.when(size > ETA, F.sum(F.col(base) * F.col(f"_{other}")).over(whole) / size).otherwise(0.0)
            d = d.withColumn(f"_{other}", F.col(f"_{other}") - share * F.col(base))
    return d.select(*bank.columns, *[F.col(f"_{t}").alias(f"residual_{t}") for t in targets])


CONTROLS = ["source_f1", "log_macs", "resolution"]


def partial_rank_statistic(bank: DataFrame, keys: list[str], controls: list[str] = CONTROLS, joint: int = 8) -> DataFrame:
    """Normalised residual product per key; null where fewer than ``joint`` residuals are non-zero."""
    d = bank.withColumn("degradation", F.col("source_f1") - F.col("held_f1"))
    r = rank_residuals(d, keys, ["instability", "degradation"], controls)
    a, b = F.col("residual_instability"), F.col("residual_degradation")
    s = r.groupBy(*keys).agg(
        F.sum(a * b).alias("ab"), F.sqrt(F.sum(a * a)).alias("na"), F.sqrt(F.sum(b * b)).alias("nb"),
        F.count_if((F.abs(a) > ETA) & (F.abs(b) > ETA)).alias("joint"))
    ok = (F.col("na") > ETA) & (F.col("nb") > ETA) & (F.col("joint") >= joint)
    return s.select(*keys, "joint", F.when(ok, F.col("ab") / (F.col("na") * F.col("nb"))).alias("statistic"))


def bank_matrix(rows: DataFrame, extra: list[str], weight: str | None = None) -> DataFrame:
    """Source F1, held F1 and mean source instability per (extra, fold, config).

    ``rows(fold, side, recording_id, config, truth, pred, instability)``; ``weight`` counts
    how often a recording was drawn, and a recording always carries its whole config vector.
    """
    keys = [*extra, "fold", "config"]
    f1 = m.macro_f1(m.cells(rows, [*keys, "side"], weight), [*keys, "side"])
    wide = f1.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "source", F.col("macro_f1"))).alias("source_f1"),
        F.max(F.when(F.col("side") == "held", F.col("macro_f1"))).alias("held_f1"))
    w = F.col(weight) if weight else F.lit(1)
    unstable = rows.where("side = 'source'").groupBy(*keys).agg(
        (F.sum(w * F.col("instability")) / F.sum(w)).alias("instability"))
    return wide.join(unstable, keys)


def _drawn_banks(rows: DataFrame, keys: list[str], draws: int, seed: int, classes: int = 2) -> DataFrame:
    """(fold, draw, config, source_f1, held_f1, instability) of resampled recordings.

    A recording's whole config vector is one row: a 1 for its prediction under each config, and its
    instability. Sums of such rows per stratum and draw hold all that the bank needs.
    """
    vector = F.flatten(F.transform("_x", lambda x: F.array(*[F.when(x["pred"] == c, 1.0).otherwise(0.0) for c in range(classes)], x["instability"])))
    packed = rows.groupBy(*keys, "recording_id").agg(F.array_sort(F.collect_list(F.struct("config", "pred", "instability"))).alias("_x"))
    packed = cut(packed.select(*keys, "recording_id", vector.alias("_v"), F.transform("_x", lambda x: x["config"]).alias("_configs")))
    odd = packed.agg(F.count_distinct("_configs")).first()[0]
    if odd > 1:
        raise ValueError("recordings differ in their configurations")
    sums = rs.draw_sums(packed, keys, "_v", draws, seed)
    width = classes + 1
    names = packed.select("_configs").limit(1)
    per = sums.withColumn("_configs", names.scalar()).select(*keys, "draw", "sums", F.posexplode("_configs").alias("_k", "config"))
    at = lambda c: F.get("sums", F.col("_k") * width + c)
    per = per.select("fold", "side", "truth", "draw", "config", F.array(*[at(c) for c in range(classes)]).alias("_n"), at(classes).alias("_u"))
    cells = per.select("fold", "side", "truth", "draw", "config", F.posexplode("_n").alias("pred", "n")).where("n > 0")
    cells = cells.groupBy("fold", "side", "truth", "draw", "config", "pred").agg(F.sum("n").cast("long").alias("n"))
    f1 = m.macro_f1(cells, ["draw", "fold", "config", "side"])
    wide = f1.groupBy("draw", "fold", "config").agg(
        F.max(F.when(F.col("side") == "source", F.col("macro_f1"))).alias("source_f1"),
        F.max(F.when(F.col("side") == "held", F.col("macro_f1"))).alias("held_f1"))
    whole = F.expr("aggregate(_n, 0.0D, (t, z) -> t + z)")
    unstable = per.where("side = 'source'").groupBy("draw", "fold", "config").agg((F.sum("_u") / F.sum(whole)).alias("instability"))
    return wide.join(unstable, ["draw", "fold", "config"])


def hierarchical_bootstrap(rows: DataFrame, costs: DataFrame, draws: int, seed: int) -> DataFrame:
    """Mean statistic over domains with interval and centred p; fewer than 95 % valid draws is untestable."""
    keys = ["fold", "side", "domain", "truth"]
    observed = partial_rank_statistic(bank_matrix(rows, []).join(costs, "config"), ["fold"])
    estimate = observed.agg(F.when(F.count("statistic") == F.count("*"), F.avg("statistic")).alias("e"))
    drawn = _drawn_banks(rows, keys, draws, seed)
    s = partial_rank_statistic(drawn.join(costs, "config"), ["draw", "fold"])
    per = s.groupBy("draw").agg(F.when(F.count("statistic") == F.count("*"), F.avg("statistic")).alias("v"))
    per = per.withColumn("e", estimate.scalar())
    valid = per.where("v is not null")
    share = (F.count("v") / F.lit(draws)).alias("valid_fraction")
    summary = per.agg(
        F.max("e").alias("estimate"), share,
        ((1 + F.count_if(F.col("v") - F.col("e") >= F.col("e") - 1e-12)) / (F.count("v") + 1)).alias("raw_p"))
    ci = rs.interval(valid, [], "v")
    ok = (F.col("valid_fraction") >= 0.95) & F.col("estimate").isNotNull()
    keep = lambda c: F.when(ok, c)
    return summary.select(
        F.when(ok, "ok").otherwise("untestable").alias("status"), "estimate", "valid_fraction",
        keep(F.col("raw_p")).alias("raw_p"), keep(ci.select("low").scalar()).alias("low"), keep(ci.select("high").scalar()).alias("high"))


def nested_bootstrap(rows: DataFrame, draws: int, seed: int, folds: list[str]) -> DataFrame:
    """Domains drawn first, recordings inside each drawn domain second; configs stay paired."""
    spark: SparkSession = rows.sparkSession
    outer = spark.range(draws).select(F.col("id").cast("int").alias("outer_draw")).withColumn(
        "outer_slot", F.explode(F.sequence(F.lit(0), F.lit(len(folds) - 1))))
    which = F.floor(uniform(F.lit(seed), F.lit("outer"), F.col("outer_draw"), F.col("outer_slot")) * len(folds)).cast("int")
    outer = outer.withColumn("fold", F.element_at(F.array(*[F.lit(f) for f in folds]), which + 1))
    outer = outer.withColumn("draw", F.col("outer_draw") * len(folds) + F.col("outer_slot"))
    # a resample for every (draw, slot); the slot's domain picks which of its banks counts
    bank = _drawn_banks(rows, ["fold", "side", "domain", "truth"], draws * len(folds), seed).join(outer, ["fold", "draw"])
    s = partial_rank_statistic(bank, ["outer_draw", "outer_slot", "fold"], ["source_f1"])
    per = s.groupBy("outer_draw").agg(F.when(F.count("statistic") == F.count("*"), F.avg("statistic")).alias("v"))
    blocked = per.agg(F.count_if(F.col("v").isNull()).alias("b"))
    ci = rs.interval(per.where("v is not null"), [], "v")
    return ci.withColumn("blocked_draws", blocked.scalar()).withColumn(
        "status", F.when(F.col("blocked_draws") > 0, "blocked").otherwise("ok"))


def freedman_lane(bank: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Diagnostic tail fraction: one permutation of the configs shared by all domains per draw.

    Not an inferential p-value. A permuted residual is no longer orthogonal to the control,
    which is projected out again; the observed instability residual already is, which leaves plain
    sums per (draw, domain).
    """
    d = bank.withColumn("degradation", F.col("source_f1") - F.col("held_f1"))
    r = rank_residuals(d, ["fold"], ["instability", "degradation"], ["source_f1"])
    r = r.withColumn("_c", small_midrank(["fold"], "source_f1"))
    r = r.withColumn("_c", F.col("_c") - F.avg("_c").over(Window.partitionBy("fold")))
    r = cut(r.select("fold", "config", F.col("residual_instability").alias("z"), F.col("residual_degradation").alias("y"), "_c"))
    draws = r.select("config").distinct().withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(permutations - 1))))
    w = Window.partitionBy("draw")  # one bank of configs per draw
    order = hash_order(F.lit(seed), F.col("draw"), F.col("config"))
    draws = draws.withColumn("_to", F.row_number().over(w.orderBy("config")))
    shuffled = F.row_number().over(w.orderBy(order))
    draws = draws.withColumn("_from", F.when(F.col("draw") < 0, F.col("_to")).otherwise(shuffled))
    moved = draws.select("draw", F.col("_to").alias("_k"), F.col("config").alias("config")).join(
        draws.select("draw", F.col("_from").alias("_k"), F.col("config").alias("_source")), ["draw", "_k"])
    d = moved.join(r.drop("y"), "config").join(r.select("fold", F.col("config").alias("_source"), "y"), ["fold", "_source"])
    s = d.groupBy("draw", "fold").agg(
        F.sum(F.col("y") * F.col("z")).alias("yz"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.sum("y").alias("sy"), F.sum(F.col("_c") * F.col("y")).alias("cy"), F.sum(F.col("_c") * F.col("_c")).alias("cc"), F.count("*").alias("n"))
    span = F.when(F.col("cc") > ETA, F.col("cy") * F.col("cy") / F.col("cc")).otherwise(0.0)
    norm = F.sqrt(F.greatest(F.col("yy") - F.col("sy") * F.col("sy") / F.col("n") - span, F.lit(0.0)))
    ok = (norm > ETA) & (F.sqrt("zz") > ETA)
    s = s.withColumn("v", F.when(ok, F.col("yz") / (norm * F.sqrt("zz"))))
    per = cut(s.groupBy("draw").agg(F.when(F.count("v") == F.count("*"), F.avg("v")).alias("v")))
    observed = per.where("draw = -1").select("v")
    drawn = per.where("draw >= 0").withColumn("e", observed.scalar())
    return drawn.agg(
        F.max("e").alias("estimate"), F.count("*").alias("permutations"),
        F.when((F.count("v") < F.count("*")) | F.max("e").isNull(), "blocked").otherwise("ok").alias("status"),
        ((1 + F.count_if(F.col("v") >= F.col("e") - 1e-12)) / (F.count("*") + 1)).alias("tail_fraction"))
