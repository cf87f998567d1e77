"""Instability reductions, Pareto choice and ablation mapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.quantiles import exact_quantiles
from ..session import cut

# ---- instability; the order median -> max -> median -> mean -> max is part of the result ----


def linf_displacement(pairs: DataFrame) -> DataFrame:
    gap = F.array_max(F.zip_with("perturbed", "clean", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return pairs.withColumn("displacement", gap).drop("clean", "perturbed")


def recording_family_medians(displacements: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    return exact_quantiles(
        displacements, [*keys, "domain", "recording_id", "family"], "displacement", {"median": 0.5}, sizes=sizes)


def recording_details(medians: DataFrame, keys: list[str]) -> DataFrame:
    """Per-recording family medians (bounded family set) and their maximum."""
    return medians.groupBy(*keys, "domain", "recording_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "median")))).alias("family_medians"),
        F.max("median").alias("recording_max"),
    )


def reduce_domains(medians: DataFrame, keys: list[str]) -> DataFrame:
    """Max over families, median over recordings per domain, equal mean over domains."""
    top = medians.groupBy(*keys, "domain", "recording_id").agg(F.max("median").alias("recording_max"))
    per_domain = exact_quantiles(top, [*keys, "domain"], "recording_max", {"median": 0.5})
    return per_domain.groupBy(*keys).agg(F.avg("median").alias("instability"))


def worst_case(per_case: DataFrame, keys: list[str]) -> DataFrame:
    """Largest case value and the first case reaching it."""
    return per_case.groupBy(*keys).agg(
        F.max("instability").alias("value"),
        F.max_by("case_index", F.struct("instability", -F.col("case_index"))).alias("worst_case"),
    )


def recording_worst_case(medians: DataFrame, keys: list[str]) -> DataFrame:
    return medians.groupBy(*keys, "domain", "recording_id").agg(
        F.max("median").alias("worst"),
        F.max_by("case_index", F.struct("median", -F.col("case_index"))).alias("case_index"))


# ---- separation and similarity ----


def fisher_ratio(features: DataFrame, keys: list[str], label: str, dims: int, ridge: float = 1e-3) -> DataFrame:
    """between / (within + ridge * d) from per-class sums, in one pass over the windows."""
    long = features.select(*keys, label, F.posexplode(F.col("values").cast("array<double>")).alias("pos", "v"))
    per = long.groupBy(*keys, label, "pos").agg(
        F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    grand = per.groupBy(*keys, "pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    d = per.join(grand, [*keys, "pos"])
    return d.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2)))
         / (F.sum(F.col("n") * F.col("s")) + ridge * dims)).alias("fisher"))


def stretch(column: str, size: Column) -> Column:
    """Linear interpolation of an array onto ``size`` points of [0, 1]."""
    x, last = F.col(column).cast("array<double>"), F.size(column) - 1

    def one(k):
        at = k * last / (size - 1)
        low = F.least(F.floor(at).cast("int"), F.greatest(last - 1, F.lit(0)))
        high = F.least(low + 1, last)
        return F.get(x, low) + (F.get(x, high) - F.get(x, low)) * (at - low)

    return F.when(F.size(column) == size, x).otherwise(F.transform(F.sequence(F.lit(0), size - 1), one))


def representation_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cosine and mean range-normalised absolute gap; degenerate only if both agree."""
    size = F.greatest(F.size("left"), F.size("right"))
    d = pairs.select(*keys, stretch("left", size).alias("x"), stretch("right", size).alias("y"))
    total = lambda e: F.expr(f"aggregate({e}, 0.0D, (t, z) -> t + z)")
    dot = total("zip_with(x, y, (a, b) -> a * b)")
    norm = F.sqrt(total("transform(x, a -> a * a)")) * F.sqrt(total("transform(y, a -> a * a)"))
    spread = F.greatest(F.array_max("x"), F.array_max("y")) - F.least(F.array_min("x"), F.array_min("y"))
    gap = total("zip_with(x, y, (a, b) -> abs(a - b))") / F.size("x")
    m = d.groupBy(*keys).agg(
        F.avg(dot / F.greatest(norm, F.lit(1e-12))).alias("cosine"),
        F.avg(gap / F.greatest(spread, F.lit(1e-12))).alias("nmae"))
    return m.withColumn("degenerate", (F.col("cosine") >= 0.995) & (F.col("nmae") <= 0.010))


# ---- Pareto choice ----

OBJECTIVES = ("sensitivity", "neg_f1", "bytes_per_sample", "macs", "latency_ms")
TOLERANCE = 1e-12
BLOCKS = 16
BLOCK_ROWS = 20_000


def minimised(records: DataFrame) -> DataFrame:
    """Feasible rows with F1 negated; a repeated id in a group fails the job."""
    return records.where("feasible").withColumn("neg_f1", -F.col("macro_f1"))


def repeated_ids(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys, "stable_id").agg(F.count("*").alias("n")).where("n > 1")


def _beaten(candidates: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Which candidates some rival dominates within the tolerance."""
    out = np.zeros(len(candidates), dtype=bool)
    for start in range(0, len(rivals), 512):
        r = rivals[start : start + 512, None, :]
        left = np.flatnonzero(~out)
        c = candidates[left][None]
        out[left] = ((r <= c + TOLERANCE).all(axis=2) & (r < c - TOLERANCE).any(axis=2)).any(axis=0)
    return out


def _minimal(points: np.ndarray, step: int = 256) -> np.ndarray:
    """Indexes of points no other point is below or equal to everywhere (one of equals stays).

    In lexicographic order only earlier points can be below; a step of them meets what is kept so
    far and the earlier points of its own step.
    """
    order = np.lexsort(points.T[::-1])
    kept = order[:0]
    for start in range(0, len(order), step):
        some = order[start : start + step]
        own = (points[some][:, None] <= points[some][None]).all(axis=2)
        covered = np.triu(own, 1).any(axis=0)
        for lo in range(0, len(kept), 4096):
            covered |= (points[kept[lo : lo + 4096]][:, None] <= points[some][None]).all(axis=2).any(axis=0)
        kept = np.concatenate([kept, some[~covered]])
    return kept.astype(int)


def _thin(pdf: pd.DataFrame) -> pd.DataFrame:
    """Drop what this set of rows already settles.

    ``rival`` marks rows that may still beat others: the minimal ones, since whatever a row
    beats is also beaten by a row below it everywhere. ``alive`` marks rows not beaten yet.
    """
    p = pdf[list(OBJECTIVES)].to_numpy(float)
    rivals = np.flatnonzero(pdf["rival"].to_numpy(bool))
    rivals = rivals[_minimal(p[rivals])] if len(rivals) else rivals
    rival = np.zeros(len(p), dtype=bool)
    rival[rivals] = True
    alive = pdf["alive"].to_numpy(bool).copy()
    own = np.flatnonzero(alive)
    alive[own] = ~_beaten(p[own], p[rivals])
    out = pdf.assign(alive=alive, rival=rival)
    return out[alive | rival]


def pareto_front(records: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """Non-dominated feasible rows per group, without a pairwise join of the table.

    Arrow batches are thinned where they are read, so the shuffle carries little more than
    local fronts. Hash blocks of a group, as many as its survivors need, are thinned again, and the
    survivors of each block meet the minimal rows of all blocks. Every stage is exact for the tolerance rule, which is
    not transitive by itself.
    """
    if not repeated_ids(records, keys).isEmpty():
        raise ValueError("Pareto ids must be unique")
    d = minimised(records).select(*keys, "stable_id", *[F.col(o).cast("double").alias(o) for o in OBJECTIVES])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    flagged = types + ", alive boolean, rival boolean"

    def local(frames):
        for pdf in frames:
            pdf = pdf.assign(alive=True, rival=True)
            groups = [g for _, g in pdf.groupby(keys, sort=False, dropna=False)] if keys else [pdf]
            for g in groups:
                if len(g):
                    yield _thin(g)

    near = cut(d.mapInPandas(local, flagged))
    blocks = blocks or max(BLOCKS, near.count() // BLOCK_ROWS)
    block = F.pmod(F.xxhash64("stable_id"), F.lit(blocks)).cast("int")
    thinned = near.withColumn("_block", block).groupBy(*keys, "_block").applyInPandas(_thin, flagged + ", _block int")
    everywhere = F.when(F.col("rival"), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array("_block"))
    sent = thinned.withColumn("_to", F.explode(everywhere))
    sent = sent.withColumn("alive", F.col("alive") & (F.col("_to") == F.col("_block")))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["alive"]]
        rivals = pdf[pdf["rival"]]
        beaten = _beaten(own[list(OBJECTIVES)].to_numpy(float), rivals[list(OBJECTIVES)].to_numpy(float))
        return own[~beaten][[*keys, "stable_id", *OBJECTIVES]]

    return sent.groupBy(*keys, "_to").applyInPandas(meet, types)


def select_unique(records: DataFrame, keys: list[str], slack: float = 0.01) -> DataFrame:
    """Front rows within ``slack`` of the best feasible F1, then least unstable, fastest, id."""
    front = pareto_front(records, keys)
    best = records.where("feasible").groupBy(*keys).agg(F.max("macro_f1").alias("_best"))
    d = front.join(best, keys) if keys else front.withColumn("_best", best.scalar())
    ok = d.where(-F.col("neg_f1") >= F.col("_best") - slack)
    first = F.min(F.struct("sensitivity", "latency_ms", "stable_id"))
    return ok.groupBy(*keys).agg(first.alias("_f")).select(*keys, F.col("_f.stable_id").alias("selected"))


def select_scalar(records: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-weight sum of min-max scaled objectives; first id on ties."""
    d = minimised(records)
    spans = d.groupBy(*keys).agg(
        *[F.min(o).alias(f"_lo_{o}") for o in OBJECTIVES], *[F.max(o).alias(f"_hi_{o}") for o in OBJECTIVES])
    joined = d.join(spans, keys) if keys else d.withColumn("_s", spans.select(F.struct("*")).scalar()).select("*", "_s.*")
    score = sum(
        (F.col(o) - F.col(f"_lo_{o}")) / F.greatest(F.col(f"_hi_{o}") - F.col(f"_lo_{o}"), F.lit(1e-12)) for o in OBJECTIVES)
    return joined.withColumn("score", score).groupBy(*keys).agg(
        F.min_by("stable_id", F.struct("score", "stable_id")).alias("selected"), F.min("score").alias("score"))


def select_best_setting(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Largest mean F1 over seeds; the smaller setting on ties."""
    mean = scores.groupBy(*keys, "setting").agg(F.avg("f1").alias("f1"))
    return mean.groupBy(*keys).agg(
        F.max_by("setting", F.struct("f1", -F.col("setting"))).alias("setting"), F.max("f1").alias("f1"))


def channel_retention(families: DataFrame) -> DataFrame:
    """Keep a family only if every gate passes; a missing value never passes.

    ``delta`` is null for the only family of a representation, which counts as independent.
    """
    independent = F.col("only_family") | F.coalesce(F.col("delta") > 0, F.lit(False))
    shortcut = F.coalesce(
        (F.col("probe") <= F.col("shuffle_q95")) & ~F.isnan("probe") & ~F.isnan("shuffle_q95"), F.lit(False))
    d = families.withColumn("independent_pass", independent).withColumn("shortcut_pass", shortcut)
    return d.withColumn(
        "retain", F.col("selected") & F.col("independent_pass") & ~F.col("degenerate") & F.col("shortcut_pass"))


# Named ablation conditions.
ABLATIONS = (
    "W", "C", "W+C", "W+C+E", "W+C+E+S",
    "active_minus_W", "active_minus_C", "active_minus_E", "active_minus_S",
    "wst_J3Q1", "wst_J3Q2", "wst_J3Q4", "wst_J4Q1", "wst_J4Q2", "wst_J4Q4", "wst_J5Q1", "wst_J5Q2", "wst_J5Q4",
    "cyclic_A4", "cyclic_A8", "cyclic_A16", "cyclic_permuted",
    "norm_percentile", "norm_zscore", "norm_none",
    "resolution_8", "resolution_16", "resolution_32",
    "selection_scalar", "selection_pareto",
)


def ablation_bank(choices: DataFrame, candidates: DataFrame, main: DataFrame) -> DataFrame:
    """Conditions resolved to candidate rows per fold.

    ``choices(fold_id, scalar, pareto)``, ``candidates(fold_id, candidate_id, value)``,
    ``main(fold_id, value)``. A deleted family that was never active is the main condition
    itself, marked as a structural identity.
    """
    d = choices.withColumn("condition_id", F.explode(F.array(*[F.lit(c) for c in ABLATIONS])))
    target = (
        F.when(F.col("condition_id") == "selection_scalar", F.col("scalar"))
        .when(F.col("condition_id") == "selection_pareto", F.col("pareto"))
        .otherwise(F.col("condition_id")))
    d = d.select("fold_id", "condition_id", target.alias("candidate_id"))
    d = d.join(candidates, ["fold_id", "candidate_id"], "left").join(
        main.withColumnRenamed("value", "_main"), "fold_id", "left")
    deletion = F.col("condition_id").startswith("active_minus_")
    kind = F.when(F.col("value").isNotNull(), "measured").when(deletion, "structural_identity").otherwise("missing")
    value = F.coalesce(F.col("value"), F.when(deletion, F.col("_main")))
    return d.select("fold_id", "condition_id", "candidate_id", value.alias("value"), kind.alias("kind"))
