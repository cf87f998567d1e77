"""Source-only fits. Every fit keeps ``role = 'source_fit'`` itself, so no caller can leak."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kernels as k
from ..plans.quantiles import exact_quantiles
from .metrics import single
from .transforms import map_windows

FIT = "source_fit"


def source_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("role") == FIT)


def array_median(column: str) -> Column:
    """Median of a bounded array, inside the row."""
    s, n = F.array_sort(column), F.size(column)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(s, low).cast("double") + F.get(s, high).cast("double")) / 2.0


def array_sum(expression: str, column: str = "values") -> Column:
    return F.expr(f"aggregate({column}, 0.0D, (a, z) -> a + {expression})")


def fit_percentile(features: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Offset p1 and scale p99 - p1 over every coefficient of a family."""
    values = source_only(features).select(*keys, F.explode("values").alias("value"))
    q = exact_quantiles(values, keys, "value", {"low": 0.01, "high": 0.99}, sizes=sizes)
    return q.select(
        *keys,
        F.lit("percentile").alias("mode"),
        F.col("low").alias("offset"),
        F.greatest(F.col("high") - F.col("low"), F.lit(1e-8)).alias("scale"),
    )


def fit_zscore(features: DataFrame, keys: list[str]) -> DataFrame:
    values = source_only(features).select(*keys, F.explode(F.col("values").cast("array<double>")).alias("v"))
    return values.groupBy(*keys).agg(
        F.lit("zscore").alias("mode"), F.avg("v").alias("offset"),
        F.greatest(F.stddev_pop("v"), F.lit(1e-8)).alias("scale"),
    )


def fit_none(features: DataFrame, keys: list[str]) -> DataFrame:
    return source_only(features).select(*keys).distinct().select(
        *keys, F.lit("none").alias("mode"), F.lit(0.0).alias("offset"), F.lit(1.0).alias("scale")
    )


def apply_normalizer(features: DataFrame, normalizers: DataFrame, keys: list[str]) -> DataFrame:
    """(x - offset) / scale as float32; percentile mode also clips to [0, 1]."""
    d = features.join(normalizers, keys)

    def one(x):
        z = (x.cast("double") - F.col("offset")) / F.col("scale")
        clipped = F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0))
        return F.when(F.col("mode") == "percentile", clipped).otherwise(z).cast("float")

    return d.withColumn("values", F.transform("values", one)).drop("mode", "offset", "scale")


def energy_reference(features: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Median window energy per recording, then median over recordings."""
    w = source_only(features).select(*keys, "recording_id", array_median("values").alias("m"))
    by_recording = exact_quantiles(w, [*keys, "recording_id"], "m", {"m": 0.5}, sizes=sizes)
    over = exact_quantiles(by_recording, keys, "m", {"m": 0.5})
    return over.select(*keys, F.greatest(F.col("m"), F.lit(1e-8)).alias("reference"))


def normalize_energy(features: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    one = lambda x: F.log1p(F.greatest(x.cast("double"), F.lit(0.0)) / F.col("reference")).cast("float")
    return features.join(references, keys).withColumn("values", F.transform("values", one)).drop("reference")


def cyclic_scores(windows: DataFrame, roles: DataFrame, i: str = "i", q: str | None = "q") -> DataFrame:
    """Median over recordings of the per-recording median envelope spectrum, per fold and bin.

    A recording's spectrum does not depend on the fold, so it is reduced once and only the
    reduced rows are fanned out to folds.
    """
    spectra = map_windows(windows, ["recording_id"], {"P": k.envelope_spectrum}, i, q)
    bins = spectra.select("recording_id", F.posexplode("values").alias("bin", "power"))
    sizes = windows.groupBy("recording_id").agg(F.count("*").alias("n"))
    medians = exact_quantiles(bins, ["recording_id", "bin"], "power", {"power": 0.5}, sizes=sizes)
    fit = source_only(roles).select("fold_id", "recording_id")
    per_fold = medians.join(fit, "recording_id")
    sizes = fit.groupBy("fold_id").agg(F.count("*").alias("n"))
    score = exact_quantiles(per_fold, ["fold_id", "bin"], "power", {"score": 0.5}, sizes=sizes)
    score = score.withColumn("score", F.when(F.col("bin") < 2, 0.0).otherwise(F.col("score")))
    order = Window.partitionBy("fold_id").orderBy("bin")  # at most W / 2 + 1 rows
    before, after = F.lag("score").over(order), F.lead("score").over(order)
    peak = F.coalesce((F.col("score") >= before) & (F.col("score") >= after), F.lit(False))
    return score.withColumn("peak", peak)


def cyclic_bins(scores: DataFrame, count: int, window: int, frame: int, separation: int = 2) -> DataFrame:
    """Greedy choice per fold: best peak first, spaced, with a new effective shift each."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        shifts: set[int] = set()
        ordered = pdf[pdf["peak"]].sort_values(["score", "bin"], ascending=[False, True])
        for b in ordered["bin"]:
            shift = k.effective_shift(b / window, frame)
            if len(kept) < count and shift not in shifts and all(abs(b - o) >= separation for o in kept):
                kept.append(int(b))
                shifts.add(shift)
        if len(kept) < count:
            raise ValueError("too few cyclic peaks with distinct shifts")
        kept.sort()
        return pd.DataFrame({"fold_id": pdf["fold_id"].iloc[0], "pos": range(count), "alpha": [b / window for b in kept]})

    return scores.groupBy("fold_id").applyInPandas(choose, "fold_id string, pos int, alpha double")


def permute_bins(bins: DataFrame, order: Column) -> DataFrame:
    """Seeded permutation per fold that is never the identity (bounded groups)."""
    w = Window.partitionBy("fold_id")
    d = bins.withColumn("_to", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    same = F.bool_and(F.col("_to") == F.col("pos")).over(w)
    d = d.withColumn("_same", same)
    to = F.when(F.col("_same"), F.pmod(F.col("_to") + 1, F.col("_n"))).otherwise(F.col("_to"))
    return d.select("fold_id", to.cast("int").alias("pos"), "alpha")


def channel_standardizer(features: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population std per channel over windows and coefficients, floor 1e-6."""
    values = source_only(features).select(*keys, F.explode(F.col("values").cast("array<double>")).alias("v"))
    return values.groupBy(*keys).agg(
        F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(1e-6)).alias("scale"))


def channel_stats_one_pass(features: DataFrame, keys: list[str]) -> DataFrame:
    """The same from sums alone: each row contributes three numbers, nothing is exploded."""
    sums = source_only(features).groupBy(*keys).agg(
        F.sum(array_sum("cast(z as double)")).alias("s1"),
        F.sum(array_sum("cast(z as double) * z")).alias("s2"),
        F.sum(F.size("values").cast("long")).alias("n"),
    )
    mean = F.col("s1") / F.col("n")
    variance = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.select(*keys, mean.alias("mean"), F.greatest(F.sqrt(variance), F.lit(1e-6)).alias("scale"), "n")


def standardize_with(features: DataFrame, statistics: DataFrame, keys: list[str]) -> DataFrame:
    one = lambda x: ((x.cast("double") - F.col("mean")) / F.col("scale")).cast("float")
    d = features.join(statistics.select(*keys, "mean", "scale"), keys)
    return d.withColumn("values", F.transform("values", one)).drop("mean", "scale")


def mean_vectors(features: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """Element-wise mean of equal-length arrays per key, combined map-side."""
    vector = array_to_vector(F.transform("values", lambda x: x.cast("double")))
    d = features.withColumn("_vec", vector)
    return d.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_vec"))).alias("values"), *extra)


def recording_mean_features(features: DataFrame, keys: list[str]) -> DataFrame:
    """One feature vector per recording; label and domain must not differ inside it."""
    return mean_vectors(
        features, [*keys, "recording_id"],
        [single("label", "label").alias("label"), single("domain", "domain").alias("domain")],
    )


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """n / (K * n_k); fails when a class never occurs."""
    c = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("n"))
    seen = c.agg(F.count("*").alias("k"))
    checked = F.when(seen.scalar() == classes, total.scalar()).otherwise(
        F.expr("cast(raise_error('a class does not occur') as bigint)"))
    return c.select(label, "n", (checked / (F.lit(classes) * F.col("n"))).alias("weight"))


def recording_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of one window: every recording carries equal mass."""
    per = rows.groupBy(*keys, "recording_id").agg(F.count("*").alias("windows"))
    n = per.groupBy(*keys).agg(F.count("*").alias("recordings"))
    joined = per.join(n, keys) if keys else per.withColumn("recordings", n.scalar())
    return joined.withColumn("weight", 1.0 / (F.col("recordings") * F.col("windows")))


T_LOW, T_HIGH, T_STEPS, T_PASSES = 0.05, 20.0, 25, 3


def fit_temperature(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Temperature minimising the recording-weighted log loss of ``logits / T``.

    Three passes over a shrinking logarithmic grid; each pass is one map-side combined
    aggregate of 25 candidates. ``at_bound`` flags a fit on the edge of the allowed range.
    """
    d = rows.join(recording_weights(rows, keys).select(*keys, "recording_id", "weight"), [*keys, "recording_id"])
    best = rows.select(*keys).distinct().withColumn("_lo", F.lit(T_LOW)).withColumn("_hi", F.lit(T_HIGH))
    for _ in range(T_PASSES):
        grid = F.expr(
            f"transform(sequence(0, {T_STEPS - 1}), s -> struct(s as s, _lo * pow(_hi / _lo, s / {T_STEPS - 1}.0D) as t))")
        e = d.join(best, keys).withColumn("_g", F.explode(grid)).withColumn("t", F.col("_g.t"))
        loss = F.expr(
            "ln(aggregate(logits, 0.0D, (a, z) -> a + exp((z - array_max(logits)) / t))) - (get(logits, truth) - array_max(logits)) / t")
        per = e.groupBy(*keys, "_lo", "_hi", "_g.s", "t").agg(F.sum(loss * F.col("weight")).alias("loss"))
        pick = per.groupBy(*keys, "_lo", "_hi").agg(F.min(F.struct("loss", "s", "t")).alias("_b"))
        ratio = F.pow(F.col("_hi") / F.col("_lo"), F.lit(1.0 / (T_STEPS - 1)))
        best = pick.select(
            *keys,
            F.greatest(F.lit(T_LOW), F.col("_b.t") / ratio).alias("_lo"),
            F.least(F.lit(T_HIGH), F.col("_b.t") * ratio).alias("_hi"),
            F.col("_b.t").alias("temperature"), F.col("_b.loss").alias("loss"),
        )
        result = best
        best = best.drop("temperature", "loss")
    t = F.col("temperature")
    return result.select(*keys, "temperature", "loss", ((t <= T_LOW + 1e-6) | (t >= T_HIGH - 1e-6)).alias("at_bound"))


def class_means(features: DataFrame, keys: list[str]) -> DataFrame:
    """Source-fit mean vector of each class, as one bounded array per key."""
    means = mean_vectors(source_only(features), [*keys, "cls"])
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cls", "values"))).alias("means"))


def nearest_mean_probs(features: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """Softmax of negative squared distances to the class means."""
    d = features.join(means, keys)
    scores = F.expr(
        "transform(means, m -> -aggregate(zip_with(values, m.values, (a, b) -> pow(cast(a as double) - b, 2)), 0.0D, (t, z) -> t + z))")
    d = d.withColumn("_s", scores).withColumn("_e", F.expr("transform(_s, s -> exp(s - array_max(_s)))"))
    d = d.withColumn("_t", F.expr("aggregate(_e, 0.0D, (a, z) -> a + z)"))
    return d.withColumn("probs", F.expr("transform(_e, z -> z / _t)")).drop("_s", "_e", "_t", "means")
