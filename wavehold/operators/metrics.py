"""Recording-level metrics. Windows are always averaged inside a recording first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.quantiles import exact_quantiles
from ..plans.ranking import blocked_running_sum, id_block, value_block


def argmax(probs: str) -> Column:
    """0-based index of the largest entry, the first one on ties."""
    return (F.array_position(F.col(probs), F.array_max(F.col(probs))) - 1).cast("int")


def mean_array(column: str, size: int) -> Column:
    """Element-wise mean of fixed-length arrays as one aggregate (no explode, map-side combined)."""
    return F.array(*[F.avg(F.get(F.col(column), F.lit(k))) for k in range(size)])


def single(column: str, what: str) -> Column:
    """The one value a group may hold; the job fails when there are two."""
    return F.expr(
        f"if(min({column}) <=> max({column}), min({column}), raise_error('{what} differs inside a group'))"
    )


def recording_mean_probs(windows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Mean probability vector per recording and its first-index argmax."""
    means = windows.groupBy(*keys, "recording_id").agg(
        single("truth", "label").cast("int").alias("truth"), mean_array("probs", classes).alias("probs")
    )
    return means.withColumn("pred", argmax("probs"))


def seed_ensemble(recordings: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Mean over seeds of recording probabilities, before any metric."""
    return recording_mean_probs(recordings, keys, classes)


def seed_misalignment(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Recordings whose seeds do not all agree on truth, or are missing from a seed."""
    seeds = recordings.groupBy(*keys).agg(F.count_distinct("seed").alias("want"))
    seen = recordings.groupBy(*keys, "recording_id").agg(
        F.count_distinct("seed").alias("seeds"), F.count_distinct("truth").alias("truths")
    )
    return seen.join(seeds, keys).where("seeds <> want or truths <> 1")


def cells(predictions: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Counts per (truth, pred): all later class metrics need only these."""
    n = F.sum(weight) if weight else F.count("*")
    return predictions.groupBy(*keys, "truth", "pred").agg(n.cast("long").alias("n"))


def confusion_matrix(cell_counts: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of the union of true and predicted labels, zeros included."""
    labels = cell_counts.groupBy(*keys).agg(
        F.array_union(F.collect_set("truth"), F.collect_set("pred")).alias("labels")
    )
    grid = labels.withColumn("truth", F.explode("labels")).withColumn("pred", F.explode("labels"))
    out = grid.drop("labels").join(cell_counts, [*keys, "truth", "pred"], "left").na.fill(0, ["n"])
    row = Window.partitionBy(*keys, "truth")
    return out.withColumn("row_share", F.col("n") / F.greatest(F.sum("n").over(row), F.lit(1)))


def class_scores(cell_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per label of the union."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("named"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("label"), zero.alias("support"), F.col("n").alias("named"), zero.alias("tp")),
    )
    per = (
        cell_counts.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.label").alias("label"))
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.named").alias("named"))
    )
    precision = F.col("tp") / F.greatest(F.col("named"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("support"), F.lit(1))
    scored = per.withColumn("precision", precision).withColumn("recall", recall)
    f1 = 2.0 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    return scored.withColumn("f1", f1)


def macro_f1(cell_counts: DataFrame, keys: list[str]) -> DataFrame:
    return class_scores(cell_counts, keys).groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy")
    )


def calibration_bins(recordings: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Non-empty confidence bins; the last bin is closed on both sides."""
    edges = F.array(*[F.lit(k * (1.0 / bins)) for k in range(bins)])
    conf = F.array_max("probs")
    d = recordings.withColumn("conf", conf).withColumn("edges", edges)
    d = d.withColumn("bin", F.expr("size(filter(edges, e -> e <= conf)) - 1"))
    return d.groupBy(*keys, "bin").agg(
        F.count("*").alias("support"),
        F.avg("conf").alias("confidence"),
        F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"),
    )


def calibration(recordings: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """ECE, multiclass Brier score and clipped log loss."""
    binned = calibration_bins(recordings, keys, bins)
    ece = binned.groupBy(*keys).agg(
        (F.sum(F.col("support") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("support")).alias("ece")
    )
    brier = F.expr("aggregate(transform(probs, (p, k) -> pow(p - if(k = truth, 1.0D, 0.0D), 2)), 0.0D, (a, v) -> a + v)")
    truth_p = F.get(F.col("probs"), F.col("truth"))
    point = recordings.groupBy(*keys).agg(
        F.avg(brier).alias("brier"),
        (-F.avg(F.log(F.greatest(F.least(truth_p, F.lit(1.0)), F.lit(1e-12))))).alias("nll"),
    )
    return ece.join(point, keys)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def binary_scores(recordings: DataFrame, background: int = 0) -> DataFrame:
    """Score 1 - P(background); y says whether the recording is not background."""
    return recordings.withColumn("score", 1.0 - F.get(F.col("probs"), F.lit(background))).withColumn(
        "y", (F.col("truth") != background).cast("int")
    )


def _score_totals(scored: DataFrame, keys: list[str], score: str, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return scored.groupBy(*keys, score).agg(
        F.sum(w).cast("long").alias("n_at"), F.sum(w * F.col("y")).cast("long").alias("pos_at")
    )


def auroc(scored: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Pairwise rank statistic with half credit for ties, from counts per distinct score."""
    t = _score_totals(scored, keys, "score", weight).withColumn("neg_at", F.col("n_at") - F.col("pos_at"))
    t = blocked_running_sum(t, keys, ["score"], value_block(F.col("score")), {"neg_upto": F.col("neg_at")})
    won = F.col("pos_at") * (F.col("neg_upto") - F.col("neg_at") + 0.5 * F.col("neg_at"))
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(won), F.sum("pos_at").cast("double") * F.sum("neg_at")).alias("auroc")
    )


def average_precision(scored: DataFrame, keys: list[str], tie_block: Column | None = None) -> DataFrame:
    """Mean precision at positives; equal scores are ordered by recording id.

    Ranks come in two levels (between distinct scores, inside one score), so a score shared
    by a third of the rows is still split over blocks of ids.
    """
    between = _score_totals(scored, keys, "score", None)
    between = blocked_running_sum(
        between.withColumn("_down", -F.col("score")),
        keys,
        ["_down"],
        value_block(F.col("_down")),
        {"n_upto": F.col("n_at"), "pos_upto": F.col("pos_at")},
    ).select(
        *keys, "score",
        (F.col("n_upto") - F.col("n_at")).alias("n_before"),
        (F.col("pos_upto") - F.col("pos_at")).alias("pos_before"),
    )
    inside = blocked_running_sum(
        scored.select(*keys, "score", "recording_id", "y"),
        [*keys, "score"],
        ["recording_id"],
        tie_block if tie_block is not None else id_block("recording_id"),
        {"n_in": F.lit(1), "pos_in": F.col("y")},
    )
    joined = inside.join(between, [*keys, "score"])
    precision = (F.col("pos_before") + F.col("pos_in")) / (F.col("n_before") + F.col("n_in"))
    return joined.groupBy(*keys).agg(
        F.try_divide(F.sum(precision * F.col("y")), F.sum("y")).alias("auprc")
    )


def detection_counts(scored: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Operating-point counts and rates with 'score >= threshold' as detection."""
    fired = (F.col("score") >= threshold).cast("int")
    y = F.col("y")
    c = scored.groupBy(*keys).agg(
        F.sum((1 - y) * (1 - fired)).alias("tn"),
        F.sum((1 - y) * fired).alias("fp"),
        F.sum(y * (1 - fired)).alias("fn"),
        F.sum(y * fired).alias("tp"),
    )
    negatives = F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    positives = F.greatest(F.col("fn") + F.col("tp"), F.lit(1))
    return (
        c.withColumn("far", F.col("fp") / negatives)
        .withColumn("miss_rate", F.col("fn") / positives)
        .withColumn("background_recall", F.col("tn") / negatives)
        .withColumn("signal_recall", F.col("tp") / positives)
    )


def source_thresholds(scored: DataFrame, keys: list[str], far: float = 0.05) -> DataFrame:
    """Smallest background score with at most ``far`` of the background above it."""
    return exact_quantiles(scored.where("y = 0"), keys, "score", {"threshold": 1.0 - far}, kind="higher")


def curve_area(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area over severity divided by its span; null for a single point."""
    order = Window.partitionBy(*keys).orderBy("severity")
    d = curve.withColumn("_dx", F.col("severity") - F.lag("severity").over(order)).withColumn(
        "_my", (F.col("value") + F.lag("value").over(order)) / 2.0
    )
    return d.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_dx") * F.col("_my")), F.max("severity") - F.min("severity")).alias("area")
    )


def cohens_d(paired: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """Paired effect size: 0 or infinite without spread, null below two pairs."""
    a = paired.groupBy(*keys).agg(
        F.count(difference).alias("n"), F.avg(difference).alias("m"), F.stddev_samp(difference).alias("s")
    )
    flat = F.when(F.abs(F.col("m")) <= 1e-12, 0.0).otherwise(F.lit(float("inf")))
    d = F.when(F.col("n") < 2, None).when(F.col("s") <= 1e-12, flat).otherwise(F.try_divide(F.col("m"), F.col("s")))
    return a.select(*keys, "n", d.alias("d"))


def midranks(values: DataFrame, keys: list[str], value: str, out: str = "midrank") -> DataFrame:
    """Average ranks for ties, from counts per distinct value."""
    t = values.groupBy(*keys, value).agg(F.count("*").alias("_at"))
    t = blocked_running_sum(t, keys, [value], value_block(F.col(value)), {"_upto": F.col("_at")})
    t = t.select(*keys, value, (F.col("_upto") - F.col("_at") + (F.col("_at") + 1) / 2.0).alias(out))
    return values.join(t, [*keys, value])


def weighted_average_precision(scored: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Average precision of a resample given as counts; equal scores rank negatives first."""
    t = _score_totals(scored, keys, "score", weight).withColumn("_down", -F.col("score"))
    t = blocked_running_sum(
        t, keys, ["_down"], value_block(F.col("_down")), {"n_upto": F.col("n_at"), "pos_upto": F.col("pos_at")})
    before = (F.col("pos_upto") - F.col("pos_at"), F.col("n_upto") - F.col("pos_at"))
    t = t.where("pos_at > 0").withColumn("_p", before[0]).withColumn("_n", before[1])
    inside = F.expr("aggregate(sequence(1L, pos_at), 0.0D, (t, j) -> t + (_p + j) / (_n + j))")
    return t.groupBy(*keys).agg((F.sum(inside) / F.sum("pos_at")).alias("auprc"))
