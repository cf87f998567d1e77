"""Label contracts, eligibility and value guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BACKGROUND = "background"


def canonical_label(streams: DataFrame, labels: DataFrame, subsets: DataFrame) -> DataFrame:
    """Background by either label, then a listed single-label subset, then the label maps.

    ``labels(dataset, name, canonical)`` and ``subsets(dataset, subset)`` are contract
    dimensions; joins on them stay ordinary so Spark decides by their measured size.
    """
    by_label = labels.select("dataset", F.col("name").alias("label"), F.col("canonical").alias("_by_label"))
    by_model = labels.select("dataset", F.col("name").alias("model_label"), F.col("canonical").alias("_by_model"))
    listed = subsets.select("dataset", "subset", F.lit(True).alias("_listed"))
    d = (
        streams.join(by_label, ["dataset", "label"], "left")
        .join(by_model, ["dataset", "model_label"], "left")
        .join(listed, ["dataset", "subset"], "left")
    )
    rule = (
        F.when((F.col("label") == BACKGROUND) | (F.col("model_label") == BACKGROUND), BACKGROUND)
        .when(F.coalesce("_listed", F.lit(False)) & (F.col("task_type") == "single_label"), "uav")
        .otherwise(F.coalesce("_by_label", "_by_model"))
    )
    return d.withColumn("canonical", rule).drop("_by_label", "_by_model", "_listed")


def exclude_recordings(streams: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return streams.where("task_type = 'single_label'").join(excluded.select(key), key, "left_anti")


def missing_labels(labelled: DataFrame, limit: int = 25) -> DataFrame:
    """First ``limit`` unmapped dataset:label names (a top-k report)."""
    name = F.concat_ws(":", "dataset", "label").alias("missing")
    return labelled.where(F.col("canonical").isNull()).select(name).distinct().orderBy("missing").limit(limit)


def shared_labels(rows: DataFrame, datasets: int) -> DataFrame:
    """Labels present in every dataset."""
    seen = rows.groupBy("label").agg(F.count_distinct("dataset").alias("datasets"))
    return seen.where(F.col("datasets") == datasets).select("label")


def keep_shared(rows: DataFrame, datasets: int) -> DataFrame:
    return rows.join(shared_labels(rows, datasets), "label", "left_semi")


def issue(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def gate_issues(summary: DataFrame, gates: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per failed gate."""
    found = F.array_compact(F.array(*[issue(~F.coalesce(ok, F.lit(False)), text) for text, ok in gates.items()]))
    return summary.select(*keys, F.explode(found).alias("issue"))


def eligible(domains: DataFrame, flags: list[str], digest: str, needed: int = 3) -> DataFrame:
    """Domains passing every review flag with a well-formed content hash, and the count gate."""
    ok = F.col(digest).rlike("^[0-9a-f]{64}$")
    for flag in flags:
        ok = ok & F.col(flag)
    kept = domains.where(ok)
    count = kept.agg(F.count("*").alias("n"))
    return kept.withColumn("gate_open", count.scalar() >= needed)


def class_index(rows: DataFrame, label: str) -> DataFrame:
    """Index of each class in sorted order; the class list is bounded, rows are not."""
    names = rows.select(label).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(label)
    return names.select(label, (F.row_number().over(order) - 1).alias("class_index"))


def encode_classes(rows: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Attach class indexes; an unknown label fails the job."""
    d = rows.join(classes, label, "left")
    checked = F.coalesce(F.col("class_index"), F.expr("cast(raise_error('unknown label') as int)"))
    return d.withColumn("class_index", checked)


def safe_component(text: Column) -> Column:
    """File-name safe form of any text."""
    clean = F.regexp_replace(F.trim(text), "[^A-Za-z0-9_.-]+", "-")
    return F.coalesce(F.nullif(F.btrim(clean, F.lit("-.")), F.lit("")), F.lit("unknown"))


def quantize(values: str, low: Column, high: Column, bits: int) -> Column:
    """Clip to [low, high] and scale to unsigned integers, rounding half to even."""
    top = (1 << bits) - 1
    span = F.greatest(high - low, F.lit(1e-12))

    def one(x):
        unit = F.least(F.greatest((x.cast("double") - low) / span, F.lit(0.0)), F.lit(1.0))
        return F.bround(unit * top, 0).cast("int")

    return F.transform(F.col(values), one)


def finite_problem(values: str) -> Column:
    """Why a signal is refused, or null."""
    bad = F.exists(F.col(values), lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return F.when(F.size(values) <= 0, "empty").when(bad, "nonfinite")


FAMILY_MASKS = {
    "W": ["W"],
    "C": ["C"],
    "W+C": ["W", "C"],
    "W+C+E": ["W", "C", "E"],
    "W+C+E+S": ["W", "C", "E", "S"],
}


def family_mask(features: DataFrame, mask: str) -> DataFrame:
    """Rows of the families in a mask: a filter that reaches the scan."""
    return features.where(F.col("family").isin(FAMILY_MASKS[mask]))
