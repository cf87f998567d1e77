"""Closed-form ridge probe and boosted trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut
from .fit import source_only

FLUSH = 32 << 20  # doubles held by one task before partial sums are emitted
BROADCAST = 32 << 20  # doubles of weights that may be sent to every executor


class _Vectors:
    """Feature vectors of a batch; rows of one key share a length, keys may differ."""

    def __init__(self, column: pa.Array):
        self.flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.start = np.asarray(column.offsets) - column.offsets[0].as_py()

    def take(self, rows) -> np.ndarray:
        sizes = self.start[rows + 1] - self.start[rows]
        if (sizes != sizes[0]).any():
            raise ValueError("feature vectors of one key differ in length")
        return self.flat[self.start[rows][:, None] + np.arange(sizes[0])]


def _groups(batch: pa.RecordBatch, keys: list[str]):
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    frame = pd.DataFrame({name: batch.column(batch.schema.names.index(name)).to_pandas() for name in keys})
    for key, rows in frame.groupby(keys, sort=False).indices.items():
        yield key if isinstance(key, tuple) else (key,), rows


def centred(features: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features with ``_m``, their key's mean vector, and the table of means: sums of centred values keep their digits."""
    rows = features.withColumn("values", F.col("values").cast("array<double>"))
    mean = cut(rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("values"))).alias("_m")))
    return (rows.join(mean, keys) if keys else rows.withColumn("_m", F.lit(mean.first()["_m"]))), mean


def gram_rows(features: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Rows of [x-m 1]' [x-m 1 onehot(cls)] summed over all source-fit windows, with the mean m.

    Each task emits its partial sums; rows are then added per (key, row) with map-side
    combining, so the shuffle is d rows per task, whatever the number of windows. Means are sent to
    executors under a checked size, so that the windows stay where they are.
    """
    rows = source_only(features).select(*keys, "cls", "values")
    source, mean = centred(rows, keys)
    size = mean.agg(F.sum(F.size("_m").cast("long")).alias("s")).first()["s"] or 0
    sent = None
    if keys and size <= BROADCAST:
        sent = rows.sparkSession.sparkContext.broadcast({tuple(r[k] for k in keys): np.array(r["_m"]) for r in mean.collect()})
        source = rows.withColumn("values", F.col("values").cast("array<double>"))
    schema = source.select(*keys).schema.add("r", T.IntegerType()).add("sums", T.ArrayType(T.DoubleType()))

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for key, total in held.items():
                n = len(total)
                columns = [pa.array([part] * n) for part in key]
                columns.append(pa.array(np.arange(n, dtype=np.int32)))
                columns.append(pa.array(list(total), type=pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "r", "sums"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _Vectors(batch.column(batch.schema.names.index("values")))
            m = _Vectors(batch.column(batch.schema.names.index("_m"))) if sent is None else None
            y = batch.column(batch.schema.names.index("cls")).to_numpy(zero_copy_only=False).astype(int)
            for key, rows in _groups(batch, keys):
                z = np.column_stack([x.take(rows) - (m.take(rows) if sent is None else sent.value[key]), np.ones(len(rows))])
                part = z.T @ np.column_stack([z, np.eye(classes)[y[rows]]])
                if key in held:
                    held[key] += part
                else:
                    held[key] = part
            if sum(t.size for t in held.values()) > FLUSH:
                yield from flush()
        yield from flush()

    partial = source.mapInArrow(run, schema).withColumn("_v", array_to_vector("sums"))
    total = partial.groupBy(*keys, "r").agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("sums"))
    return total.join(mean, keys) if keys else total.withColumn("_m", F.lit(mean.first()["_m"]))


def fit_ridge(features: DataFrame, keys: list[str], classes: int, l2: float = 0.01) -> DataFrame:
    """Weights of the standardised ridge probe, one row per key.

    Standardisation is applied to the summed Gram matrix, so one pass over the data is
    enough. The solve is d x d per key and runs as a grouped task, never on the driver.
    """
    rows = gram_rows(features, keys, classes)
    key_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    schema = (key_type + ", " if keys else "") + "mean array<double>, scale array<double>, weights array<double>, n double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total, shift = np.stack(pdf.sort_values("r")["sums"].to_numpy()), np.asarray(pdf["_m"].iloc[0])
        d = len(total) - 1
        gram, target = total[:, : d + 1], total[:, d + 1 :]
        n = gram[d, d]
        mean = gram[d, :d] / n
        scale = np.maximum(np.sqrt(np.maximum(np.diag(gram)[:d] / n - mean**2, 0.0)), 1e-6)
        change = np.zeros((d + 1, d + 1))
        change[np.arange(d), np.arange(d)] = 1.0 / scale
        change[d, :d] = -mean / scale
        change[d, d] = 1.0
        lhs = change.T @ gram @ change + l2 * np.eye(d + 1)
        weights = np.linalg.solve(lhs, change.T @ target)
        out = {name: [pdf[name].iloc[0]] for name in keys}
        out.update(mean=[shift + mean], scale=[scale], weights=[weights.ravel()], n=[n])
        return pd.DataFrame(out)

    grouped = rows.groupBy(*keys) if keys else rows.groupBy(F.lit("all"))
    return grouped.applyInPandas(solve, schema)


def _softmax(logits):
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / np.maximum(e.sum(axis=1, keepdims=True), 1e-12)


def score_ridge(features: DataFrame, model: DataFrame, keys: list[str], keep: list[str], classes: int) -> DataFrame:
    """Class probabilities per row. Weights are sent to executors only under a checked size."""
    model = cut(model)
    size = model.agg(F.sum(F.size("weights").cast("long")).alias("s")).first()["s"] or 0
    if size <= BROADCAST:
        return _score_sent(features, model, keys, keep, classes)
    return _score_joined(features, model, keys, keep, classes)


def _score_sent(features, model, keys, keep, classes):
    fitted = {tuple(r[k] for k in keys): (np.array(r["mean"]), np.array(r["scale"]), np.array(r["weights"]).reshape(-1, classes))
              for r in model.collect()}
    sent = features.sparkSession.sparkContext.broadcast(fitted)
    names = list(dict.fromkeys([*keys, *keep]))
    source = features.select(*names, F.col("values").cast("array<double>").alias("values"))
    schema = source.select(*names).schema.add("probs", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _Vectors(batch.column(batch.schema.names.index("values")))
            probs = np.full((batch.num_rows, classes), np.nan)
            known = np.zeros(batch.num_rows, dtype=bool)
            for key, rows in _groups(batch, keys):
                if key in sent.value:
                    mean, scale, weights = sent.value[key]
                    z = (x.take(rows) - mean) / scale
                    probs[rows] = _softmax(z @ weights[:-1] + weights[-1])
                    known[rows] = True
            columns = [batch.column(batch.schema.names.index(name)) for name in names]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(list(probs), type=pa.list_(pa.float64()))], names=[*names, "probs"])
            yield out.filter(pa.array(known))

    return source.mapInArrow(run, schema)


def _score_joined(features, model, keys, keep, classes):
    names = list(dict.fromkeys([*keys, *keep]))
    one = model.select(F.struct("mean", "scale", "weights").alias("_m"))
    d = features.join(model, keys) if keys else features.withColumn("_m", one.scalar()).select("*", "_m.*")
    d = d.withColumn("_z", F.expr("zip_with(zip_with(values, mean, (a, b) -> a - b), scale, (a, s) -> a / s)"))
    logits = F.expr(
        f"transform(sequence(0, {classes - 1}), c -> aggregate(transform(_z, (a, p) -> a * weights[p * {classes} + c]), 0.0D, (t, a) -> t + a)"
        f" + weights[size(_z) * {classes} + c])")
    d = d.withColumn("_l", logits).withColumn("_e", F.expr("transform(_l, a -> exp(a - array_max(_l)))"))
    total = F.expr("aggregate(_e, 0.0D, (t, a) -> t + a)")
    return d.withColumn("_t", total).select(*names, F.expr("transform(_e, a -> a / greatest(_t, 1e-12D))").alias("probs"))


def boosted_trees(
    features: DataFrame, classes: list[int], rounds: int = 500, depth: int = 6,
    step: float = 0.05, subsample: float = 0.8, seed: int = 24021,
) -> dict:
    """One boosted model per class (one for two classes), early-stopped on source_selection."""
    data = features.where(F.col("role").isin("source_fit", "source_selection")).select(
        array_to_vector(F.col("values").cast("array<double>")).alias("features"), "cls",
        (F.col("role") == "source_selection").alias("held"))
    wanted = classes if len(classes) > 2 else classes[1:]
    models = {}
    for c in wanted:
        trainer = GBTClassifier(
            maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed,
            validationIndicatorCol="held", labelCol="target", featuresCol="features")
        models[c] = trainer.fit(data.withColumn("target", (F.col("cls") == c).cast("double")))
    return models


def boosted_probs(features: DataFrame, models: dict, classes: list[int], keep: list[str]) -> DataFrame:
    d = features.select(*keep, array_to_vector(F.col("values").cast("array<double>")).alias("features"))
    for c, model in models.items():
        raw = f"_raw_{c}"
        model = model.copy().setPredictionCol(f"_pred_{c}").setProbabilityCol(f"_prob_{c}").setRawPredictionCol(raw)
        d = model.transform(d)
    if len(models) == 1:
        (c,) = models
        p = vector_to_array(F.col(f"_prob_{c}"))
        return d.select(*keep, p.alias("probs"))
    parts = [vector_to_array(F.col(f"_prob_{c}"))[1] for c in classes]
    total = sum(parts[1:], parts[0])
    return d.select(*keep, F.array(*[p / F.greatest(total, F.lit(1e-12)) for p in parts]).alias("probs"))
