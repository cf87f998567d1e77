"""What a user may plug in: framing in SQL, own perturbations, own fitted representations, own bootstrap statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans import resampling as rs
from .fit import source_only

SIGNAL = "i array<double>, q array<double>"


def register_frame(spark: SparkSession, name: str = "frame") -> None:
    """SQL table function ``name(values, length, hop)``: (start, stop, part) of every whole frame.

    ``SELECT w.id, f.* FROM windows w, LATERAL frame(w.x, 16, 8) f``. Null arrays and arrays shorter
    than a frame give no row. A row holds one array, so a call is bounded by it; long signals are
    framed from their samples by ``windows.frame_samples``.
    """

    class Frame:
        def eval(self, values, length: int, hop: int):
            if length < 1 or hop < 1:
                raise ValueError("length and hop must be positive")
            for start in range(0, len(values if values is not None else ()) - length + 1, hop):
                yield start, start + length, [float(z) for z in values[start : start + length]]

    spark.udtf.register(name, F.udtf(Frame, returnType="start int, stop int, part array<double>"))


def perturbation(function: Callable[[np.ndarray, np.random.Generator, float], np.ndarray]) -> Callable[..., Column]:
    """(i, q, seed, severity) -> struct(i, q) from a user's (signal, generator, severity) -> signal.

    A window has its own generator, made from its seed column, so results do not depend on batches
    or partitions. Null signals stay null; a result of another length or with a value that is not
    finite stops the job.
    """

    def one(i, q, seed, severity):
        if i is None or q is None:
            return None
        x = np.asarray(i, dtype=float) + 1j * np.asarray(q, dtype=float)
        y = np.asarray(function(x, np.random.default_rng(int(seed)), float(severity)), dtype=complex)
        if y.shape != x.shape or not np.isfinite(y).all():
            raise ValueError("a perturbation keeps the length of its signal and gives finite values")
        return y

    @F.pandas_udf(SIGNAL)
    def run(i: pd.Series, q: pd.Series, seed: pd.Series, severity: pd.Series) -> pd.DataFrame:
        out = [one(*row) for row in zip(i, q, seed, severity)]
        part = lambda side: pd.Series([None if y is None else side(y) for y in out], dtype=object)
        return pd.DataFrame({"i": part(np.real), "q": part(np.imag)})

    return run


def perturb_user(windows: DataFrame, function, severities: Iterable[float], seed_of: Callable[[Column, Column], Column], index: str) -> DataFrame:
    """Windows (i, q, ...) x severities under a user's perturbation, beside severity_index, severity and seed."""
    cases = F.array(*[F.struct(F.lit(k).alias("severity_index"), F.lit(float(s)).alias("severity")) for k, s in enumerate(severities)])
    d = windows.withColumn("_c", F.explode(cases)).select("*", "_c.*").drop("_c")
    d = d.withColumn("seed", seed_of(F.col(index), F.col("severity_index")).cast("long"))
    made = perturbation(function)("i", "q", "seed", "severity")
    return d.withColumn("_p", made).drop("i", "q").select("*", "_p.i", "_p.q").drop("_p")


class Representation(Protocol):
    """A user's representation: families of features with parameters learned from source rows."""

    families: tuple[str, ...]

    def fit(self, source: DataFrame, keys: list[str]) -> DataFrame:
        """One row of parameters per key from source_fit rows."""

    def transform_by_family(self, windows: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
        """The windows with one array column per family."""


class Fitted(NamedTuple):
    """A representation with its parameters; made by fit_representation only."""

    representation: Representation
    parameters: DataFrame
    keys: list[str]

    def transform_by_family(self, windows: DataFrame) -> DataFrame:
        return self.representation.transform_by_family(windows, self.parameters, self.keys)

    def transform(self, windows: DataFrame) -> DataFrame:
        """Families joined to ``values``, in the order in which the representation names them."""
        families = list(self.representation.families)
        return self.transform_by_family(windows).withColumn("values", F.concat(*families)).drop(*families)

    def source_artifact(self) -> DataFrame:
        """(keys, sha256) of the parameters: what a frozen source model is compared with."""
        names = sorted(set(self.parameters.columns) - set(self.keys))
        return self.parameters.select(*self.keys, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("sha256"))


def fit_representation(representation: Representation, rows: DataFrame, keys: list[str]) -> Fitted:
    """Fit on rows of role source_fit, which are picked here, so that a user's code sees no other."""
    return Fitted(representation, representation.fit(source_only(rows), keys), keys)


def bootstrap_of_sums(
    rows: DataFrame, keys: list[str], block_id: str, sums: dict[str, Column], statistic: Callable[[dict[str, Column]], Column], draws: int, seed: int,
    order: Column | None = None,
) -> DataFrame:
    """(keys, blocks, estimate, low, high) of a user's statistic under resampling of whole blocks.

    ``sums`` names what is summed over rows and ``statistic`` turns those sums into a value: ratios,
    variances, correlations, regression slopes. Rows are reduced to one vector of sums per block
    before any draw, and only sums per draw are shuffled. Nulls add nothing; below two blocks the
    interval is null.
    """
    names = list(sums)
    total = [F.coalesce(F.sum(c.cast("double")), F.lit(0.0)) for c in sums.values()]
    blocks = rows.groupBy(*keys, F.col(block_id).alias("recording_id")).agg(F.array(*total).alias("_x"))
    value = lambda column: statistic({name: F.get(column, F.lit(k)) for k, name in enumerate(names)})
    drawn = rs.draw_sums(blocks, keys, "_x", draws, seed, order).select(*keys, "draw", value(F.col("sums")).alias("v"))
    whole = blocks.groupBy(*keys).agg(F.count("*").alias("blocks"), F.array(*[F.sum(F.col("_x")[k]) for k in range(len(names))]).alias("_x"))
    return _with_interval(whole.select(*keys, "blocks", value(F.col("_x")).alias("estimate")), drawn, keys)


def bootstrap_of_values(
    values: DataFrame, keys: list[str], value: str, statistic: Callable[[str, str], Column], draws: int, seed: int, order: Column | None = None,
) -> DataFrame:
    """As bootstrap_of_sums, for statistics that are no function of sums; one row per recording.

    ``statistic(value, weight)`` is an aggregate with whole weights, such as
    ``lambda x, m: F.percentile(x, 0.5, F.col(m))``. Every drawn row is shuffled: draws x rows.
    """
    drawn = rs.draw_recordings(values, keys, draws, seed, [value], order).groupBy(*keys, "draw").agg(statistic(value, "m").alias("v"))
    whole = values.withColumn("m", F.lit(1)).groupBy(*keys).agg(F.count("*").alias("blocks"), statistic(value, "m").alias("estimate"))
    return _with_interval(whole, drawn, keys)


def _with_interval(whole: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    out = whole.join(rs.interval(drawn, keys, "v"), keys, "left")
    enough = F.col("blocks") >= 2
    return out.select(*keys, "blocks", "estimate", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))
