"""Block resampling of recordings, spread over draws.

A stratum's rows have positions; every draw has as many slots as the stratum has rows. How many
slots fall in a block of positions comes from a tree of binomial splits, and each slot's place in
its block from a counter (plans/draws.py). So a task works out all draws of the blocks it holds, and
sums per (stratum, draw) are all that moves: no draw meets the recordings in a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..operators import metrics as m
from . import draws as dr
from .quantiles import exact_quantiles
from .ranking import blocked_row_number, text_block

HELD = 16 << 20  # numbers of unsent sums in one task
TOGETHER = 250  # draws whose sums travel in one row


def _schema(df: DataFrame, names: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    out = T.StructType([df.schema[c] for c in names])
    for name, kind in more:
        out = out.add(name, kind)
    return out


def draw_cells(cells: DataFrame, keys: list[str], stratum: list[str], cell: list[str], draws: int, seed: int) -> DataFrame:
    """Counts ``m`` per (keys, draw, stratum, cell) of a stratified resample with replacement.

    ``cells`` holds counts ``n`` per (keys, stratum, cell): a stratum's recordings, ordered by cell. Draws
    depend on ``stratum`` only, so different ``keys`` (conditions) with equal strata are resampled alike.
    """
    group = list(dict.fromkeys([*keys, *stratum]))
    packed = cells.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(*cell, F.col("n").alias("cnt")))).alias("_c"), F.sum("n").alias("_n"))
    packed = packed.withColumn("_upto", F.expr("transform(_c, (x, k) -> aggregate(slice(_c, 1, k + 1), 0L, (t, y) -> t + y.cnt))"))
    blocks = packed.select(*group, "_n", "_upto", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / dr.BLOCK))).alias("_block"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = _schema(blocks, group, ("draw", T.IntegerType()), ("_k", T.IntegerType()), ("m", T.LongType()))

    def run(frames):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for key, total in held.items():
                draw, k = np.nonzero(total)
                out = pd.DataFrame({"draw": draw.astype(np.int32), "_k": k.astype(np.int32), "m": total[draw, k].astype(np.int64)})
                yield out.assign(**dict(zip(group, key)))[[*group, "draw", "_k", "m"]]
            held.clear()

        for pdf in frames:
            for row in pdf.to_dict("records"):
                key, upto, n, block = tuple(row[c] for c in group), np.asarray(row["_upto"]), int(row["_n"]), int(row["_block"])
                size = min(dr.BLOCK, n - block * dr.BLOCK)
                of = np.searchsorted(upto, block * dr.BLOCK + np.arange(size), side="right")
                seen, at = np.unique(of, return_inverse=True)
                part = dr.resampled(seed, tuple(row[c] for c in stratum), n, block, draws, np.eye(len(seen))[at])
                if key not in held:
                    held[key] = np.zeros((draws, len(upto)))
                held[key][:, seen] += part
                if sum(t.size for t in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    drawn = blocks.repartition(parts, *group, "_block").mapInPandas(run, schema)
    drawn = drawn.groupBy(*group, "draw", "_k").agg(F.sum("m").alias("m"))
    names = packed.select(*group, F.posexplode("_c").alias("_k", "_cell")).select(*group, "_k", *[F.col(f"_cell.{c}").alias(c) for c in cell if c not in group])
    return drawn.join(names, [*group, "_k"]).drop("_k")


def _blocks(rows: DataFrame, stratum: list[str], block: Column | None) -> DataFrame:
    """Rows with their stratum's size _n and their _block, positions by recording id, in order within tasks."""
    block = text_block(rows, "recording_id") if block is None else block
    placed = blocked_row_number(rows, stratum, ["recording_id"], block, "_at")
    sizes = rows.groupBy(*stratum).agg(F.count("*").alias("_n"))
    placed = placed.withColumn("_block", F.floor((F.col("_at") - 1) / dr.BLOCK)).join(sizes, stratum)
    # few rows, many draws: a fixed number, so that adaptive execution does not gather them in one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, *stratum, "_block").sortWithinPartitions(*stratum, "_block", "_at")


def _whole_blocks(frames, names: list[str]):
    """(key, frame) of each block, put together where a batch ends inside it."""
    at, held = None, []
    for frame in frames:
        for key, pdf in frame.groupby(names, sort=False, dropna=False):
            if key != at and held:
                yield at, pd.concat(held)
                held = []
            at = key
            held.append(pdf)
    if held:
        yield at, pd.concat(held)


def draw_sums(rows: DataFrame, stratum: list[str], values: str, draws: int, seed: int, block: Column | None = None) -> DataFrame:
    """(stratum, draw, sums): sums of the vector column ``values`` over each draw of the stratum's rows.

    One row per recording. Strata are drawn within themselves. Tasks send the sums of many draws in one
    row, so adding them up costs by the number, not by the draw.
    """
    placed = _blocks(rows.select(*stratum, "recording_id", F.col(values).cast("array<double>").alias("_v")), stratum, block)
    schema = _schema(placed, stratum, ("_from", T.IntegerType()), ("sums", T.ArrayType(T.DoubleType())))

    def run(frames):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for key, total in held.items():
                at = np.arange(0, draws, TOGETHER, dtype=np.int32)
                out = pd.DataFrame({"_from": at, "sums": [total[k : k + TOGETHER].ravel() for k in at]})
                yield out.assign(**dict(zip(stratum, key)))[[*stratum, "_from", "sums"]]
            held.clear()

        for key, pdf in _whole_blocks(frames, [*stratum, "_block"]):
            x = np.stack(pdf["_v"].to_numpy())
            part = dr.resampled(seed, key[:-1], int(pdf["_n"].iloc[0]), int(key[-1]), draws, x)
            held[key[:-1]] = held[key[:-1]] + part if key[:-1] in held else part
            if sum(t.size for t in held.values()) > HELD:
                yield from flush()
        yield from flush()

    partial = placed.mapInPandas(run, schema).withColumn("_s", array_to_vector("sums"))
    whole = partial.groupBy(*stratum, "_from").agg(vector_to_array(Summarizer.sum(F.col("_s"))).alias("_t"))
    n = f"least({TOGETHER}, {draws} - _from)"
    each = F.expr(f"transform(sequence(0, {n} - 1), k -> struct(_from + k as draw, slice(_t, cast(k * (size(_t) div {n}) + 1 as int), cast(size(_t) div {n} as int)) as sums))")
    return whole.select(*stratum, F.inline(each))


def draw_recordings(rows: DataFrame, stratum: list[str], draws: int, seed: int, carry: list[str] = (), block: Column | None = None) -> DataFrame:
    """(stratum, recording_id, carry, draw, m): how often each row is drawn, zeros left out, made beside the rows.

    For statistics that need each drawn row, not sums: the output has draws times rows.
    """
    placed = _blocks(rows.select(*stratum, "recording_id", *carry), stratum, block)
    names = [*stratum, "recording_id", *carry]
    schema = _schema(placed, names, ("draw", T.IntegerType()), ("m", T.LongType()))

    def run(frames):
        for key, pdf in _whole_blocks(frames, [*stratum, "_block"]):
            counts = dr.block_counts(seed, key[:-1], int(pdf["_n"].iloc[0]), int(key[-1]), draws)
            step = max(1, (1 << 20) // len(pdf))
            for k in range(0, draws, step):
                some = range(k, min(draws, k + step))
                draw, at = dr.slots(dr.keyed(seed, key[:-1], some, int(key[-1])), counts[k : some.stop], len(pdf))
                cell, many = np.unique(draw * len(pdf) + at, return_counts=True)
                yield pdf[names].iloc[cell % len(pdf)].assign(draw=(k + cell // len(pdf)).astype(np.int32), m=many)

    return placed.mapInPandas(run, schema)


def interval(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2.5 % and 97.5 % points; a group has one row per draw, so its size is the draw count."""
    return exact_quantiles(values, keys, value, {"low": 0.025, "high": 0.975}, bounded=True)


def f1_draws(counts: DataFrame, keys: list[str], domain: str = "fold") -> DataFrame:
    """Macro F1 per (keys, domain, draw) from drawn cell counts."""
    c = counts.groupBy(*keys, domain, "draw", "truth", "pred").agg(F.sum("m").alias("n"))
    return m.macro_f1(c, [*keys, domain, "draw"]).drop("balanced_accuracy")


def bootstrap_macro_f1(predictions: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """Equal-domain mean of macro F1 with its interval, recordings resampled within class."""
    c = m.cells(predictions, [*keys, "fold"])
    observed = m.macro_f1(c, [*keys, "fold"]).groupBy(*keys).agg(F.avg("macro_f1").alias("estimate"))
    d = f1_draws(draw_cells(c, keys, ["fold", "truth"], ["pred"], draws, seed), keys)
    d = d.groupBy(*keys, "draw").agg(F.avg("macro_f1").alias("v"))
    return observed.join(interval(d, keys, "v"), keys)


def contrast_draws(paired: DataFrame, stratum: list[str], draws: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Observed per-fold F1 of both sides, and the same per draw, on shared resamples.

    ``paired(fold, ..., truth, left_pred, right_pred)`` has one row per recording.
    """
    cells = paired.groupBy(*stratum, "left_pred", "right_pred").agg(F.count("*").alias("n"))
    drawn = draw_cells(cells, [], stratum, ["left_pred", "right_pred"], draws, seed)

    def both(counts, weight, extra):
        side = lambda name: m.macro_f1(
            counts.groupBy("fold", *extra, "truth", F.col(f"{name}_pred").alias("pred")).agg(F.sum(weight).alias("n")),
            ["fold", *extra]).select("fold", *extra, F.col("macro_f1").alias(name))
        return side("left").join(side("right"), ["fold", *extra])

    return both(cells, "n", []), both(drawn, "m", ["draw"])


def centered_p(draws: DataFrame, keys: list[str], value: str, observed: str, null: float = 0.0) -> DataFrame:
    """(1 + #(draw - obs >= obs - null)) / (B + 1)."""
    # the slack keeps exact ties counted whatever the summation order
    above = F.count_if(F.col(value) - F.col(observed) >= F.col(observed) - null - 1e-12)
    return draws.groupBy(*keys).agg(((1 + above) / (F.count("*") + 1)).alias("raw_p"))


def bootstrap_contrast(paired: DataFrame, stratum: list[str], draws: int, seed: int, null: float = 0.0) -> DataFrame:
    """Mean paired F1 difference and worst-domain difference, with intervals and p."""
    seen, drawn = contrast_draws(paired, stratum, draws, seed)
    mean = F.avg(F.col("left") - F.col("right")).alias("v")
    worst = (F.min("left") - F.min("right")).alias("w")
    observed = seen.agg(mean, worst)
    per = drawn.groupBy("draw").agg(mean, worst)
    per = per.withColumn("obs", observed.select("v").scalar())
    low = interval(per, [], "v")
    wide = interval(per, [], "w").withColumnsRenamed({"low": "worst_low", "high": "worst_high"})
    p = centered_p(per, [], "v", "obs", null)
    one = lambda d, c: d.select(c).scalar().alias(c)
    return observed.select(
        F.col("v").alias("estimate"), F.col("w").alias("worst_estimate"), one(low, "low"), one(low, "high"),
        one(wide, "worst_low"), one(wide, "worst_high"), one(p, "raw_p"))


def mean_difference_draws(values: DataFrame, stratum: list[str], value: str, draws: int, seed: int, block: Column | None = None) -> DataFrame:
    """Resampled mean of ``value`` per stratum and draw."""
    d = draw_sums(values.withColumn("_x", F.array(value, F.lit(1.0))), stratum, "_x", draws, seed, block)
    return d.select(*stratum, "draw", (F.col("sums")[0] / F.col("sums")[1]).alias("v"))


def paired_bootstrap(
    values: DataFrame, keys: list[str], value: str, draws: int, seed: int, block: Column | None = None,
    alternative: str = "superiority", margin: float = 0.0,
) -> DataFrame:
    """One-sided test of a mean recording effect against a margin."""
    if alternative not in ("superiority", "noninferiority"):
        raise ValueError("alternative must be superiority or noninferiority")
    null = margin if alternative == "superiority" else -margin
    observed = values.groupBy(*keys).agg(F.avg(value).alias("estimate"))
    d = mean_difference_draws(values, keys, value, draws, seed, block).join(observed, keys)
    return observed.join(interval(d, keys, "v"), keys).join(centered_p(d, keys, "v", "estimate", null), keys)


def block_bootstrap_ci(rows: DataFrame, keys: list[str], block_id: str, value: str, draws: int, seed: int, order: Column | None = None) -> DataFrame:
    """Interval of a mean under resampling of whole blocks; null below two blocks.

    A mean needs only each block's sum and count, so rows are reduced before any draw.
    """
    blocks = rows.groupBy(*keys, F.col(block_id).alias("recording_id")).agg(
        F.array(F.sum(value).cast("double"), F.count(value).cast("double")).alias("x"))
    d = draw_sums(blocks, keys, "x", draws, seed, order).select(*keys, "draw", (F.col("sums")[0] / F.col("sums")[1]).alias("v"))
    n = blocks.groupBy(*keys).agg(F.count("*").alias("blocks"))
    ci = interval(d, keys, "v")
    out = n.join(ci, keys, "left")
    enough = F.col("blocks") >= 2
    return out.select(*keys, "blocks", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def holm(p_values: DataFrame, keys: list[str], name: str, p: str) -> DataFrame:
    """Step-down adjustment inside each experiment (a handful of hypotheses); null p stays null."""
    finite = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(*keys, finite)
    rank = F.row_number().over(w.orderBy(p, name))
    n = F.count("*").over(w)
    d = p_values.withColumn("_f", finite).withColumn("_r", (n - rank + 1) * F.col(p))
    run = F.max("_r").over(Window.partitionBy(*keys, "_f").orderBy(p, name).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("holm_p", F.when(F.col("_f"), F.least(F.lit(1.0), run))).drop("_f", "_r")
