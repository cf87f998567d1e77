"""Range partitioning by sampled splitters, for keys of two longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _uniform(seed: int, *cols: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def range_of(hi: str, lo: str, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at most the key: a binary search in two literal arrays."""
    if not splitters:
        return F.lit(0)
    highs, lows = F.lit([int(a) for a, _ in splitters]), F.lit([int(b) for _, b in splitters])
    steps = [1 << k for k in range(len(splitters).bit_length() - 1, -1, -1)]

    def step(pos, width):
        at = pos + width - 1
        h, l = F.get(highs, at), F.get(lows, at)
        return F.when((F.col(hi) > h) | ((F.col(hi) == h) & (F.col(lo) >= l)), pos + width).otherwise(pos)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def _draw(df: DataFrame, hi: str, lo: str, size: str, total: int, ranges: int, per_range: int, seed: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample of about ranges * per_range keys, the documented bound."""
    if ranges < 2 or not total:
        return []
    want = ranges * per_range
    sample = df.where(_uniform(seed, hi, lo) * float(total) < F.col(size) * float(want)).select(hi, lo, size).collect()
    weights = sorted((r[0], r[1], max(r[2], total / want)) for r in sample)
    whole, run, out = sum(w for *_, w in weights), 0.0, []
    for a, b, w in weights:
        # a splitter opens a range: the first key past each quantile
        if run >= whole * (len(out) + 1) / ranges and (not out or (a, b) > out[-1]):
            out.append((a, b))
        run += w
    return out


def splitters(df: DataFrame, hi: str, lo: str, size: str, per_task: int, least: int = 1, per_range: int = 32, seed: int = 11, rounds: int = 6) -> list[tuple[int, int]]:
    """Sorted splitters whose ranges hold about `per_task` rows; overfull ones are subdivided by further samples.

    Work per round is one pass over `df` (cut it first). Keys that are equal in both parts cannot be
    parted; a range of one such key stays whole.
    """
    n, total = df.agg(F.count("*"), F.sum(size)).first()
    if not n:
        return []
    found = _draw(df, hi, lo, size, total, max(least, -(-n // per_task)), per_range, seed)
    for k in range(1, rounds + 1):
        at = range_of(hi, lo, found)
        full = df.withColumn("__r", at).groupBy("__r").agg(
            F.count("*").alias("n"), F.sum(size).alias("w"), F.min(F.struct(hi, lo)).alias("a"), F.max(F.struct(hi, lo)).alias("b"),
        ).where((F.col("n") > 2 * per_task) & (F.col("a") < F.col("b"))).collect()
        if not full:
            break
        inside = df.withColumn("__r", at).where(F.col("__r").isin([r["__r"] for r in full]))
        parts = sum(-(-r["n"] // per_task) for r in full)
        found = sorted({*found, *_draw(inside, hi, lo, size, sum(r["w"] for r in full), 2 * parts, per_range, seed + k)})
    return found


def placed(df: DataFrame, hi: str, lo: str, size: str, cuts: list[tuple[int, int]], *ties: str) -> DataFrame:
    """`df` with __range, __rank (from 0) and __before (sizes of all rows before it) in key order.

    Rows are ordered inside their range only; ranges are shifted by the totals of earlier ones.
    """
    from pyspark.sql import Window

    rows = df.withColumn("__range", range_of(hi, lo, cuts))
    totals = rows.groupBy("__range").agg(F.count("*").alias("__n"), F.sum(size).alias("__w"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = cut(totals.select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__w0"),
        F.sum("__w").over(whole).alias("__total"), F.sum("__n").over(whole).alias("__count"),
    ))
    own = Window.partitionBy("__range").orderBy(hi, lo, *ties)
    inner = rows.withColumn("__rank", F.row_number().over(own) - 1).withColumn(
        "__before", F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per range, and as many ranges as splitters in the driver: small by construction
    return inner.join(F.broadcast(offsets), "__range").withColumns({
        "__rank": F.col("__rank") + F.col("__n0"), "__before": F.col("__before") + F.col("__w0"),
    }).drop("__n0", "__w0")
