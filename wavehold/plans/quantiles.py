"""Exact quantiles for groups of any size.

Spark's ``percentile`` keeps a group's distinct values in one buffer. That is used while
every group is proven to stay under ``limit`` rows. Larger groups go through interval
refinement: count per bucket (map-side combined), keep the bucket holding the wanted rank,
repeat. The answer is the same order statistic; no value is dropped or approximated.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, sized

LIMIT = 500_000
BUCKETS = 1024
LARGEST = sys.float_info.max


def higher(value: Column, q: float, n: Column | None = None) -> Column:
    """Aggregate: order statistic at ceil(q*(n-1)) of a bounded group."""
    n = F.count(value) if n is None else n
    return F.element_at(
        F.sort_array(F.collect_list(value)), (F.ceil(F.lit(q) * (n - 1)) + 1).cast("int")
    )


def _plain(df: DataFrame, keys, value: str, probs: dict[str, float], kind: str) -> DataFrame:
    v = F.col(value).cast("double")
    if kind == "higher":
        return df.groupBy(*keys).agg(*[higher(v, q).alias(n) for n, q in probs.items()])
    packed = df.groupBy(*keys).agg(
        F.percentile(v, F.array(*[F.lit(float(q)) for q in probs.values()])).alias("_q")
    )
    return packed.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    kind: str = "linear",
    bounded: bool = False,
    sizes: DataFrame | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per group with a column per entry of ``probs``.

    ``kind`` is ``linear`` (interpolated) or ``higher`` (order statistic). ``bounded`` says
    the caller has proven that no group exceeds ``limit``. ``sizes`` is an optional cheap
    table whose ``n`` bounds every group from above; it saves counting ``df`` itself.
    """
    over = F.col("n") > limit
    if bounded or (sizes is not None and sizes.where(over).isEmpty()):
        return _plain(df, keys, value, probs, kind)
    hot = sized(df.groupBy(*keys).agg(F.count(value).alias("n")).where(over).select(*keys))
    if hot.isEmpty():
        return _plain(df, keys, value, probs, kind)
    if not keys:
        return refine_quantiles(df, keys, value, probs, kind, limit)
    cold = _plain(df.join(hot, keys, "left_anti"), keys, value, probs, kind)
    heavy = refine_quantiles(df.join(hot, keys, "left_semi"), keys, value, probs, kind, limit)
    return cold.unionByName(heavy)


def refine_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], kind: str, limit: int
) -> DataFrame:
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if not keys:
        data = data.withColumn("_all", F.lit(1))
    group = keys or ["_all"]
    base = data.groupBy(*group).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    wanted = [
        F.struct(
            F.lit(name).alias("_name"),
            (F.lit(float(q)) * (F.col("_n") - 1)).alias("_at"),
        )
        for name, q in probs.items()
    ]
    want = cut(base.withColumn("_w", F.explode(F.array(*wanted))).select("*", "_w.*").drop("_w"))
    sides = [F.floor("_at"), F.ceil("_at")] if kind == "linear" else [F.ceil("_at")]
    target = want.select(
        *group,
        F.explode(F.array_distinct(F.array(*[s.cast("long") for s in sides]))).alias("_rank"),
        "_lo",
        "_hi",
        F.lit(0).cast("long").alias("_base"),
        F.col("_n").alias("_cnt"),
    ).distinct()
    target = sized(target)
    while not target.where((F.col("_cnt") > limit) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        inside = data.join(target, group).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # infinities and NaN (the largest, as Spark orders it) have buckets of their own
        lo, hi = F.greatest(F.col("_lo"), F.lit(-LARGEST)), F.least(F.col("_hi"), F.lit(LARGEST))
        plain = (F.col("_v") - lo) / (hi - lo)
        share = F.when(hi - lo <= LARGEST, plain).otherwise((F.col("_v") / 2 - lo / 2) / (hi / 2 - lo / 2))
        bucket = (
            F.when(F.isnan("_v"), BUCKETS + 1).when(F.col("_v") > LARGEST, BUCKETS).when(F.col("_v") < -LARGEST, -1)
            .otherwise(F.greatest(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)))
        )
        counted = (
            inside.withColumn("_b", bucket)
            .groupBy(*group, "_rank", "_base", "_b")
            .agg(F.count("*").alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
        )
        upto = (
            Window.partitionBy(*group, "_rank")
            .orderBy("_b")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        target = sized(
            counted.withColumn("_end", F.col("_base") + F.sum("_c").over(upto))
            .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
            .select(
                *group,
                "_rank",
                F.col("_mn").alias("_lo"),
                F.col("_mx").alias("_hi"),
                (F.col("_end") - F.col("_c")).alias("_base"),
                F.col("_c").alias("_cnt"),
            )
        )
    settled = target.where("_lo = _hi").select(*group, "_rank", F.col("_lo").alias("_x"))
    small = (
        data.join(target.where("_lo < _hi"), group)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*group, "_rank", "_base")
        .agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
        .select(*group, "_rank", F.element_at("_vs", (F.col("_rank") - F.col("_base") + 1).cast("int")).alias("_x"))
    )
    found = cut(settled.unionByName(small))
    named = want.select(*group, "_name", "_at")
    up = named.withColumn("_rank", F.ceil("_at").cast("long")).join(found, [*group, "_rank"])
    up = up.select(*group, "_name", "_at", F.col("_x").alias("_up"))
    if kind == "linear":
        down = named.withColumn("_rank", F.floor("_at").cast("long")).join(found, [*group, "_rank"])
        down = down.select(*group, "_name", F.col("_x").alias("_down"))
        both = up.join(down, [*group, "_name"])
        result = F.col("_down") + (F.col("_up") - F.col("_down")) * (F.col("_at") - F.floor("_at"))
    else:
        both, result = up, F.col("_up")
    wide = both.groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == n, result)).alias(n) for n in probs]
    )
    return wide if keys else wide.drop("_all")
