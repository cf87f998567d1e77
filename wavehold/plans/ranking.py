"""Ranks, running sums and neighbours inside groups of any size.

A plain window function sends one group to one task. Here the order is cut into blocks
(any expression that never decreases along the order), the window runs inside
``(group, block)``, and the small table of block totals supplies what earlier blocks add.
A group holding a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK_IDS = 1 << 16


def id_block(column: str, width: int = BLOCK_IDS) -> Column:
    """Block for unique integer ids: at most ``width`` rows per (group, block)."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def _as_number(df: DataFrame, column: str) -> Column:
    """Times as microseconds, so that no time zone or leap in local time touches their order."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(column)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column)) if kind == "timestamp_ntz" else F.col(column)


def _search(value: Column, edge: Column, edges: int) -> Column:
    """How many of the sorted edges are at most ``value``, by halving."""
    steps = F.lit([1 << k for k in range(edges.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(value >= F.get(edge, at + step - 1), at + step).otherwise(at))


def density_block(df: DataFrame, order: list[str], width: int = BLOCK_IDS, most: int = 1 << 14, sample: int = 16) -> Column:
    """Block of the order of ``order`` columns (group keys first), edges at measured quantiles.

    About ``width`` rows lie in a block however dense a stretch of one group is, and groups smaller
    than that stay whole. Columns are text, whole numbers or times. Beyond ``most`` blocks they grow
    instead, so that at most about ``most`` x ``sample`` places come to the driver. Edges change the
    layout only, never a rank or a sum; rows equal in all of ``order`` share a block.
    """
    rows = df.count()
    blocks = min(most, -(-rows // width))
    if blocks <= 1:
        return F.lit(0)
    names = [f"c{k}" for k in range(len(order))]
    place = df.select(*[_as_number(df, c).alias(n) for c, n in zip(order, names)])
    share = int(min(1.0, sample * blocks / rows) * (1 << 30))
    drawn = place.where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < share).distinct().orderBy(*names).collect()
    edges = [drawn[k] for k in sorted({len(drawn) * k // blocks for k in range(1, blocks)})] if drawn else []
    if not edges:
        return F.lit(0)
    # one literal, folded once, instead of an expression per edge
    text = json.dumps([row.asDict() for row in edges])
    edge = F.from_json(F.lit(text), T.ArrayType(place.schema))
    return _search(F.struct(*[_as_number(df, c).alias(n) for c, n in zip(order, names)]), edge, len(edges))


def text_block(df: DataFrame, column: str, width: int = BLOCK_IDS, sample: int = 64) -> Column:
    """Block for any text order: boundaries measured on the column, about ``width`` rows apart.

    About ``sample`` distinct values per block come to the driver; ids that share a long prefix are
    parted as well as any others. Boundaries change the layout only, never a rank or a sum.
    """
    blocks = -(-df.count() // width)
    if blocks <= 1:
        return F.lit(0)
    rows = df.select(F.col(column).cast("string").alias("v")).where("v is not null")
    share = int(min(1.0, sample / width) * (1 << 30))
    drawn = sorted(r["v"] for r in rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).distinct().collect())
    # Python orders code points and Spark orders UTF-8 bytes: the same order
    edges = sorted({drawn[len(drawn) * k // blocks] for k in range(1, blocks)}) if drawn else []
    if not edges:
        return F.lit(0)
    return _search(F.col(column).cast("string"), F.lit(edges), len(edges))


def hash_block(column: str, digits: int = 3) -> Column:
    """Block for hexadecimal hashes used as an order."""
    return F.substring(F.col(column), 1, digits)


def value_block(value: Column, steps: int = 4096) -> Column:
    """Monotone block of any finite double: sign, binary exponent, mantissa step."""
    v = value.cast("double")
    size = F.greatest(F.abs(v), F.lit(1e-300))
    exponent = F.floor(F.log2(size))
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * steps)
    code = (exponent + 2000) * (2 * steps) + mantissa + 1
    return F.when(v > 0, code).when(v < 0, -code).otherwise(F.lit(0)).cast("long")


def _grouped(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Adds the (keys, block) struct. Window, totals and rejoin all partition by this one
    column, so the rows are shuffled once; a struct also compares equal when a key is null."""
    return df.withColumn("_g", F.struct(*keys, block.alias("_block")))


def _within(keys: list[str]):
    return Window.partitionBy(*[F.col(f"_g.{k}") for k in keys]).orderBy(F.col("_g._block"))


def _totals(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """What earlier blocks of the group add to each sum: one small row per (keys, block)."""
    block = df.groupBy("_g").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = _within(keys).rowsBetween(Window.unboundedPreceding, -1)
    return block.select(
        "_g", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums])


def blocked_row_number(df: DataFrame, keys: list[str], order: list, block: Column, out: str) -> DataFrame:
    """1-based rank of each row in its group, in ``order``."""
    d = _grouped(df, keys, block)
    totals = _totals(d, keys, {"n": F.lit(1)})
    local = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    joined = d.withColumn("_local", local).join(totals, "_g")
    return joined.withColumn(out, (F.col("_local") + F.col("_o_n")).cast("long")).drop("_g", "_local", "_o_n")


def blocked_running_sum(
    df: DataFrame, keys: list[str], order: list, block: Column, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums; ``sums`` maps output name to the summed column."""
    d = _grouped(df, keys, block)
    totals = _totals(d, keys, sums)
    frame = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, column in sums.items():
        d = d.withColumn(f"_l_{name}", F.sum(column).over(frame))
    joined = d.join(totals, "_g")
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_l_{name}") + F.col(f"_o_{name}"))
    return joined.drop("_g", *[f"_l_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def blocked_lag(
    df: DataFrame, keys: list[str], order: list[str], block: Column, columns: list[str]
) -> DataFrame:
    """Previous row's ``columns`` as ``last_<column>``; null on a group's first row."""
    d = _grouped(df, keys, block)
    packed = F.struct(*order, *[c for c in columns if c not in order])
    tails = d.groupBy("_g").agg(F.max(packed).alias("_tail"))
    tails = tails.select("_g", F.lag("_tail").over(_within(keys)).alias("_last_tail"))
    joined = d.withColumn("_lag", F.lag(packed).over(Window.partitionBy("_g").orderBy(*order))).join(tails, "_g")
    pick = F.coalesce(F.col("_lag"), F.col("_last_tail"))
    for column in columns:
        joined = joined.withColumn(f"last_{column}", pick[column])
    return joined.drop("_g", "_lag", "_last_tail")


def blocked_lead(
    df: DataFrame, keys: list[str], order: list[str], block: Column, columns: list[str]
) -> DataFrame:
    """Next row's ``columns`` as ``next_<column>``; null on a group's last row."""
    d = _grouped(df, keys, block)
    packed = F.struct(*order, *[c for c in columns if c not in order])
    first = d.groupBy("_g").agg(F.min(packed).alias("_head"))
    heads = first.select("_g", F.lead("_head").over(_within(keys)).alias("_next_head"))
    local = Window.partitionBy("_g").orderBy(*order)
    joined = d.withColumn("_lead", F.lead(packed).over(local)).join(heads, "_g")
    pick = F.coalesce(F.col("_lead"), F.col("_next_head"))
    for column in columns:
        joined = joined.withColumn(f"next_{column}", pick[column])
    return joined.drop("_g", "_lead", "_next_head")
