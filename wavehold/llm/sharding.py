"""Shards of near equal bytes by sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .ranges import placed, splitters


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5, so that equal texts are neighbours in key order; null counts as empty."""
    return F.conv(F.substring(F.md5(text_or_empty(text)), 1, 15), 16, 10).cast("long")


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", per_task: int = 500_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, text_key): every row's shard under the law `bytes`.

    Keys (text_key, doc_id) are sampled with a chance in proportion to their size; quantiles of the
    sample split the key order into ranges of about `per_task` rows, and ranges that come out
    overfull are split again. Sizes are summed inside ranges and shifted by the totals of earlier
    ranges, so shard k takes the rows whose preceding bytes lie in [k, k + 1) shares of the total:
    no shard is off by more than one row's size. Copies of a text are neighbours and stay together
    unless a border falls among them, as it must for a group beyond one share. Size is UTF-8 bytes
    plus 1, for null 1. slot counts a shard's rows from 0 in key order. A null id is ordered first.
    Rows equal in id and text are interchangeable. An empty table gives no rows. Only keys and sizes
    are shuffled, never texts.
    """
    text = F.col(text_col)
    rows = cut(df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key_id"),
        (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        text_key(text).alias("text_key"),
    ))
    cuts = splitters(rows, "text_key", "key_id", "size", per_task, least=4 * shards)
    order = placed(rows, "text_key", "key_id", "size", cuts, "size")
    dealt = cut(order.withColumn("shard", F.floor(F.col("__before") * F.lit(shards).cast("decimal(10,0)") / F.col("__total")).cast("int")))
    # one row per shard
    starts = F.broadcast(dealt.groupBy("shard").agg(F.min("__rank").alias("__first")))
    return dealt.join(starts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__rank") - F.col("__first")).cast("long").alias("slot"), "text_key",
    )


def write_shards(df: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all columns of `df` under path/shard=K in slot order and return the assignment. Ids must be unique.

    Own columns of `df` named shard or slot are written as shard_of_row and slot_of_row.
    """
    dealt = shard_rows(df, shards, id_col, text_col)
    renamed = df.withColumnsRenamed({c: f"{c}_of_row" for c in ("shard", "slot") if c in df.columns})
    out = renamed.join(dealt.select(F.col("doc_id").alias("__id"), "shard", "slot"), F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return dealt
