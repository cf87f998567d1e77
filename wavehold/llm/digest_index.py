"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, cut, text_or_empty


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of a text without its white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), WHITE + "++", ""), 256))


class DigestIndex:
    """Digests of all texts seen so far, as a bucketed and sorted Parquet table.

    The table lies at `location` (shared storage) and can be opened again by any later session with
    the same bucket number. `add` decides a batch: its digests are aggregated map-side, so a group
    of copies crosses the network as a few rows; what the index knows is removed by a sort-merge
    anti-join on the bucketing key, and the rest is appended.

    Rules. Of equal texts in a batch the row with most code points stays, then the smallest id; a
    null id comes after all others. A text that an earlier batch brought keeps that batch's row.
    Adding a batch again under the same name changes nothing. Rows that share id and text share
    their fate. Empty and null texts are equal to each other. Empty batches append nothing. Other
    columns of the batch are not read.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark = spark
        self.name = f"digest_index_{hashlib.md5(location.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{location}'"
        )
        self.buckets = int(buckets)
        self.location = location

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, digest), one row per row of `df`."""
        batch = batch or uuid.uuid4().hex
        rows = cut(df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            text_digest(F.col(text_col)).alias("digest"),
            F.length(text_or_empty(F.col(text_col))).alias("points"),
        ))
        best = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"))
        groups = cut(rows.groupBy("digest").agg(F.min(best)["id"].alias("keep_id"), F.count("*").alias("n_rows")))
        known = self.table().select("digest").hint("merge")
        fresh = groups.join(known, "digest", "left_anti")
        (
            fresh.select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.insertInto(self.name)
        )
        index = self.table().select("digest", F.col("keep_id").alias("first_id"), F.col("n_rows").alias("first_rows"), "batch")
        of_batch = F.col("batch") == batch
        decided = groups.join(index.hint("merge"), "digest").select(
            "digest", F.col("first_id").alias("keep_id"), of_batch.alias("fresh"),
            F.when(of_batch, F.col("n_rows")).otherwise(F.col("n_rows") + F.col("first_rows")).alias("group_size"),
        )
        # both sides are plain exchanges here, so that Spark can split a group that holds many rows
        decided = cut(decided)
        return rows.join(decided, "digest").select(
            "doc_id", "keep_id", "group_size", (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest",
        )


def drop_duplicates(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Rows of `df` that stay, with all their columns."""
    lost = index.add(df, id_col, text_col, batch).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    return df.withColumn("__text_digest", text_digest(F.col(text_col))).join(
        lost, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_digest") == F.col("__digest")), "left_anti",
    ).drop("__text_digest")
