"""A training corpus from raw documents: toxic texts go, copies go, near copies go, sources are mixed, texts become ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavehold.llm import bpe, mixing, toxicity
from wavehold.llm.common import fresh_path, stored, table
from wavehold.llm.digest_index import DigestIndex, drop_duplicates
from wavehold.llm.near_dup import drop_near_duplicates
from wavehold.llm.queries import TOKENIZERS

REJECT = 0.7


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under REJECT; the model learns from the labels that are not held out."""
    model = toxicity.fit_tables(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < REJECT).select(*docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id, against a fresh digest index."""
    index = DigestIndex(spark, fresh_path(spark, "digest-index"), buckets=max(12, docs.count() // 1_000_000))
    return drop_duplicates(docs, index, batch="documents")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 0.8 or more."""
    return drop_near_duplicates(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the weights of the domains; no document twice."""
    return mixing.mixed_rows(docs, share=(1, 2), epochs=1)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): ids of whole texts, and whether they decode to the text."""
    rows = bpe.encode_decode(docs, f"{TOKENIZERS}/byte_bpe_50k.json")
    return rows.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", toxic_out), ("exact_dedup", copies_out), ("near_dedup", near_copies_out), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL = None  # learned scores and MinHash groups are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
