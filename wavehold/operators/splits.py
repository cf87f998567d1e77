"""Leakage-safe folds and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rng import hash_order
from ..plans.ranking import blocked_row_number, hash_block

ROLES = ("source_fit", "source_calibration", "source_selection", "source_validation")
HELD = "held_target"
SEED = 24021


def groups_of(recordings: DataFrame) -> DataFrame:
    """One row per physical group; a group spanning labels sits in its smallest one."""
    return recordings.groupBy("domain", "group_id").agg(F.min("label").alias("label"))


def stratum_support(recordings: DataFrame) -> DataFrame:
    return groups_of(recordings).groupBy("domain", "label").agg(F.count("*").alias("n_groups"))


def assign_group_roles(recordings: DataFrame, seed: int = SEED, sparse: bool = False) -> DataFrame:
    """Role per group inside each domain x label stratum, from a hash order.

    The order depends only on (seed, group), never on input order. With ``sparse`` a stratum
    of exactly two groups gives one to fit and one to validation.
    """
    g = groups_of(recordings).withColumn("_h", hash_order(F.lit(seed), F.col("group_id")))
    ranked = blocked_row_number(g, ["domain", "label"], ["_h", "group_id"], hash_block("_h"), "_rank")
    names = F.array(*[F.lit(r) for r in ROLES])
    role = F.element_at(names, (F.pmod(F.col("_rank") - 1, F.lit(4)) + 1).cast("int"))
    if sparse:
        ranked = ranked.join(stratum_support(recordings), ["domain", "label"])
        pair = F.when(F.col("_rank") == 1, ROLES[0]).otherwise(ROLES[3])
        role = F.when(F.col("n_groups") == 2, pair).otherwise(role)
    return ranked.select("domain", "label", "group_id", role.alias("role"))


def split_roles(recordings: DataFrame, folds: list[str], seed: int = SEED, sparse: bool = False) -> DataFrame:
    """One row per fold and recording with its role; the fold's domain is held out entirely.

    Every domain x label stratum must have a group for each role; with ``sparse`` two are enough.
    """
    enough = (F.col("n_groups") >= len(ROLES)) | ((F.col("n_groups") == 2) & F.lit(sparse))
    short = stratum_support(recordings).where(~enough).limit(5).collect()
    if short:
        raise ValueError(f"strata with too few groups: {[(r['domain'], r['label'], r['n_groups']) for r in short]}")
    roles = assign_group_roles(recordings, seed, sparse).select("domain", "group_id", "role")
    d = recordings.join(roles, ["domain", "group_id"])
    d = d.withColumn("fold_id", F.explode(F.array(*[F.lit(f) for f in folds])))
    role = F.when(F.col("domain") == F.col("fold_id"), HELD).otherwise(F.col("role"))
    return d.select("fold_id", role.alias("role"), *recordings.columns)


def role_overlaps(members: DataFrame, keys: list[str], member: str = "recording_id") -> DataFrame:
    """Members seen in two roles, as role pairs of a bounded role set (no self join)."""
    seen = members.groupBy(*keys, member).agg(F.array_sort(F.collect_set("role")).alias("_r")).where("size(_r) > 1")
    pairs = F.expr(
        "flatten(transform(_r, (a, k) -> transform(slice(_r, k + 2, size(_r)), b -> struct(a as left_role, b as right_role))))"
    )
    return seen.withColumn("_p", F.explode(pairs)).select(*keys, member, "_p.*")


def materialize_roles(roles: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the listed ids, and the listed ids that do not exist."""
    return rows.join(roles, key), roles.join(rows.select(key), key, "left_anti")


def source_contract(recordings: DataFrame, allowed: Column) -> DataFrame:
    """Closed world: what is not source is target. One row per group with its sides."""
    side = F.when(allowed, "source").otherwise("target")
    d = recordings.withColumn("side", side)
    return d.groupBy("group_id").agg(
        F.count_if(F.col("side") == "source").alias("source_recordings"),
        F.count_if(F.col("side") == "target").alias("target_recordings"),
        (F.count_distinct("side") > 1).alias("leaks"),
    )
