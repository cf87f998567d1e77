"""Ordered relations between feature families, per perturbed sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rng import hash_order
from ..plans.quantiles import exact_quantiles
from ..plans.ranking import blocked_lag, blocked_row_number, blocked_running_sum, hash_block, id_block
from ..session import cut

CELL = ["nuisance", "severity"]
TOL = 1e-6


def _sum(expression: str) -> Column:
    return F.expr(f"aggregate({expression}, 0.0D, (t, z) -> t + z)")


def mean_gap(a: str, b: str) -> Column:
    return _sum(f"zip_with({a}, {b}, (x, y) -> abs(x - y))") / F.size(a)


def sensitivity_scale(pairs: DataFrame, epsilon: float = 1e-8, sizes: DataFrame | None = None) -> DataFrame:
    """kappa per family and case: high quantile over recordings of the median response ratio."""
    change = F.sqrt(_sum("zip_with(perturbed_logp, clean_logp, (x, y) -> pow(x - y, 2))"))
    ratio = change / (mean_gap("perturbed", "clean") + epsilon)
    d = pairs.select("family", *CELL, "recording_id", ratio.alias("ratio"))
    per = exact_quantiles(d, ["family", *CELL, "recording_id"], "ratio", {"ratio": 0.5}, sizes=sizes)
    return exact_quantiles(per, ["family", *CELL], "ratio", {"kappa": 0.95}, kind="higher", sizes=sizes)


def family_risk_margin(pairs: DataFrame, scales: DataFrame) -> DataFrame:
    """risk = kappa * mean |change|; margin = log p(true) minus the best other class."""
    d = pairs.join(scales, ["family", *CELL], "left")
    kappa = F.coalesce("kappa", F.expr("cast(raise_error('missing sensitivity scale') as double)"))
    others = F.expr("array_max(filter(perturbed_logp, (p, k) -> k <> truth))")
    return d.select(
        "sample_index", "recording_id", "truth", *CELL, "family",
        (kappa * mean_gap("perturbed", "clean")).alias("risk"),
        (F.get(F.col("perturbed_logp"), F.col("truth")) - others).alias("margin"),
    )


def build_relations(evidence: DataFrame, tolerance: float = TOL) -> DataFrame:
    """Winner and loser of each comparable family pair of a sample.

    A sample has a handful of families, so its pairs are formed inside one small row.
    """
    rows = evidence.groupBy("sample_index", "recording_id", "truth", *CELL).agg(
        F.array_sort(F.collect_list(F.struct("family", "risk", "margin"))).alias("f"))
    t = tolerance
    beats = lambda a, b: (
        f"({a}.risk <= {b}.risk + {t}D and {a}.margin >= {b}.margin - {t}D"
        f" and ({a}.risk < {b}.risk - {t}D or {a}.margin > {b}.margin + {t}D))")
    pairs = F.expr(
        "flatten(transform(f, (a, k) -> transform(slice(f, k + 2, size(f)), b -> "
        f"case when {beats('a', 'b')} and not {beats('b', 'a')} then struct(a.family as winner, b.family as loser) "
        f"when {beats('b', 'a')} and not {beats('a', 'b')} then struct(b.family as winner, a.family as loser) end)))")
    d = rows.withColumn("_p", F.explode(F.array_compact(pairs)))
    return d.select("sample_index", "recording_id", "truth", *CELL, "_p.*")


def relation_coverage(evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """Share of recordings with a relation, per perturbation family."""
    all_ = evidence.groupBy("nuisance").agg(F.count_distinct("recording_id").alias("recordings"))
    got = relations.groupBy("nuisance").agg(F.count_distinct("recording_id").alias("covered"))
    d = all_.join(got, "nuisance", "left").na.fill(0, ["covered"])
    return d.withColumn("share", F.col("covered") / F.col("recordings"))


def missing_cells(evidence: DataFrame, relations: DataFrame) -> DataFrame:
    cell = ["recording_id", *CELL]
    return evidence.select(*cell).distinct().join(relations.select(*cell).distinct(), cell, "left_anti")


def relation_weights(relations: DataFrame) -> DataFrame:
    """Equal mass over recordings, then perturbations, severities and pairs; sums to one."""
    cells = relations.groupBy("recording_id", *CELL).agg(F.count("*").alias("_pairs"))
    kinds = cells.groupBy("recording_id", "nuisance").agg(F.count("*").alias("_severities"))
    records = kinds.groupBy("recording_id").agg(F.count("*").alias("_kinds"))
    total = records.agg(F.count("*").alias("n")).scalar()
    mass = cells.join(kinds, ["recording_id", "nuisance"]).join(records, "recording_id").select(
        "recording_id", *CELL,
        (1.0 / (total * F.col("_kinds") * F.col("_severities") * F.col("_pairs"))).alias("weight"))
    return relations.join(mass, ["recording_id", *CELL])


def relation_loss(relations: DataFrame, gates: DataFrame, margin: float = 0.2) -> DataFrame:
    """Hinge on gate logits, averaged over pairs, severities, perturbations and recordings in turn.

    ``gates(sample_index, gate)`` holds one logit per family; an unknown sample fails.
    """
    d = relations.join(gates, "sample_index", "left")
    gate = F.coalesce(F.col("gate"), F.expr("cast(raise_error('relation without gate') as array<double>)"))
    d = d.withColumn("_g", gate)
    hinge = F.greatest(F.get("_g", F.col("loser")) - F.get("_g", F.col("winner")) + margin, F.lit(0.0))
    d = d.groupBy("recording_id", *CELL).agg(F.avg(hinge).alias("v"))
    d = d.groupBy("recording_id", "nuisance").agg(F.avg("v").alias("v"))
    d = d.groupBy("recording_id").agg(F.avg("v").alias("v"))
    return d.agg(F.avg("v").alias("loss"))


def shuffle_relations(relations: DataFrame, seed: int) -> DataFrame:
    """Permute (winner, loser) inside (label, perturbation, severity); never the identity.

    Both orders are ranked in blocks, so a stratum of any size stays distributed.
    """
    stratum = ["truth", *CELL]
    d = relations.withColumn("_h", hash_order(F.lit(seed), F.col("sample_index"), F.col("winner"), F.col("loser")))
    d = blocked_row_number(d, stratum, ["sample_index", "winner", "loser"], id_block("sample_index"), "_at")
    d = blocked_row_number(d, stratum, ["_h"], hash_block("_h"), "_to")
    shape = d.groupBy(*stratum).agg(F.count("*").alias("_n"), F.bool_and(F.col("_at") == F.col("_to")).alias("_same"))
    d = d.join(shape, stratum)
    to = F.when(F.col("_same"), F.col("_to") % F.col("_n") + 1).otherwise(F.col("_to"))
    source = d.select(*stratum, to.alias("_at"), F.col("winner").alias("_w"), F.col("loser").alias("_l"))
    out = d.join(source, [*stratum, "_at"])
    return out.select(
        "sample_index", "recording_id", *stratum, F.col("winner").alias("old_winner"), F.col("loser").alias("old_loser"),
        F.col("_w").alias("winner"), F.col("_l").alias("loser"))


def require_changed(shuffled: DataFrame) -> DataFrame:
    """Fail when the permutation left every relation as it was."""
    moved = shuffled.where("old_winner <> winner or old_loser <> loser")
    if moved.isEmpty():
        raise RuntimeError("the permutation control changed nothing")
    return shuffled


def remap_after_deletion(relations: DataFrame, deleted: Column) -> DataFrame:
    """Drop relations touching a family and close the gap in the indexes."""
    kept = relations.where((F.col("winner") != deleted) & (F.col("loser") != deleted))
    move = lambda c: F.when(F.col(c) > deleted, F.col(c) - 1).otherwise(F.col(c)).cast("int")
    return kept.withColumn("winner", move("winner")).withColumn("loser", move("loser"))


def sample_relations(weighted: DataFrame, draws: DataFrame, buckets: int = 4096) -> DataFrame:
    """Weighted draws with replacement: each uniform ``u`` meets the relation whose interval holds it.

    Intervals end at a blocked running sum and begin where the one before ends, the last one ends
    at 1, so that every draw has exactly one. The range join is an equi-join on buckets of [0, 1),
    and an interval is repeated only for the buckets it covers.
    """
    order = ["sample_index", "winner", "loser"]
    d = blocked_running_sum(
        weighted, [], order, id_block("sample_index"), {"_hi": F.col("weight")})
    d = cut(d)
    top = d.agg(F.max("_hi")).first()[0]
    d = blocked_lag(d, [], order, id_block("sample_index"), ["_hi"]).withColumn("_lo", F.coalesce("last__hi", F.lit(0.0))).drop("last__hi")
    d = d.withColumn("_hi", F.when(F.col("_hi") == top, 1.0).otherwise(F.col("_hi")))
    edge = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1)).cast("int")
    spans = d.withColumn("_b", F.explode(F.sequence(edge(F.greatest(F.col("_lo"), F.lit(0.0))), edge(F.col("_hi")))))
    hit = (F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_hi"))
    return draws.withColumn("_b", edge(F.col("u"))).join(spans, "_b").where(hit).drop("_b", "_lo", "_hi")


def routing_summary(gates: DataFrame, keys: list[str], families: int) -> DataFrame:
    """Mean gate weight per family and mean entropy."""
    entropy = F.expr("-aggregate(gate, 0.0D, (t, p) -> t + if(p > 0, p * ln(p), 0.0D))")
    return gates.groupBy(*keys).agg(
        *[F.avg(F.get("gate", F.lit(k))).alias(f"weight_{k}") for k in range(families)], F.avg(entropy).alias("entropy"))
