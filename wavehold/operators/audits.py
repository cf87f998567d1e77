"""Leakage audits and permutation controls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kernels as k
from ..plans.quantiles import exact_quantiles
from ..plans.ranking import blocked_lead, blocked_row_number, text_block
from ..session import cut
from . import probe
from .fit import mean_vectors
from .metrics import argmax, single
from .splits import role_overlaps
from .transforms import map_windows


def duplicate_audit(rows: DataFrame, digest: Column) -> DataFrame:
    """Surplus copies, and contents present in more than one role."""
    per = rows.withColumn("_d", digest).groupBy("_d").agg(
        F.count("*").alias("copies"), F.count_distinct("role").alias("roles"))
    return per.agg(
        F.sum(F.col("copies") - 1).alias("surplus"), F.count_if(F.col("copies") > 1).alias("repeated"),
        F.count_if(F.col("roles") > 1).alias("cross_role"))


def signal_digest(i: str, q: str | None = None) -> Column:
    """Content hash of a window's samples."""
    text = F.to_json(F.struct(*[c for c in (i, q) if c]))
    return F.sha2(text, 256)


def fingerprints(windows: DataFrame, role: str, i: str = "i", q: str | None = "q") -> DataFrame:
    """Centred unit-length mean log envelope spectrum per recording."""
    spectra = map_windows(windows, ["recording_id", role], {"P": k.log_envelope_256}, i, q)
    mean = mean_vectors(spectra, ["recording_id"], [single(role, "role").alias("role")])
    mean = mean.withColumn("_m", F.expr("aggregate(values, 0.0D, (t, z) -> t + z) / size(values)"))
    mean = mean.withColumn("_c", F.expr("transform(values, z -> z - _m)"))
    norm = F.greatest(F.sqrt(F.expr("aggregate(_c, 0.0D, (t, z) -> t + z * z)")), F.lit(1e-12))
    return mean.withColumn("_n", norm).select("recording_id", "role", F.expr("transform(_c, z -> z / _n)").alias("unit"))


PROJECTIONS = 8
CELL_AXES = 3

_dot = lambda x, y: F.expr(f"aggregate(zip_with({x}, {y}, (a, b) -> a * b), 0.0D, (t, z) -> t + z)")
_apart = lambda x, y: F.sqrt(F.expr(f"aggregate(zip_with({x}, {y}, (a, b) -> (a - b) * (a - b)), 0.0D, (t, z) -> t + z)"))


def near_duplicates(prints: DataFrame, threshold: float = 0.999) -> DataFrame:
    """(recording_id, role, class_id, class_size, links): cross-role recordings with fingerprints of cosine >= threshold, exactly.

    ``class_id`` is the least recording with an equal fingerprint, ``links`` the recordings of other roles
    within the threshold. Cosine t on unit vectors means distance <= d = sqrt(2 - 2t). Projections on
    orthonormal directions never lengthen a difference, so linked vectors lie in the same or
    neighbouring cells of side d. In each cell the classes within d / 2 of its pivot form a ball, every
    other class a ball of its own. By the triangle inequality two balls are wholly linked, wholly
    apart, or open; only classes of open balls are compared, so a crowd of nearly equal recordings is
    counted without its pairs.
    """
    d = math.sqrt(max(2.0 - 2.0 * threshold, 1e-12))
    reach, slack = d * (1 + 1e-9), 1e-9
    axis = lambda j: F.expr(
        f"aggregate(transform(unit, (z, p) -> z * cos(pi() * (p + 0.5D) * {j} / size(unit)) * sqrt(2.0D / size(unit))), 0.0D, (t, z) -> t + z)")
    members = cut(prints.select("recording_id", "role", "unit", F.sha2(F.to_json(F.struct("unit")), 256).alias("fp")))
    same = members.groupBy("fp").agg(F.first("unit").alias("unit"), F.min("recording_id").alias("class_id"), F.count("*").alias("class_size"))
    same = same.withColumn("p", F.array(*[axis(j + 1) for j in range(PROJECTIONS)]))
    same = cut(same.withColumn("cell", F.transform(F.slice("p", 1, CELL_AXES), lambda z: F.floor(z / reach))))
    # the pivot is the class nearest to the middle of its cell, so that an outlier seldom is
    middle = same.groupBy("cell").agg(F.array(*[F.avg(F.col("p")[j]) for j in range(PROJECTIONS)]).alias("_mid"))
    pivots = same.join(middle, "cell").groupBy("cell").agg(F.min(F.struct(_apart("p", "_mid"), "fp", "unit")).alias("pivot"))
    placed = same.join(pivots, "cell").withColumn("_far", _apart("unit", "pivot.unit"))
    inner = F.col("_far") <= d / 2 - slack
    placed = cut(placed.select(
        "fp", "unit", "p", "cell", F.when(inner, F.col("pivot.fp")).otherwise(F.col("fp")).alias("ball"), F.when(inner, F.col("_far")).otherwise(0.0).alias("_far")))
    roles = members.groupBy("fp", "role").agg(F.count("*").alias("n"))
    by_ball = placed.select("fp", "ball").join(roles, "fp").groupBy("ball", "role").agg(F.sum("n").alias("n"))
    radius = placed.groupBy("ball").agg(F.max("_far").alias("radius"))
    balls = cut(placed.where("fp = ball").select("ball", "cell", "p", "unit").join(radius, "ball"))
    light = balls.select("ball", "cell", "p", "radius")
    steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in s]) for s in _offsets(CELL_AXES)])
    left = light.select(*[F.col(c).alias(n) for c, n in (("ball", "l"), ("cell", "cell"), ("p", "lp"), ("radius", "lr"))])
    right = light.withColumn("_s", F.explode(steps)).select(
        F.col("ball").alias("r"), F.expr("zip_with(cell, _s, (a, b) -> a + b)").alias("cell"), F.col("p").alias("rp"), F.col("radius").alias("rr"))
    near = left.join(right, "cell").where((F.col("l") < F.col("r")) & (_apart("lp", "rp") - F.col("lr") - F.col("rr") <= reach)).select("l", "r", "lr", "rr")
    units = balls.select("ball", "unit")
    near = near.join(units.select(F.col("ball").alias("l"), F.col("unit").alias("lu")), "l").join(units.select(F.col("ball").alias("r"), F.col("unit").alias("ru")), "r")
    near = near.select("l", "r", "lr", "rr", _apart("lu", "ru").alias("between"))
    wholly = F.col("between") + F.col("lr") + F.col("rr") <= d - slack
    near = cut(near.where(F.col("between") - F.col("lr") - F.col("rr") <= reach).select("l", "r", wholly.alias("wholly")))
    own = placed.select("fp", F.col("ball").alias("l"), "unit")
    both = lambda pairs: pairs.select("l", "r").unionByName(pairs.select(F.col("r").alias("l"), F.col("l").alias("r")))
    inside = placed.select("fp", "ball").join(by_ball, "ball").select("fp", "role", "n")
    linked = both(near.where("wholly")).join(own.select("fp", "l"), "l").join(by_ball.withColumnRenamed("ball", "r"), "r").select("fp", "role", "n")
    other = own.select(F.col("fp").alias("fp2"), F.col("l").alias("r"), F.col("unit").alias("unit2"))
    open_ = near.where("not wholly").join(own, "l").join(other, "r").where(_dot("unit", "unit2") >= threshold).select("fp", "fp2")
    pairs = open_.unionByName(open_.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2")))
    found = pairs.join(roles.withColumnRenamed("fp", "fp2"), "fp2").select("fp", "role", "n")
    links = inside.unionByName(linked).unionByName(found).groupBy("fp", "role").agg(F.sum("n").alias("n"))
    links = links.withColumnRenamed("role", "_other")
    counted = members.select("recording_id", "role", "fp").join(links, "fp").groupBy("recording_id", "role", "fp").agg(
        F.sum(F.when(~F.col("role").eqNullSafe(F.col("_other")), F.col("n")).otherwise(0)).alias("links"))
    return counted.join(same.select("fp", "class_id", "class_size"), "fp").select("recording_id", "role", "class_id", "class_size", "links")


def _offsets(axes: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(axes):
        out = [(*o, v) for o in out for v in (-1, 0, 1)]
    return out


def temporal_adjacency(windows: DataFrame, gap: int, block: Column) -> DataFrame:
    """Consecutive windows of a recording closer than ``gap`` samples."""
    d = blocked_lead(windows, ["recording_id"], ["start"], block, ["start"])
    return d.where(F.col("next_start") - F.col("end") < gap).select("recording_id", "start", "next_start")


def window_violations(windows: DataFrame, length: int) -> DataFrame:
    """Rows breaking the window contract, and recordings that cross labels."""
    faults = F.array_compact(F.array(
        F.when(F.col("start") < 0, F.lit("negative_start")),
        F.when(F.col("end") - F.col("start") != length, F.lit("boundary")),
        F.when(F.size("x") != length, F.lit("shape")),
    ))
    row = windows.select("recording_id", F.explode(faults).alias("fault"))
    label = windows.groupBy("recording_id").agg(F.count_distinct("label").alias("n")).where("n > 1").select(
        "recording_id", F.lit("label").alias("fault"))
    return row.unionByName(label)


def group_leakage(members: DataFrame) -> DataFrame:
    """Recordings in two roles of one fold."""
    return role_overlaps(members, ["fold_id"])


def probe_accuracy(recordings: DataFrame, keys: list[str], block: Column | None = None, l2: float = 0.05) -> DataFrame:
    """Domain probe: ridge on every other recording of each domain, accuracy on the rest.

    ``cls`` is the domain index. Null where a key has fewer than two domains or a domain has
    fewer than two recordings: unavailable is never a pass.
    """
    ranked = blocked_row_number(recordings, [*keys, "cls"], ["recording_id"], text_block(recordings, "recording_id") if block is None else block, "_rank")
    d = ranked.withColumn("role", F.when(F.col("_rank") % 2 == 1, "source_fit").otherwise("test"))
    support = recordings.groupBy(*keys, "cls").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        ((F.count("*") >= 2) & (F.min("n") >= 2)).alias("usable"))
    top = recordings.agg(F.max("cls").alias("c")).first()["c"]
    usable = d.join(support.where("usable"), keys, "left_semi") if keys else d
    model = probe.fit_ridge(usable, keys, top + 1, l2)
    scored = probe.score_ridge(usable.where("role = 'test'"), model, keys, ["cls"], top + 1)
    hit = (argmax("probs") == F.col("cls")).cast("double")
    accuracy = scored.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))
    return support.join(accuracy, keys, "left") if keys else accuracy


def null_quantile(values: DataFrame, keys: list[str], value: str, q: float = 0.95) -> DataFrame:
    return exact_quantiles(values, keys, value, {"threshold": q}, kind="higher")


def integrity_report(audits: list[DataFrame]) -> DataFrame:
    """(audit, failures) rows -> pass or fail with a content hash of the evidence."""
    rows = audits[0]
    for a in audits[1:]:
        rows = rows.unionByName(a)
    status = F.when(F.col("failures").isNull(), "not_applicable").when(F.col("failures") > 0, "failed").otherwise("passed")
    evidence = F.sha2(F.concat_ws("|", "audit", F.col("failures").cast("string")), 256)
    return rows.select("audit", status.alias("status"), F.lit(True).alias("critical"), evidence.alias("evidence"))


def consistency_mismatches(recorded: DataFrame, observed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Linked artifacts that disagree, plus keys present on one side only."""
    right = observed.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_seen"))
    d = recorded.withColumn("_listed", F.lit(True)).join(right, key, "full_outer")
    faults = F.array_compact(F.array(
        F.when(F.col("_seen").isNull(), F.lit("missing")),
        F.when(F.col("_listed").isNull(), F.lit("unlisted")),
        *[F.when(F.col("_seen") & F.col("_listed") & ~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in columns],
    ))
    return d.select(key, F.explode(faults).alias("fault"))


def failed_checks(families: DataFrame) -> DataFrame:
    """Names of failed checks per family; a non-finite probe reads as not estimable."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c))
    d = families.withColumn("probe", finite("probe")).withColumn("shuffle_q95", finite("shuffle_q95"))
    failed = F.array_compact(F.array(
        F.when(~F.col("selected"), F.lit("selected")),
        F.when(~F.col("independent_pass"), F.lit("independent_value")),
        F.when(~F.coalesce(F.col("probe") <= F.col("shuffle_q95"), F.lit(False)), F.lit("shortcut")),
        F.when(F.col("degenerate"), F.lit("representation_degenerate")),
        F.when(F.col("probe").isNull() | F.col("shuffle_q95").isNull(), F.lit("probe_not_estimable")),
    ))
    return d.withColumn("failed_checks", failed)
