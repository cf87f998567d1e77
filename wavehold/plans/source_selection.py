"""Choose one representation per fold from source data alone.

Raw maps depend on (family, parameters) and, for the cyclic family, on the fold whose source
recordings fitted the frequencies. Each distinct raw map is computed once per window; folds
and configurations refer to it, so 25 candidates do not mean 25 transforms. Folds are a column
and run side by side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import costs, fit, metrics as m, perturb, probe, selection, transforms as tr, windows as wo
from ..session import cut
from .quantiles import exact_quantiles


def cyclic_frequencies(windows: DataFrame, roles: DataFrame, counts: set[int], frame: int, seed: int = 24024) -> dict:
    """(fold, count, permuted) -> frequencies. Only a few numbers per fold reach the driver."""
    from ..functions.rng import hash_order

    length = windows.select(F.size("i").alias("n")).first()["n"]
    scores = cut(fit.cyclic_scores(windows, roles))
    out = {}
    for count in sorted(counts):
        bins = fit.cyclic_bins(scores, count, length, frame)
        mixed = fit.permute_bins(bins, hash_order(F.lit(seed), F.col("fold_id"), F.col("pos"))) if count > 1 else bins
        rows = bins.withColumn("p", F.lit(False)).unionByName(mixed.withColumn("p", F.lit(True)).select("fold_id", "pos", "alpha", "p"))
        for r in rows.orderBy("fold_id", "p", "pos").collect():
            out.setdefault((r["fold_id"], count, r["p"]), []).append(r["alpha"])
    return out


def _raw_families(configs, folds, alphas):
    """name -> kernel of every distinct raw map, and (fold, config, family, name, mode) members."""
    kernels, members = {}, []
    for c in configs:
        for fold in folds:
            for family, key in c.raw().items():
                name = tr.raw_key(key) + (f"@{fold}" if family == "C" else "")
                if name not in kernels:
                    own = {(a, p): v for (f, a, p), v in alphas.items() if f == fold}
                    kernels[name] = tr.raw_kernel(key, own)
                mode = "energy" if family == "E" else c.normalization
                members.append((fold, c.stable_id, family, name, mode))
    return kernels, members


def _member_table(spark, members) -> DataFrame:
    return spark.createDataFrame(members, "fold_id string, config_id string, member string, family string, mode string")


def fit_scalers(raw: DataFrame, kernels: dict, members: list[tuple]) -> DataFrame:
    """Offset and scale per (fold, raw map, mode), from source-fit windows."""
    places = {name: k + 1 for k, name in enumerate(kernels)}
    fitted = raw.select("recording_id", "maps", F.inline("roles")).where("role = 'source_fit'")

    def pick(mode):
        wanted = sorted({(fold, name, places[name]) for fold, _, _, name, m in members if m == mode})
        wanted = _local(raw.sparkSession, wanted, fold_id=pa.string(), family=pa.string(), at=pa.int32())
        return fitted.join(wanted, "fold_id").select("fold_id", "family", "role", "recording_id", F.element_at("maps", F.col("at")).alias("values"))

    keys = ["fold_id", "family"]
    ref = fit.energy_reference(pick("energy"), keys).select(*keys, F.lit("energy").alias("mode"), F.lit(0.0).alias("offset"), F.col("reference").alias("scale"))
    parts = [fit.fit_percentile(pick("percentile"), keys), fit.fit_zscore(pick("zscore"), keys), fit.fit_none(pick("none"), keys), ref]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out)


def _local(spark, rows: list[tuple], **kinds) -> DataFrame:
    """A table of a few rows whose size Spark knows, so that joins with it move nothing else."""
    return spark.createDataFrame(pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds)))


def _one(x: Column, mode: Column, offset: Column, scale: Column) -> Column:
    z = (x - offset) / scale
    return (
        F.when(mode == "percentile", F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0)))
        .when(mode == "energy", F.log1p(F.greatest(x, F.lit(0.0)) / scale))
        .otherwise(z)
        .cast("float"))


def _scaled(column: str) -> Column:
    return F.transform(column, lambda x: _one(x, F.col("mode"), F.col("offset"), F.col("scale")))


def assembled(raw: DataFrame, kernels: dict, members: list[tuple], scalers: DataFrame) -> DataFrame:
    """One feature vector per (fold, config, window): scaled maps in family order, put together in the window's own row.

    The scalers, a few numbers per fold and map, reach the driver.
    """
    places = {name: k + 1 for k, name in enumerate(kernels)}
    fitted = {(r["fold_id"], r["family"], r["mode"]): (r["offset"], r["scale"]) for r in scalers.collect()}
    recipes = {}
    for fold, config, family, name, mode in sorted(members, key=lambda m: "WCESIQV".index(m[2])):
        if (fold, name, mode) in fitted:
            offset, scale = fitted[fold, name, mode]
            recipes.setdefault((fold, config), []).append({"at": places[name], "mode": mode, "offset": offset, "scale": scale})
    part = pa.struct([("at", pa.int32()), ("mode", pa.string()), ("offset", pa.float64()), ("scale", pa.float64())])
    recipes = _local(raw.sparkSession, [(*key, parts) for key, parts in recipes.items()], fold_id=pa.string(), config_id=pa.string(), parts=pa.list_(part))
    d = raw.select("recording_id", "vec_id", "cls", "maps", F.inline("roles")).where("role <> 'held_target'").join(recipes, "fold_id")
    scaled = F.transform("parts", lambda p: F.transform(F.element_at("maps", p["at"]), lambda x: _one(x, p["mode"], p["offset"], p["scale"])))
    return d.select("fold_id", "config_id", "role", "recording_id", "vec_id", "cls", F.flatten(scaled).alias("values"))


def selection_f1(features: DataFrame, classes: int, role: str = "source_selection") -> DataFrame:
    """Recording-level macro F1 of the ridge probe of each (fold, config)."""
    keys = ["fold_id", "config_id"]
    model = probe.fit_ridge(features, keys, classes)
    p = probe.score_ridge(features.where(F.col("role") == role), model, keys, ["recording_id", "cls"], classes)
    r = m.recording_mean_probs(p.withColumnRenamed("cls", "truth"), keys, classes)
    return m.macro_f1(m.cells(r, keys), keys).select(*keys, "macro_f1")


def instability(windows: DataFrame, roles: DataFrame, kernels: dict, used: DataFrame, scalers: DataFrame, seed: int) -> DataFrame:
    """Worst case over the grid of the family displacement, on one window per recording."""
    first = wo.first_window(windows, ["recording_id", "domain"], ["start", "vec_id", "i", "q"])
    pairs = perturb.paired_maps(perturb.recording_position(first), ["recording_id", "domain"], kernels, lambda window, case: seed + 1009 * window + case)
    d = pairs.join(roles.where("role = 'source_selection'").select("fold_id", "recording_id"), "recording_id")
    d = d.join(scalers, ["fold_id", "family"])
    d = d.withColumn("clean", _scaled("clean")).withColumn("perturbed", _scaled("perturbed"))
    gap = selection.linf_displacement(d).select("fold_id", "family", "mode", "domain", "recording_id", "case_index", "displacement")
    # one window per recording: its displacement is the recording median
    per = gap.join(used, ["fold_id", "family", "mode"]).groupBy("fold_id", "config_id", "case_index", "domain", "recording_id").agg(
        F.max("displacement").alias("recording_max"))
    dom = exact_quantiles(per, ["fold_id", "config_id", "case_index", "domain"], "recording_max", {"v": 0.5}, sizes=windows.groupBy("domain").agg(F.count_distinct("recording_id").alias("n")))
    case = dom.groupBy("fold_id", "config_id", "case_index").agg(F.avg("v").alias("instability"))
    return selection.worst_case(case, ["fold_id", "config_id"]).withColumnRenamed("value", "sensitivity")


def objectives(windows: DataFrame, roles: DataFrame, configs, folds: list[str], latencies: DataFrame, classes: int, seed: int = 24021) -> DataFrame:
    """The five objectives and feasibility of every (fold, config).

    ``windows(vec_id, recording_id, domain, cls, start, i, q)``; ``latencies(config_id,
    latency_ms, measurement_valid)`` are measured elsewhere.
    """
    spark = windows.sparkSession
    roles = roles.select("fold_id", "role", "recording_id")
    counts = {c.cyclic for c in configs if "C" in c.families}
    alphas = cyclic_frequencies(windows, roles, counts, configs[0].frame)
    kernels, members = _raw_families(configs, folds, alphas)
    used = _member_table(spark, members)
    # roles meet the short signals, not the maps
    placed = windows.join(roles.groupBy("recording_id").agg(F.collect_list(F.struct("fold_id", "role")).alias("roles")), "recording_id")
    raw = cut(tr.map_bank(placed, ["vec_id", "recording_id", "cls", "roles"], kernels))
    scalers = fit_scalers(raw, kernels, members)
    f1 = selection_f1(assembled(raw, kernels, members, scalers), classes)
    unstable = instability(windows, roles, kernels, used, scalers, seed)
    lengths = windows.select(F.size("i").alias("n")).distinct()
    cost = costs.representation_cost(lengths, configs).join(latencies, "config_id").withColumnRenamed("latency_ms", "batch1_latency_ms")
    cost = costs.budget_check(cost).select(
        "config_id", "bytes_per_sample", F.col("estimated_macs").alias("macs"), F.col("batch1_latency_ms").alias("latency_ms"), "feasible")
    return f1.join(unstable, ["fold_id", "config_id"]).join(cost, "config_id").withColumnRenamed("config_id", "stable_id")


def choose(records: DataFrame) -> DataFrame:
    """Pareto and scalar choices per fold, with the size of the front."""
    records = cut(records)
    keys = ["fold_id"]
    front = selection.pareto_front(records, keys).groupBy(*keys).agg(F.count("*").alias("front_size"))
    pareto = selection.select_unique(records, keys)
    scalar = selection.select_scalar(records, keys).select(*keys, F.col("selected").alias("scalar_selected"))
    return front.join(pareto, keys).join(scalar, keys)
