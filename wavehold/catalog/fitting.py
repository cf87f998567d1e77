"""Source-only fits, probes and the flagship held-domain query."""

from pyspark.sql import functions as F

from ..operators import costs, fit, metrics as m, probe, transforms as tr
from ..sources import views as v
from .base import W, WP, query, with_
from .splits import FOLDS, ROLES, fold_plan

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def role_windows(spark, sf, plan=None):
    """Windows fanned out to folds with their role; the vector itself is the feature map."""
    plan = fold_plan(spark, sf) if plan is None else plan
    w = v.windows(spark, sf).select("vec_id", "recording_id", "domain", "label", "cls", F.col("x").alias("values"))
    return w.join(plan.drop("n_windows"), "recording_id")


def coefficient_sizes(plan):
    """Cheap bound for the quantile fits: coefficients per fold from the split plan."""
    return plan.where("role = 'source_fit'").groupBy("fold_id").agg((F.sum("n_windows") * 64).alias("n"))


RW = ROLES + """, rw AS (SELECT r.fold_id, r.role, w.* FROM w JOIN roles r ON r.recording_id = w.recording_id),
cf AS (SELECT fold_id, unnest(x)::DOUBLE AS z FROM rw WHERE role = 'source_fit'),
pn AS (SELECT fold_id, quantile_cont(z, 0.01) AS offs, greatest(quantile_cont(z, 0.99) - quantile_cont(z, 0.01), 1e-8) AS scale FROM cf GROUP BY fold_id)"""


@query("fit_percentile", with_(RW) + "SELECT fold_id, 'percentile' AS mode, round(offs, 6) AS offs, round(scale, 6) AS scale FROM pn")
def _(spark, sf):
    plan = fold_plan(spark, sf)
    n = fit.fit_percentile(role_windows(spark, sf, plan), ["fold_id"], coefficient_sizes(plan))
    return n.select("fold_id", "mode", F.round("offset", 6).alias("offs"), *r6("scale"))


@query("fit_percentile_all_values", """SELECT event_type, round(quantile_cont(value, 0.01), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.99), 6) AS high FROM events GROUP BY event_type""")
def _(spark, sf):
    """Same quantiles by interval refinement, the path taken by groups over the buffer limit."""
    from ..plans.quantiles import refine_quantiles
    e = v.table(spark, sf, "events").select("event_type", "value")
    q = refine_quantiles(e, ["event_type"], "value", {"low": 0.01, "mid": 0.5, "high": 0.99}, "linear", limit=64)
    return q.select("event_type", *r6("low", "mid", "high"))


@query("fit_zscore", with_(RW) + """SELECT fold_id, 'zscore' AS mode, round(avg(z), 6) AS offs, round(greatest(stddev_pop(z), 1e-8), 6) AS scale FROM cf GROUP BY fold_id
  UNION ALL SELECT DISTINCT fold_id, 'none', 0.0, 1.0 FROM cf""")
def _(spark, sf):
    rw = role_windows(spark, sf)
    both = fit.fit_zscore(rw, ["fold_id"]).unionByName(fit.fit_none(rw, ["fold_id"]))
    return both.select("fold_id", "mode", F.round("offset", 6).alias("offs"), *r6("scale"))


NORM = RW + """, nw AS (SELECT rw.fold_id, role, vec_id, recording_id, domain, label, cls,
  list_transform(x, lambda z: CAST(least(greatest((z::DOUBLE - offs) / scale, 0.0), 1.0) AS FLOAT)) AS x FROM rw JOIN pn ON pn.fold_id = rw.fold_id)"""


def normalized(spark, sf):
    plan = fold_plan(spark, sf)
    rw = role_windows(spark, sf, plan)
    n = fit.fit_percentile(rw, ["fold_id"], coefficient_sizes(plan))
    return fit.apply_normalizer(rw, n, ["fold_id"])


@query("apply_normalizer", with_(NORM) + """SELECT fold_id, vec_id, role, round(list_sum(list_transform(x, lambda z: z::DOUBLE)), 5) AS total,
  len(list_filter(x, lambda z: z = 0 OR z = 1)) AS clipped FROM nw""")
def _(spark, sf):
    return normalized(spark, sf).select("fold_id", "vec_id", "role", F.round(fit.array_sum("cast(z as double)"), 5).alias("total"),
                                        F.size(F.filter("values", lambda z: (z == 0) | (z == 1))).cast("long").alias("clipped"))


MEANS = NORM + """, cm AS (SELECT fold_id, cls, p, avg(x[p + 1]::DOUBLE) AS mu FROM nw, range(64) z(p) WHERE role = 'source_fit' GROUP BY ALL),
 ds AS (SELECT nw.fold_id, role, vec_id, recording_id, nw.cls AS truth, cm.cls AS c, -sum(pow(x[p + 1]::DOUBLE - mu, 2)) AS s FROM nw JOIN cm ON cm.fold_id = nw.fold_id GROUP BY ALL),
 np AS (SELECT fold_id, role, vec_id, recording_id, truth, c, exp(s - max(s) OVER q) / sum(exp(s)) OVER q * exp(max(s) OVER q) AS p FROM ds WINDOW q AS (PARTITION BY fold_id, vec_id)),
 nr AS (SELECT fold_id, role, recording_id, truth, avg(p) FILTER (WHERE c = 0) AS p0, avg(p) FILTER (WHERE c = 1) AS p1 FROM np GROUP BY ALL),
 np2 AS (SELECT *, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS pred FROM nr WHERE role = 'held_target'),
 cl AS (SELECT fold_id, label, sum(t) AS sup, sum(q) AS named, sum(h) AS tp FROM (SELECT fold_id, truth AS label, 1 AS t, 0 AS q, CASE WHEN truth = pred THEN 1 ELSE 0 END AS h FROM np2
   UNION ALL SELECT fold_id, pred, 0, 1, 0 FROM np2) GROUP BY ALL)"""


def held_predictions(spark, sf):
    nw = normalized(spark, sf)
    means = fit.class_means(nw, ["fold_id"])
    p = fit.nearest_mean_probs(nw.where("role = 'held_target'"), means, ["fold_id"])
    return m.recording_mean_probs(p.withColumnRenamed("cls", "truth"), ["fold_id"], 2)


@query("held_domain_macro_f1", with_(MEANS) + """SELECT fold_id, round(avg(2.0 * (tp / greatest(named, 1)) * (tp / greatest(sup, 1)) / greatest(tp / greatest(named, 1) + tp / greatest(sup, 1), 1e-12)), 6) AS macro_f1,
  CAST(sum(sup) AS BIGINT) AS recordings FROM cl GROUP BY fold_id""")
def held_domain_macro_f1(spark, sf):
    scores = m.class_scores(m.cells(held_predictions(spark, sf), ["fold_id"]), ["fold_id"])
    return scores.groupBy("fold_id").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.sum("support").alias("recordings"))


@query("nearest_mean_probs", with_(MEANS) + "SELECT fold_id, recording_id, truth, pred, round(p0, 6) AS p0 FROM np2")
def _(spark, sf):
    return held_predictions(spark, sf).select("fold_id", "recording_id", "truth", "pred", F.round(F.col("probs")[0], 6).alias("p0"))


def energy_maps(spark, sf, plan):
    """Frame powers per window with roles."""
    w = v.iq_windows(spark, sf).select("vec_id", "recording_id", tr.frame_energy("i", "q", 8, 4).alias("values"))
    return w.join(plan.drop("n_windows"), "recording_id")


_EN = ROLES + """, il AS (SELECT vec_id, recording_id, n, i[n + 1]::DOUBLE AS re, q[n + 1]::DOUBLE AS im FROM w, range(32) z(n)),
 le AS (SELECT vec_id, recording_id, t, sum(re * re + im * im) / 8 AS val FROM il, range(7) tt(t) WHERE n >= 4 * t AND n < 4 * t + 8 GROUP BY ALL),
 wm AS (SELECT vec_id, recording_id, median(val) AS m FROM le GROUP BY ALL),
 rm AS (SELECT fold_id, wm.recording_id, median(m) AS m FROM wm JOIN roles r ON r.recording_id = wm.recording_id AND role = 'source_fit' GROUP BY ALL),
 er AS (SELECT fold_id, greatest(median(m), 1e-8) AS reference FROM rm GROUP BY fold_id)"""


def recording_sizes(plan):
    return plan.select(F.col("n_windows").alias("n"))


@query("energy_reference", with_(_EN) + "SELECT fold_id, round(reference, 8) AS reference FROM er")
def _(spark, sf):
    plan = fold_plan(spark, sf)
    return fit.energy_reference(energy_maps(spark, sf, plan), ["fold_id"], recording_sizes(plan)).select("fold_id", F.round("reference", 8).alias("reference"))


@query("normalize_energy", with_(_EN) + """SELECT e.fold_id, vec_id, round(avg(CAST(ln(1 + greatest(val, 0) / reference) AS FLOAT)::DOUBLE), 5) AS mean_energy
  FROM le JOIN roles r ON r.recording_id = le.recording_id JOIN er e ON e.fold_id = r.fold_id GROUP BY e.fold_id, vec_id""")
def _(spark, sf):
    plan = fold_plan(spark, sf)
    e = energy_maps(spark, sf, plan)
    ref = fit.energy_reference(e, ["fold_id"], recording_sizes(plan))
    d = fit.normalize_energy(e, ref, ["fold_id"])
    return d.select("fold_id", "vec_id", F.round(fit.array_sum("cast(z as double)") / F.size("values"), 5).alias("mean_energy"))


_CY = ROLES + """, en AS (SELECT vec_id, recording_id, n, abs(x[n + 1]::DOUBLE) - list_avg(list_transform(x, lambda z: abs(z::DOUBLE))) AS e FROM w, range(64) z(n)),
 ps AS (SELECT vec_id, recording_id, f, pow(sum(e * cos(2 * pi() * f * n / 64.0)), 2) + pow(sum(e * sin(2 * pi() * f * n / 64.0)), 2) AS p FROM en, range(33) z(f) GROUP BY ALL),
 rm AS (SELECT recording_id, f, median(p) AS p FROM ps GROUP BY ALL),
 sc AS (SELECT fold_id, f, CASE WHEN f < 2 THEN 0 ELSE median(p) END AS score FROM rm JOIN roles USING (recording_id) WHERE role = 'source_fit' GROUP BY fold_id, f),
 pk AS (SELECT *, coalesce(score >= lag(score) OVER q AND score >= lead(score) OVER q, false) AS peak FROM sc WINDOW q AS (PARTITION BY fold_id ORDER BY f)),
 od AS (SELECT *, least(greatest(CAST(floor(f / 64.0 * 16 + 0.5) AS INTEGER), 1), 15) AS sh, row_number() OVER (PARTITION BY fold_id ORDER BY score DESC, f) AS k FROM pk WHERE peak)"""
_GREEDY = """, g AS (SELECT fold_id, 0::BIGINT AS k, []::BIGINT[] AS fs, []::INTEGER[] AS ss FROM od GROUP BY fold_id
  UNION ALL SELECT g.fold_id, od.k, CASE WHEN ok THEN list_append(fs, od.f) ELSE fs END, CASE WHEN ok THEN list_append(ss, od.sh) ELSE ss END
  FROM g JOIN od ON od.fold_id = g.fold_id AND od.k = g.k + 1, LATERAL (SELECT len(fs) < 3 AND NOT list_contains(ss, od.sh) AND len(list_filter(fs, lambda o: abs(o - od.f) < 2)) = 0 AS ok)),
 ch AS (SELECT fold_id, list_sort(arg_max(fs, k)) AS fs FROM g GROUP BY fold_id)"""


def peaks(spark, sf):
    return fit.cyclic_scores(v.windows(spark, sf), fold_plan(spark, sf), i="x", q=None)


@query("cyclic_bin_scores", with_(_CY) + "SELECT fold_id, CAST(f AS INTEGER) AS bin, round(score, 6) AS score, peak FROM pk")
def _(spark, sf):
    return peaks(spark, sf).select("fold_id", "bin", *r6("score"), "peak")


@query("cyclic_bin_discovery", "WITH RECURSIVE " + _CY + _GREEDY + " SELECT fold_id, CAST(p AS INTEGER) AS pos, fs[p + 1] / 64.0 AS alpha FROM ch, range(3) z(p)")
def _(spark, sf):
    return fit.cyclic_bins(peaks(spark, sf), count=3, window=64, frame=16)


@query("permute_cyclic_bins", "WITH RECURSIVE " + _CY + _GREEDY + """, b AS (SELECT fold_id, CAST(p AS INTEGER) AS pos, fs[p + 1] / 64.0 AS alpha FROM ch, range(3) z(p)),
  t AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY sha256(concat_ws('|', 24024, fold_id, pos))) - 1 AS d FROM b)
  SELECT fold_id, CAST(CASE WHEN bool_and(d = pos) OVER (PARTITION BY fold_id) THEN (d + 1) % 3 ELSE d END AS INTEGER) AS pos, alpha FROM t""")
def _(spark, sf):
    from ..functions.rng import hash_order
    b = fit.cyclic_bins(peaks(spark, sf), count=3, window=64, frame=16)
    return fit.permute_bins(b, hash_order(F.lit(24024), F.col("fold_id"), F.col("pos")))


def channels(spark, sf):
    """Two channels of each window (I and Q) with roles."""
    w = v.iq_windows(spark, sf).select("vec_id", "recording_id", F.explode(F.array(
        F.struct(F.lit(0).alias("channel"), F.col("i").alias("values")), F.struct(F.lit(1).alias("channel"), F.col("q").alias("values")))).alias("c"))
    return w.select("vec_id", "recording_id", "c.*").join(fold_plan(spark, sf).drop("n_windows"), "recording_id")


_CH = ROLES + """, ch AS (SELECT fold_id, role, vec_id, 0 AS channel, unnest(i)::DOUBLE AS z FROM w JOIN roles USING (recording_id)
  UNION ALL SELECT fold_id, role, vec_id, 1, unnest(q)::DOUBLE FROM w JOIN roles USING (recording_id)),
 st AS (SELECT fold_id, channel, avg(z) AS mean, greatest(stddev_pop(z), 1e-6) AS scale, count(*) AS n FROM ch WHERE role = 'source_fit' GROUP BY ALL)"""


@query("channel_standardizer", with_(_CH) + "SELECT fold_id, channel, round(mean, 6) AS mean, round(scale, 6) AS scale FROM st")
def _(spark, sf):
    return fit.channel_standardizer(channels(spark, sf), ["fold_id", "channel"]).select("fold_id", "channel", *r6("mean", "scale"))


@query("channel_stats_one_pass", with_(_CH) + "SELECT fold_id, channel, round(mean, 6) AS mean, round(scale, 6) AS scale, n FROM st")
def _(spark, sf):
    return fit.channel_stats_one_pass(channels(spark, sf), ["fold_id", "channel"]).select("fold_id", "channel", *r6("mean", "scale"), "n")


@query("standardize_with", with_(_CH) + """SELECT ch.fold_id, vec_id, ch.channel, round(sum(CAST((z - mean) / scale AS FLOAT)::DOUBLE), 4) AS total
  FROM ch JOIN st ON st.fold_id = ch.fold_id AND st.channel = ch.channel GROUP BY ALL""")
def _(spark, sf):
    c = channels(spark, sf)
    s = fit.standardize_with(c, fit.channel_stats_one_pass(c, ["fold_id", "channel"]), ["fold_id", "channel"])
    return s.select("fold_id", "vec_id", "channel", F.round(fit.array_sum("cast(z as double)"), 4).alias("total"))


@query("recording_mean_features", with_(W) + """SELECT recording_id, min(label) AS label, min(domain) AS domain, CAST(p AS INTEGER) AS pos, round(avg(x[p + 1]::DOUBLE), 6) AS value
  FROM w, range(64) z(p) GROUP BY recording_id, p""")
def _(spark, sf):
    w = v.windows(spark, sf).withColumnRenamed("x", "values")
    d = fit.recording_mean_features(w, [])
    return d.select("recording_id", "label", "domain", F.posexplode("values").alias("pos", "value")).withColumn("value", F.round("value", 6))


def halves(spark, sf):
    """Two features per window: mean of each half of the vector."""
    half = lambda a: F.expr(f"aggregate(slice(values, {a}, 32), 0.0D, (t, z) -> t + cast(z as double)) / 32")
    return role_windows(spark, sf).withColumn("values", F.array(half(1), half(33)))


RIDGE = ROLES + """, hv AS (SELECT fold_id, role, vec_id, w.recording_id, cls, list_avg(list_transform(i, lambda z: z::DOUBLE)) AS a, list_avg(list_transform(q, lambda z: z::DOUBLE)) AS b
  FROM w JOIN roles r ON r.recording_id = w.recording_id),
 st AS (SELECT fold_id, avg(a) AS ma, avg(b) AS mb, greatest(stddev_pop(a), 1e-6) AS sa, greatest(stddev_pop(b), 1e-6) AS sb FROM hv WHERE role = 'source_fit' GROUP BY fold_id),
 zz AS (SELECT hv.*, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM hv JOIN st USING (fold_id)),
 gm AS (SELECT fold_id, c, count(*) + 0.01 AS nn, sum(za * za) + 0.01 AS aa, sum(zb * zb) + 0.01 AS bb, sum(za * zb) AS ab,
  sum(za * y) AS ay, sum(zb * y) AS by_, sum(y) AS sy FROM (SELECT *, CASE WHEN cls = c THEN 1.0::DOUBLE ELSE 0 END AS y FROM zz, range(2) k(c) WHERE role = 'source_fit') GROUP BY fold_id, c),
 rwt AS (SELECT fold_id, c, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb, sy / nn AS w0 FROM gm)"""


@query("fit_ridge", with_(RIDGE) + """SELECT fold_id, CAST(2 * r + c AS INTEGER) AS pos, round(CASE r WHEN 0 THEN wa WHEN 1 THEN wb ELSE w0 END, 6) AS weight FROM rwt, range(3) z(r)""")
def _(spark, sf):
    model = probe.fit_ridge(halves(spark, sf), ["fold_id"], 2)
    return model.select("fold_id", F.posexplode("weights").alias("pos", "weight")).withColumn("weight", F.round("weight", 6))


@query("score_ridge", with_(RIDGE) + """, sl AS (SELECT zz.fold_id, role, vec_id, c, za * wa + zb * wb + w0 AS l FROM zz JOIN rwt USING (fold_id)),
  sp AS (SELECT fold_id, role, vec_id, max(l) FILTER (WHERE c = 0) AS l0, max(l) FILTER (WHERE c = 1) AS l1 FROM sl GROUP BY ALL)
  SELECT fold_id, role, vec_id, round(1 / (1 + exp(l1 - l0)), 6) AS p0, CASE WHEN l0 >= l1 THEN 0 ELSE 1 END AS pred FROM sp""")
def _(spark, sf):
    h = halves(spark, sf)
    p = probe.score_ridge(h, probe.fit_ridge(h, ["fold_id"], 2), ["fold_id"], ["role", "vec_id"], 2)
    return p.select("fold_id", "role", "vec_id", F.round(F.col("probs")[0], 6).alias("p0"), m.argmax("probs").alias("pred"))


@query("ridge_full_vector")
def _(spark, sf):
    """All 64 coefficients as features; recording-level F1 on the held domain."""
    nw = normalized(spark, sf)
    model = probe.fit_ridge(nw, ["fold_id"], 2)
    p = probe.score_ridge(nw.where("role = 'held_target'"), model, ["fold_id"], ["recording_id", "cls"], 2)
    r = m.recording_mean_probs(p.withColumnRenamed("cls", "truth"), ["fold_id"], 2)
    return m.macro_f1(m.cells(r, ["fold_id"]), ["fold_id"]).select("fold_id", *r6("macro_f1", "balanced_accuracy"))


@query("boosted_trees")
def _(spark, sf):
    """Few shallow rounds here; the operator's defaults are 500 rounds of depth 6."""
    rows, parts = role_windows(spark, sf), []
    for fold in FOLDS:
        own = rows.where(F.col("fold_id") == fold)
        models = probe.boosted_trees(own, [0, 1], rounds=2, depth=2)
        parts.append(probe.boosted_probs(own.where("role = 'held_target'"), models, [0, 1], ["fold_id", "recording_id", "cls"]))
    p = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("cls", "truth")
    r = m.recording_mean_probs(p, ["fold_id"], 2)
    return r.select("fold_id", "recording_id", "truth", "pred", F.round(F.col("probs")[0], 6).alias("p0"))


@query("class_weights", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(sum(n) OVER () / (10 * n), 6) AS weight FROM c""")
def _(spark, sf):
    return fit.class_weights(v.table(spark, sf, "embeddings"), "label", 10).select("label", "n", *r6("weight"))


@query("recording_weights", """WITH c AS (SELECT user_id AS recording_id, count(*) AS windows FROM events GROUP BY user_id)
  SELECT recording_id, windows, count(*) OVER () AS recordings, round(1.0 / (count(*) OVER () * windows), 9) AS weight FROM c""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumnRenamed("user_id", "recording_id")
    return fit.recording_weights(e, []).select("recording_id", "windows", "recordings", F.round("weight", 9).alias("weight"))


def _temperature_sql():
    out = WP + """, lg AS (SELECT condition, seed, fold, recording_id, truth, list_transform(probs, lambda p: ln(p)) AS lo FROM wp),
 rc AS (SELECT condition, seed, fold, recording_id, count(*) AS nw FROM lg GROUP BY ALL),
 wt AS (SELECT *, 1.0 / (nw * count(*) OVER (PARTITION BY condition, seed, fold)) AS weight FROM rc),
 d AS (SELECT lg.condition, lg.seed, lg.fold, lg.truth, lo, list_max(lo) AS mx, weight FROM lg JOIN wt USING (condition, seed, fold, recording_id)),
 b0 AS (SELECT DISTINCT condition, seed, fold, 0.05::DOUBLE AS a, 20.0::DOUBLE AS z FROM d)"""
    for n in range(3):
        out += f""", p{n} AS (SELECT d.condition, d.seed, d.fold, a, z, s, a * pow(z / a, s / 24.0::DOUBLE) AS t,
  sum(weight * (ln(list_sum(list_transform(lo, lambda q: exp((q - mx) / (a * pow(z / a, s / 24.0::DOUBLE)))))) - (lo[truth + 1] - mx) / (a * pow(z / a, s / 24.0::DOUBLE)))) AS loss
  FROM d JOIN b{n} USING (condition, seed, fold), range(25) g(s) GROUP BY ALL),
 q{n} AS (SELECT condition, seed, fold, a, z, arg_min(t, (loss, s)) AS t, min(loss) AS loss FROM p{n} GROUP BY ALL),
 b{n + 1} AS (SELECT condition, seed, fold, greatest(0.05, t / pow(z / a, 1 / 24.0::DOUBLE)) AS a, least(20.0, t * pow(z / a, 1 / 24.0::DOUBLE)) AS z, t, loss FROM q{n})"""
    return out


@query("fit_temperature", with_(_temperature_sql()) + """SELECT condition, seed, fold, round(t, 4) AS temperature, round(loss, 6) AS loss, t <= 0.05 + 1e-6 OR t >= 20 - 1e-6 AS at_bound FROM b3""")
def _(spark, sf):
    p = v.window_predictions(spark, sf).withColumn("logits", F.transform("probs", lambda z: F.log(z)))
    t = fit.fit_temperature(p.drop("probs"), ["condition", "seed", "fold"])
    return t.select("condition", "seed", "fold", F.round("temperature", 4).alias("temperature"), *r6("loss"), "at_bound")


BANK = list({c.stable_id: c for c in tr.fixed_bank() + tr.selection_bank()}.values())
_CV = ", ".join(f"('{c.stable_id}', {len(c.families)}, {c.bins}, {costs.transform_count(c)}, {int('E' in c.families)})" for c in BANK)
COST = f"""ln AS (SELECT DISTINCT len(embedding) AS n FROM embeddings), cfg AS (SELECT * FROM (VALUES {_CV}) z(config_id, channels, bins, ffts, pw)),
 cost AS (SELECT config_id, n, (channels * bins * bins * 4)::DOUBLE AS bytes_per_sample, ffts * n * log2(greatest(n, 2)) * 5.0 + pw * n + channels * bins * bins * 8 AS estimated_macs FROM ln, cfg)"""


def cost_rows(spark, sf):
    lengths = v.table(spark, sf, "embeddings").select(F.size("embedding").alias("n")).distinct()
    return costs.representation_cost(lengths, BANK)


@query("representation_cost", with_(COST) + "SELECT config_id, CAST(n AS INTEGER) AS n, bytes_per_sample, round(estimated_macs, 4) AS estimated_macs FROM cost")
def _(spark, sf):
    return cost_rows(spark, sf).select("config_id", "n", "bytes_per_sample", F.round("estimated_macs", 4).alias("estimated_macs"))


@query("budget_check", """WITH c AS (SELECT l_suppkey AS config_id, avg(l_quantity) * 160 AS bytes_per_sample, avg(l_extendedprice) / 380 AS batch1_latency_ms, sum(l_extendedprice) * 4.5 AS estimated_macs, bool_and(l_discount < 0.2) AS ok FROM lineitem GROUP BY l_suppkey)
  SELECT config_id, concat_ws(',', CASE WHEN NOT ok THEN 'invalid_batch1_latency_measurement' END, CASE WHEN bytes_per_sample > 4096 THEN 'bytes_per_sample' END,
  CASE WHEN batch1_latency_ms > 100 THEN 'batch1_latency_ms' END, CASE WHEN estimated_macs > 1e8 THEN 'estimated_macs' END) AS failures,
  ok AND bytes_per_sample <= 4096 AND batch1_latency_ms <= 100 AND estimated_macs <= 1e8 AS feasible FROM c""")
def _(spark, sf):
    c = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("config_id")).agg(
        (F.avg("l_quantity") * 160).alias("bytes_per_sample"), (F.avg("l_extendedprice") / 380).alias("batch1_latency_ms"),
        (F.sum("l_extendedprice") * 4.5).alias("estimated_macs"), F.bool_and(F.col("l_discount") < 0.2).alias("measurement_valid"))
    return costs.budget_check(c).select("config_id", F.array_join("failures", ",").alias("failures"), "feasible")


@query("ensemble_cost", """WITH s AS (SELECT l_suppkey AS model, l_linenumber AS seed, sum(l_quantity) AS parameters, sum(l_extendedprice) AS model_macs, avg(l_tax) AS rep_macs,
  avg(l_discount) AS bytes, avg(l_quantity) AS ms, avg(l_tax) AS rep_ms, max(l_extendedprice) AS peak, bool_and(l_quantity > 1) AS valid FROM lineitem GROUP BY ALL)
  SELECT model, round(sum(parameters), 4) AS parameters, round(sum(model_macs) + avg(rep_macs), 4) AS macs, round(avg(bytes), 6) AS bytes_per_sample, round(sum(ms) + avg(rep_ms), 6) AS median_ms,
  max(peak) AS peak_bytes, bool_and(valid) AS measurement_valid, count(*) AS ensemble_size FROM s GROUP BY model""")
def _(spark, sf):
    s = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model"), F.col("l_linenumber").alias("seed")).agg(
        F.sum("l_quantity").alias("parameters"), F.sum("l_extendedprice").alias("model_macs"), F.avg("l_tax").alias("representation_macs"),
        F.avg("l_discount").alias("bytes_per_sample"), F.avg("l_quantity").alias("model_ms"), F.avg("l_tax").alias("representation_ms"),
        F.max("l_extendedprice").alias("peak_bytes"), F.bool_and(F.col("l_quantity") > 1).alias("valid"))
    e = costs.ensemble_cost(s, ["model"])
    return e.select("model", F.round("parameters", 4).alias("parameters"), F.round("macs", 4).alias("macs"), *r6("bytes_per_sample", "median_ms"), "peak_bytes", "measurement_valid", "ensemble_size")
