"""Decision and report-table queries; brands stand in for experiments."""

import re

from pyspark.sql import functions as F

from ..operators import decisions as ops, metrics as m, report
from ..plans import resampling as rs
from ..session import cut
from ..sources import views as v
from .base import RP, query, with_
from .metrics import F1, PER, _BINS, _CAL, ensemble, ensemble_cells, recs
from .resampling import B, BDET2, BF1, CON, PC, ROB, SEED, _DM, contrast, detection_interval, draws_sql, f1_interval, macro2, robustness_draws

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
# Four measured effects of each part; brands are experiments, parts their recordings.
PE = """pe AS (SELECT p_brand AS experiment, p_size % 7 AS candidate, p_size % 4 AS family, p_partkey AS recording_id, avg(l_discount) - 0.049 AS e0, avg(l_tax) - 0.039 AS e1,
  avg(l_quantity) / 50 - 0.5 AS e2, avg(l_extendedprice) / 100000 - 0.37 AS e3 FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)"""


def effects(spark, sf):
    line = v.table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[F.avg(c).alias(c) for c in ("l_discount", "l_tax", "l_quantity", "l_extendedprice")])
    part = v.table(spark, sf, "part").join(line, F.col("p_partkey") == F.col("l_partkey"))
    return part.select(
        F.col("p_brand").alias("experiment"), (F.col("p_size") % 7).alias("candidate"), (F.col("p_size") % 4).alias("family"), F.col("p_partkey").alias("recording_id"),
        (F.col("l_discount") - 0.049).alias("e0"), (F.col("l_tax") - 0.039).alias("e1"), (F.col("l_quantity") / 50 - 0.5).alias("e2"), (F.col("l_extendedprice") / 100000 - 0.37).alias("e3"))


def p_values(e, keys):
    """(keys, e0..e3, p0..p3, low0, low1): mean effects of `e`, their centred bootstrap p and lower limits, on shared draws."""
    names = [f"e{k}" for k in range(4)]
    d = rs.draw_sums(e.withColumn("_x", F.array(*names, F.lit(1.0))), keys, "_x", B, SEED)
    d = d.select(*keys, *[(F.col("sums")[k] / F.col("sums")[4]).alias(f"v{k}") for k in range(4)])
    seen = e.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
    above = lambda k: F.count_if(F.col(f"v{k}") - F.col(f"e{k}") >= F.col(f"e{k}") - 1e-12)
    p = d.join(seen, keys).groupBy(*keys, *names).agg(
        *[((1 + above(k)) / (F.count("*") + 1)).alias(f"p{k}") for k in range(4)], *[F.percentile(f"v{k}", F.lit(0.025)).alias(f"low{k}") for k in range(2)])
    return cut(p)


def pv_sql(keys, out):
    """`out`: the same from `pe`."""
    g = ", ".join(keys)
    return PE + draws_sql("pe", [], keys, "recording_id", f"{out}_d") + f""", {out}_o AS (SELECT {g}, {', '.join(f'avg(e{k}) AS e{k}' for k in range(4))} FROM pe GROUP BY {g}),
 {out}_v AS (SELECT {g}, draw, {', '.join(f'avg(e{k}) AS v{k}' for k in range(4))} FROM {out}_d GROUP BY {g}, draw),
 {out} AS (SELECT {g}, {', '.join(f'e{k}' for k in range(4))}, {', '.join(f'(1 + count(*) FILTER (WHERE v{k} - e{k} >= e{k} - 1e-12)) / (count(*) + 1) AS p{k}' for k in range(4))},
  quantile_cont(v0, 0.025) AS low0, quantile_cont(v1, 0.025) AS low1 FROM {out}_v JOIN {out}_o USING ({g}) GROUP BY ALL)"""


H1C = pv_sql(["experiment", "candidate"], "pc") + """, cs AS (SELECT p_brand AS experiment, p_size % 7 AS candidate, avg(p_retailprice) < 1480 AS feasible, min(p_size) < 8 OR p_brand NOT LIKE '%3' AS valid FROM part GROUP BY p_brand, p_size % 7),
 ca AS (SELECT experiment, candidate, p0 AS a, p1 AS b, p2 AS c, p3 AS d, feasible, valid FROM cs JOIN pc USING (experiment, candidate)),
 h1 AS (SELECT experiment, count(*) AS candidates, CASE WHEN bool_and(valid) THEN 'ok' ELSE 'untestable' END AS status,
  CASE WHEN bool_and(valid) THEN least(1.0, count(*) * min(CASE WHEN feasible THEN greatest(a, b, c, d) ELSE 1.0 END)) END AS raw_p FROM ca GROUP BY experiment)"""


def h1(spark, sf, e):
    g = v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("experiment"), (F.col("p_size") % 7).alias("candidate")).agg(
        (F.avg("p_retailprice") < 1480).alias("feasible"), F.min("p_size").alias("_m"))
    names = ("p_instability_vs_w", "p_instability_vs_stft", "p_f1_vs_w", "p_f1_vs_stft")
    p = p_values(e, ["experiment", "candidate"])
    g = g.join(p.select("experiment", "candidate", *[F.col(f"p{k}").alias(n) for k, n in enumerate(names)]), ["experiment", "candidate"])
    g = g.withColumn("measurement_valid", (F.col("_m") < 8) | ~F.col("experiment").endswith("3"))
    return ops.intersection_union(g, ["experiment"])


@query("h1_intersection_union", with_(H1C) + "SELECT experiment, candidates, status, round(raw_p, 6) AS raw_p FROM h1")
def _(spark, sf):
    return h1(spark, sf, cut(effects(spark, sf))).select("experiment", "candidates", "status", *r6("raw_p"))


H3C = pv_sql(["experiment", "family"], "pf") + """, fs AS (SELECT p_brand AS experiment, p_size % 4 AS family, 0.99 + avg(p_size) / 4000 AS cosine, abs(avg(p_retailprice) - 1490) / 2000 AS nmae FROM part GROUP BY p_brand, p_size % 4),
 fa AS (SELECT experiment, family, p2 AS p, cosine, nmae FROM fs JOIN pf USING (experiment, family)),
 h3 AS (SELECT experiment, count(*) FILTER (WHERE cosine >= 0.995 AND nmae <= 0.01) AS degenerate_families, 'ok' AS status, CASE WHEN count(*) FILTER (WHERE cosine >= 0.995 AND nmae <= 0.01) > 0 THEN 1.0 ELSE max(p) END AS raw_p FROM fa GROUP BY experiment)"""


def h3(spark, sf, e):
    g = v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("experiment"), (F.col("p_size") % 4).alias("family")).agg(
        (0.99 + F.avg("p_size") / 4000).alias("cosine"), (F.abs(F.avg("p_retailprice") - 1490) / 2000).alias("nmae"))
    p = p_values(e, ["experiment", "family"]).select("experiment", "family", F.col("p2").alias("raw_p"))
    return ops.deletion(g.join(p, ["experiment", "family"]), ["experiment"])


@query("h3_deletion", with_(H3C) + "SELECT experiment, degenerate_families, status, round(raw_p, 6) AS raw_p FROM h3")
def _(spark, sf):
    return h3(spark, sf, cut(effects(spark, sf))).select("experiment", "degenerate_families", "status", *r6("raw_p"))


H4C = pv_sql(["experiment"], "pb") + """, ex AS (SELECT p_brand AS experiment, avg(p_size) AS sz, avg(p_retailprice) AS pr, count(*) AS n FROM part GROUP BY p_brand),
 h4 AS (SELECT experiment, CASE WHEN n > 1 AND experiment NOT LIKE '%4' THEN 'ok' ELSE 'untestable' END AS status,
  CASE WHEN n > 1 AND experiment NOT LIKE '%4' THEN CASE WHEN sz < 26 AND pr < 1510 THEN greatest(p0, p1) ELSE 1.0 END END AS raw_p FROM ex JOIN pb USING (experiment))"""
MEC = """, mm AS (SELECT *, e0 AS dg, e1 AS ds FROM ex JOIN pb USING (experiment)),
 ms AS (SELECT experiment, CASE WHEN NOT (n > 20) THEN 'untestable' WHEN dg <= 0 OR ds <= 0 THEN 'negative' WHEN low0 > 0 AND low1 > 0 AND sz / 25 <= 1.1 THEN 'supported' ELSE 'partial' END AS state FROM mm)"""


def experiments(spark, sf):
    return v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("experiment")).agg(
        F.avg("p_size").alias("sz"), F.avg("p_retailprice").alias("pr"), F.count("*").alias("n"))


def h4(spark, sf, p):
    """`p` holds the p values of whole experiments."""
    e = experiments(spark, sf).join(p, "experiment")
    return ops.cost_tradeoff(e.select(
        "experiment", (F.col("n") > 1).alias("measurement_valid"), (F.col("sz") < 26).alias("bytes_reduced"), (F.col("pr") < 1510).alias("macs_reduced"),
        F.col("p0").alias("p_performance"), F.when(~F.col("experiment").endswith("4"), F.col("p1")).alias("p_latency")))


@query("decision_ladders", with_(H4C + MEC) + "SELECT experiment, status, round(raw_p, 6) AS raw_p, state FROM h4 JOIN ms USING (experiment)")
def _(spark, sf):
    p = p_values(cut(effects(spark, sf)), ["experiment"])  # one table of draws serves both ladders
    e = experiments(spark, sf).join(p, "experiment")
    yes = F.lit(True)
    s = ops.mechanism_state(e.select(
        "experiment", yes.alias("eligible"), yes.alias("integrity"), yes.alias("calibration"), yes.alias("compute_valid"),
        (F.col("n") - 1).alias("relation_recordings"), F.lit(0.5).alias("min_coverage"),
        F.col("e0").alias("delta_gate"), F.col("e1").alias("delta_shuffle"), F.col("low0").alias("gate_low"), F.col("low1").alias("shuffle_low"),
        F.lit(0.0).alias("worst_low"), (F.col("sz") / 25).alias("parameter_ratio"), F.lit(1.0).alias("mac_ratio"), F.lit(1.0).alias("latency_ratio")))
    return h4(spark, sf, p).join(s.select("experiment", "state"), "experiment").select("experiment", "status", *r6("raw_p"), "state")


@query("holm", with_(pv_sql(["experiment"], "pb")) + """, p AS (SELECT experiment, h, CASE WHEN h = 3 AND experiment LIKE '%5' THEN NULL ELSE ([p0, p1, p2, p3])[h + 1] END AS p FROM pb, range(4) z(h)),
  r AS (SELECT *, (count(p) OVER (PARTITION BY experiment) - row_number() OVER (PARTITION BY experiment ORDER BY p NULLS LAST, h) + 1) * p AS r FROM p)
  SELECT experiment, CAST(h AS INTEGER) AS h, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, max(r) OVER (PARTITION BY experiment ORDER BY p NULLS LAST, h ROWS UNBOUNDED PRECEDING)) END, 6) AS holm_p FROM r""")
def _(spark, sf):
    """Four bootstrap p-values per brand; one is missing in some."""
    p = p_values(cut(effects(spark, sf)), ["experiment"]).select("experiment", F.posexplode(F.array(*[f"p{k}" for k in range(4)])).alias("h", "p"))
    p = p.withColumn("p", F.when(~((F.col("h") == 3) & F.col("experiment").endswith("5")), F.col("p")))
    return rs.holm(p, ["experiment"], "h", "p").select("experiment", "h", *r6("p", "holm_p"))


@query("finalize_hypotheses", with_(H1C, H3C[len(PE) + 2:], H4C[len(PE) + 2:]) + f""", al AS (SELECT experiment, 'H1' AS hypothesis, status, raw_p FROM h1 UNION ALL SELECT experiment, 'H3', status, raw_p FROM h3 UNION ALL SELECT experiment, 'H4', status, raw_p FROM h4
  UNION ALL SELECT experiment, 'H2', 'ok', p3 FROM pb), rd AS (SELECT experiment, count(*) FILTER (WHERE status = 'ok') = 4 AS ready FROM al GROUP BY experiment),
 rr AS (SELECT *, (count(raw_p) OVER (PARTITION BY experiment) - row_number() OVER (PARTITION BY experiment ORDER BY raw_p NULLS LAST, hypothesis) + 1) * raw_p AS r FROM al JOIN rd USING (experiment)),
 hh AS (SELECT *, least(1.0, max(r) OVER (PARTITION BY experiment ORDER BY raw_p NULLS LAST, hypothesis ROWS UNBOUNDED PRECEDING)) AS hp FROM rr)
 SELECT experiment, hypothesis, CASE WHEN ready THEN round(raw_p, 6) END AS raw_p, CASE WHEN ready THEN round(hp, 6) END AS holm_p, CASE WHEN NOT ready THEN 'untestable' WHEN hp <= 0.05 THEN 'supported' ELSE 'negative' END AS status FROM hh""")
def _(spark, sf):
    tag = lambda d, h: d.select("experiment", F.lit(h).alias("hypothesis"), "status", F.col("raw_p").cast("double").alias("raw_p"))
    e = cut(effects(spark, sf))
    p = p_values(e, ["experiment"])  # H2 and H4 read the same draws
    h2 = p.select("experiment", F.lit("ok").alias("status"), F.col("p3").alias("raw_p"))
    raw = tag(h1(spark, sf, e), "H1").unionByName(tag(h2, "H2")).unionByName(tag(h3(spark, sf, e), "H3")).unionByName(tag(h4(spark, sf, p), "H4"))
    return ops.finalize(raw, ["experiment"]).select("experiment", "hypothesis", *r6("raw_p", "holm_p"), "status")


@query("ablation_table", with_(BF1 + re.sub(r"\bdr(?=\b|_)", "dr2", CON[len(RP):]))
       + """SELECT 'control' AS condition_id, 'equal_domain' AS held_domain, (SELECT count(*) FROM pr) AS recording_count, round(bo.estimate, 6) AS mean_macro_f1, round(bf.low, 6) AS ci95_low, round(bf.high, 6) AS ci95_high,
  round(-co.estimate, 6) AS delta_vs_main, round(-cs.high, 6) AS delta_ci95_low, round(-cs.low, 6) AS delta_ci95_high FROM bo JOIN bf USING (condition), co, cs WHERE condition = 'control'""")
def _(spark, sf):
    """Ablated condition against the main one; the sign of the contrast is flipped."""
    own = f1_interval(spark, sf).where("condition = 'control'")
    c = cut(contrast(spark, sf))
    n = v.windows(spark, sf, classes=10).agg(F.count_distinct("recording_id").alias("n"))
    one = lambda d, name: d.select(name).scalar()
    return own.select(
        F.col("condition").alias("condition_id"), F.lit("equal_domain").alias("held_domain"), one(n, "n").alias("recording_count"),
        F.round("estimate", 6).alias("mean_macro_f1"), F.round("low", 6).alias("ci95_low"), F.round("high", 6).alias("ci95_high"),
        F.round(-one(c, "estimate"), 6).alias("delta_vs_main"), F.round(-one(c, "high"), 6).alias("delta_ci95_low"), F.round(-one(c, "low"), 6).alias("delta_ci95_high"))


@query("robustness_table", with_(ROB + macro2("rp", ["condition", "fold", "seed"], "sf")) + """, sv AS (SELECT condition, seed, avg(f1) AS f1 FROM sf GROUP BY ALL)
 SELECT condition AS condition_id, round((max(f1) FILTER (WHERE seed = 0) + 2 * max(f1) FILTER (WHERE seed = 1) + max(f1) FILTER (WHERE seed = 2)) / 4, 6) AS area, arg_min(seed, (f1, seed)) AS worst_setting,
 round(max(f1) - min(f1), 6) AS worst_degradation, round(max(ra.low), 6) AS ci95_low, round(max(ra.high), 6) AS ci95_high FROM sv JOIN ra USING (condition) GROUP BY condition""")
def _(spark, sf):
    keys = ["condition", "fold", "seed"]
    f1 = m.macro_f1(m.cells(recs(spark, sf), keys), keys).groupBy("condition", F.col("seed").alias("severity")).agg(F.avg("macro_f1").alias("value"))
    area = m.curve_area(f1, ["condition"])
    worst = f1.groupBy("condition").agg(F.min_by("severity", F.struct("value", "severity")).alias("worst_setting"), (F.max("value") - F.min("value")).alias("worst_degradation"))
    ci = rs.interval(m.curve_area(robustness_draws(spark, sf), ["condition", "draw"]), ["condition"], "area")
    d = area.join(worst, "condition").join(ci, "condition")
    return d.select(F.col("condition").alias("condition_id"), *r6("area"), "worst_setting", *r6("worst_degradation"), F.round("low", 6).alias("ci95_low"), F.round("high", 6).alias("ci95_high"))


@query("detection_table", with_(BDET2) + """, oa AS (SELECT a.condition, a.fold, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc FROM sc0 a JOIN sc0 b ON a.condition = b.condition AND a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY ALL),
 oc AS (SELECT condition, fold, count(*) FILTER (WHERE y = 0 AND score >= 0.9) / greatest(count(*) FILTER (WHERE y = 0), 1) AS far, count(*) FILTER (WHERE y = 1 AND score < 0.9) / greatest(count(*) FILTER (WHERE y = 1), 1) AS miss, count(*) AS n FROM sc0 GROUP BY ALL)
 SELECT condition AS condition_id, round(avg(auroc), 6) AS auroc, round(avg(far), 6) AS far, round(avg(miss), 6) AS miss_rate, round(max(auroc_low), 6) AS ci95_low, round(max(auroc_high), 6) AS ci95_high, CAST(sum(n) AS BIGINT) AS recording_count
 FROM oa JOIN oc USING (condition, fold) JOIN bx USING (condition) GROUP BY condition""")
def _(spark, sf):
    s = cut(m.binary_scores(ensemble(spark, sf)).drop("probs"))
    keys = ["condition", "fold"]
    n = s.groupBy(*keys).agg(F.count("*").alias("n"))
    d = m.auroc(s, keys).join(m.detection_counts(s, keys, F.lit(0.9)), keys).join(n, keys)
    o = d.groupBy("condition").agg(F.avg("auroc").alias("auroc"), F.avg("far").alias("far"), F.avg("miss_rate").alias("miss_rate"), F.sum("n").alias("recording_count"))
    return o.join(detection_interval(spark, sf), "condition").select(
        F.col("condition").alias("condition_id"), *r6("auroc", "far", "miss_rate"), F.round("auroc_low", 6).alias("ci95_low"), F.round("auroc_high", 6).alias("ci95_high"), "recording_count")


@query("per_class_table", with_(PC + macro2("ens", ["condition", "fold"], "fo")) + """, oc AS (SELECT condition, label, avg(tp / greatest(named, 1)) AS precision, avg(tp / greatest(sup, 1)) AS recall, CAST(sum(sup) AS BIGINT) AS recording_support FROM fo_s GROUP BY ALL)
 SELECT condition AS condition_id, label AS class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, recording_support, round(low, 6) AS ci95_low, round(high, 6) AS ci95_high FROM oc JOIN cq USING (condition, label)""")
def _(spark, sf):
    c = cut(ensemble_cells(spark, sf))
    per = m.class_scores(c, ["condition", "fold"]).groupBy("condition", "label").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.sum("support").alias("recording_support"))
    d = rs.draw_cells(c, ["condition"], ["fold", "truth"], ["pred"], B, SEED).withColumnRenamed("m", "n")
    b = m.class_scores(d, ["condition", "fold", "draw"]).groupBy("condition", "label", "draw").agg(F.avg("f1").alias("v"))
    o = per.join(rs.interval(b, ["condition", "label"], "v"), ["condition", "label"])
    return o.select(F.col("condition").alias("condition_id"), F.col("label").alias("class_id"), *r6("precision", "recall"), "recording_support", F.round("low", 6).alias("ci95_low"), F.round("high", 6).alias("ci95_high"))


@query("calibration_table", with_(_CAL) + """SELECT condition AS condition_id, fold AS held_domain, CAST(bin AS INTEGER) AS bin, round(confidence, 6) AS confidence, round(accuracy, 6) AS empirical_accuracy, support AS bin_support,
 round(ece, 6) AS ece, round(brier, 6) AS brier, round(nll, 6) AS nll FROM bins JOIN ece USING (condition, fold) JOIN pt USING (condition, fold)""")
def _(spark, sf):
    e, keys = cut(ensemble(spark, sf)), ["condition", "fold"]
    d = m.calibration_bins(e, keys).join(m.calibration(e, keys), keys)
    return d.select(F.col("condition").alias("condition_id"), F.col("fold").alias("held_domain"), "bin", *r6("confidence"), F.round("accuracy", 6).alias("empirical_accuracy"), F.col("support").alias("bin_support"), *r6("ece", "brier", "nll"))


@query("pilot_report", with_(BF1) + """SELECT condition, round(max(estimate), 6) AS mean_f1, round(max(worst), 6) AS worst_f1, round(max(low), 6) AS ci95_low, round(max(high), 6) AS ci95_high,
 round(max(f1) FILTER (WHERE fold = 'd0'), 6) AS d0, round(max(f1) FILTER (WHERE fold = 'd1'), 6) AS d1, round(max(f1) FILTER (WHERE fold = 'd2'), 6) AS d2 FROM fo JOIN bo USING (condition) JOIN bf USING (condition) GROUP BY condition""")
def _(spark, sf):
    f1 = m.macro_f1(ensemble_cells(spark, sf), ["condition", "fold"])
    wide = f1.groupBy("condition").pivot("fold", ["d0", "d1", "d2"]).agg(F.max("macro_f1"))
    worst = f1.groupBy("condition").agg(F.min("macro_f1").alias("worst_f1"))
    d = f1_interval(spark, sf).join(wide, "condition").join(worst, "condition")
    return d.select("condition", F.round("estimate", 6).alias("mean_f1"), *r6("worst_f1"), F.round("low", 6).alias("ci95_low"), F.round("high", 6).alias("ci95_high"), *r6("d0", "d1", "d2"))


@query("validate_results", with_(RP) + """, bad AS (SELECT *, CASE WHEN vec_id % 50 = 7 THEN list_transform(probs, lambda p: p * 1.01) WHEN vec_id % 50 = 9 THEN list_transform(probs, lambda p: p - 0.001) ELSE probs END AS pb FROM wp)
 SELECT condition, seed, fault, count(*) AS n FROM (SELECT condition, seed, 'probabilities_do_not_sum_to_one' AS fault FROM bad WHERE abs(list_sum(pb) - 1) > 1e-9
  UNION ALL SELECT condition, seed, 'negative_probability' FROM bad WHERE len(list_filter(pb, lambda p: p < 0)) > 0
  UNION ALL SELECT condition, seed, 'recording_repeated' FROM bad GROUP BY condition, seed, recording_id HAVING count(*) > 1) GROUP BY ALL""")
def _(spark, sf):
    """Window rows offered as recording rows, some of them spoiled: every fault must show."""
    p = v.window_predictions(spark, sf)
    spoiled = F.when(F.col("vec_id") % 50 == 7, F.transform("probs", lambda x: x * 1.01)).when(
        F.col("vec_id") % 50 == 9, F.transform("probs", lambda x: x - 0.001)).otherwise(F.col("probs"))
    p = p.withColumn("probs", spoiled).withColumn("pred", m.argmax("probs"))
    return report.prediction_faults(p, ["condition", "seed"], v.CLASSES).groupBy("condition", "seed", "fault").agg(F.count("*").alias("n"))


@query("recompute_report", with_(F1) + """, st AS (SELECT condition, fold, CASE WHEN fold = 'd1' THEN round(macro_f1, 3) ELSE macro_f1 END AS stored, macro_f1 AS fresh FROM f1)
 SELECT condition, fold, 'macro_f1' AS field, round(stored, 6) AS stored, round(fresh, 6) AS fresh FROM st WHERE abs(stored - fresh) > 1e-9""")
def _(spark, sf):
    """A stored summary with one domain rounded away against its recomputation."""
    fresh = cut(m.macro_f1(ensemble_cells(spark, sf), ["condition", "fold"]))
    stored = fresh.withColumn("macro_f1", F.when(F.col("fold") == "d1", F.round("macro_f1", 3)).otherwise(F.col("macro_f1")))
    d = report.compare_stored(stored, fresh, ["condition", "fold"], ["macro_f1", "balanced_accuracy"], 1e-9)
    return d.select("condition", "fold", "field", *r6("stored", "fresh"))


@query("provenance_report", """WITH f AS (SELECT source, CASE WHEN count(*) % 7 = 0 THEN NULL WHEN count(*) % 5 = 0 THEN upper(sha256(min(text))) ELSE sha256(min(text)) END AS digest, count(DISTINCT doc_id % 40) AS n_roles FROM documents GROUP BY source)
 SELECT source, fault FROM (SELECT source, 'hash_missing' AS fault FROM f WHERE digest IS NULL UNION ALL SELECT source, 'hash_malformed' FROM f WHERE NOT regexp_matches(digest, '^[0-9a-f]{64}$') UNION ALL SELECT source, 'role_count' FROM f WHERE n_roles <> 40)""")
def _(spark, sf):
    n = F.count("*")
    f = v.table(spark, sf, "documents").groupBy("source").agg(
        F.when(n % 7 == 0, None).when(n % 5 == 0, F.upper(F.sha2(F.min("text"), 256))).otherwise(F.sha2(F.min("text"), 256)).alias("digest"),
        F.count_distinct(F.col("doc_id") % 40).alias("n_roles"))
    return report.provenance_faults(f, "source", "digest", 40)


@query("figure_series", with_(BF1) + """SELECT condition AS series_id, 'main' AS panel_id, CAST(NULL AS DOUBLE) AS x, round(estimate, 6) AS y, round(low, 6) AS ci95_low, round(high, 6) AS ci95_high, (SELECT count(DISTINCT recording_id) FROM ens) AS recording_support, 'equal_domain' AS held_domain FROM bo JOIN bf USING (condition)
 UNION ALL SELECT condition, 'heatmap', CAST(substr(fold, 2) AS DOUBLE), round(f1, 6), NULL, NULL, (SELECT count(DISTINCT recording_id) FROM ens e WHERE e.fold = fo.fold), fold FROM fo""")
def _(spark, sf):
    e = cut(ensemble(spark, sf))
    n = e.agg(F.count_distinct("recording_id").alias("n"))
    main = report.series(f1_interval(spark, sf), "main", series_id=F.col("condition"), y=F.round("estimate", 6), ci95_low=F.round("low", 6),
                         ci95_high=F.round("high", 6), recording_support=n.scalar(), held_domain=F.lit("equal_domain"))
    per = m.macro_f1(m.cells(e, ["condition", "fold"]), ["condition", "fold"]).join(e.groupBy("fold").agg(F.count_distinct("recording_id").alias("n")), "fold")
    heat = report.series(per, "heatmap", series_id=F.col("condition"), x=F.substring("fold", 2, 9), y=F.round("macro_f1", 6), recording_support=F.col("n"), held_domain=F.col("fold"))
    return main.unionByName(heat)
