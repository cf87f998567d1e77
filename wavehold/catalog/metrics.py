"""Metric queries."""

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..sources import views as v
from .base import OBJ, RP, SC, WP, query, with_


def recs(spark, sf):
    return m.recording_mean_probs(v.window_predictions(spark, sf), ["condition", "seed", "fold"], v.CLASSES)


def ensemble(spark, sf):
    return m.seed_ensemble(recs(spark, sf).drop("pred"), ["condition", "fold"], v.CLASSES)


def ensemble_cells(spark, sf):
    return m.cells(ensemble(spark, sf), ["condition", "fold"])


r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]

CELLS = RP + ", cells AS (SELECT condition, fold, truth, pred, count(*) AS n FROM ens GROUP BY ALL)"
_CS = """, sides AS (SELECT condition, fold, truth AS label, n AS support, 0 AS named,
  CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM cells
  UNION ALL SELECT condition, fold, pred, 0, n, 0 FROM cells),
per0 AS (SELECT condition, fold, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support,
  CAST(sum(named) AS BIGINT) AS named FROM sides GROUP BY ALL),
per1 AS (SELECT *, tp / greatest(named, 1) AS precision, tp / greatest(support, 1) AS recall FROM per0),
per AS (SELECT *, 2.0 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM per1)"""
PER = CELLS + _CS
F1 = PER + ", f1 AS (SELECT condition, fold, avg(f1) AS macro_f1, avg(recall) AS balanced_accuracy FROM per GROUP BY ALL)"


@query("recording_mean_probs", with_(RP) + """SELECT condition, seed, fold, recording_id, truth, pred,
  round(list_max(probs), 6) AS confidence, round(probs[1], 6) AS p_first FROM rp""")
def _(spark, sf):
    return recs(spark, sf).select(
        "condition", "seed", "fold", "recording_id", "truth", "pred",
        F.round(F.array_max("probs"), 6).alias("confidence"), F.round(F.col("probs")[0], 6).alias("p_first"),
    )


@query("seed_ensemble", with_(RP) + """SELECT condition, fold, recording_id, truth, pred,
  round(list_max(probs), 6) AS confidence FROM ens""")
def _(spark, sf):
    return ensemble(spark, sf).select(
        "condition", "fold", "recording_id", "truth", "pred", F.round(F.array_max("probs"), 6).alias("confidence")
    )


@query("seed_alignment", with_(RP) + """, want AS (SELECT condition, fold, count(DISTINCT seed) AS want FROM rp GROUP BY ALL),
 seen AS (SELECT condition, fold, recording_id, count(DISTINCT seed) AS seeds, count(DISTINCT truth) AS truths FROM rp GROUP BY ALL)
 SELECT condition, fold, count(*) AS recordings, count(*) FILTER (WHERE seeds <> want OR truths <> 1) AS misaligned
 FROM seen JOIN want USING (condition, fold) GROUP BY condition, fold""")
def _(spark, sf):
    r = recs(spark, sf)
    bad = m.seed_misalignment(r, ["condition", "fold"]).groupBy("condition", "fold").agg(F.count("*").alias("misaligned"))
    n = r.groupBy("condition", "fold").agg(F.count_distinct("recording_id").alias("recordings"))
    return n.join(bad, ["condition", "fold"], "left").na.fill(0, ["misaligned"])


@query("confusion_matrix", with_(CELLS) + """, labels AS (SELECT condition, fold, truth AS label FROM cells
  UNION SELECT condition, fold, pred FROM cells)
  SELECT a.condition, a.fold, a.label AS truth, b.label AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round(coalesce(c.n, 0) / greatest(sum(coalesce(c.n, 0)) OVER (PARTITION BY a.condition, a.fold, a.label), 1), 6) AS row_share
  FROM labels a JOIN labels b ON a.condition = b.condition AND a.fold = b.fold
  LEFT JOIN cells c ON c.condition = a.condition AND c.fold = a.fold AND c.truth = a.label AND c.pred = b.label""")
def _(spark, sf):
    out = m.confusion_matrix(ensemble_cells(spark, sf), ["condition", "fold"])
    return out.select("condition", "fold", "truth", "pred", "n", *r6("row_share"))


@query("macro_f1", with_(F1) + "SELECT condition, fold, round(macro_f1, 6) AS macro_f1 FROM f1")
def _(spark, sf):
    return m.macro_f1(ensemble_cells(spark, sf), ["condition", "fold"]).select("condition", "fold", *r6("macro_f1"))


@query("classification_report", with_(F1) + """SELECT p.condition, p.fold, p.label, p.support, round(p.precision, 6) AS precision,
  round(p.recall, 6) AS recall, round(p.f1, 6) AS f1, round(f.balanced_accuracy, 6) AS balanced_accuracy
  FROM per p JOIN f1 f USING (condition, fold)""")
def _(spark, sf):
    per = m.class_scores(ensemble_cells(spark, sf), ["condition", "fold"])
    overall = per.groupBy("condition", "fold").agg(F.avg("recall").alias("balanced_accuracy"))
    return per.join(overall, ["condition", "fold"]).select(
        "condition", "fold", "label", "support", *r6("precision", "recall", "f1", "balanced_accuracy")
    )


_BINS = RP + """, b0 AS (SELECT condition, fold, truth, pred, probs, list_max(probs) AS conf FROM ens),
b1 AS (SELECT *, len(list_filter(list_transform(range(0, 10), lambda k: k * 0.1::DOUBLE), lambda e: e <= conf)) - 1 AS bin FROM b0),
bins AS (SELECT condition, fold, bin, count(*) AS support, avg(conf) AS confidence,
  avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END) AS accuracy FROM b1 GROUP BY ALL)"""
_CAL = _BINS + """, ece AS (SELECT condition, fold, sum(support * abs(confidence - accuracy)) / sum(support) AS ece FROM bins GROUP BY ALL),
pt AS (SELECT condition, fold, avg(list_sum(list_transform(range(0, 10), lambda k: pow(probs[k + 1] - CASE WHEN k = truth THEN 1.0 ELSE 0.0 END, 2)))) AS brier,
  -avg(ln(greatest(least(probs[truth + 1], 1.0), 1e-12))) AS nll FROM ens GROUP BY ALL)"""


@query("calibration", with_(_CAL) + """SELECT condition, fold, round(ece, 6) AS ece, round(brier, 6) AS brier, round(nll, 6) AS nll
  FROM ece JOIN pt USING (condition, fold)""")
def _(spark, sf):
    return m.calibration(ensemble(spark, sf), ["condition", "fold"]).select("condition", "fold", *r6("ece", "brier", "nll"))


_WIL = """greatest((p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n), 0.0)"""


@query("wilson_interval", with_(_BINS) + """, x AS (SELECT condition, fold, bin, support, confidence, accuracy,
  accuracy::DOUBLE AS p, support::DOUBLE AS n, 1.96::DOUBLE AS z FROM bins)
 SELECT condition, fold, CAST(bin AS INTEGER) AS bin, support, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy,
 round(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0.0), 6) AS low,
 round(least((p + z*z/(2*n)) / (1 + z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 1.0), 6) AS high FROM x""")
def _(spark, sf):
    b = m.calibration_bins(ensemble(spark, sf), ["condition", "fold"])
    n = F.col("support").cast("double")
    low, high = m.wilson(F.col("accuracy") * n, n)
    return b.select("condition", "fold", "bin", "support", *r6("confidence", "accuracy"),
                    F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


BIN = RP + ", bs AS (SELECT *, 1.0 - probs[1] AS score, CASE WHEN truth <> 0 THEN 1 ELSE 0 END AS y FROM rp)"


@query("binary_scores", with_(BIN) + "SELECT condition, seed, fold, recording_id, y, round(score, 6) AS score FROM bs")
def _(spark, sf):
    return m.binary_scores(recs(spark, sf)).select("condition", "seed", "fold", "recording_id", "y", *r6("score"))


AUC = SC + """, sp AS (SELECT a.domain, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc
  FROM sc a JOIN sc b ON a.domain = b.domain AND a.y = 1 AND b.y = 0 GROUP BY a.domain)"""


@query("auroc", with_(AUC) + """SELECT d.domain, round(sp.auroc, 6) AS auroc FROM (SELECT DISTINCT domain FROM sc) d
  LEFT JOIN sp ON sp.domain = d.domain""")
def _(spark, sf):
    return m.auroc(v.scores(spark, sf), ["domain"]).select("domain", *r6("auroc"))


AP = SC + """, o AS (SELECT domain, y, row_number() OVER z AS k, sum(y) OVER (z ROWS UNBOUNDED PRECEDING) AS c
  FROM sc WINDOW z AS (PARTITION BY domain ORDER BY score DESC, recording_id)),
ap AS (SELECT domain, CASE WHEN sum(y) > 0 THEN sum(y * c / k) / sum(y) END AS auprc FROM o GROUP BY domain)"""


@query("average_precision", with_(AP) + "SELECT domain, round(auprc, 6) AS auprc FROM ap")
def _(spark, sf):
    return m.average_precision(v.scores(spark, sf), ["domain"]).select("domain", *r6("auprc"))


THR = """, thr AS (SELECT domain, list_sort(list(score))[CAST(ceil(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS threshold
  FROM sc WHERE y = 0 GROUP BY domain)"""


@query("source_threshold_by_domain", with_(SC + THR) + """SELECT domain, threshold,
  max(threshold) OVER () AS source_threshold FROM thr""")
def _(spark, sf):
    per = m.source_thresholds(v.scores(spark, sf), ["domain"])
    top = per.agg(F.max("threshold").alias("source_threshold"))
    return per.withColumn("source_threshold", top.scalar())


@query("source_threshold", with_(SC) + """SELECT list_sort(list(score))[CAST(ceil(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS threshold
  FROM sc WHERE y = 0""")
def _(spark, sf):
    return m.source_thresholds(v.scores(spark, sf), [])


DET = SC + THR + """, det AS (SELECT domain,
  CAST(count(*) FILTER (WHERE y = 0 AND NOT score >= t) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE y = 0 AND score >= t) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE y = 1 AND NOT score >= t) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE y = 1 AND score >= t) AS BIGINT) AS tp
  FROM sc, (SELECT max(threshold) AS t FROM thr) GROUP BY domain)"""


@query("detection_metrics", with_(DET) + """SELECT domain, tn, fp, fn, tp, round(fp / greatest(fp + tn, 1), 6) AS far,
 round(fn / greatest(fn + tp, 1), 6) AS miss_rate, round(tn / greatest(fp + tn, 1), 6) AS background_recall,
 round(tp / greatest(fn + tp, 1), 6) AS signal_recall FROM det""")
def _(spark, sf):
    s = v.scores(spark, sf)
    t = m.source_thresholds(s, ["domain"]).agg(F.max("threshold").alias("t"))
    d = m.detection_counts(s.withColumn("t", t.scalar()), ["domain"], F.col("t"))
    return d.select("domain", "tn", "fp", "fn", "tp", *r6("far", "miss_rate", "background_recall", "signal_recall"))


@query("record_metrics", with_(_CAL + _CS.replace("FROM cells", "FROM (SELECT condition, fold, truth, pred, count(*) AS n FROM ens GROUP BY ALL)")
 + """, f1 AS (SELECT condition, fold, avg(f1) AS macro_f1 FROM per GROUP BY ALL),
 sc2 AS (SELECT condition, fold, 1.0 - probs[1] AS score, CASE WHEN truth <> 0 THEN 1 ELSE 0 END AS y FROM ens),
 au AS (SELECT a.condition, a.fold, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc
  FROM sc2 a JOIN sc2 b ON a.condition = b.condition AND a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY ALL)""")
 + """SELECT condition, fold, round(macro_f1, 6) AS macro_f1, round(ece, 6) AS ece, round(brier, 6) AS brier, round(nll, 6) AS nll,
 CASE WHEN auroc IS NULL THEN 'ineligible' ELSE 'ok' END AS detection, round(auroc, 6) AS auroc
 FROM f1 JOIN ece USING (condition, fold) JOIN pt USING (condition, fold) LEFT JOIN au USING (condition, fold)""")
def _(spark, sf):
    e = ensemble(spark, sf)
    keys = ["condition", "fold"]
    f1 = m.macro_f1(m.cells(e, keys), keys)
    auc = m.auroc(m.binary_scores(e), keys)
    out = f1.join(m.calibration(e, keys), keys).join(auc, keys, "left")
    return out.select(*keys, *r6("macro_f1", "ece", "brier", "nll"),
                      F.when(F.col("auroc").isNull(), "ineligible").otherwise("ok").alias("detection"), *r6("auroc"))


@query("curve_area", """WITH c AS (SELECT event_type, dayofmonth(ts) AS severity, avg(value) AS value FROM events GROUP BY ALL),
 l AS (SELECT *, severity - lag(severity) OVER z AS dx, (value + lag(value) OVER z) / 2.0 AS my FROM c
   WINDOW z AS (PARTITION BY event_type ORDER BY severity))
 SELECT event_type, round(sum(dx * my) / nullif(max(severity) - min(severity), 0), 6) AS area FROM l GROUP BY event_type""")
def _(spark, sf):
    c = v.table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").alias("severity")).agg(F.avg("value").alias("value"))
    return m.curve_area(c, ["event_type"]).select("event_type", *r6("area"))


SEEDF1 = WP_SEED = RP + """, sc0 AS (SELECT condition, seed, fold, truth, pred, count(*) AS n FROM rp GROUP BY ALL),
ss AS (SELECT condition, seed, fold, truth AS label, n AS support, 0 AS named, CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM sc0
  UNION ALL SELECT condition, seed, fold, pred, 0, n, 0 FROM sc0),
sp0 AS (SELECT condition, seed, fold, label, sum(tp) / greatest(sum(named), 1) AS pr, sum(tp) / greatest(sum(support), 1) AS re FROM ss GROUP BY ALL),
sf1 AS (SELECT condition, seed, fold, avg(2.0 * pr * re / greatest(pr + re, 1e-12)) AS f1 FROM sp0 GROUP BY ALL)"""


def seed_f1(spark, sf):
    keys = ["condition", "seed", "fold"]
    return m.macro_f1(m.cells(recs(spark, sf), keys), keys)


@query("seed_variability", with_(SEEDF1) + """SELECT condition, fold, round(coalesce(stddev_samp(f1), 0), 6) AS seed_std,
  count(*) AS seeds FROM sf1 GROUP BY condition, fold""")
def _(spark, sf):
    return seed_f1(spark, sf).groupBy("condition", "fold").agg(
        F.round(F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)), 6).alias("seed_std"), F.count("*").alias("seeds")
    )


@query("domain_summary", with_(F1) + """SELECT condition, round(avg(macro_f1), 6) AS mean_f1, round(min(macro_f1), 6) AS worst_f1,
  min_by(fold, (macro_f1, fold)) AS worst_domain, count(*) AS domains FROM f1 GROUP BY condition""")
def _(spark, sf):
    return m.macro_f1(ensemble_cells(spark, sf), ["condition", "fold"]).groupBy("condition").agg(
        F.round(F.avg("macro_f1"), 6).alias("mean_f1"), F.round(F.min("macro_f1"), 6).alias("worst_f1"),
        F.min_by("fold", F.struct("macro_f1", "fold")).alias("worst_domain"), F.count("*").alias("domains"),
    )


@query("domain_heatmap", with_(F1) + """SELECT condition, round(max(macro_f1) FILTER (WHERE fold = 'd0'), 6) AS d0,
  round(max(macro_f1) FILTER (WHERE fold = 'd1'), 6) AS d1, round(max(macro_f1) FILTER (WHERE fold = 'd2'), 6) AS d2 FROM f1 GROUP BY condition""")
def _(spark, sf):
    f1 = m.macro_f1(ensemble_cells(spark, sf), ["condition", "fold"])
    return f1.groupBy("condition").pivot("fold", ["d0", "d1", "d2"]).agg(F.round(F.max("macro_f1"), 6))


@query("cohens_d_paired", with_(SEEDF1) + """, pr2 AS (SELECT a.fold, a.seed, a.f1 - b.f1 AS diff FROM sf1 a JOIN sf1 b
  ON a.fold = b.fold AND a.seed = b.seed AND a.condition = 'full' AND b.condition = 'control')
  SELECT fold, count(*) AS n, round(CASE WHEN count(*) < 2 THEN NULL WHEN stddev_samp(diff) <= 1e-12 THEN
  CASE WHEN abs(avg(diff)) <= 1e-12 THEN 0 ELSE 'inf'::DOUBLE END ELSE avg(diff) / stddev_samp(diff) END, 6) AS d FROM pr2 GROUP BY fold""")
def _(spark, sf):
    f1 = seed_f1(spark, sf)
    wide = f1.groupBy("fold", "seed").pivot("condition", ["full", "control"]).agg(F.max("macro_f1"))
    return m.cohens_d(wide.withColumn("diff", F.col("full") - F.col("control")), ["fold"], "diff").select("fold", "n", *r6("d"))


@query("midranks", """SELECT l_returnflag AS grp, l_orderkey, l_linenumber,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS midrank FROM lineitem""")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_orderkey", "l_linenumber", "l_quantity")
    return m.midranks(li, ["grp"], "l_quantity").drop("l_quantity")
