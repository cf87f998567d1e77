"""Relation queries: three families per sample, each with a clean and a perturbed score."""

from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators import metrics as m, relations as ops
from ..sources import views as v
from .base import WP, query, u, with_

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]

FAM = WP + """, fam AS (SELECT f.seed AS family, f.vec_id AS sample_index, f.recording_id, f.truth, concat('n', f.vec_id % 4) AS nuisance, (f.vec_id // 4) % 3 AS severity,
  f.probs AS cp, c.probs AS pp, list_transform(f.probs, lambda z: ln(z)) AS cl, list_transform(c.probs, lambda z: ln(z)) AS pl
  FROM wp f JOIN wp c ON f.seed = c.seed AND f.vec_id = c.vec_id AND f.condition = 'full' AND c.condition = 'control'),
 rt AS (SELECT *, list_avg(list_transform(range(1, 11), lambda k: abs(cp[k] - pp[k]))) AS gap, sqrt(list_sum(list_transform(range(1, 11), lambda k: pow(pl[k] - cl[k], 2)))) AS ch FROM fam),
 md AS (SELECT family, nuisance, severity, recording_id, median(ch / (gap + 1e-8)) AS ratio FROM rt GROUP BY ALL),
 kp AS (SELECT family, nuisance, severity, list_sort(list(ratio))[CAST(ceil(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS kappa FROM md GROUP BY ALL),
 ev AS (SELECT sample_index, recording_id, truth, rt.nuisance, rt.severity, rt.family, kappa * gap AS risk,
  pl[truth + 1] - list_max(list_transform(list_filter(range(0, 10), lambda k: k <> truth), lambda k: pl[k + 1])) AS margin FROM rt JOIN kp USING (family, nuisance, severity))"""
_B = lambda a, b: f"({a}.risk <= {b}.risk + 1e-6 AND {a}.margin >= {b}.margin - 1e-6 AND ({a}.risk < {b}.risk - 1e-6 OR {a}.margin > {b}.margin + 1e-6))"
REL = FAM + f""", rel AS (SELECT a.sample_index, a.recording_id, a.truth, a.nuisance, a.severity, CASE WHEN {_B('a', 'b')} THEN a.family ELSE b.family END AS winner,
  CASE WHEN {_B('a', 'b')} THEN b.family ELSE a.family END AS loser FROM ev a JOIN ev b ON a.sample_index = b.sample_index AND a.family < b.family AND {_B('a', 'b')} <> {_B('b', 'a')})"""


def pairs(spark, sf):
    p = v.window_predictions(spark, sf)
    side = lambda c: F.max(F.when(F.col("condition") == c, F.col("probs")))
    d = p.groupBy(F.col("seed").alias("family"), F.col("vec_id").alias("sample_index"), "recording_id", "truth").agg(
        side("full").alias("clean"), side("control").alias("perturbed"))
    log = lambda c: F.transform(c, lambda z: F.log(z))
    return d.select(
        "family", "sample_index", "recording_id", "truth", F.concat(F.lit("n"), F.col("sample_index") % 4).alias("nuisance"),
        (F.floor(F.col("sample_index") / 4) % 3).alias("severity"), "clean", "perturbed",
        log("clean").alias("clean_logp"), log("perturbed").alias("perturbed_logp"))


def sizes(spark, sf):
    """Windows per recording bound every group of the scale fit."""
    return v.windows(spark, sf, classes=10).groupBy("recording_id").agg(F.count("*").alias("n"))


def scales(spark, sf, p=None):
    return ops.sensitivity_scale(p if p is not None else pairs(spark, sf), sizes=sizes(spark, sf))


def evidence(spark, sf):
    p = pairs(spark, sf)
    return ops.family_risk_margin(p, scales(spark, sf, p))


def relations(spark, sf):
    return ops.build_relations(evidence(spark, sf))


@query("sensitivity_scale", with_(FAM) + "SELECT family, nuisance, severity, round(kappa, 6) AS kappa FROM kp")
def _(spark, sf):
    return scales(spark, sf).select("family", "nuisance", "severity", *r6("kappa"))


@query("family_risk_margin", with_(FAM) + "SELECT sample_index, family, nuisance, severity, round(risk, 6) AS risk, round(margin, 6) AS margin FROM ev")
def _(spark, sf):
    return evidence(spark, sf).select("sample_index", "family", "nuisance", "severity", *r6("risk", "margin"))


@query("build_relations", with_(REL) + "SELECT * FROM rel")
def _(spark, sf):
    return relations(spark, sf)


@query("relation_coverage", with_(REL) + """, a AS (SELECT nuisance, count(DISTINCT recording_id) AS recordings FROM ev GROUP BY nuisance), c AS (SELECT nuisance, count(DISTINCT recording_id) AS covered FROM rel GROUP BY nuisance)
  SELECT a.nuisance, recordings, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / recordings, 6) AS share FROM a LEFT JOIN c ON a.nuisance = c.nuisance""")
def _(spark, sf):
    e = evidence(spark, sf)
    return ops.relation_coverage(e, ops.build_relations(e)).select("nuisance", "recordings", "covered", *r6("share"))


@query("relation_missing_cells", with_(REL) + """, a AS (SELECT DISTINCT recording_id, nuisance, severity FROM ev), c AS (SELECT DISTINCT recording_id, nuisance, severity, 1 AS got FROM rel)
  SELECT a.nuisance, a.severity, count(*) AS cells, count(*) - count(got) AS missing FROM a LEFT JOIN c USING (recording_id, nuisance, severity) GROUP BY ALL""")
def _(spark, sf):
    e = evidence(spark, sf)
    miss = ops.missing_cells(e, ops.build_relations(e)).groupBy("nuisance", "severity").agg(F.count("*").alias("missing"))
    cells = e.select("recording_id", "nuisance", "severity").distinct().groupBy("nuisance", "severity").agg(F.count("*").alias("cells"))
    return cells.join(miss, ["nuisance", "severity"], "left").na.fill(0, ["missing"])


WGT = REL + """, n1 AS (SELECT recording_id, nuisance, severity, count(*) AS np FROM rel GROUP BY ALL), n2 AS (SELECT recording_id, nuisance, count(*) AS ns FROM n1 GROUP BY ALL),
 n3 AS (SELECT recording_id, count(*) AS nk FROM n2 GROUP BY ALL),
 wr AS (SELECT rel.*, 1.0::DOUBLE / ((SELECT count(*) FROM n3) * nk * ns * np) AS weight FROM rel JOIN n1 USING (recording_id, nuisance, severity) JOIN n2 USING (recording_id, nuisance) JOIN n3 USING (recording_id))"""


@query("relation_weights", with_(WGT) + "SELECT sample_index, winner, loser, round(weight, 9) AS weight FROM wr")
def _(spark, sf):
    return ops.relation_weights(relations(spark, sf)).select("sample_index", "winner", "loser", F.round("weight", 9).alias("weight"))


@query("relation_loss", with_(REL) + """, g AS (SELECT sample_index, list(margin ORDER BY family) AS gate FROM ev GROUP BY sample_index),
 l AS (SELECT recording_id, nuisance, severity, avg(greatest(gate[loser + 1] - gate[winner + 1] + 0.2, 0)) AS v FROM rel JOIN g USING (sample_index) GROUP BY ALL),
 l2 AS (SELECT recording_id, nuisance, avg(v) AS v FROM l GROUP BY ALL), l3 AS (SELECT recording_id, avg(v) AS v FROM l2 GROUP BY ALL)
 SELECT round(avg(v), 6) AS loss FROM l3""")
def _(spark, sf):
    e = evidence(spark, sf)
    gates = e.groupBy("sample_index").agg(F.array_sort(F.collect_list(F.struct("family", "margin"))).alias("_g")).select(
        "sample_index", F.col("_g.margin").alias("gate"))
    return ops.relation_loss(ops.build_relations(e), gates).select(*r6("loss"))


SHUF = REL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY truth, nuisance, severity ORDER BY sample_index, winner, loser) AS pos,
  row_number() OVER (PARTITION BY truth, nuisance, severity ORDER BY sha256(concat_ws('|', 24025, sample_index, winner, loser))) AS tgt, count(*) OVER (PARTITION BY truth, nuisance, severity) AS n FROM rel),
 r2 AS (SELECT *, CASE WHEN bool_and(pos = tgt) OVER (PARTITION BY truth, nuisance, severity) THEN tgt % n + 1 ELSE tgt END AS dst FROM rk)"""


@query("shuffle_relations", with_(SHUF) + """SELECT d.sample_index, d.truth, d.nuisance, d.severity, d.winner AS old_winner, d.loser AS old_loser, s.winner, s.loser
  FROM r2 d JOIN r2 s ON s.truth = d.truth AND s.nuisance = d.nuisance AND s.severity = d.severity AND s.dst = d.pos""")
def _(spark, sf):
    return ops.shuffle_relations(relations(spark, sf), 24025).select(
        "sample_index", "truth", "nuisance", "severity", "old_winner", "old_loser", "winner", "loser")


@query("remap_after_deletion", with_(REL) + """, x AS (SELECT rel.*, k FROM rel, range(3) z(k))
 SELECT CAST(k AS INTEGER) AS deleted, CAST(winner - CASE WHEN winner > k THEN 1 ELSE 0 END AS INTEGER) AS winner, CAST(loser - CASE WHEN loser > k THEN 1 ELSE 0 END AS INTEGER) AS loser, count(*) AS n
 FROM x WHERE winner <> k AND loser <> k GROUP BY ALL""")
def _(spark, sf):
    d = relations(spark, sf).withColumn("deleted", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return ops.remap_after_deletion(d, F.col("deleted")).groupBy("deleted", "winner", "loser").agg(F.count("*").alias("n"))


@query("sample_relations", with_(WGT) + f""", cum0 AS (SELECT *, sum(weight) OVER (ORDER BY sample_index, winner, loser ROWS UNBOUNDED PRECEDING) AS hi FROM wr),
 cum AS (SELECT sample_index, winner, loser, coalesce(lag(hi) OVER o, 0) AS lo, CASE WHEN lead(hi) OVER o IS NULL THEN 1 ELSE hi END AS hi FROM cum0 WINDOW o AS (ORDER BY sample_index, winner, loser)),
 dr AS (SELECT vec_id AS draw, {u("'draw'", 'vec_id')} AS u FROM embeddings)
 SELECT draw, sample_index, winner, loser FROM dr JOIN cum ON u >= lo AND u < hi""")
def _(spark, sf):
    draws = v.windows(spark, sf).select(F.col("vec_id").alias("draw"), uniform("draw", F.col("vec_id")).alias("u"))
    return ops.sample_relations(ops.relation_weights(relations(spark, sf)), draws).select("draw", "sample_index", "winner", "loser")


_ENT = "-list_sum(list_transform(g, lambda p: p * ln(p)))"


@query("routing_summary", with_(FAM) + f""", g0 AS (SELECT sample_index, nuisance, severity, list(exp(-risk) ORDER BY family) AS e FROM ev GROUP BY ALL),
 g1 AS (SELECT nuisance, severity, list_transform(e, lambda z: z / list_sum(e)) AS g FROM g0)
 SELECT nuisance, severity, round(avg(g[1]), 6) AS weight_0, round(avg(g[2]), 6) AS weight_1, round(avg(g[3]), 6) AS weight_2, round(avg({_ENT}), 6) AS entropy FROM g1 GROUP BY ALL""")
def _(spark, sf):
    """Gate weights: softmax of negative risk over the families of a sample."""
    g = evidence(spark, sf).groupBy("sample_index", "nuisance", "severity").agg(F.array_sort(F.collect_list(F.struct("family", "risk"))).alias("_g"))
    g = g.withColumn("_e", F.transform(F.col("_g.risk"), lambda r: F.exp(-r))).withColumn("_t", F.expr("aggregate(_e, 0.0D, (t, z) -> t + z)"))
    g = g.withColumn("gate", F.expr("transform(_e, z -> z / _t)"))
    return ops.routing_summary(g, ["nuisance", "severity"], 3).select("nuisance", "severity", *r6("weight_0", "weight_1", "weight_2", "entropy"))


@query("late_fusion_mean", with_(WP) + """, av AS (SELECT condition, vec_id, min(truth) AS truth, [""" + ", ".join(f"avg(probs[{k}])" for k in range(1, 11)) + """] AS p FROM wp GROUP BY condition, vec_id)
 SELECT condition, vec_id, truth, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred, round(list_max(p), 6) AS confidence FROM av""")
def _(spark, sf):
    d = v.window_predictions(spark, sf).groupBy("condition", "vec_id").agg(F.min("truth").alias("truth"), m.mean_array("probs", v.CLASSES).alias("p"))
    return d.select("condition", "vec_id", "truth", m.argmax("p").alias("pred"), F.round(F.array_max("p"), 6).alias("confidence"))
