"""Resampling inference queries, at the fixed number of draws."""

from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators import metrics as m
from ..plans import bank as bk, draws as dr, resampling as rs
from ..session import cut
from ..sources import views as v
from .base import RP, SC, W, query, u, with_
from .metrics import ensemble, recs
from .perturbation import DETERMINISTIC
from .selecting import DISP, medians

B, SEED = 10_000, 24022
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def macro2(src, keys, out, weight="1"):
    k = ", ".join(keys)
    return f""", {out}_s AS (SELECT {k}, label, sum(t) AS sup, sum(n) AS named, sum(h) AS tp FROM (SELECT {k}, truth AS label, {weight} AS t, 0 AS n, CASE WHEN truth = pred THEN {weight} ELSE 0 END AS h FROM {src}
  UNION ALL SELECT {k}, pred, 0, {weight}, 0 FROM {src}) GROUP BY {k}, label),
 {out} AS (SELECT {k}, avg(2.0 * (tp / greatest(named, 1)) * (tp / greatest(sup, 1)) / greatest(tp / greatest(named, 1) + tp / greatest(sup, 1), 1e-12)) AS f1 FROM {out}_s GROUP BY {k})"""


def draws_sql(src, part, stratum, order, out, draws=B, seed=SEED):
    """Resample src rows: positions within (part, stratum) in ``order``; for strata of one block."""
    g = ", ".join([*part, *stratum])
    same = " AND ".join(f"a.{c} = b.{c}" for c in [*part, *stratum])
    return f""", {out}_p AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY {g}) AS sz FROM {src}),
 {out}_z AS (SELECT DISTINCT {g}, sz FROM {out}_p)""" + dr.sql_slots(f"{out}_z", stratum, str(seed), draws, f"{out}_s", tuple(part)) + f""",
 {out} AS (SELECT b.draw, a.* EXCLUDE (pos, sz) FROM {out}_p a JOIN {out}_s b ON {same} AND a.pos = b.loc)"""


CI = "quantile_cont({0}, 0.025) AS low, quantile_cont({0}, 0.975) AS high"


@query("stratified_bootstrap", with_(RP + draws_sql("ens", ["condition"], ["fold", "truth"], "pred", "dr")) + "SELECT condition, fold, draw, truth, pred, count(*) AS m FROM dr GROUP BY ALL")
def _(spark, sf):
    c = m.cells(ensemble(spark, sf), ["condition", "fold"])
    return rs.draw_cells(c, ["condition"], ["fold", "truth"], ["pred"], B, SEED).select("condition", "fold", "draw", "truth", "pred", "m")


@query("stratified_bootstrap_large", with_(RP) + f"SELECT condition, fold, CAST(draw AS INTEGER) AS draw, count(*) AS recordings FROM ens, range({B}) d(draw) GROUP BY ALL")
def _(spark, sf):
    """Every draw has as many recordings as its fold."""
    c = m.cells(ensemble(spark, sf), ["condition", "fold"])
    d = rs.draw_cells(c, ["condition"], ["fold", "truth"], ["pred"], B, SEED)
    return d.groupBy("condition", "fold", "draw").agg(F.sum("m").alias("recordings"))


BF1 = RP + draws_sql("ens", ["condition"], ["fold", "truth"], "pred", "dr") + macro2("dr", ["condition", "fold", "draw"], "fd") + macro2("ens", ["condition", "fold"], "fo") + f""",
 bd AS (SELECT condition, draw, avg(f1) AS v FROM fd GROUP BY ALL), bo AS (SELECT condition, avg(f1) AS estimate, min(f1) AS worst FROM fo GROUP BY ALL),
 bf AS (SELECT condition, {CI.format('v')} FROM bd GROUP BY condition)"""


def f1_interval(spark, sf):
    return rs.bootstrap_macro_f1(ensemble(spark, sf), ["condition"], B, SEED)


@query("bootstrap_macro_f1", with_(BF1) + "SELECT condition, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high FROM bo JOIN bf USING (condition)")
def _(spark, sf):
    return f1_interval(spark, sf).select("condition", *r6("estimate", "low", "high"))


def paired(spark, sf):
    e = ensemble(spark, sf).drop("probs")
    side = lambda c: F.max(F.when(F.col("condition") == c, F.col("pred")))
    return e.groupBy("fold", "recording_id", "truth").agg(side("full").alias("left_pred"), side("control").alias("right_pred"))


CON = RP + """, pr AS (SELECT a.fold, a.recording_id, a.truth, a.pred AS left_pred, b.pred AS right_pred FROM ens a JOIN ens b ON a.fold = b.fold AND a.recording_id = b.recording_id AND a.condition = 'full' AND b.condition = 'control')""" \
    + draws_sql("pr", [], ["fold", "truth"], "left_pred, right_pred", "dr") + """, dl AS (SELECT fold, draw, truth, left_pred AS pred FROM dr), dg AS (SELECT fold, draw, truth, right_pred AS pred FROM dr),
 ol AS (SELECT fold, truth, left_pred AS pred FROM pr), og AS (SELECT fold, truth, right_pred AS pred FROM pr)""" + macro2("dl", ["fold", "draw"], "fl") + macro2("dg", ["fold", "draw"], "fg") + macro2("ol", ["fold"], "gl") + macro2("og", ["fold"], "gg") + """,
 co AS (SELECT avg(gl.f1 - gg.f1) AS estimate, min(gl.f1) - min(gg.f1) AS worst_estimate FROM gl JOIN gg USING (fold)),
 cd AS (SELECT draw, avg(fl.f1 - fg.f1) AS v, min(fl.f1) - min(fg.f1) AS w FROM fl JOIN fg USING (fold, draw) GROUP BY draw),
 cs AS (SELECT quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, quantile_cont(w, 0.025) AS worst_low, quantile_cont(w, 0.975) AS worst_high,
  (1 + count(*) FILTER (WHERE v - (SELECT estimate FROM co) >= (SELECT estimate FROM co) - 1e-12)) / (count(*) + 1) AS raw_p FROM cd)"""


def contrast(spark, sf):
    return rs.bootstrap_contrast(cut(paired(spark, sf)), ["fold", "truth"], B, SEED)


@query("bootstrap_contrast", with_(CON) + "SELECT round(estimate, 6) AS estimate, round(worst_estimate, 6) AS worst_estimate, round(low, 6) AS low, round(high, 6) AS high, round(worst_low, 6) AS worst_low, round(worst_high, 6) AS worst_high, round(raw_p, 6) AS raw_p FROM co, cs")
def _(spark, sf):
    return contrast(spark, sf).select(*r6("estimate", "worst_estimate", "low", "high", "worst_low", "worst_high", "raw_p"))


THRESHOLD = 0.9
BDET = RP + ", sc0 AS (SELECT condition, fold, recording_id, truth, CASE WHEN truth <> 0 THEN 1 ELSE 0 END AS y, 1.0 - probs[1] AS score FROM ens)" \
    + draws_sql("sc0", ["condition"], ["fold", "truth"], "recording_id", "dr") + f""",
 au AS (SELECT a.condition, a.fold, a.draw, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc FROM dr a JOIN dr b ON a.condition = b.condition AND a.fold = b.fold AND a.draw = b.draw AND a.y = 1 AND b.y = 0 GROUP BY ALL),
 ro AS (SELECT condition, fold, draw, y, row_number() OVER q AS k, sum(y) OVER (q ROWS UNBOUNDED PRECEDING) AS c FROM dr WINDOW q AS (PARTITION BY condition, fold, draw ORDER BY score DESC, y)),
 ap AS (SELECT condition, fold, draw, sum(y * c / k) / sum(y) AS auprc FROM ro GROUP BY ALL),
 ct AS (SELECT condition, fold, draw, count(*) FILTER (WHERE y = 0 AND score >= {THRESHOLD}) / greatest(count(*) FILTER (WHERE y = 0), 1) AS far, count(*) FILTER (WHERE y = 1 AND score < {THRESHOLD}) / greatest(count(*) FILTER (WHERE y = 1), 1) AS miss FROM dr GROUP BY ALL),
 bt AS (SELECT condition, draw, avg(auroc) AS auroc, avg(auprc) AS auprc, avg(far) AS far, avg(miss) AS miss FROM au JOIN ap USING (condition, fold, draw) JOIN ct USING (condition, fold, draw) GROUP BY ALL)"""
_DM = ("auroc", "auprc", "far", "miss")
BDET2 = BDET + ", bx AS (SELECT condition, " + ", ".join(f"quantile_cont({c}, 0.025) AS {c}_low, quantile_cont({c}, 0.975) AS {c}_high" for c in _DM) + " FROM bt GROUP BY condition)"


def detection_draws(spark, sf):
    scored = m.binary_scores(ensemble(spark, sf)).select("condition", "fold", "recording_id", "truth", "y", "score")
    # strata are the same recordings in every condition: one row carries all conditions' scores
    rows = scored.groupBy("fold", "truth", "recording_id").agg(F.collect_list(F.struct("condition", "y", "score")).alias("scores"))
    d = rs.draw_recordings(rows, ["fold", "truth"], B, SEED, ["scores"])
    d = cut(d.select("fold", "truth", "recording_id", "draw", "m", F.inline("scores")))
    keys = ["condition", "fold", "draw"]
    fired, y, n = (F.col("score") >= THRESHOLD).cast("int"), F.col("y"), F.col("m")
    rates = d.groupBy(*keys).agg(
        (F.sum(n * (1 - y) * fired) / F.greatest(F.sum(n * (1 - y)), F.lit(1))).alias("far"),
        (F.sum(n * y * (1 - fired)) / F.greatest(F.sum(n * y), F.lit(1))).alias("miss"))
    t = m.auroc(d, keys, "m").join(m.weighted_average_precision(d, keys, "m"), keys).join(rates, keys)
    return t.groupBy("condition", "draw").agg(*[F.avg(c).alias(c) for c in _DM])


def detection_interval(spark, sf):
    t = detection_draws(spark, sf)
    cols = [F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in _DM]  # one row per draw
    q = t.groupBy("condition").agg(*cols)
    return q.select("condition", *[q[c][k].alias(f"{c}_{s}") for c in _DM for k, s in enumerate(("low", "high"))])


@query("bootstrap_detection", with_(BDET2) + "SELECT condition, " + ", ".join(f"round({c}_{s}, 6) AS {c}_{s}" for c in _DM for s in ("low", "high")) + " FROM bx")
def _(spark, sf):
    return detection_interval(spark, sf).select("condition", *r6(*[f"{c}_{s}" for c in _DM for s in ("low", "high")]))


PC = RP + draws_sql("ens", ["condition"], ["fold", "truth"], "pred", "dr") + macro2("dr", ["condition", "fold", "draw"], "fd") + f""",
 cf AS (SELECT condition, fold, draw, label, 2.0 * (tp / greatest(named, 1)) * (tp / greatest(sup, 1)) / greatest(tp / greatest(named, 1) + tp / greatest(sup, 1), 1e-12) AS f1 FROM fd_s),
 ca AS (SELECT condition, label, draw, avg(f1) AS v FROM cf GROUP BY ALL), cq AS (SELECT condition, label, avg(v) AS mean_f1, {CI.format('v')} FROM ca GROUP BY ALL)"""


@query("bootstrap_per_class", with_(PC) + "SELECT condition, label, round(mean_f1, 6) AS mean_f1, round(low, 6) AS low, round(high, 6) AS high FROM cq")
def _(spark, sf):
    c = m.cells(ensemble(spark, sf), ["condition", "fold"])
    d = rs.draw_cells(c, ["condition"], ["fold", "truth"], ["pred"], B, SEED).withColumnRenamed("m", "n")
    per = m.class_scores(d, ["condition", "fold", "draw"]).groupBy("condition", "label", "draw").agg(F.avg("f1").alias("v"))
    mean = per.groupBy("condition", "label").agg(F.avg("v").alias("mean_f1"))
    return mean.join(rs.interval(per, ["condition", "label"], "v"), ["condition", "label"]).select("condition", "label", *r6("mean_f1", "low", "high"))


# Severity of a curve point is the seed here: each seed is one setting of the same recordings.
ROB = RP + """, rv AS (SELECT condition, fold, recording_id, truth, list(pred ORDER BY seed) AS ps FROM rp GROUP BY ALL)""" + draws_sql("rv", ["condition"], ["fold", "truth"], "ps", "dr") \
    + ", dv AS (SELECT condition, fold, draw, truth, s AS severity, ps[s + 1] AS pred FROM dr, range(3) z(s))" + macro2("dv", ["condition", "fold", "draw", "severity"], "fd") + """,
 cv AS (SELECT condition, draw, severity, avg(f1) AS f1 FROM fd GROUP BY ALL), ar AS (SELECT condition, draw, (sum(CASE severity WHEN 1 THEN 2 ELSE 1 END * f1)) / 4 AS area FROM cv GROUP BY ALL),
 ra AS (SELECT condition, quantile_cont(area, 0.025) AS low, quantile_cont(area, 0.975) AS high, avg(area) AS mean_area FROM ar GROUP BY condition)"""


def robustness_draws(spark, sf):
    """Recordings are cells of their predictions at all severities, so only counts of cells are drawn."""
    at = lambda k: F.max(F.when(F.col("seed") == k, F.col("pred"))).alias(f"p{k}")
    r = recs(spark, sf).groupBy("condition", "fold", "recording_id", "truth").agg(*[at(k) for k in range(3)])
    cells = r.groupBy("condition", "fold", "truth", "p0", "p1", "p2").agg(F.count("*").alias("n"))
    d = rs.draw_cells(cells, ["condition"], ["fold", "truth"], ["p0", "p1", "p2"], B, SEED)
    d = d.select("condition", "fold", "draw", "truth", "m", F.posexplode(F.array("p0", "p1", "p2")).alias("severity", "pred"))
    f1 = m.macro_f1(m.cells(d, ["condition", "fold", "draw", "severity"], "m"), ["condition", "fold", "draw", "severity"])
    return f1.groupBy("condition", "draw", "severity").agg(F.avg("macro_f1").alias("value"))


@query("bootstrap_robustness", with_(ROB) + "SELECT condition, round(mean_area, 6) AS mean_area, round(low, 6) AS low, round(high, 6) AS high FROM ra")
def _(spark, sf):
    a = m.curve_area(robustness_draws(spark, sf), ["condition", "draw"])
    mean = a.groupBy("condition").agg(F.avg("area").alias("mean_area"))
    return mean.join(rs.interval(a, ["condition"], "area"), "condition").select("condition", *r6("mean_area", "low", "high"))


@query("source_metric_contrast", with_(RP + """, pr0 AS (SELECT 'all' AS fold, a.fold AS domain, a.recording_id, a.truth, a.pred AS left_pred, b.pred AS right_pred FROM ens a JOIN ens b ON a.fold = b.fold AND a.recording_id = b.recording_id AND a.condition = 'full' AND b.condition = 'control')"""
       + draws_sql("pr0", [], ["fold", "domain", "truth"], "left_pred, right_pred", "dr") + """, dl AS (SELECT fold, draw, truth, left_pred AS pred FROM dr), dg AS (SELECT fold, draw, truth, right_pred AS pred FROM dr),
 ol AS (SELECT fold, truth, left_pred AS pred FROM pr0), og AS (SELECT fold, truth, right_pred AS pred FROM pr0)""" + macro2("dl", ["fold", "draw"], "fl") + macro2("dg", ["fold", "draw"], "fg") + macro2("ol", ["fold"], "gl") + macro2("og", ["fold"], "gg")
       + """, co AS (SELECT avg(gl.f1 - gg.f1) AS estimate FROM gl JOIN gg USING (fold)), cd AS (SELECT draw, avg(fl.f1 - fg.f1) AS v FROM fl JOIN fg USING (fold, draw) GROUP BY draw)""")
       + "SELECT round(max(estimate), 6) AS estimate, round((1 + count(*) FILTER (WHERE v - estimate >= estimate - 1e-12)) / (count(*) + 1), 6) AS raw_p FROM cd, co")
def _(spark, sf):
    p = paired(spark, sf).withColumnRenamed("fold", "domain").withColumn("fold", F.lit("all"))
    return rs.bootstrap_contrast(cut(p), ["fold", "domain", "truth"], B, SEED).select(*r6("estimate", "raw_p"))


_INS = DISP + """, mx AS (SELECT domain, recording_id, max(med) FILTER (WHERE family = 'I') AS l, max(med) FILTER (WHERE family = 'Q') AS r FROM fm GROUP BY ALL), df AS (SELECT domain, recording_id, r - l AS diff FROM mx)"""


def instability_gaps(spark, sf, cases=None):
    """Worst case per recording of one family minus the other (comparator minus candidate)."""
    md = (medians(spark, sf, cases) if cases else medians(spark, sf)).groupBy("domain", "recording_id").agg(
        F.max(F.when(F.col("family") == "I", F.col("median"))).alias("l"), F.max(F.when(F.col("family") == "Q", F.col("median"))).alias("r"))
    return cut(md.select("domain", "recording_id", (F.col("r") - F.col("l")).alias("diff")))


def instability_contrast(g):
    d = rs.mean_difference_draws(g, ["domain"], "diff", B, SEED).groupBy("draw").agg(F.avg("v").alias("v"))
    e = g.groupBy("domain").agg(F.avg("diff").alias("v")).agg(F.avg("v").alias("e"))
    p = rs.centered_p(d.withColumn("e", e.scalar()), [], "v", "e", null=-0.01)
    return e.select(F.round("e", 6).alias("estimate"), F.round(p.scalar(), 6).alias("raw_p"))


def domain_p(g):
    d = rs.mean_difference_draws(g, ["domain"], "diff", B, SEED)
    return rs.centered_p(d.join(g.groupBy("domain").agg(F.avg("diff").alias("e")), "domain"), ["domain"], "v", "e").select("domain", *r6("raw_p"))


@query("source_instability_contrast")
def _(spark, sf):
    return instability_contrast(instability_gaps(spark, sf))


@query("source_instability_contrast_fixed_cases", with_(_INS + draws_sql("df", [], ["domain"], "recording_id", "dr")) + """, dd2 AS (SELECT draw, domain, avg(diff) AS v FROM dr GROUP BY ALL), dv AS (SELECT draw, avg(v) AS v FROM dd2 GROUP BY draw),
  ob AS (SELECT avg(v) AS e FROM (SELECT domain, avg(diff) AS v FROM df GROUP BY domain))
  SELECT round(max(e), 6) AS estimate, round((1 + count(*) FILTER (WHERE v - e >= e + 0.01 - 1e-12)) / (count(*) + 1), 6) AS raw_p FROM dv, ob""")
def _(spark, sf):
    return instability_contrast(instability_gaps(spark, sf, DETERMINISTIC))


@query("centered_p", with_(_INS + draws_sql("df", [], ["domain"], "recording_id", "dr")) + """, dd2 AS (SELECT draw, domain, avg(diff) AS v FROM dr GROUP BY ALL), ob AS (SELECT domain, avg(diff) AS e FROM df GROUP BY domain)
  SELECT domain, round((1 + count(*) FILTER (WHERE v - e >= e - 1e-12)) / (count(*) + 1), 6) AS raw_p FROM dd2 JOIN ob USING (domain) GROUP BY domain""")
def _(spark, sf):
    return domain_p(instability_gaps(spark, sf, DETERMINISTIC))


_PB = """WITH pv AS (SELECT o_orderpriority AS k, o_custkey AS recording_id, avg(o_totalprice) / 1000 - 150 AS diff FROM orders GROUP BY ALL)"""


@query("paired_bootstrap", _PB + draws_sql("pv", [], ["k"], "recording_id", "dr") + """, dv AS (SELECT k, draw, avg(diff) AS v FROM dr GROUP BY ALL), ob AS (SELECT k, avg(diff) AS e FROM pv GROUP BY k)
  SELECT k, round(max(e), 4) AS estimate, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high, round((1 + count(*) FILTER (WHERE v - e >= e + 5 - 1e-12)) / (count(*) + 1), 6) AS raw_p FROM dv JOIN ob USING (k) GROUP BY k""")
def _(spark, sf):
    p = v.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_custkey").alias("recording_id")).agg((F.avg("o_totalprice") / 1000 - 150).alias("diff"))
    d = rs.paired_bootstrap(p, ["k"], "diff", B, SEED, F.floor(F.col("recording_id") / 65536), "noninferiority", 5.0)
    return d.select("k", *[F.round(c, 4).alias(c) for c in ("estimate", "low", "high")], *r6("raw_p"))


@query("block_bootstrap_ci", "WITH bl AS (SELECT event_type AS k, user_id AS recording_id, sum(value) AS s, count(value) AS c FROM events GROUP BY ALL)" + draws_sql("bl", [], ["k"], "recording_id", "dr")
       + """, dv AS (SELECT k, draw, sum(s) / sum(c) AS v FROM dr GROUP BY ALL) SELECT k, count(DISTINCT recording_id) AS blocks, round(max(low), 6) AS low, round(max(high), 6) AS high
  FROM bl JOIN (SELECT k, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM dv GROUP BY k) USING (k) GROUP BY k""")
def _(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("k"), "user_id", "value")
    return rs.block_bootstrap_ci(e, ["k"], "user_id", "value", B, SEED, F.floor(F.col("recording_id") / 65536)).select("k", "blocks", *r6("low", "high"))


# ---- the bank: 12 configurations per recording ----

BANK = W + f""", rc AS (SELECT recording_id, domain, cls AS truth, [{', '.join(f'avg(abs(x[{k}]::DOUBLE))' for k in range(1, 13))}] AS ins FROM w GROUP BY ALL),
 bank AS (SELECT f.fold, CASE WHEN domain = f.fold THEN 'held' ELSE 'source' END AS side, domain, recording_id, c AS config, truth, CASE WHEN {u("'bank'", 'recording_id', 'c')} < 0.6 + 0.02 * c THEN truth ELSE 1 - truth END AS pred,
  ins[c + 1] AS instability FROM rc, range(12) z(c), (VALUES ('d0'), ('d1'), ('d2')) f(fold)),
 costs AS (SELECT c AS config, ln(1000.0 * (c % 5 + 1)) AS log_macs, ([8, 16, 32])[c % 3 + 1]::DOUBLE AS resolution FROM range(12) z(c))"""


def bank_rows(spark, sf):
    w = v.windows(spark, sf)
    rc = w.groupBy("recording_id", "domain", F.col("cls").alias("truth")).agg(F.array(*[F.avg(F.abs(F.col("x")[k].cast("double"))) for k in range(12)]).alias("ins"))
    d = rc.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("fold", F.explode(F.array(*[F.lit(f) for f in ("d0", "d1", "d2")])))
    right = uniform("bank", F.col("recording_id"), F.col("config")) < 0.6 + 0.02 * F.col("config")
    d = d.select("fold", F.when(F.col("domain") == F.col("fold"), "held").otherwise("source").alias("side"), "domain", "recording_id", "config", "truth",
                 F.when(right, F.col("truth")).otherwise(1 - F.col("truth")).alias("pred"), F.get("ins", F.col("config")).alias("instability"))
    return cut(d)


def bank_costs(rows):
    c = F.col("config")
    return rows.select("config").distinct().select("config", F.log(1000.0 * (c % 5 + 1)).alias("log_macs"),
                                                   F.element_at(F.array(F.lit(8.0), F.lit(16.0), F.lit(32.0)), (c % 3 + 1).cast("int")).alias("resolution"))


def matrix_sql(src, extra, out, weight="1"):
    e = "".join(f"{c}, " for c in extra)
    keys = [*extra, "fold", "side", "config"]
    on = ", ".join([*extra, "fold", "config"])
    return macro2(src, keys, f"{out}_f") + f""", {out} AS (SELECT {on}, max(f1) FILTER (WHERE side = 'source') AS source_f1, max(f1) FILTER (WHERE side = 'held') AS held_f1, max(i.instability) AS instability
  FROM {out}_f JOIN (SELECT {on}, avg(instability) AS instability FROM {src} WHERE side = 'source' GROUP BY ALL) i USING ({on}) GROUP BY {on})"""


def statistic_sql(src, keys, out):
    """Partial rank statistic by successive projection of midranks."""
    k = ", ".join(keys)
    q = f"PARTITION BY {k}"
    mid = lambda c: f"rank() OVER ({q} ORDER BY {c}) + (count(*) OVER ({q}, {c}) - 1) / 2.0"
    cols = ["source_f1", "log_macs", "resolution", "instability", "dg"]
    text = f""", {out}_0 AS (SELECT *, source_f1 - held_f1 AS dg FROM {src}), {out}_1 AS (SELECT {k}, config, {', '.join(f'{mid(c)} AS {c}' for c in cols)} FROM {out}_0),
 {out}_2 AS (SELECT {k}, config, {', '.join(f'{c} - avg({c}) OVER ({q}) AS {c}' for c in cols)} FROM {out}_1)"""
    for n, control in enumerate(cols[:3]):
        rest = cols[n + 1:]
        kept = "".join(f"{c}, " for c in cols[: n + 1])
        proj = ", ".join(f"{c} - CASE WHEN sum({control} * {control}) OVER ({q}) > 1e-10 THEN sum({control} * {c}) OVER ({q}) / sum({control} * {control}) OVER ({q}) ELSE 0 END * {control} AS {c}" for c in rest)
        text += f", {out}_{n + 3} AS (SELECT {k}, config, {kept}{proj} FROM {out}_{n + 2})"
    return text + f""", {out}_9 AS (SELECT {k}, sum(instability * dg) AS ab, sqrt(sum(instability * instability)) AS na, sqrt(sum(dg * dg)) AS nb, count(*) FILTER (WHERE abs(instability) > 1e-10 AND abs(dg) > 1e-10) AS joint FROM {out}_5 GROUP BY {k}),
 {out} AS (SELECT {k}, joint, CASE WHEN na > 1e-10 AND nb > 1e-10 AND joint >= 8 THEN ab / (na * nb) END AS statistic FROM {out}_9)"""


@query("bank_matrix", with_(BANK + matrix_sql("bank", [], "mx")) + "SELECT fold, CAST(config AS INTEGER) AS config, round(source_f1, 6) AS source_f1, round(held_f1, 6) AS held_f1, round(instability, 6) AS instability FROM mx")
def _(spark, sf):
    return bk.bank_matrix(bank_rows(spark, sf), []).select("fold", "config", *r6("source_f1", "held_f1", "instability"))


PRS = BANK + matrix_sql("bank", [], "mx") + ", mc AS (SELECT * FROM mx JOIN costs USING (config))" + statistic_sql("mc", ["fold"], "st")


@query("partial_rank_statistic", with_(PRS) + "SELECT fold, joint, round(statistic, 6) AS statistic FROM st")
def _(spark, sf):
    rows = bank_rows(spark, sf)
    return bk.partial_rank_statistic(bk.bank_matrix(rows, []).join(bank_costs(rows), "config"), ["fold"]).select("fold", "joint", *r6("statistic"))


_PICK = ", rl AS (SELECT DISTINCT fold, side, domain, truth, recording_id FROM bank)" + draws_sql("rl", [], ["fold", "side", "domain", "truth"], "recording_id", "dr") \
    + ", bd AS (SELECT dr.draw, bank.* FROM bank JOIN dr USING (fold, side, domain, truth, recording_id))"


@query("hierarchical_bootstrap", with_(PRS + _PICK + matrix_sql("bd", ["draw"], "my") + ", md AS (SELECT * FROM my JOIN costs USING (config))" + statistic_sql("md", ["draw", "fold"], "sd"))
       + """, es AS (SELECT CASE WHEN count(statistic) = count(*) THEN avg(statistic) END AS e FROM st), pd AS (SELECT draw, CASE WHEN count(statistic) = count(*) THEN avg(statistic) END AS v FROM sd GROUP BY draw),
  sm AS (SELECT max(e) AS e, count(v) / 10000.0 AS vf, (1 + count(*) FILTER (WHERE v - e >= e - 1e-12)) / (count(v) + 1) AS p, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM pd, es)
  SELECT CASE WHEN vf >= 0.95 AND e IS NOT NULL THEN 'ok' ELSE 'untestable' END AS status, round(e, 6) AS estimate, vf AS valid_fraction, CASE WHEN vf >= 0.95 AND e IS NOT NULL THEN round(p, 6) END AS raw_p,
  CASE WHEN vf >= 0.95 AND e IS NOT NULL THEN round(lo, 6) END AS low, CASE WHEN vf >= 0.95 AND e IS NOT NULL THEN round(hi, 6) END AS high FROM sm""")
def _(spark, sf):
    rows = bank_rows(spark, sf)
    h = bk.hierarchical_bootstrap(rows, bank_costs(rows), B, SEED)
    return h.select("status", *r6("estimate"), "valid_fraction", *r6("raw_p", "low", "high"))


@query("nested_bootstrap")
def _(spark, sf):
    return bk.nested_bootstrap(bank_rows(spark, sf), B, SEED, ["d0", "d1", "d2"])


@query("freedman_lane", with_(BANK + matrix_sql("bank", [], "mx") + """, r0 AS (SELECT *, source_f1 - held_f1 AS dg FROM mx), r1 AS (SELECT fold, config, """ + ", ".join(f"rank() OVER (PARTITION BY fold ORDER BY {c}) + (count(*) OVER (PARTITION BY fold, {c}) - 1) / 2.0 - 6.5 AS {o}" for c, o in (("source_f1", "c"), ("instability", "z"), ("dg", "y"))) + """ FROM r0),
 r2 AS (SELECT fold, config, c, z - sum(c * z) OVER q / sum(c * c) OVER q * c AS z, y - sum(c * y) OVER q / sum(c * c) OVER q * c AS y FROM r1 WINDOW q AS (PARTITION BY fold)),
 pm AS (SELECT draw, config, row_number() OVER (PARTITION BY draw ORDER BY config) AS pos, row_number() OVER (PARTITION BY draw ORDER BY sha256(concat_ws('|', 24021, draw, config))) AS src FROM range(12) a(config), range(10000) b(draw)),
 mv AS (SELECT a.draw, a.config, b.config AS source FROM pm a JOIN pm b ON a.draw = b.draw AND a.pos = b.src UNION ALL SELECT -1, config, config FROM range(12) a(config)),
 sm AS (SELECT draw, t.fold, sum(s.y * t.z) AS yz, sum(t.z * t.z) AS zz, sum(s.y * s.y) - sum(s.y) * sum(s.y) / 12 - pow(sum(t.c * s.y), 2) / sum(t.c * t.c) AS yy FROM mv JOIN r2 t ON t.config = mv.config JOIN r2 s ON s.fold = t.fold AND s.config = mv.source GROUP BY ALL),
 v AS (SELECT draw, avg(yz / sqrt(yy * zz)) AS v FROM sm GROUP BY draw), e AS (SELECT v AS e FROM v WHERE draw = -1)
 SELECT round(max(e), 6) AS estimate, count(*) AS permutations, 'ok' AS status, round((1 + count(*) FILTER (WHERE v >= e - 1e-12)) / (count(*) + 1), 6) AS tail_fraction FROM v, e WHERE draw >= 0"""))
def _(spark, sf):
    """Diagnostic only."""
    f = bk.freedman_lane(bk.bank_matrix(bank_rows(spark, sf), []), B, 24021)
    return f.select(*r6("estimate"), "permutations", "status", *r6("tail_fraction"))
