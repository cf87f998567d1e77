"""Perturbation queries on complex windows of 32 samples."""

from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators import metrics as m, perturb as ops, transforms as tr, windows as wo
from ..operators.fit import array_sum
from ..sources import views as v
from .base import W, query, with_
from .splits import ROLES, fold_plan
from .transforms import IL

GRID_SQL = "gr AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{name}', {sev!r}::DOUBLE, '{name}:{sev:.10g}')" for n, (name, sev) in enumerate(ops.CASES)) + ") z(case_index, nuisance, severity, case_id))"

# Every deterministic case is linear: y[n] = sum over m of (wr + i wi) x[m].
OP = GRID_SQL + """, op AS (
 SELECT case_index, n, n AS m, cos(2 * pi() * severity * n) AS wr, sin(2 * pi() * severity * n) AS wi FROM gr, range(32) z(n) WHERE nuisance = 'carrier_frequency_offset'
 UNION ALL SELECT case_index, n, n, cos(severity), sin(severity) FROM gr, range(32) z(n) WHERE nuisance = 'global_phase'
 UNION ALL SELECT case_index, n, (n - CAST(severity AS INTEGER) + 32) % 32, 1, 0 FROM gr, range(32) z(n) WHERE nuisance = 'timing_offset'
 UNION ALL SELECT case_index, n, m, 1 - abs(t - m), 0 FROM (SELECT case_index, n, (n - 15.5) / (1 + severity) + 15.5 AS t FROM gr, range(32) z(n) WHERE nuisance = 'time_scaling'), range(32) y(m) WHERE abs(t - m) < 1
 UNION ALL SELECT case_index, n, m, CASE WHEN m = n THEN 1 WHEN m = n + 1 THEN 0.25 * (pow(10, severity / 20) - 1) ELSE -0.25 * (pow(10, severity / 20) - 1) END, 0
   FROM gr, range(32) z(n), range(32) y(m) WHERE nuisance = 'bandpass_response' AND abs(m - n) <= 1)"""
PT = IL + ", " + OP + """, pt AS (SELECT vec_id, case_index, op.n, sum(wr * re - wi * im) AS re, sum(wr * im + wi * re) AS im FROM il JOIN op ON op.m = il.n GROUP BY ALL)"""


def fixed_case(name, form):
    severities = dict(ops.GRID)[name]

    def run(spark, sf):
        w = v.iq_windows(spark, sf).select("vec_id", "i", "q", F.explode(F.array(*[F.lit(s) for s in severities])).alias("severity"))
        i, q = form(F.col("severity"))
        d = w.select("vec_id", "severity", F.posexplode(F.arrays_zip(i.alias("re"), q.alias("im"))).alias("n", "y"))
        return d.select("vec_id", "severity", "n", (F.round("y.re", 6) + F.lit(0.0)).alias("re"), (F.round("y.im", 6) + F.lit(0.0)).alias("im"))

    return run


for _name, _id, _form in (
    ("shift_frequency", "carrier_frequency_offset", ops.shift_frequency),
    ("rotate_phase", "global_phase", ops.rotate_phase),
    ("shift_time", "timing_offset", ops.shift_time),
    ("scale_time", "time_scaling", ops.scale_time),
    ("bandpass_ripple", "bandpass_response", ops.bandpass_ripple),
):
    query(_name, with_(PT) + f"""SELECT vec_id, severity, CAST(pt.n AS INTEGER) AS n, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im FROM pt JOIN gr USING (case_index) WHERE nuisance = '{_id}'""")(
        fixed_case(_id, _form))


@query("nuisance_grid", with_(GRID_SQL) + """SELECT case_index, nuisance, severity, case_id, count(*) AS cells FROM embeddings, gr GROUP BY ALL""")
def _(spark, sf):
    d = v.windows(spark, sf).withColumn("_c", F.explode(ops.case_array())).select("_c.*").drop("severity_index")
    return d.groupBy("case_index", "nuisance", "severity", "case_id").agg(F.count("*").alias("cells"))


def first_windows(spark, sf):
    """Earliest complex window per recording with the recording's index."""
    w = v.iq_windows(spark, sf, starts=True)
    first = wo.first_window(w, ["recording_id", "domain", "label"], ["start", "vec_id", "cls", "i", "q"])
    return ops.recording_position(first)


@query("expand_relations", with_(W, GRID_SQL) + """, f AS (SELECT *, row_number() OVER (ORDER BY recording_id) - 1 AS position FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY start) = 1))
  SELECT recording_id, vec_id, case_index, case_id, position * 32 + case_index AS cell, 80000 + 1009 * position + case_index AS seed FROM f, gr""")
def _(spark, sf):
    e = ops.expand_relations(first_windows(spark, sf), ops.seeds("fit_relations"))
    return e.select("recording_id", "vec_id", "case_index", "case_id", "cell", "seed")


def cells_of(spark, sf, *names, use="bank_metrics"):
    """Cells of all windows, numbered by recording and start."""
    w = wo.global_order(v.iq_windows(spark, sf, starts=True), 64)
    case = "severity_index" if use == "robustness" else "case_index"
    return ops.expand_relations(w, ops.seeds(use), cases=[c for c in ops.CASES if c[0] in names], case=case)


def power_of(i="i", q="q"):
    return F.expr(f"aggregate(zip_with({i}, {q}, (a, b) -> cast(a as double) * a + cast(b as double) * b), 0.0D, (t, z) -> t + z) / size({i})")


def noise_power(spark, sf, name):
    """Power of (perturbed - clean) over clean power, which the scaling rule fixes exactly."""
    c = cells_of(spark, sf, name).withColumn("ci", F.col("i")).withColumn("cq", F.col("q"))
    p = ops.perturb_rows(c, ["vec_id", "severity", "ci", "cq"])
    p = p.withColumn("di", F.zip_with("i", "ci", lambda a, b: a - b)).withColumn("dq", F.zip_with("q", "cq", lambda a, b: a - b))
    return p.select("vec_id", "severity", power_of("di", "dq").alias("noise"), power_of("ci", "cq").alias("clean"), power_of().alias("power"))


_POWER = IL + ", " + GRID_SQL + ", pw AS (SELECT vec_id, avg(re * re + im * im) AS p FROM il GROUP BY vec_id)"


@query("add_awgn")
def _(spark, sf):
    d = noise_power(spark, sf, "awgn")
    return d.groupBy("severity").agg(F.count("*").alias("windows"), F.round(F.avg(F.col("noise") / F.col("clean")), 6).alias("mean_ratio"))


@query("add_colored_noise", with_(_POWER) + """SELECT vec_id, severity, round(p / pow(10, severity / 10), 6) AS noise FROM pw, gr WHERE nuisance = 'colored_noise'""")
def _(spark, sf):
    return noise_power(spark, sf, "colored_noise").select("vec_id", "severity", F.round("noise", 6).alias("noise"))


@query("mix_interferer", with_(_POWER) + """SELECT vec_id, severity, round(p / pow(10, severity / 10), 6) AS noise FROM pw, gr WHERE nuisance = 'ism_mixing'""")
def _(spark, sf):
    return noise_power(spark, sf, "ism_mixing").select("vec_id", "severity", F.round("noise", 6).alias("noise"))


@query("flat_fade", with_(_POWER) + """SELECT vec_id, severity, round(p * severity * severity, 6) AS power FROM pw, gr WHERE nuisance = 'flat_fading'""")
def _(spark, sf):
    return noise_power(spark, sf, "flat_fading").select("vec_id", "severity", F.round("power", 6).alias("power"))


@query("add_multipath")
def _(spark, sf):
    d = noise_power(spark, sf, "multipath")
    return d.groupBy("severity").agg(F.count("*").alias("windows"), F.round(F.avg(F.col("power") / F.col("clean")), 6).alias("mean_ratio"))


DETERMINISTIC = [c for c in ops.CASES if c[0] in ops.FIXED]


def iq_families():
    return {"I": lambda x: x.real, "Q": lambda x: x.imag}


# the windows that fits and selection may see: source recordings of the first fold
SOURCE = """so AS (SELECT recording_id, role FROM roles WHERE fold_id = 'd0' AND role IN ('source_fit', 'source_selection'))"""


def source_windows(spark, sf):
    plan = fold_plan(spark, sf).where("fold_id = 'd0' AND role IN ('source_fit', 'source_selection')").select("recording_id", "role")
    return v.iq_windows(spark, sf).join(plan, "recording_id").withColumn("position", F.col("vec_id"))


def source_pairs(spark, sf, cases):
    """Same transform on both sides, standardised with statistics of the clean windows of source_fit."""
    w = source_windows(spark, sf)
    pairs = ops.paired_maps(w, ["vec_id"], iq_families(), ops.seeds("fit_relations"), cases=cases)
    stats = w.where("role = 'source_fit'").select(F.posexplode("i").alias("n", "a"), "q").select("a", F.get("q", F.col("n")).alias("b")).agg(
        F.struct(F.avg("a").alias("mi"), F.avg("b").alias("mq"), F.stddev_pop("a").alias("si"), F.stddev_pop("b").alias("sq")).alias("s"))
    d = pairs.withColumn("_s", stats.scalar())
    first = F.col("family") == "I"
    mean, scale = F.when(first, F.col("_s.mi")).otherwise(F.col("_s.mq")), F.when(first, F.col("_s.si")).otherwise(F.col("_s.sq"))
    gap = F.expr("aggregate(zip_with(perturbed, clean, (a, b) -> abs(a - b)), 0.0D, (t, z) -> t + z) / size(clean)") / scale
    level = (F.expr("aggregate(perturbed, 0.0D, (t, z) -> t + z) / size(clean)") - mean) / scale
    return d.select("vec_id", "case_index", "family", F.round(gap, 6).alias("mean_gap"), F.round(level, 5).alias("mean_perturbed"))


@query("paired_features")
def _(spark, sf):
    return source_pairs(spark, sf, ops.CASES)


@query("paired_features_fixed_cases", with_(ROLES, PT[len(W) + 2:], SOURCE) + """, st AS (SELECT avg(re) AS mi, avg(im) AS mq, stddev_pop(re) AS si, stddev_pop(im) AS sq FROM il JOIN w USING (vec_id) JOIN so ON so.recording_id = w.recording_id WHERE so.role = 'source_fit'),
 pr AS (SELECT pt.vec_id, case_index, 'I' AS family, abs(pt.re - il.re) / si AS d, (pt.re - mi) / si AS z FROM pt JOIN il ON pt.vec_id = il.vec_id AND pt.n = il.n, st
  UNION ALL SELECT pt.vec_id, case_index, 'Q', abs(pt.im - il.im) / sq, (pt.im - mq) / sq FROM pt JOIN il ON pt.vec_id = il.vec_id AND pt.n = il.n, st)
 SELECT vec_id, case_index, family, round(avg(d), 6) AS mean_gap, round(avg(z), 5) AS mean_perturbed FROM pr WHERE vec_id IN (SELECT vec_id FROM w JOIN so USING (recording_id)) GROUP BY ALL""")
def _(spark, sf):
    """The cases without a random part."""
    return source_pairs(spark, sf, DETERMINISTIC)


@query("teacher_pairs", with_(IL) + """, g AS (SELECT vec_id, row_number() OVER (ORDER BY recording_id, start) - 1 AS position FROM w), pw AS (SELECT vec_id, avg(re * re + im * im) AS p FROM il GROUP BY vec_id),
 a AS (SELECT -1 AS case_index, p FROM pw UNION ALL SELECT position % 32, p FROM g JOIN pw USING (vec_id))
 SELECT CAST(case_index AS INTEGER) AS case_index, count(*) AS rows, CASE WHEN case_index = -1 OR case_index BETWEEN 13 AND 21 THEN round(avg(p), 6) END AS mean_power FROM a GROUP BY case_index""")
def _(spark, sf):
    """All clean rows, then each window once under the case its index falls on."""
    w = wo.global_order(v.iq_windows(spark, sf, starts=True), 64)
    clean = w.select("recording_id", "start", F.lit(-1).alias("case_index"), F.col("i").cast("array<double>").alias("i"), F.col("q").cast("array<double>").alias("q"))
    turned = ops.perturb_rows(ops.cycle_cases(w, ops.seeds("teacher_pairs")), ["recording_id", "start", "case_index"])
    both = clean.unionByName(turned)
    # power is fixed for clean rows and for the cases that only rotate or shift samples
    kept = (F.col("case_index") == -1) | F.col("case_index").between(13, 21)
    return both.groupBy("case_index").agg(F.count("*").alias("rows"), F.avg(power_of()).alias("p")).select(
        "case_index", "rows", F.when(kept, F.round("p", 6)).alias("mean_power"))


def severity_cells(spark, sf, names, use="bank_metrics"):
    """A fixed two-class score on the perturbed windows: sign of the mean I x Q product."""
    p = ops.perturb_rows(cells_of(spark, sf, *names, use=use).withColumnRenamed("cls", "truth"), ["recording_id", "domain", "truth", "case_index", "nuisance", "severity"])
    s = F.expr("aggregate(zip_with(i, q, (a, b) -> a * b), 0.0D, (t, z) -> t + z)")
    probs = F.array(1 / (1 + F.exp(-4 * s)), 1 / (1 + F.exp(4 * s)))
    r = m.recording_mean_probs(p.withColumn("probs", probs), ["domain", "case_index", "nuisance", "severity"], 2)
    return m.cells(r, ["domain", "case_index", "nuisance", "severity"])


@query("nuisance_bank_metrics")
def _(spark, sf):
    c = severity_cells(spark, sf, [n for n, _ in ops.GRID])
    return m.macro_f1(c, ["domain", "case_index", "nuisance", "severity"]).select("domain", "case_index", "nuisance", "severity", F.round("macro_f1", 6).alias("macro_f1"))


_FIXEDBANK = PT + """, sc AS (SELECT pt.vec_id, case_index, sum(re * im) AS s FROM pt GROUP BY ALL),
 rp AS (SELECT domain, case_index, recording_id, min(cls) AS truth, avg(1 / (1 + exp(-4 * s))) AS p0 FROM sc JOIN w USING (vec_id) GROUP BY ALL),
 pd AS (SELECT *, CASE WHEN p0 >= 1 - p0 THEN 0 ELSE 1 END AS pred FROM rp),
 cl AS (SELECT domain, case_index, label, sum(t) AS sup, sum(q) AS named, sum(h) AS tp FROM (SELECT domain, case_index, truth AS label, 1 AS t, 0 AS q, CASE WHEN truth = pred THEN 1 ELSE 0 END AS h FROM pd
  UNION ALL SELECT domain, case_index, pred, 0, 1, 0 FROM pd) GROUP BY ALL)"""


@query("nuisance_bank_fixed_cases", with_(_FIXEDBANK) + """SELECT domain, nuisance, severity, round(avg(2.0 * (tp / greatest(named, 1)) * (tp / greatest(sup, 1)) / greatest(tp / greatest(named, 1) + tp / greatest(sup, 1), 1e-12)), 6) AS macro_f1
  FROM cl JOIN gr USING (case_index) GROUP BY ALL""")
def _(spark, sf):
    c = severity_cells(spark, sf, ops.FIXED)
    return m.macro_f1(c, ["domain", "nuisance", "severity"]).select("domain", "nuisance", "severity", F.round("macro_f1", 6).alias("macro_f1"))


@query("robustness_curve")
def _(spark, sf):
    """Macro F1 per severity on the noise and interference grids, with the area below."""
    c = severity_cells(spark, sf, ["awgn", "ism_mixing"], "robustness")
    f1 = m.macro_f1(c, ["domain", "nuisance", "severity"]).withColumnRenamed("macro_f1", "value")
    area = m.curve_area(f1, ["domain", "nuisance"])
    return f1.join(area, ["domain", "nuisance"]).select("domain", "nuisance", "severity", F.round("value", 6).alias("macro_f1"), F.round("area", 6).alias("area"))
