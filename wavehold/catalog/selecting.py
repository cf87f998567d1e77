"""Instability, Pareto and ablation queries."""

from pyspark.sql import functions as F

from ..operators import perturb as pt, selection as ops
from ..session import cut
from ..sources import views as v
from .base import OBJ, RP, W, query, with_
from .metrics import SEEDF1, seed_f1
from .splits import ROLES, fold_plan
from .perturbation import DETERMINISTIC, PT, SOURCE, iq_families, source_windows

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
BOUND = lambda spark, sf: v.recordings(spark, sf).select(F.col("n_windows").alias("n"))


def displacements(spark, sf, cases=pt.CASES):
    """Window x case x family displacement of I and Q maps on source windows."""
    pairs = pt.paired_maps(source_windows(spark, sf), ["vec_id", "recording_id", "domain"], iq_families(), pt.seeds("source_instability"), cases=cases)
    return ops.linf_displacement(pairs)


DISP = ROLES + ", " + PT[len(W) + 2:] + ", " + SOURCE + """, dp AS (SELECT pt.vec_id, w.recording_id, w.domain, case_index, 'I' AS family, max(abs(pt.re - il.re)) AS d, max(abs(pt.im - il.im)) AS d2
  FROM pt JOIN il ON pt.vec_id = il.vec_id AND pt.n = il.n JOIN w ON w.vec_id = pt.vec_id JOIN so ON so.recording_id = w.recording_id GROUP BY ALL),
 dd AS (SELECT vec_id, recording_id, domain, case_index, 'I' AS family, d FROM dp UNION ALL SELECT vec_id, recording_id, domain, case_index, 'Q', d2 FROM dp),
 fm AS (SELECT domain, recording_id, case_index, family, median(d) AS med FROM dd GROUP BY ALL),
 rm AS (SELECT domain, recording_id, case_index, max(med) AS rmax FROM fm GROUP BY ALL),
 dm AS (SELECT domain, case_index, median(rmax) AS med FROM rm GROUP BY ALL),
 ci AS (SELECT case_index, avg(med) AS instability FROM dm GROUP BY case_index)"""


def medians(spark, sf, cases=pt.CASES):
    return ops.recording_family_medians(displacements(spark, sf, cases), ["case_index"], BOUND(spark, sf))


def details(rows):
    d = ops.recording_details(rows, ["case_index"])
    return d.select("domain", "recording_id", "case_index", F.round(F.col("family_medians")["I"], 6).alias("median_i"),
                    F.round(F.col("family_medians")["Q"], 6).alias("median_q"), *r6("recording_max"))


STEPS = {
    "linf_displacement": (
        "SELECT vec_id, case_index, family, round(d, 6) AS displacement FROM dd",
        lambda spark, sf, cases: displacements(spark, sf, cases).select("vec_id", "case_index", "family", *r6("displacement"))),
    "reduce_recording_family_domain": (
        "SELECT case_index, round(instability, 6) AS instability FROM ci",
        lambda spark, sf, cases: ops.reduce_domains(medians(spark, sf, cases), ["case_index"]).select("case_index", *r6("instability"))),
    "recording_details": (
        """SELECT fm.domain, fm.recording_id, fm.case_index, round(max(med) FILTER (WHERE family = 'I'), 6) AS median_i,
  round(max(med) FILTER (WHERE family = 'Q'), 6) AS median_q, round(max(med), 6) AS recording_max FROM fm GROUP BY ALL""",
        lambda spark, sf, cases: details(medians(spark, sf, cases))),
    "source_instability": (
        "SELECT round(max(instability), 6) AS value, arg_max(case_index, (instability, -case_index)) AS worst_case FROM ci",
        lambda spark, sf, cases: ops.worst_case(ops.reduce_domains(medians(spark, sf, cases), ["case_index"]), []).select(*r6("value"), "worst_case")),
    "recording_worst_case": (
        "SELECT domain, recording_id, round(max(med), 6) AS worst FROM fm GROUP BY ALL",
        lambda spark, sf, cases: ops.recording_worst_case(medians(spark, sf, cases), []).select("domain", "recording_id", *r6("worst"))),
}
for _name, (_sql, _step) in STEPS.items():  # all 32 cases; and, with an SQL twin, those without a random part
    query(_name)(lambda spark, sf, step=_step: step(spark, sf, pt.CASES))
    query(f"{_name}_fixed_cases", with_(DISP) + _sql)(lambda spark, sf, step=_step: step(spark, sf, DETERMINISTIC))


@query("source_instability_all_cases")
def _(spark, sf):
    """All 32 cases, random ones included, per case."""
    med = medians(spark, sf)
    return ops.reduce_domains(med, ["case_index"]).select("case_index", *r6("instability"))


@query("fisher_ratio", with_(W) + """, l AS (SELECT domain, cls, p, x[p + 1]::DOUBLE AS z FROM w, range(64) r(p)),
 g AS (SELECT domain, p, avg(z) AS g FROM l GROUP BY ALL), c AS (SELECT domain, cls, p, count(*) AS n, avg(z) AS m, var_pop(z) AS s FROM l GROUP BY ALL)
 SELECT domain, round(sum(n * pow(m - g, 2)) / (sum(n * s) + 1e-3 * 64), 6) AS fisher FROM c JOIN g USING (domain, p) GROUP BY domain""")
def _(spark, sf):
    w = v.windows(spark, sf).withColumnRenamed("x", "values")
    return ops.fisher_ratio(w, ["domain"], "cls", 64).select("domain", *r6("fisher"))


@query("representation_similarity", with_(W) + """, pr AS (SELECT domain, list_transform(x[1:32], lambda z: z::DOUBLE) AS a, list_transform(x[33:64], lambda z: z::DOUBLE) AS b FROM w)
 , sm AS (SELECT domain, avg(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-12)) AS cosine,
 avg(list_avg(list_transform(range(1, 33), lambda k: abs(a[k] - b[k]))) / greatest(greatest(list_max(a), list_max(b)) - least(list_min(a), list_min(b)), 1e-12)) AS nmae FROM pr GROUP BY domain)
 SELECT domain, round(cosine, 6) AS cosine, round(nmae, 6) AS nmae, cosine >= 0.995 AND nmae <= 0.01 AS degenerate FROM sm""")
def _(spark, sf):
    w = v.windows(spark, sf).select("domain", F.slice("x", 1, 32).alias("left"), F.slice("x", 33, 32).alias("right"))
    return ops.representation_similarity(w, ["domain"]).select("domain", *r6("cosine", "nmae"), "degenerate")


@query("similarity_unequal_lengths", with_(W) + """, st AS (SELECT vec_id, k, k * 31 / 39.0::DOUBLE AS t FROM w, range(40) z(k)),
 pr AS (SELECT w.domain, w.vec_id, list(x[least(floor(t), 30)::INTEGER + 1]::DOUBLE + (x[least(floor(t), 30)::INTEGER + 2]::DOUBLE - x[least(floor(t), 30)::INTEGER + 1]::DOUBLE) * (t - least(floor(t), 30)) ORDER BY k) AS a,
  list(x[25 + k]::DOUBLE ORDER BY k) AS b FROM w JOIN st USING (vec_id) GROUP BY ALL)
 SELECT domain, round(avg(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-12)), 6) AS cosine FROM pr GROUP BY domain""")
def _(spark, sf):
    w = v.windows(spark, sf).select("domain", F.slice("x", 1, 32).alias("left"), F.slice("x", 25, 40).alias("right"))
    return ops.representation_similarity(w, ["domain"]).select("domain", *r6("cosine"))


FRONT = OBJ + """, fz AS (SELECT * FROM obj WHERE feasible),
 front AS (SELECT * FROM fz c WHERE NOT EXISTS (SELECT 1 FROM fz o WHERE o.stable_id <> c.stable_id
  AND o.sensitivity <= c.sensitivity + 1e-12 AND -o.macro_f1 <= -c.macro_f1 + 1e-12 AND o.bytes_per_sample <= c.bytes_per_sample + 1e-12 AND o.macs <= c.macs + 1e-12 AND o.latency_ms <= c.latency_ms + 1e-12
  AND (o.sensitivity < c.sensitivity - 1e-12 OR -o.macro_f1 < -c.macro_f1 - 1e-12 OR o.bytes_per_sample < c.bytes_per_sample - 1e-12 OR o.macs < c.macs - 1e-12 OR o.latency_ms < c.latency_ms - 1e-12)))"""


@query("pareto_front", with_(FRONT) + "SELECT stable_id, round(macro_f1, 6) AS macro_f1 FROM front")
def _(spark, sf):
    return ops.pareto_front(v.objectives(spark, sf), []).select("stable_id", F.round(-F.col("neg_f1"), 6).alias("macro_f1"))


PARTS = """po AS (SELECT p_brand AS fold, l_partkey AS stable_id, round(avg(l_discount), 6) AS sensitivity, round(avg(l_tax) * 10, 6) AS macro_f1, round(avg(l_quantity), 6) AS latency_ms, CAST(any_value(p_size) AS DOUBLE) AS bytes_per_sample,
 round(avg(l_extendedprice), 6) AS macs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_partkey)"""


@query("pareto_front_per_group", with_(PARTS) + """SELECT fold, stable_id FROM po c WHERE NOT EXISTS (SELECT 1 FROM po o WHERE o.fold = c.fold AND o.stable_id <> c.stable_id
  AND o.sensitivity <= c.sensitivity + 1e-12 AND -o.macro_f1 <= -c.macro_f1 + 1e-12 AND o.bytes_per_sample <= c.bytes_per_sample + 1e-12 AND o.macs <= c.macs + 1e-12 AND o.latency_ms <= c.latency_ms + 1e-12
  AND (o.sensitivity < c.sensitivity - 1e-12 OR -o.macro_f1 < -c.macro_f1 - 1e-12 OR o.bytes_per_sample < c.bytes_per_sample - 1e-12 OR o.macs < c.macs - 1e-12 OR o.latency_ms < c.latency_ms - 1e-12))""")
def _(spark, sf):
    """Many candidates per group: every part competes inside its brand."""
    p = v.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    li = v.table(spark, sf, "lineitem").join(p, "l_partkey")
    avg = lambda c, k=1: F.round(F.avg(c) * k, 6)
    o = li.groupBy(F.col("p_brand").alias("fold"), F.col("l_partkey").alias("stable_id")).agg(
        avg("l_discount").alias("sensitivity"), avg("l_tax", 10).alias("macro_f1"), avg("l_quantity").alias("latency_ms"),
        F.first("p_size").cast("double").alias("bytes_per_sample"), avg("l_extendedprice").alias("macs"), F.lit(True).alias("feasible"))
    return ops.pareto_front(cut(o), ["fold"]).select("fold", "stable_id")


@query("select_unique", with_(FRONT) + """SELECT arg_min(stable_id, (sensitivity, latency_ms, stable_id)) AS selected FROM front
  WHERE macro_f1 >= (SELECT max(macro_f1) FROM fz) - 0.01""")
def _(spark, sf):
    return ops.select_unique(v.objectives(spark, sf), [])


_SPAN = " + ".join(f"({e} - min({e}) OVER ()) / greatest(max({e}) OVER () - min({e}) OVER (), 1e-12)" for e in ("sensitivity", "(-macro_f1)", "bytes_per_sample", "macs", "latency_ms"))


@query("select_scalar", with_(OBJ) + f""", s AS (SELECT stable_id, {_SPAN} AS score FROM obj WHERE feasible)
  SELECT arg_min(stable_id, (score, stable_id)) AS selected, round(min(score), 6) AS score FROM s""")
def _(spark, sf):
    return ops.select_scalar(v.objectives(spark, sf), []).select("selected", *r6("score"))


@query("select_best_setting", with_(SEEDF1) + """, t AS (SELECT condition, fold, seed // 2 AS setting, avg(f1) AS f1 FROM sf1 GROUP BY ALL)
  SELECT condition, fold, arg_max(setting, (f1, -setting)) AS setting, round(max(f1), 6) AS f1 FROM t GROUP BY ALL""")
def _(spark, sf):
    s = seed_f1(spark, sf).select("condition", "fold", F.floor(F.col("seed") / 2).cast("int").alias("setting"), F.col("macro_f1").alias("f1"))
    return ops.select_best_setting(s, ["condition", "fold"]).select("condition", "fold", "setting", *r6("f1"))


_CANDS = ops.ABLATIONS


@query("ablation_bank", with_(W) + f""", names AS (SELECT name, CAST(pos - 1 AS INTEGER) AS pos FROM (SELECT unnest({list(_CANDS)!r}) AS name, unnest(range(1, 31)) AS pos)),
 ch AS (SELECT domain AS fold_id, CASE WHEN avg(x[1]::DOUBLE) > 0 THEN 'W' ELSE 'C' END AS scalar, CASE WHEN avg(x[2]::DOUBLE) > 0 THEN 'wst_J3Q1' ELSE 'resolution_8' END AS pareto, avg(x[3]::DOUBLE) AS main FROM w GROUP BY domain),
 cv AS (SELECT domain AS fold_id, name AS candidate_id, avg(x[pos + 1]::DOUBLE) AS value FROM w, names WHERE name NOT LIKE 'selection%' AND name NOT IN ('active_minus_E', 'active_minus_S') GROUP BY ALL),
 rs AS (SELECT fold_id, name AS condition_id, CASE name WHEN 'selection_scalar' THEN scalar WHEN 'selection_pareto' THEN pareto ELSE name END AS candidate_id, main FROM ch, names)
 SELECT rs.fold_id, condition_id, rs.candidate_id, round(coalesce(value, CASE WHEN condition_id LIKE 'active_minus_%' THEN main END), 6) AS value,
 CASE WHEN value IS NOT NULL THEN 'measured' WHEN condition_id LIKE 'active_minus_%' THEN 'structural_identity' ELSE 'missing' END AS kind FROM rs LEFT JOIN cv ON cv.fold_id = rs.fold_id AND cv.candidate_id = rs.candidate_id""")
def _(spark, sf):
    w = v.windows(spark, sf)
    at = lambda k: F.avg(F.col("x")[k].cast("double"))
    base = w.groupBy(F.col("domain").alias("fold_id")).agg(
        F.when(at(0) > 0, "W").otherwise("C").alias("scalar"), F.when(at(1) > 0, "wst_J3Q1").otherwise("resolution_8").alias("pareto"), at(2).alias("value"),
        *[at(k).alias(f"c{k}") for k in range(30)])
    named = [(k, c) for k, c in enumerate(_CANDS) if not c.startswith("selection") and c not in ("active_minus_E", "active_minus_S")]
    cands = base.select("fold_id", F.explode(F.array(*[F.struct(F.lit(c).alias("candidate_id"), F.col(f"c{k}").alias("value")) for k, c in named])).alias("c")).select("fold_id", "c.*")
    return ops.ablation_bank(base.select("fold_id", "scalar", "pareto"), cands, base.select("fold_id", "value")).withColumn("value", F.round("value", 6))


def bank_for_short_windows():
    from ..operators import transforms as tr
    return tr.selection_bank(cyclic=(1, 2, 3), bins=(2, 4, 8), frame=16, hop=8)


def fold_objectives(spark, sf):
    """Objectives of the 25 candidates on complex windows of 32 samples."""
    from ..plans import source_selection as ss
    folds = ["d0", "d1", "d2"]
    w = cut(v.iq_windows(spark, sf, starts=True).select("vec_id", "recording_id", "domain", "cls", "start", "i", "q"))
    roles = fold_plan(spark, sf)
    configs = bank_for_short_windows()
    lat = spark.createDataFrame([(c.stable_id, float(c.bins * len(c.families)), True) for c in configs], "config_id string, latency_ms double, measurement_valid boolean")
    return ss.objectives(w, roles, configs, folds, lat, 2)


@query("source_objectives")
def _(spark, sf):
    o = fold_objectives(spark, sf)
    return o.select("fold_id", "stable_id", *r6("macro_f1", "sensitivity"), "bytes_per_sample", "macs", "latency_ms", "feasible")


@query("source_selection")
def _(spark, sf):
    from ..plans import source_selection as ss
    return ss.choose(fold_objectives(spark, sf))
