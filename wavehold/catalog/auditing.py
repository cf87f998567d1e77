"""Audit and negative-control queries."""

from pyspark.sql import functions as F

from ..operators import audits as ops, fit, metrics as m, probe, selection, windows as wo
from ..plans import draws as dr, permutation as pm
from ..plans.ranking import id_block
from ..session import cut
from ..sources import views as v
from .base import W, W10, query, u, with_
from .fitting import RIDGE, halves
from .framing import FR, HOP, framed
from .splits import ROLES, fold_plan

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


@query("duplicate_audit", """WITH d AS (SELECT sha256(text) AS h, count(*) AS copies, count(DISTINCT doc_id % 5) AS roles FROM documents GROUP BY 1)
  SELECT CAST(sum(copies - 1) AS BIGINT) AS surplus, count(*) FILTER (WHERE copies > 1) AS repeated, count(*) FILTER (WHERE roles > 1) AS cross_role FROM d""")
def _(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("role", F.col("doc_id") % 5)
    return ops.duplicate_audit(d, F.sha2("text", 256))


@query("window_duplicate_audit", with_(W) + """, d AS (SELECT CAST(x AS VARCHAR) AS h, count(*) AS copies, count(DISTINCT domain) AS roles FROM w GROUP BY 1)
  SELECT CAST(sum(copies - 1) AS BIGINT) AS surplus, count(*) FILTER (WHERE copies > 1) AS repeated, count(*) FILTER (WHERE roles > 1) AS cross_role FROM d""")
def _(spark, sf):
    return ops.duplicate_audit(v.windows(spark, sf).withColumn("role", F.col("domain")), ops.signal_digest("x"))


NEAR, WIDE = 0.999, 0.9


@query("near_duplicate_audit", with_(W10) + f""", dft AS (SELECT recording_id, domain, vec_id, f, ln(1 + sqrt(pow(sum(abs(x[n + 1]::DOUBLE) * cos(2 * pi() * f * n / 256.0)), 2) + pow(sum(abs(x[n + 1]::DOUBLE) * sin(2 * pi() * f * n / 256.0)), 2))) AS s
  FROM w10, range(64) a(n), range(129) b(f) GROUP BY ALL), mn AS (SELECT recording_id, min(domain) AS role, f, avg(s) AS s FROM dft GROUP BY recording_id, f),
 ct AS (SELECT recording_id, role, f, s - avg(s) OVER (PARTITION BY recording_id) AS c FROM mn), un AS (SELECT recording_id, role, f, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY recording_id)), 1e-12) AS c FROM ct), mr AS (SELECT DISTINCT recording_id, role FROM un), pr AS (SELECT a.recording_id AS l, b.recording_id AS r, a.role <> b.role AS crosses, sum(a.c * b.c) AS cosine FROM un a JOIN un b ON a.f = b.f GROUP BY ALL)
 SELECT l AS recording_id, min(role) AS role, min(r) FILTER (WHERE cosine >= 1 - 1e-12) AS class_id, count(*) FILTER (WHERE cosine >= 1 - 1e-12) AS class_size,
  count(*) FILTER (WHERE crosses AND cosine >= {NEAR}) AS links, count(*) FILTER (WHERE crosses AND cosine >= {WIDE}) AS wide_links FROM pr JOIN mr ON l = mr.recording_id GROUP BY l""")
def _(spark, sf):
    w = v.windows(spark, sf, classes=10)
    prints = cut(ops.fingerprints(w, "domain", i="x", q=None))
    wide = ops.near_duplicates(prints, WIDE).select("recording_id", F.col("links").alias("wide_links"))
    return ops.near_duplicates(prints, NEAR).join(wide, "recording_id")


@query("temporal_adjacency_audit", with_(FR) + """, k AS (SELECT * FROM fr WHERE start // 32 = ("end" - 1) // 32), n AS (SELECT recording_id, start, "end", lead(start) OVER (PARTITION BY recording_id ORDER BY start) AS next_start FROM k)
  SELECT recording_id, start, next_start FROM n WHERE next_start - "end" < 0""")
def _(spark, sf):
    kept = wo.respect_continuity(framed(spark, sf), 32)
    return ops.temporal_adjacency(kept, 0, id_block("start", 4096))


@query("window_chunk_check", with_(FR) + """, t AS (SELECT recording_id, start, "end", CASE WHEN start // 8 % 5 = 4 THEN 'other' ELSE label END AS label FROM fr)
  SELECT fault, count(*) AS n FROM (SELECT recording_id, 'label' AS fault FROM t GROUP BY recording_id HAVING count(DISTINCT label) > 1
  UNION ALL SELECT recording_id, 'boundary' FROM t WHERE "end" - start <> 16) GROUP BY fault""")
def _(spark, sf):
    label = F.when(F.floor(F.col("start") / HOP) % 5 == 4, "other").otherwise(F.col("label"))
    return ops.window_violations(framed(spark, sf).withColumn("label", label), 16).groupBy("fault").agg(F.count("*").alias("n"))


@query("group_leakage_audit", """WITH t AS (SELECT DISTINCT o_orderstatus AS fold_id, o_custkey AS recording_id, o_orderkey % 4 AS role FROM orders)
  SELECT a.fold_id, a.role AS left_role, b.role AS right_role, count(*) AS shared FROM t a JOIN t b ON a.fold_id = b.fold_id AND a.recording_id = b.recording_id AND a.role < b.role GROUP BY ALL""")
def _(spark, sf):
    t = v.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("fold_id"), F.col("o_custkey").alias("recording_id"), (F.col("o_orderkey") % 4).alias("role"))
    return ops.group_leakage(t).groupBy("fold_id", "left_role", "right_role").agg(F.count("*").alias("shared"))


def ridge2_sql(src, key, classes, l2, out):
    """Closed-form two-feature ridge in SQL; src(key, recording_id, a, b, y, train)."""
    return f""", {out}_st AS (SELECT {key}, avg(a) AS ma, avg(b) AS mb, greatest(stddev_pop(a), 1e-6) AS sa, greatest(stddev_pop(b), 1e-6) AS sb FROM {src} WHERE train GROUP BY {key}),
 {out}_z AS (SELECT s.*, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM {src} s JOIN {out}_st USING ({key})),
 {out}_g AS (SELECT {key}, c, count(*) + {l2} AS nn, sum(za * za) + {l2} AS aa, sum(zb * zb) + {l2} AS bb, sum(za * zb) AS ab, sum(za * t) AS ay, sum(zb * t) AS by_, sum(t) AS sy
  FROM (SELECT *, CASE WHEN y = c THEN 1.0::DOUBLE ELSE 0 END AS t FROM {out}_z, range({classes}) k(c) WHERE train) GROUP BY {key}, c),
 {out}_l AS (SELECT z.{key}, recording_id, y, c, za * (ay * bb - by_ * ab) / (aa * bb - ab * ab) + zb * (aa * by_ - ab * ay) / (aa * bb - ab * ab) + sy / nn AS l FROM {out}_z z JOIN {out}_g g ON z.{key} = g.{key} WHERE NOT train),
 {out} AS (SELECT {key}, recording_id, min(y) AS y, arg_max(c, (l, -c)) AS pred FROM {out}_l GROUP BY {key}, recording_id)"""


RF = W + """, rf AS (SELECT recording_id, min(domain) AS domain, min(cls) AS cls, avg(list_avg(list_transform(i, lambda z: z::DOUBLE))) AS a, avg(list_avg(list_transform(q, lambda z: z::DOUBLE))) AS b FROM w GROUP BY recording_id)"""
_SPLIT = """, {o} AS (SELECT k, recording_id, a, b, y, row_number() OVER (PARTITION BY k, y ORDER BY recording_id) % 2 = 1 AS train FROM {s})"""


def recording_halves(spark, sf):
    """Two recording-level features, with the domain index as class."""
    half = lambda a: F.expr(f"aggregate(slice(x, {a}, 32), 0.0D, (t, z) -> t + cast(z as double)) / 32")
    w = v.windows(spark, sf).withColumn("values", F.array(half(1), half(33)))
    r = fit.recording_mean_features(w, [])
    r = r.select("recording_id", "domain", F.col("label").cast("int").alias("label"), "values", F.substring("domain", 2, 9).cast("int").alias("cls"))
    return cut(r)  # one row per recording, read by every permutation


def block():
    return None  # measured on the table


@query("domain_probe", with_(RF) + ", p0 AS (SELECT cls AS k, recording_id, a, b, CAST(substr(domain, 2) AS INTEGER) AS y FROM rf)" + _SPLIT.format(o="p1", s="p0") + ridge2_sql("p1", "k", 3, 0.05, "pr")
       + " SELECT k AS label, round(avg(CASE WHEN pred = y THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pr GROUP BY k")
def _(spark, sf):
    return ops.probe_accuracy(recording_halves(spark, sf), ["label"], block()).select("label", *r6("accuracy"))


def perm_sql(src, key, draws, seed, label, out):
    """Relabelled copies: positions are permuted and meet the cumulative class counts."""
    return f""", {out}_c AS (SELECT {key}, {label}, sum(count(*)) OVER (PARTITION BY {key} ORDER BY {label}) AS upto FROM {src} GROUP BY {key}, {label}),
 {out}_s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY recording_id) - 1 AS pos, count(*) OVER (PARTITION BY {key}) AS n FROM {src})""" + dr.sql_permuted(f"{out}_s", [key], str(seed), draws, f"{out}_m") + f""",
 {out} AS (SELECT s.* EXCLUDE ({label}, pos, n), m.draw, (SELECT min(c.{label}) FROM {out}_c c WHERE c.{key} = m.{key} AND m.moved < c.upto) AS {label} FROM {out}_s s JOIN {out}_m m USING ({key}, pos))"""


NULLS, SHUFFLES = 999, 10_000  # the fixed numbers of permutations


@query("domain_probe_null", with_(RF) + ", p0 AS (SELECT cls AS lab, recording_id, a, b, CAST(substr(domain, 2) AS INTEGER) AS y FROM rf)" + perm_sql("p0", "lab", NULLS, 24024, "y", "pm")
       + ", q0 AS (SELECT lab * 100000 + draw AS k, recording_id, a, b, y FROM pm)" + _SPLIT.format(o="q1", s="q0") + ridge2_sql("q1", "k", 3, 0.05, "pr")
       + """, ac AS (SELECT k // 100000 AS label, k % 100000 AS draw, avg(CASE WHEN pred = y THEN 1.0 ELSE 0 END) AS accuracy FROM pr GROUP BY k)
 SELECT label, count(*) AS permutations, round(list_sort(list(accuracy))[CAST(ceil(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1], 6) AS threshold FROM ac GROUP BY label""")
def _(spark, sf):
    a = cut(pm.probe_null(recording_halves(spark, sf), ["label"], 3, NULLS, 24024))
    q = ops.null_quantile(a, ["label"], "accuracy")
    n = a.groupBy("label").agg(F.count("*").alias("permutations"))
    return q.join(n, "label").select("label", "permutations", *r6("threshold"))


_FS = ROLES + """, rf AS (SELECT recording_id, min(domain) AS domain, min(cls) AS cls, avg(list_avg(list_transform(i, lambda z: z::DOUBLE))) AS a, avg(list_avg(list_transform(q, lambda z: z::DOUBLE))) AS b FROM w GROUP BY recording_id),
 fr AS (SELECT fold_id AS f, role, rf.* FROM rf JOIN roles USING (recording_id) WHERE role IN ('source_fit', 'source_selection')),
 ft AS (SELECT f, recording_id, a, b, cls AS y FROM fr WHERE role = 'source_fit')"""


def macro_sql(src, key, out):
    return f""", {out}_s AS (SELECT {key}, label, sum(t) AS sup, sum(n) AS named, sum(h) AS tp FROM (SELECT {key}, y AS label, 1 AS t, 0 AS n, CASE WHEN y = pred THEN 1 ELSE 0 END AS h FROM {src}
  UNION ALL SELECT {key}, pred, 0, 1, 0 FROM {src}) GROUP BY {key}, label),
 {out} AS (SELECT {key}, avg(2.0 * (tp / greatest(named, 1)) * (tp / greatest(sup, 1)) / greatest(tp / greatest(named, 1) + tp / greatest(sup, 1), 1e-12)) AS f1 FROM {out}_s GROUP BY {key})"""


def fold_recordings(spark, sf):
    roles = fold_plan(spark, sf).drop("n_windows")
    return cut(recording_halves(spark, sf).drop("cls").withColumnRenamed("label", "cls").join(roles, "recording_id"))


def shuffled_cells(fit_rows, eval_rows, classes, l2):
    fits = pm.permuted_fits(fit_rows, ["fold_id"], classes, SHUFFLES, 24023, l2)
    return cut(pm.permuted_cells(fits, eval_rows, ["fold_id"], classes))


def tail(null, real, keys, value):
    """p of the true fit among the permuted ones, (1 + #>=) / (B + 1)."""
    above = F.count_if(F.col("_null") >= F.col(value) - 1e-9)
    return null.withColumnRenamed(value, "_null").join(real, keys).groupBy(*keys).agg(((1 + above) / (F.count("*") + 1)).alias("p_value"))


@query("label_shuffle_control", with_(_FS) + perm_sql("ft", "f", SHUFFLES, 24023, "y", "pm")
       + f""", tr AS (SELECT concat(f, '/', draw) AS k, recording_id, a, b, y, true AS train FROM pm UNION ALL SELECT concat(f, '/real'), recording_id, a, b, y, true FROM ft
  UNION ALL SELECT concat(f, '/', d), recording_id, a, b, cls, false FROM fr, (SELECT unnest(list_append(list_transform(range(0, {SHUFFLES}), lambda z: CAST(z AS VARCHAR)), 'real')) AS d) WHERE role = 'source_selection')""" + ridge2_sql("tr", "k", 2, 0.01, "pr") + macro_sql("pr", "k", "mf")
       + f""", nl AS (SELECT split_part(k, '/', 1) AS f, list_sort(list(f1))[CAST(ceil(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS q95, list(f1) AS fs FROM mf WHERE k NOT LIKE '%real' GROUP BY 1),
 rl AS (SELECT split_part(k, '/', 1) AS f, f1 FROM mf WHERE k LIKE '%real')
 SELECT f AS fold_id, len(fs) AS permutations, round(f1, 6) AS macro_f1, round(q95, 6) AS shuffle_q95, CASE WHEN q95 < f1 THEN 'passed' ELSE 'failed' END AS status,
 round((1 + len(list_filter(fs, lambda z: z >= f1 - 1e-9))) / ({SHUFFLES} + 1.0), 6) AS p_value FROM nl JOIN rl USING (f)""")
def _(spark, sf):
    rows = fold_recordings(spark, sf)
    f1 = m.macro_f1(shuffled_cells(rows.where("role = 'source_fit'"), rows.where("role = 'source_selection'"), 2, 0.01), ["fold_id", "draw"])
    f1 = cut(f1.select("fold_id", "draw", "macro_f1"))
    null, real = f1.where("draw >= 0"), f1.where("draw < 0").drop("draw")
    q = ops.null_quantile(null, ["fold_id"], "macro_f1").withColumnRenamed("threshold", "shuffle_q95")
    n = null.groupBy("fold_id").agg(F.count("*").alias("permutations"))
    status = F.when(F.col("shuffle_q95") < F.col("macro_f1"), "passed").otherwise("failed")
    out = real.join(q, "fold_id").join(tail(null, real, ["fold_id"], "macro_f1"), "fold_id").join(n, "fold_id")
    return out.select("fold_id", "permutations", *r6("macro_f1", "shuffle_q95"), status.alias("status"), *r6("p_value"))


_BG = ROLES + """, rf AS (SELECT recording_id, min(domain) AS domain, min(cls) AS cls, avg(list_avg(list_transform(i, lambda z: z::DOUBLE))) AS a, avg(list_avg(list_transform(q, lambda z: z::DOUBLE))) AS b FROM w GROUP BY recording_id),
 fr AS (SELECT fold_id AS f, role, recording_id, a, b, CAST(substr(rf.domain, 2) AS INTEGER) AS y FROM rf JOIN roles USING (recording_id) WHERE rf.cls = 0),
 ft AS (SELECT f, recording_id, a, b, y FROM fr WHERE role = 'source_fit')"""


@query("background_only_control", with_(_BG) + perm_sql("ft", "f", SHUFFLES, 24023, "y", "pm")
       + f""", tr AS (SELECT concat(f, '/', draw) AS k, recording_id, a, b, y, true AS train FROM pm UNION ALL SELECT concat(f, '/real'), recording_id, a, b, y, true FROM ft
  UNION ALL SELECT concat(f, '/', d), recording_id, a, b, y, false FROM fr, (SELECT unnest(list_append(list_transform(range(0, {SHUFFLES}), lambda z: CAST(z AS VARCHAR)), 'real')) AS d) WHERE role = 'source_selection')"""
       + ridge2_sql("tr", "k", 3, 0.05, "pr") + """, ac AS (SELECT k, avg(CASE WHEN pred = y THEN 1.0 ELSE 0 END) AS accuracy FROM pr GROUP BY k),
 nl AS (SELECT split_part(k, '/', 1) AS fold_id, list_sort(list(accuracy))[CAST(ceil(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS threshold FROM ac WHERE k NOT LIKE '%real' GROUP BY 1)
 SELECT fold_id, round(accuracy, 6) AS accuracy, round(threshold, 6) AS threshold, CASE WHEN accuracy <= threshold THEN 'passed' ELSE 'failed' END AS status FROM nl JOIN ac ON ac.k = concat(fold_id, '/real')""")
def _(spark, sf):
    """Domain probe on background recordings alone (class 0), with its permutation null."""
    rows = fold_recordings(spark, sf).where("cls = 0").withColumn("cls", F.substring("domain", 2, 9).cast("int"))
    c = shuffled_cells(rows.where("role = 'source_fit'"), rows.where("role = 'source_selection'"), 3, 0.05)
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")
    a = cut(c.groupBy("fold_id", "draw").agg(hit.alias("accuracy")))
    null, real = a.where("draw >= 0"), a.where("draw < 0").drop("draw")
    q = ops.null_quantile(null, ["fold_id"], "accuracy")
    status = F.when(F.col("accuracy").isNull(), "not_applicable").when(F.col("accuracy") <= F.col("threshold"), "passed").otherwise("failed")
    return real.join(q, "fold_id", "left").select("fold_id", *r6("accuracy", "threshold"), status.alias("status"))


@query("integrity_report", """WITH d AS (SELECT sha256(text) AS h, count(DISTINCT doc_id % 5) AS roles FROM documents GROUP BY 1),
 g AS (SELECT o_custkey FROM orders GROUP BY o_orderstatus, o_custkey HAVING count(DISTINCT o_orderkey % 4) > 1),
 a AS (SELECT 'duplicates' AS audit, count(*) FILTER (WHERE roles > 1) AS failures FROM d UNION ALL SELECT 'group_overlap', count(*) FROM g
  UNION ALL SELECT 'label_contract', count(*) FROM labels WHERE toxic NOT IN (0, 1) UNION ALL SELECT 'background_only', NULL)
 SELECT audit, CASE WHEN failures IS NULL THEN 'not_applicable' WHEN failures > 0 THEN 'failed' ELSE 'passed' END AS status, true AS critical,
 sha256(concat_ws('|', audit, CAST(failures AS VARCHAR))) AS evidence FROM a""")
def _(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("role", F.col("doc_id") % 5)
    dup = ops.duplicate_audit(d, F.sha2("text", 256)).select(F.lit("duplicates").alias("audit"), F.col("cross_role").alias("failures"))
    t = v.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("fold_id"), F.col("o_custkey").alias("recording_id"), (F.col("o_orderkey") % 4).alias("role"))
    over = ops.group_leakage(t).select("fold_id", "recording_id").distinct().agg(F.count("*").alias("failures")).select(F.lit("group_overlap").alias("audit"), "failures")
    lab = v.table(spark, sf, "labels").where("toxic not in (0, 1)").agg(F.count("*").alias("failures")).select(F.lit("label_contract").alias("audit"), "failures")
    bg = lab.select(F.lit("background_only").alias("audit"), F.lit(None).cast("long").alias("failures"))
    return ops.integrity_report([dup, over, lab, bg])


@query("artifact_consistency", """WITH r AS (SELECT o_orderkey AS k, o_totalprice AS total, o_orderstatus AS st FROM orders), o AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS total, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'P' END AS st FROM lineitem GROUP BY 1),
 j AS (SELECT r.k AS rk, o.k AS ok, round(r.total) <> round(o.total) AS bt, r.st <> o.st AS bs FROM r FULL OUTER JOIN o ON r.k = o.k)
 SELECT fault, n FROM (SELECT 'missing' AS fault, count(*) FILTER (WHERE ok IS NULL) AS n FROM j UNION ALL SELECT 'unlisted', count(*) FILTER (WHERE rk IS NULL) FROM j
 UNION ALL SELECT 'total', count(*) FILTER (WHERE bt) FROM j UNION ALL SELECT 'st', count(*) FILTER (WHERE bs) FROM j) WHERE n > 0""")
def _(spark, sf):
    r = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").alias("total"), F.col("o_orderstatus").alias("st"))
    o = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.round(F.sum("l_extendedprice")).alias("total"), F.when(F.count_distinct("l_linestatus") == 1, F.min("l_linestatus")).otherwise("P").alias("st"))
    return ops.consistency_mismatches(r, o, "k", ["total", "st"]).groupBy("fault").agg(F.count("*").alias("n"))


# Sums are whole millionths, so that no tie depends on the order of addition; probe and shuffle_q95 are in millionths.
_FC = """WITH c AS (SELECT l_suppkey AS family, sum(CAST(round(l_discount * 1000000) AS BIGINT)) AS d, sum(CAST(round(l_tax * 1000000) AS BIGINT)) AS t, sum(CAST(round(l_quantity * 1000000) AS BIGINT)) AS q,
  count(l_discount) AS nd, count(l_tax) AS nt, count(l_quantity) AS nq FROM lineitem GROUP BY l_suppkey),
 f AS (SELECT family, d > 49000 * nd AS selected, t > 39000 * nt AS independent_pass, q > 25500000 * nq AS degenerate,
  CASE WHEN family % 10 = 3 THEN 'nan'::DOUBLE ELSE (10 * d)::DOUBLE / nd END AS probe, (25 * t)::DOUBLE / (2 * nt) AS shuffle_q95 FROM c)"""


def family_checks(spark, sf):
    whole = lambda c: F.sum(F.round(F.col(c) * 1000000).cast("long"))
    c = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("family")).agg(
        whole("l_discount").alias("d"), whole("l_tax").alias("t"), whole("l_quantity").alias("q"),
        F.count("l_discount").alias("nd"), F.count("l_tax").alias("nt"), F.count("l_quantity").alias("nq"))
    return c.select(
        "family", (F.col("d") > 49000 * F.col("nd")).alias("selected"), (F.col("t") > 39000 * F.col("nt")).alias("independent_pass"), (F.col("q") > 25500000 * F.col("nq")).alias("degenerate"),
        F.when(F.col("family") % 10 == 3, float("nan")).otherwise((10 * F.col("d")).cast("double") / F.col("nd")).alias("probe"), ((25 * F.col("t")).cast("double") / (2 * F.col("nt"))).alias("shuffle_q95"))


@query("family_failure_report", _FC + """, g AS (SELECT *, CASE WHEN isnan(probe) THEN NULL ELSE probe END AS pb FROM f)
 SELECT family, concat_ws(',', CASE WHEN NOT selected THEN 'selected' END, CASE WHEN NOT independent_pass THEN 'independent_value' END, CASE WHEN NOT coalesce(pb <= shuffle_q95, false) THEN 'shortcut' END,
 CASE WHEN degenerate THEN 'representation_degenerate' END, CASE WHEN pb IS NULL THEN 'probe_not_estimable' END) AS failed_checks, round(pb) / 1000000 AS probe FROM g""")
def _(spark, sf):
    return ops.failed_checks(family_checks(spark, sf)).select("family", F.array_join("failed_checks", ",").alias("failed_checks"), (F.round("probe") / 1000000).alias("probe"))


@query("channel_retention", _FC + """ SELECT family, selected AND independent_pass AND NOT degenerate AND NOT isnan(probe) AND probe <= shuffle_q95 AS retain FROM f""")
def _(spark, sf):
    c = family_checks(spark, sf).withColumn("only_family", F.lit(False)).withColumn("delta", F.when(F.col("independent_pass"), 0.1).otherwise(-0.1))
    return selection.channel_retention(c).select("family", "retain")
