"""Projection, filter and gate queries."""

from pyspark.sql import functions as F

from ..operators import projections as ops
from ..sources import views as v
from .base import W, query, with_

# Customers stand in for streams: region = dataset, nation = label, market segment = model label.
STREAMS = """st AS (SELECT c_custkey AS recording_id, CAST(n_regionkey AS VARCHAR) AS dataset,
  CASE WHEN n_nationkey = 0 THEN 'background' ELSE concat('n', n_nationkey) END AS label, c_mktsegment AS model_label,
  CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS subset,
  CASE WHEN c_custkey % 4 = 0 THEN 'multi_label' ELSE 'single_label' END AS task_type FROM customer JOIN nation ON c_nationkey = n_nationkey),
lb AS (SELECT CAST(n_regionkey AS VARCHAR) AS dataset, concat('n', n_nationkey) AS name, concat('class', n_nationkey % 3) AS canonical
  FROM nation WHERE n_nationkey < 15
  UNION ALL SELECT DISTINCT '1', c_mktsegment, concat('class', length(c_mktsegment) % 3) FROM customer WHERE length(c_mktsegment) > 8),
can AS (SELECT st.*, CASE WHEN st.label = 'background' OR model_label = 'background' THEN 'background'
  WHEN st.dataset = '4' AND subset = 'high' AND task_type = 'single_label' THEN 'uav'
  ELSE coalesce(a.canonical, b.canonical) END AS canonical FROM st
  LEFT JOIN lb a ON a.dataset = st.dataset AND a.name = st.label LEFT JOIN lb b ON b.dataset = st.dataset AND b.name = st.model_label)"""


def streams(spark, sf):
    c = v.table(spark, sf, "customer").join(
        v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("recording_id"), F.col("n_regionkey").cast("string").alias("dataset"),
        F.when(F.col("n_nationkey") == 0, "background").otherwise(F.concat(F.lit("n"), "n_nationkey")).alias("label"),
        F.col("c_mktsegment").alias("model_label"),
        F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("subset"),
        F.when(F.col("c_custkey") % 4 == 0, "multi_label").otherwise("single_label").alias("task_type"),
    )


def contract(spark, sf):
    n = v.table(spark, sf, "nation").where("n_nationkey < 15").select(
        F.col("n_regionkey").cast("string").alias("dataset"), F.concat(F.lit("n"), "n_nationkey").alias("name"),
        F.concat(F.lit("class"), F.col("n_nationkey") % 3).alias("canonical"))
    m = v.table(spark, sf, "customer").select("c_mktsegment").distinct().where("length(c_mktsegment) > 8").select(
        F.lit("1").alias("dataset"), F.col("c_mktsegment").alias("name"),
        F.concat(F.lit("class"), F.length("c_mktsegment") % 3).alias("canonical"))
    subsets = v.table(spark, sf, "region").where("r_regionkey = 4").select(
        F.col("r_regionkey").cast("string").alias("dataset"), F.lit("high").alias("subset"))
    return n.unionByName(m), subsets


def labelled(spark, sf):
    return ops.canonical_label(streams(spark, sf), *contract(spark, sf))


@query("canonical_label", with_(STREAMS) + "SELECT recording_id, dataset, label, model_label, canonical FROM can")
def _(spark, sf):
    return labelled(spark, sf).select("recording_id", "dataset", "label", "model_label", "canonical")


@query("exclude_recordings", with_(STREAMS) + """SELECT recording_id, dataset, label FROM st WHERE task_type = 'single_label'
  AND recording_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def _(spark, sf):
    listed = v.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("recording_id"))
    return ops.exclude_recordings(streams(spark, sf), listed, "recording_id").select("recording_id", "dataset", "label")


@query("missing_label_report", with_(STREAMS) + """SELECT DISTINCT concat(dataset, ':', label) AS missing FROM can WHERE canonical IS NULL ORDER BY 1 LIMIT 25""")
def _(spark, sf):
    return ops.missing_labels(labelled(spark, sf))


@query("shared_labels", """WITH r AS (SELECT o_orderpriority AS dataset, o_custkey AS label FROM orders),
  sh AS (SELECT label FROM r GROUP BY label HAVING count(DISTINCT dataset) = 5)
  SELECT dataset, count(*) AS kept_rows, count(DISTINCT label) AS labels FROM r WHERE label IN (SELECT label FROM sh) GROUP BY dataset""")
def _(spark, sf):
    r = v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("label"))
    kept = ops.keep_shared(r, 5)
    return kept.groupBy("dataset").agg(F.count("*").alias("kept_rows"), F.count_distinct("label").alias("labels"))


_GATE = STREAMS + """, g AS (SELECT dataset, count(*) AS n, count(DISTINCT canonical) AS labels, count(*) FILTER (WHERE canonical IS NULL) AS unmapped,
  bool_or(canonical = 'background') AS bg FROM can GROUP BY dataset)"""


@query("eligibility_gates", with_(_GATE) + """, i AS (SELECT dataset, 'needs two labels' AS issue FROM g WHERE NOT labels >= 2
  UNION ALL SELECT dataset, 'unmapped labels' FROM g WHERE NOT unmapped = 0
  UNION ALL SELECT dataset, 'no background' FROM g WHERE NOT coalesce(bg, false))
  SELECT g.dataset, CASE WHEN count(issue) = 0 THEN 'ready' ELSE 'blocked' END AS status, count(issue) AS issues, min(issue) AS first_issue
  FROM g LEFT JOIN i ON g.dataset = i.dataset GROUP BY g.dataset""")
def _(spark, sf):
    g = labelled(spark, sf).groupBy("dataset").agg(
        F.count_distinct("canonical").alias("labels"), F.count_if(F.col("canonical").isNull()).alias("unmapped"),
        F.bool_or(F.col("canonical") == "background").alias("bg"))
    issues = ops.gate_issues(g, {
        "needs two labels": F.col("labels") >= 2, "unmapped labels": F.col("unmapped") == 0, "no background": F.col("bg")}, ["dataset"])
    return g.join(issues, "dataset", "left").groupBy("dataset").agg(
        F.when(F.count("issue") == 0, "ready").otherwise("blocked").alias("status"),
        F.count("issue").alias("issues"), F.min("issue").alias("first_issue"))


@query("eligible_domains", """WITH d AS (SELECT source AS domain, bool_and(n_chars > 0) AS licensed, count(*) > 20 AS reviewed,
  sha256(max(text)) AS digest FROM documents GROUP BY source), k AS (SELECT * FROM d WHERE licensed AND reviewed AND regexp_matches(digest, '^[0-9a-f]{64}$'))
  SELECT domain, digest, (SELECT count(*) FROM k) >= 3 AS gate_open FROM k""")
def _(spark, sf):
    d = v.table(spark, sf, "documents").groupBy(F.col("source").alias("domain")).agg(
        F.bool_and(F.col("n_chars") > 0).alias("licensed"), (F.count("*") > 20).alias("reviewed"), F.sha2(F.max("text"), 256).alias("digest"))
    return ops.eligible(d, ["licensed", "reviewed"], "digest").select("domain", "digest", "gate_open")


@query("dataset_summary", with_(STREAMS) + """SELECT dataset, count(*) AS recordings, count(DISTINCT recording_id % 10) AS groups,
  count(DISTINCT canonical) AS classes, coalesce(bool_or(canonical = 'background'), false) AS has_background FROM can GROUP BY dataset""")
def _(spark, sf):
    return labelled(spark, sf).groupBy("dataset").agg(
        F.count("*").alias("recordings"), F.count_distinct(F.col("recording_id") % 10).alias("groups"),
        F.count_distinct("canonical").alias("classes"),
        F.coalesce(F.bool_or(F.col("canonical") == "background"), F.lit(False)).alias("has_background"))


@query("family_mask", with_(W) + """, f AS (SELECT vec_id, fam, x[16 * k + 1 : 16 * k + 16] AS vals FROM w, (VALUES ('W', 0), ('C', 1), ('E', 2), ('S', 3)) t(fam, k)),
  mk AS (SELECT * FROM (VALUES ('W', 'W'), ('C', 'C'), ('W+C', 'W'), ('W+C', 'C'), ('W+C+E', 'W'), ('W+C+E', 'C'), ('W+C+E', 'E'),
  ('W+C+E+S', 'W'), ('W+C+E+S', 'C'), ('W+C+E+S', 'E'), ('W+C+E+S', 'S')) t(mask, fam))
  SELECT mask, count(*) AS maps, count(DISTINCT f.fam) AS families, round(sum(list_sum(list_transform(vals, lambda z: z::DOUBLE))), 5) AS total FROM f JOIN mk ON f.fam = mk.fam GROUP BY mask""")
def _(spark, sf):
    from functools import reduce
    w = v.windows(spark, sf)
    fam = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.slice("x", 16 * k + 1, 16).alias("values")) for k, f in enumerate("WCES")]))
    f = w.select("vec_id", fam.alias("f")).select("vec_id", "f.*")
    total = F.expr("aggregate(values, 0.0D, (a, z) -> a + cast(z as double))")
    parts = [ops.family_mask(f, mask).agg(F.lit(mask).alias("mask"), F.count("*").alias("maps"), F.count_distinct("family").alias("families"),
             F.round(F.sum(total), 5).alias("total")) for mask in ops.FAMILY_MASKS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("encode_classes", """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part))
  SELECT p_partkey, p_brand, CAST(k AS INTEGER) AS class_index FROM part JOIN c USING (p_brand)""")
def _(spark, sf):
    p = v.table(spark, sf, "part").select("p_partkey", "p_brand")
    return ops.encode_classes(p, ops.class_index(p, "p_brand"), "p_brand")


@query("safe_path_component", """SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '-', 'g'), '-.'), ''), 'unknown') AS component,
  substr(sha256(url), 1, 12) AS short_id FROM pages""")
def _(spark, sf):
    return v.table(spark, sf, "pages").select(
        "page_id", ops.safe_component(F.col("url")).alias("component"), F.substring(F.sha2("url", 256), 1, 12).alias("short_id"))


@query("quantize_values", with_(W) + """, b AS (SELECT * FROM (VALUES (8), (16)) t(bits)),
  q AS (SELECT vec_id, bits, list_transform(x, lambda z: CAST(round_even(least(greatest((z::DOUBLE + 0.25) / 0.5, 0.0), 1.0) * ((1 << bits) - 1), 0) AS BIGINT)) AS v FROM w, b)
  SELECT vec_id, bits, CAST(list_sum(v) AS BIGINT) AS total, CAST(list_max(v) AS BIGINT) AS top, CAST(v[1] AS BIGINT) AS first FROM q""")
def _(spark, sf):
    w = v.windows(spark, sf)
    out = []
    for bits in (8, 16):
        q = w.withColumn("v", ops.quantize("x", F.lit(-0.25), F.lit(0.25), bits))
        out.append(q.select("vec_id", F.lit(bits).alias("bits"), F.expr("aggregate(v, 0L, (a, z) -> a + z)").alias("total"),
                            F.array_max("v").cast("long").alias("top"), F.col("v")[0].cast("long").alias("first")))
    return out[0].unionByName(out[1])


@query("finite_guard", with_(W) + """, g AS (SELECT label, CASE WHEN len(x) = 0 THEN 'empty' WHEN len(list_filter(x, lambda z: isnan(z) OR isinf(z) OR z IS NULL)) > 0 THEN 'nonfinite' ELSE 'ok' END AS state FROM w)
  SELECT label, state, count(*) AS windows FROM g GROUP BY ALL""")
def _(spark, sf):
    w = v.windows(spark, sf)
    return w.groupBy("label", F.coalesce(ops.finite_problem("x"), F.lit("ok")).alias("state")).agg(F.count("*").alias("windows"))
