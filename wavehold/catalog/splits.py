"""Split and role queries."""

from pyspark.sql import functions as F

from ..operators import splits as ops
from ..session import cut
from ..sources import views as v
from .base import REC, query, with_

FOLDS = ["d0", "d1", "d2"]
ROLES = REC + """, rk AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY sha256(concat_ws('|', 24021, group_id)), group_id) AS k FROM rec),
roles AS (SELECT f.fold_id, CASE WHEN domain = f.fold_id THEN 'held_target' ELSE
  ['source_fit', 'source_calibration', 'source_selection', 'source_validation'][(k - 1) % 4 + 1] END AS role,
  recording_id, group_id, domain, label FROM rk, (SELECT DISTINCT domain AS fold_id FROM rec) f)"""

USERS = """us AS (SELECT user_id AS recording_id, user_id AS group_id, concat('d', (user_id // 2) % 3) AS domain,
  CAST(user_id % 2 AS VARCHAR) AS label, count(*) AS n FROM events GROUP BY ALL)"""


def users(spark, sf):
    s = v.table(spark, sf, "events")
    return s.groupBy("user_id").agg(F.count("*").alias("n")).select(
        F.col("user_id").alias("recording_id"), F.col("user_id").alias("group_id"),
        F.concat(F.lit("d"), (F.floor(F.col("user_id") / 2) % 3).cast("string")).alias("domain"),
        (F.col("user_id") % 2).cast("string").alias("label"), "n",
    )


def roles(spark, sf):
    return ops.split_roles(v.recordings(spark, sf), FOLDS)


def fold_plan(spark, sf):
    """The split plan as a table of its own: recordings only, read by every later stage."""
    return cut(roles(spark, sf).select("fold_id", "role", "recording_id", "n_windows"))


@query("leave_one_domain_out", with_(ROLES) + """SELECT fold_id, domain, CASE WHEN role = 'held_target' THEN 'held_target' ELSE 'source' END AS side,
  count(*) AS recordings FROM roles GROUP BY ALL""")
def _(spark, sf):
    side = F.when(F.col("role") == ops.HELD, ops.HELD).otherwise("source")
    return roles(spark, sf).groupBy("fold_id", "domain", side.alias("side")).agg(F.count("*").alias("recordings"))


@query("assign_source_roles", with_(ROLES) + "SELECT fold_id, role, recording_id, group_id, domain, label FROM roles")
def _(spark, sf):
    return roles(spark, sf).select("fold_id", "role", "recording_id", "group_id", "domain", "label")


@query("assign_roles_long_signals", with_(USERS) + """, k AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY sha256(concat_ws('|', 24021, group_id)), group_id) AS k FROM us)
 SELECT domain, label, group_id, ['source_fit', 'source_calibration', 'source_selection', 'source_validation'][(k - 1) % 4 + 1] AS role FROM k""")
def _(spark, sf):
    return ops.assign_group_roles(users(spark, sf))


@query("split_support_gate", """WITH g AS (SELECT DISTINCT l_returnflag AS domain, l_linestatus AS label, l_suppkey % 7 AS group_id FROM lineitem)
  SELECT domain, label, count(*) AS n_groups, CASE WHEN count(*) < 4 THEN 'needs at least 4 physical groups' ELSE 'ok' END AS status FROM g GROUP BY ALL""")
def _(spark, sf):
    rec = v.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("label"), (F.col("l_suppkey") % 7).alias("group_id")).distinct()
    s = rec.groupBy("domain", "label").agg(F.count_distinct("group_id").alias("n_groups"))
    return s.withColumn("status", F.when(F.col("n_groups") < 4, "needs at least 4 physical groups").otherwise("ok"))


@query("sparse_stratum_rule", """WITH r AS (SELECT DISTINCT concat(label, '-', vec_id % 6) AS group_id, concat('d', vec_id % 3) AS domain, CAST(label AS VARCHAR) AS label FROM embeddings),
  k AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY sha256(concat_ws('|', 24021, group_id)), group_id) AS k, count(*) OVER (PARTITION BY domain, label) AS m FROM r)
  SELECT domain, label, group_id, CASE WHEN m = 2 THEN CASE WHEN k = 1 THEN 'source_fit' ELSE 'source_validation' END ELSE
  ['source_fit', 'source_calibration', 'source_selection', 'source_validation'][(k - 1) % 4 + 1] END AS role FROM k""")
def _(spark, sf):
    return ops.assign_group_roles(v.windows(spark, sf, classes=10), sparse=True)


@query("assert_disjoint_roles", """WITH t AS (SELECT DISTINCT sha256(text) AS h, doc_id % 5 AS role FROM documents)
  SELECT a.role AS left_role, b.role AS right_role, count(*) AS shared FROM t a JOIN t b ON a.h = b.h AND a.role < b.role GROUP BY ALL""")
def _(spark, sf):
    d = v.table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 5).alias("role"))
    return ops.role_overlaps(d, [], "h").groupBy("left_role", "right_role").agg(F.count("*").alias("shared"))


@query("materialize_roles", """WITH r AS (SELECT doc_id, doc_id % 4 AS role FROM documents)
  SELECT role, count(l.doc_id) AS rows_found, count(*) - count(l.doc_id) AS unknown_ids, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS quality FROM r LEFT JOIN labels l ON r.doc_id = l.doc_id GROUP BY role""")
def _(spark, sf):
    listed = v.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("role"))
    found, unknown = ops.materialize_roles(listed, v.table(spark, sf, "labels"), "doc_id")
    a = found.groupBy("role").agg(F.count("*").alias("rows_found"), F.sum("quality").cast("long").alias("quality"))
    b = unknown.groupBy("role").agg(F.count("*").alias("unknown_ids"))
    return a.join(b, "role", "full_outer").na.fill(0)


@query("source_contract", """WITH r AS (SELECT *, o_custkey % 40 AS group_id, o_orderstatus <> 'P' AND year(o_orderdate) < 1996 AS src FROM orders)
  SELECT group_id, count(*) FILTER (WHERE src) AS source_recordings, count(*) FILTER (WHERE NOT src) AS target_recordings,
  count(DISTINCT src) > 1 AS leaks FROM r GROUP BY group_id""")
def _(spark, sf):
    r = v.table(spark, sf, "orders").withColumn("group_id", F.col("o_custkey") % 40)
    return ops.source_contract(r, (F.col("o_orderstatus") != "P") & (F.year("o_orderdate") < 1996))


@query("temporal_group_proof", with_(USERS) + """SELECT domain, bool_and(n >= 40) AS verified, count(*) AS recordings FROM us GROUP BY domain""")
def _(spark, sf):
    return users(spark, sf).groupBy("domain").agg(F.bool_and(F.col("n") >= 40).alias("verified"), F.count("*").alias("recordings"))
