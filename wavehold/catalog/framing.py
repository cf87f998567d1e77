"""Windowing and sampling queries."""

from pyspark.sql import functions as F

from ..operators import windows as ops
from ..sources import views as v
from .base import S, W, query, with_

KEYS = ["recording_id", "domain", "label"]
LENGTH, HOP = 16, 8
FR = S + """, fr AS (SELECT a.recording_id, a.domain, a.label, b.start, b.start + 16 AS "end"
  FROM (SELECT recording_id, domain, label, count(*) AS m FROM s GROUP BY ALL) a,
  LATERAL (SELECT unnest(range(0, a.m - 15, 8)) AS start) b)"""


def framed(spark, sf):
    return ops.frame_samples(v.samples(spark, sf), KEYS, LENGTH, HOP)


@query("frame_windows", with_(FR) + """SELECT fr.recording_id, fr.domain, fr.label, fr.start, fr."end", round(avg(s.v), 6) AS mean_v
  FROM fr JOIN s ON s.recording_id = fr.recording_id AND s.n >= fr.start AND s.n < fr."end" GROUP BY ALL""")
def _(spark, sf):
    mean = F.expr("aggregate(x, 0.0D, (a, z) -> a + z)") / LENGTH
    return framed(spark, sf).select(*KEYS, "start", "end", F.round(mean, 6).alias("mean_v"))


@query("frame_counts", with_(S) + """SELECT recording_id, count(*) AS n_samples, greatest(0, 1 + CAST(floor((count(*) - 16) / 8.0) AS BIGINT)) AS n_windows
  FROM s GROUP BY recording_id""")
def _(spark, sf):
    c = v.samples(spark, sf, position=False).groupBy("recording_id").agg(F.count("*").alias("n_samples"))
    return c.withColumn("n_windows", ops.window_count(F.col("n_samples"), LENGTH, HOP))


@query("cap_windows_even", with_(FR) + """, c AS (SELECT *, start // 8 AS r, count(*) OVER (PARTITION BY recording_id) AS m FROM fr)
  SELECT recording_id, start FROM c WHERE m <= 3 OR r IN (0, (m - 1) // 2, m - 1)""")
def _(spark, sf):
    return ops.cap_windows_even(framed(spark, sf), ["recording_id"], HOP, 3).select("recording_id", "start")


@query("respect_continuity", with_(FR) + """SELECT recording_id, start FROM fr WHERE start // 32 = ("end" - 1) // 32""")
def _(spark, sf):
    return ops.respect_continuity(framed(spark, sf), 32).select("recording_id", "start")


@query("first_window_per_recording", with_(W) + """SELECT recording_id, domain, label, vec_id, start, round(x[1]::DOUBLE, 6) AS x0
  FROM w QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY start) = 1""")
def _(spark, sf):
    first = ops.first_window(v.windows(spark, sf, starts=True), KEYS, ["start", "vec_id", "x"])
    return first.select(*KEYS, "vec_id", "start", F.round(F.col("x")[0].cast("double"), 6).alias("x0"))


@query("cap_candidates_global", with_(FR) + """, g AS (SELECT *, row_number() OVER (ORDER BY recording_id, start) - 1 AS position, count(*) OVER () AS m FROM fr)
  SELECT recording_id, start, position FROM g WHERE position IN (SELECT j * (m - 1) // 39 FROM (SELECT unnest(range(0, 40)) AS j), (SELECT max(m) AS m FROM g))""")
def _(spark, sf):
    return ops.cap_candidates_global(framed(spark, sf), HOP, 40).select("recording_id", "start", "position")


@query("frames_in_window", with_(W) + """, sz AS (SELECT * FROM (VALUES (16), (80)) t(frame_samples)),
 p AS (SELECT vec_id, frame_samples, CASE WHEN frame_samples > 64 THEN list_concat(x, list_transform(range(64, frame_samples), lambda k: 0.0::FLOAT)) ELSE x END AS p FROM w, sz)
 SELECT vec_id, frame_samples, CAST(k AS INTEGER) AS frame_no,
 round(list_sum(list_transform(p[8 * k + 1 : 8 * k + frame_samples], lambda z: z::DOUBLE * z)) / frame_samples, 6) AS power
 FROM p, LATERAL (SELECT unnest(range(0, (len(p) - frame_samples) // 8 + 1)) AS k)""")
def _(spark, sf):
    w = v.windows(spark, sf).select("vec_id", "x")
    parts = []
    for size in (16, 80):
        power = F.expr("aggregate(frame, 0.0D, (a, z) -> a + cast(z as double) * z)") / size
        parts.append(ops.frames_in_window(w, size, 8).select(
            "vec_id", F.lit(size).alias("frame_samples"), "frame_no", F.round(power, 6).alias("power")))
    return parts[0].unionByName(parts[1])


@query("cycle_case_assignment", with_(W) + """SELECT recording_id, start, vec_id, position, position % 32 AS case_index FROM
  (SELECT *, row_number() OVER (ORDER BY recording_id, start) - 1 AS position FROM w)""")
def _(spark, sf):
    o = ops.global_order(v.windows(spark, sf, starts=True), 64)
    return o.select("recording_id", "start", "vec_id", "position", F.pmod("position", F.lit(32)).alias("case_index"))


@query("memory_plan", with_(S) + """, c AS (SELECT recording_id, domain, greatest(0, 1 + CAST(floor((count(*) - 16) / 8.0) AS BIGINT)) AS k FROM s GROUP BY ALL),
  t AS (SELECT domain, count(*) AS recordings, CAST(sum(least(k, 8)) AS BIGINT) AS windows FROM c GROUP BY domain)
  SELECT domain, recordings, windows, windows * (16 * 8 + 4096) AS cached_bytes, recordings * 32 AS relation_rows,
  recordings * 32 * (2 * 16 * 8 + 2 * 4096) AS relation_bytes FROM t""")
def _(spark, sf):
    c = v.samples(spark, sf, position=False).groupBy("recording_id", "domain").agg(F.count("*").alias("n"))
    return ops.memory_plan(c, ["domain"], LENGTH, HOP, per_recording=8)
