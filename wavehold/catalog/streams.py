"""Streaming queries over the events table as a file stream, with batch twins in SQL."""

from pyspark.sql import functions as F

from ..sources import sinks, views as v
from ..streaming import jobs
from .base import S, query, with_

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def events(spark, sf):
    # a pattern serves both a table folder and a single file
    return jobs.event_stream(spark, f"{sf}/events.parque[t]")


def hours(c):
    return F.floor(F.unix_timestamp(c) / 3600).alias(c)


@query("ledgered_stream", "SELECT CAST(user_id AS VARCHAR) AS recording_id, count(*) AS samples, 'complete' AS status FROM events GROUP BY user_id")
def _(spark, sf):
    wanted = v.samples(spark, sf, position=False).groupBy("recording_id").agg(F.count("*").alias("sample_count"))
    return jobs.ledgered_stream(events(spark, sf), wanted, sinks.scratch(spark, "ledgered"))


@query("stream_frame_windows", with_(S) + """, e AS (SELECT recording_id, domain, v, CAST(floor(epoch(ts) / 10800) AS BIGINT) AS h FROM s), x AS (SELECT recording_id, domain, v, (h - k) * 3 AS start FROM e, range(2) z(k))
  SELECT recording_id, domain, start, start + 6 AS "end", count(*) AS samples, round(avg(v), 6) AS mean_v FROM x GROUP BY ALL""")
def _(spark, sf):
    w = jobs.frame_windows(events(spark, sf), "6 hours", "3 hours", "1 day", F.count("*").alias("samples"), F.avg("v").alias("mean_v"))
    d = jobs.drain_whole(w, ["recording_id", "domain", "start", "end"], "frames")
    return d.select("recording_id", "domain", hours("start"), hours("end"), "samples", *r6("mean_v"))


@query("stream_first_window", with_(S) + "SELECT recording_id, event_id, v FROM s WHERE n = 0")
def _(spark, sf):
    parts = jobs.drain_whole(jobs.first_sample_parts(events(spark, sf), "1 day", "1 day"), jobs.PART, "first")
    return jobs.first_sample(parts).select("recording_id", "event_id", "v")


@query("stream_energy", with_(S) + """, rf AS (SELECT domain, avg(v * v) AS reference FROM s GROUP BY domain), x AS (SELECT recording_id, s.domain, CAST(floor(epoch(ts) / 43200) AS BIGINT) * 12 AS start, avg(v * v) AS power FROM s GROUP BY ALL)
  SELECT recording_id, x.domain, start, round(ln(1 + power / reference), 6) AS energy FROM x JOIN rf USING (domain)""")
def _(spark, sf):
    ref = v.samples(spark, sf, position=False).groupBy("domain").agg(F.avg(F.col("v") * F.col("v")).alias("reference"))
    d = jobs.drain_whole(jobs.energy_windows(events(spark, sf), ref, "12 hours", "1 day"), ["recording_id", "domain", "start", "end"], "energy")
    return d.select("recording_id", "domain", hours("start"), *r6("energy"))


@query("stream_session", with_(S) + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY recording_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM s),
  k AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM g)
  SELECT recording_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) + 21600 AS "end", count(*) AS samples FROM k GROUP BY recording_id, sess
  HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM s)""")
def _(spark, sf):
    """Closed blocks only: those whose end the watermark has passed."""
    d = jobs.drain_whole(jobs.sessions(events(spark, sf), "6 hours", "1 day"), ["recording_id", "start", "end"], "sessions", "append")
    return d.select("recording_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "samples")


@query("stream_detection", with_(S) + "SELECT recording_id, round(avg(v / 500.0), 6) AS score, count(*) AS samples, avg(v / 500.0) >= 0.05 AS detected FROM s GROUP BY recording_id")
def _(spark, sf):
    parts = jobs.drain_whole(jobs.detection_parts(events(spark, sf), F.col("v") / 500.0, "1 day", "1 day"), jobs.PART, "detect")
    return jobs.running_detection(parts, 0.05).select("recording_id", *r6("score"), "samples", "detected")
