"""Registry of queries with their SQL twins, and the SQL text of the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.rng import sql_uniform as u

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


W = """w AS (SELECT vec_id, CAST(label % 2 AS INTEGER) AS cls, CAST(label % 2 AS VARCHAR) AS label,
  concat(label % 2, '-', vec_id % 12) AS recording_id, concat('d', vec_id % 3) AS domain,
  64 * (row_number() OVER (PARTITION BY label % 2, vec_id % 12 ORDER BY vec_id) - 1) AS start,
  embedding AS x, embedding[1:32] AS i, embedding[33:64] AS q FROM embeddings)"""

W10 = """w10 AS (SELECT vec_id, label AS cls, concat(label, '-', vec_id % 6) AS recording_id,
  concat('d', vec_id % 3) AS domain, embedding AS x FROM embeddings)"""

REC = W + """, rec AS (SELECT recording_id, recording_id AS group_id, domain, label, count(*) AS n_windows
  FROM w GROUP BY ALL)"""

S = """s AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, CAST(user_id % 2 AS VARCHAR) AS label,
  concat('d', (user_id // 2) % 3) AS domain, ts, event_id, value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"""

SC = """sc AS (SELECT d.doc_id AS recording_id, d.lang AS domain, l.toxic AS y,
  round(1.0 - exp(-d.n_chars / 5000.0), 3) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_avg = ", ".join(f"avg(probs[{k}])" for k in range(1, 11))

WP = f"""variants AS (SELECT * FROM (VALUES ('full', 0.55), ('control', 0.35)) c(condition, hit),
  (VALUES (0), (1), (2)) z(seed)),
wp0 AS (SELECT condition, seed, concat('d', vec_id % 3) AS fold, concat(label, '-', vec_id % 6) AS recording_id,
  vec_id, label AS truth, list_transform(range(1, 11), lambda k: exp(8 * embedding[10 * seed + k]::DOUBLE
  + CASE WHEN k - 1 = label AND {u('condition', 'seed', 'vec_id')} < hit THEN 1.1::DOUBLE ELSE 0.0::DOUBLE END)) AS e
  FROM embeddings, variants),
wp AS (SELECT condition, seed, fold, recording_id, vec_id, truth,
  list_transform(e, lambda v: v / list_sum(e)) AS probs FROM wp0)"""

RP = WP + f""", rp0 AS (SELECT condition, seed, fold, recording_id, min(truth) AS truth, [{_avg}] AS probs
  FROM wp GROUP BY condition, seed, fold, recording_id),
rp AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM rp0),
ens0 AS (SELECT condition, fold, recording_id, min(truth) AS truth, [{_avg}] AS probs
  FROM rp GROUP BY condition, fold, recording_id),
ens AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred FROM ens0)"""

OBJ = """obj AS (SELECT p_brand AS stable_id, round(avg(l_discount), 6) AS sensitivity,
  round(avg(l_tax) * 10, 6) AS macro_f1, round(avg(l_quantity), 6) AS latency_ms,
  round(avg(p_size), 6) AS bytes_per_sample, round(avg(l_extendedprice), 6) AS macs,
  avg(l_quantity) <= 25.6 AS feasible FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
