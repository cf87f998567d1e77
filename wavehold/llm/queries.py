"""Registered queries of this folder with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, credentials, mixing, toxicity
from .bpe import encode_decode
from .common import fresh_path, table
from .digest_index import DigestIndex
from .fuzzy_lines import repeated_lines
from .hilbert_ann import nearest
from .manifest import merkle_manifest, without_newlines
from .near_dup import near_duplicates
from .packing import read_documents, write_blocks
from .runs import repeated_runs
from .sharding import shard_rows

TOKENIZERS = str(Path(public_tokenizers.path("word_bpe_49k.json")).parent)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# CRC-32 by its polynomial, bit by bit, over the bytes of a text
CRC_TABLE = """c AS (SELECT n, list_reduce(list_prepend(n::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(n)),
tab AS (SELECT list(v ORDER BY n) AS crc FROM c)"""


def crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'),
  lambda h: ('0x' || h)::UBIGINT)), lambda a, b: xor(a >> 8, tab.crc[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)"""


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_hilbert_orderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _level_sql(k: int, weight: str) -> str:
    """One level of the budget tree, after the level above it (t{k - 1})."""
    up, own = ", ".join(mixing.LEVELS[:k]), ", ".join(mixing.LEVELS[: k + 1])
    part = f"PARTITION BY {up} " if k else ""
    budget = f"JOIN (SELECT {up}, given AS budget FROM t{k - 1}) USING ({up})" if k else "CROSS JOIN whole"
    return f"""
n{k} AS (SELECT {own}, sum(capacity) AS capacity, {weight} AS weight FROM leaves GROUP BY {own}),
a{k} AS (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b4,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM n{k} {budget}
  WINDOW w AS ({part}ORDER BY capacity::DOUBLE / weight, {mixing.LEVELS[k]})),
f{k} AS (SELECT *, capacity::HUGEINT * rest_w <= (budget::HUGEINT - b4) * weight AS filled FROM a{k}),
g{k} AS (SELECT *, sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({part}) AS taken,
  sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({part}) AS open FROM f{k}),
t{k} AS (SELECT *, CASE WHEN filled THEN capacity ELSE least(capacity, (budget::HUGEINT - taken) * weight // open) END AS given FROM g{k})"""


def _mixing_sql(of: str = "documents", epochs: int = 2, share: tuple[int, int] = (1, 2), seed: int = 29) -> str:
    weight = "CASE domain " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in mixing.DOMAIN_WEIGHTS.items()) + " ELSE 1 END"
    leaf = ", ".join(mixing.LEVELS)
    return rf"""
WITH r AS (SELECT doc_id, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS number, coalesce(lang, 'null') AS lang,
  coalesce(source, 'null') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens FROM {of}),
d AS (SELECT * EXCLUDE number, CASE WHEN number = '' THEN 'other' ELSE 'domain' || (right(number, 2)::INT % 4) END AS domain FROM r),
leaves AS (SELECT {leaf}, sum(n_tokens) AS tokens, {epochs} * sum(n_tokens) AS capacity FROM d GROUP BY ALL),
whole AS (SELECT least(sum(tokens)::HUGEINT * {share[0]} // {share[1]}, sum(capacity)) AS budget FROM leaves),
{_level_sql(0, weight)},
{_level_sql(1, "1")},
{_level_sql(2, "1")},
plan AS (SELECT {leaf}, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole_epochs,
  CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM t2 JOIN (SELECT {leaf}, tokens FROM leaves) USING ({leaf})),
o AS (SELECT d.*, whole_epochs, rest, ('0x' || substr(md5('{seed}:' || whole_epochs || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS draw
  FROM d JOIN plan USING ({leaf})),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY draw, doc_id NULLS FIRST, n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, {leaf}, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(whole_epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM p
"""


SQL["op3_hierarchical_budgets"] = _mixing_sql()


@query
def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_lines(table(spark, sf_dir, "documents"))
    return rows.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


@query
def op5_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credentials.report(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < credentials.STRONG)
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(credentials.named(base), 256).alias("base_sha256"), credentials.named(F.col("spans")).alias("spans"),
    )


def _credential_sql() -> str:
    kinds = []
    for k, (_, role, pattern, group, least) in enumerate(credentials.KINDS):
        rx = pattern.replace("'", "''")
        kinds.append(f"""SELECT doc_id, {k} AS kind, '{role}' AS role, string_split_regex(text, '{rx}') AS gaps,
  regexp_extract_all(text, '{rx}', 0) AS found, regexp_extract_all(text, '{rx}', {group}) AS counted, {least} AS least FROM d""")
    names = ", ".join(f"'{k}'" for k, *_ in credentials.KINDS)
    near = f"o.doc_id = w.doc_id AND o.role <> w.role AND o.start < w.stop + {credentials.SCOPE} AND o.stop > w.start - {credentials.SCOPE}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
i AS (SELECT *, unnest(range(1, len(found) + 1)) AS n FROM m),
p0 AS (SELECT doc_id, kind, role, n, length(found[n]) AS size, length(counted[n]) >= least AS whole,
  sum(length(gaps[n]) + length(found[n])) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop FROM i),
p AS (SELECT doc_id, kind, role, CAST(stop - size AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM p0 WHERE whole),
s AS (SELECT doc_id, kind, start, stop FROM p WHERE kind < {credentials.STRONG} UNION ALL
  SELECT w.doc_id, w.kind, w.start, w.stop FROM p w WHERE w.kind >= {credentials.STRONG} AND
    (EXISTS (SELECT 1 FROM p o WHERE {near} AND o.kind < {credentials.STRONG}) OR
     (SELECT count(DISTINCT o.role) FROM p o WHERE {near}) = 2)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(([{names}])[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {credentials.STRONG}), '') AS base,
  string_agg(([{names}])[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


SQL["op5_credential_linking"] = _credential_sql()


@query
def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_bit_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    path = fresh_path(spark, "token-blocks")
    write_blocks(table(spark, sf_dir, "documents"), path, f"{tokenizers}/word_bpe_49k.json", 49_408)
    return read_documents(spark, path)


@query
def op8_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_tables(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query
def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    rows = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{tokenizers}/byte_bpe_50k.json")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, fresh_path(spark, "digest-index"), buckets=max(12, documents.count() // 1_000_000))
    out = index.add(documents, batch="documents")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op10_digest_index"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM r
"""


@query
def op11_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"), plant=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


@query
def op12_midstate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), without_newlines())


def _manifest_sql() -> str:
    def leaf(text: str) -> str:
        cols = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in cols) + ")"

    def tree(name: str, first: str) -> str:
        """Nodes of all levels, and of every node the siblings on its two sides."""
        near = "string_agg(digest, '' ORDER BY idx) OVER (PARTITION BY tree, lvl, idx // 3 ORDER BY idx ROWS BETWEEN {} EXCLUDE CURRENT ROW)"
        return f"""
{name} AS (SELECT tree, 0 AS lvl, idx, digest, count(*) OVER (PARTITION BY tree) AS size FROM {first} UNION ALL
  SELECT tree, max(lvl) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (max(size) + 2) // 3 FROM {name} WHERE size > 1 GROUP BY tree, idx // 3),
{name}_near AS (SELECT tree, lvl, idx, size, coalesce({near.format("UNBOUNDED PRECEDING AND CURRENT ROW")}, '') AS l,
  coalesce({near.format("CURRENT ROW AND UNBOUNDED FOLLOWING")}, '') AS r FROM {name} WHERE size > 1),
{name}_top AS (SELECT tree, lvl AS height, digest FROM {name} WHERE size = 1)"""

    return f"""
WITH RECURSIVE {CRC_TABLE},
f AS (SELECT *, {crc_sql("doc_id::VARCHAR")} % 2 = 0 AS even FROM documents, tab),
d AS (SELECT doc_id, source AS tree, {leaf("text")} AS leaf, {leaf("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM f),
n AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS idx FROM d),
{tree("t", "n")},
s AS (SELECT 0 AS tree, t_top.tree AS source, digest, row_number() OVER (ORDER BY encode(t_top.tree) NULLS FIRST) - 1 AS idx FROM t_top),
{tree("u", "s")},
p AS (SELECT n.doc_id, n.leaf, n.changed, n.tree, n.idx, s.digest AS subroot, s.idx AS at, u_top.digest AS root, t_top.height AS h, u_top.height AS hh
  FROM n JOIN s ON n.tree IS NOT DISTINCT FROM s.source JOIN t_top ON n.tree IS NOT DISTINCT FROM t_top.tree, u_top),
w AS (SELECT *, 0 AS k, changed AS folded, '' AS near FROM p UNION ALL
  SELECT w.* REPLACE (k + 1 AS k, sha256(coalesce(a.l, b.l) || folded || coalesce(a.r, b.r)) AS folded, near || coalesce(a.l, b.l) || coalesce(a.r, b.r) AS near)
  FROM w LEFT JOIN t_near a ON k < h AND a.tree IS NOT DISTINCT FROM w.tree AND a.lvl = k AND a.idx = w.idx // (3 ** k)::BIGINT
  LEFT JOIN u_near b ON k >= h AND b.lvl = k - h AND b.idx = w.at // (3 ** greatest(k - h, 0))::BIGINT WHERE k < h + hh)
SELECT doc_id, leaf, subroot, root, sha256(near) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM w WHERE k = h + hh
"""


SQL["op12_midstate_tree"] = _manifest_sql()


@query
def op13_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bloom_lm.score(documents, bloom_lm.train(documents.where(~bloom_lm.held_out())))


SQL["op6_sampled_splitters"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{CRC_TABLE},
k AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, text,
  ('0x' || substr(md5(text), 1, 15))::BIGINT AS key FROM t),
x AS (SELECT k.*, {crc_sql("text")} AS text_crc32 FROM k, tab),
o AS (SELECT *, row_number() OVER w - 1 AS rank, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(size) OVER () AS total FROM x WINDOW w AS (ORDER BY key, doc_id NULLS FIRST)),
s AS (SELECT *, CAST(before * 8 // total AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
