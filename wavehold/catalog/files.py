"""Source and sink queries; file content is derived from the tables by Spark itself."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from ..operators import windows as wo
from ..plans.ranking import blocked_row_number, id_block
from ..session import cut
from ..sources import captures, files as ops, sinks, views as v
from .base import S, W, query, with_
from .framing import FR, framed
from .relating import REL, relations

r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


@query("read_manifest", """SELECT CAST(c_custkey AS VARCHAR) AS recording_id, CAST(c_nationkey % 3 AS VARCHAR) AS dataset, c_mktsegment AS label, c_nationkey = 0 AS is_background,
  c_custkey * 10 AS sample_count, c_name AS origin, 'v1' AS schema_version FROM customer""")
def _(spark, sf):
    """Manifest files of bounded size are written, read with the declared schema and exploded."""
    c = v.table(spark, sf, "customer")
    rec = F.struct(
        F.col("c_custkey").cast("string").alias("recording_id"), (F.col("c_nationkey") % 3).cast("string").alias("dataset"), F.concat(F.lit("raw/"), "c_name").alias("path"),
        F.col("c_mktsegment").alias("label"), (F.col("c_nationkey") == 0).alias("is_background"), F.lit(1.0e8).alias("sample_rate_hz"),
        (F.col("c_custkey") * 10).alias("sample_count"), F.create_map(F.lit("origin"), F.col("c_name")).alias("metadata"))
    doc = c.groupBy(F.floor(F.col("c_custkey") / 1000).alias("g")).agg(F.collect_list(rec).alias("recordings"))
    path = sinks.scratch(spark, "manifest")
    doc.select(F.to_json(F.struct(F.lit("v1").alias("schema_version"), "recordings")).alias("value")).write.text(path)
    m = ops.require_unique(ops.read_manifest(spark, path, multi_line=False))
    return m.select("recording_id", "dataset", "label", "is_background", "sample_count", F.col("metadata")["origin"].alias("origin"), "schema_version")


@query("duplicate_manifest_ids", """SELECT CAST(o_custkey AS VARCHAR) AS recording_id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def _(spark, sf):
    return ops.repeated_recordings(v.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("recording_id")))


@query("read_signal_slice", with_(S) + "SELECT recording_id, n, v FROM s WHERE n >= 20 AND n < 50")
def _(spark, sf):
    """Chunks stored by range of chunk number, so the filter skips whole files and row groups."""
    path = sinks.scratch(spark, "chunks")
    chunks = wo.signal_chunks(v.samples(spark, sf), ["recording_id"], chunk=16)
    chunks.repartitionByRange("chunk_no", "recording_id").sortWithinPartitions("chunk_no", "recording_id").write.parquet(path)
    return ops.read_signal_slice(spark.read.parquet(path), 20, 50, 16)


FILE = 1024  # windows a capture file holds


def capture_files(spark, sf, **how):
    """Raw files of the windows' samples, written by tasks; read back through the data source."""
    w = v.iq_windows(spark, sf).select("recording_id", "vec_id", "i", "q")
    w = blocked_row_number(w, ["recording_id"], ["vec_id"], id_block("vec_id"), "at")
    folder = sinks.scratch(spark, "captures")

    def put(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        name = f"{key[0]}.{key[1]}.iq"
        captures.write_capture(folder if ":/" in folder else f"file://{folder}", name, np.concatenate(pdf["i"].to_list()), np.concatenate(pdf["q"].to_list()))
        return pd.DataFrame({"path": [name]})

    parts = w.groupBy("recording_id", F.floor((F.col("at") - 1) / FILE).cast("long").alias("part"))
    cut(parts.applyInPandas(put, "path string"))
    return captures.read_captures(spark, folder if ":/" in folder else f"file://{folder}", **how)


IQ_FILES = W + f""", ra AS (SELECT recording_id, i, q, row_number() OVER (PARTITION BY recording_id ORDER BY vec_id) - 1 AS pos FROM w),
 ch AS (SELECT concat(recording_id, '.', pos // {FILE}, '.iq') AS path, CAST(4 * (pos % {FILE}) + k AS BIGINT) AS chunk_no, round(list_sum(list_transform(range(1, 9), lambda n: i[8 * k + n]::DOUBLE)), 6) AS sum_i,
  round(list_sum(list_transform(range(1, 9), lambda n: q[8 * k + n]::DOUBLE)), 6) AS sum_q FROM ra, range(4) z(k))"""


def chunk_sums(d):
    total = lambda c: F.round(F.expr(f"aggregate({c}, 0.0D, (t, z) -> t + cast(z as double))"), 6)
    return d.select("path", "chunk_no", total("i").alias("sum_i"), total("q").alias("sum_q"))


@query("ingest_interleaved_iq", with_(IQ_FILES) + "SELECT * FROM ch")
def _(spark, sf):
    """Raw capture files back to I/Q chunks of 8; each file is read by ranges."""
    return chunk_sums(capture_files(spark, sf, chunk=8, partition_bytes=1 << 16))


@query("read_capture_range", with_(IQ_FILES) + "SELECT * FROM ch WHERE chunk_no >= 40 AND chunk_no < 44")
def _(spark, sf):
    """A slice of every capture; only its byte ranges are opened."""
    return chunk_sums(capture_files(spark, sf, chunk=8).where("chunk_no >= 40 AND chunk_no < 44"))


@query("file_inventory_sha256", "SELECT DISTINCT url AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages")
def _(spark, sf):
    p = v.table(spark, sf, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return ops.inventory(p)


@query("file_inventory_parts", """WITH d AS (SELECT conv_id, turn, sha256(text) AS h, octet_length(encode(text)) AS b FROM conversations)
  SELECT conv_id AS path, CAST(sum(b) AS BIGINT) AS bytes, sha256(string_agg(h, '' ORDER BY turn)) AS sha256 FROM d GROUP BY conv_id""")
def _(spark, sf):
    """A conversation as a file arriving in ordered parts."""
    c = v.table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("part_no"), F.encode("text", "UTF-8").alias("content"))
    return ops.inventory(c)


@query("verify_checksums", """SELECT doc_id AS path, CASE WHEN doc_id % 23 = 5 THEN 'missing' ELSE 'changed' END AS fault FROM documents WHERE doc_id % 23 = 5 OR doc_id % 17 = 3""")
def _(spark, sf):
    """A recorded inventory against content where some documents are gone and some altered."""
    d = v.table(spark, sf, "documents")
    recorded = ops.inventory(d.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")))
    now = d.where(F.col("doc_id") % 23 != 5).select(
        F.col("doc_id").alias("path"), F.encode(F.when(F.col("doc_id") % 17 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8").alias("content"))
    return ops.checksum_faults(recorded, ops.inventory(now))


CAP = """cp AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('T', lpad(CAST(p_size AS VARCHAR), 4, '0'), '_D', lpad(CAST(p_partkey % 10 AS VARCHAR), 2, '0'), '_S', lpad(CAST(p_partkey % 7 AS VARCHAR), 4, '0'), '.mat')
  WHEN 1 THEN concat('T', 10000 + p_size, '_S', lpad(CAST(p_partkey % 7 AS VARCHAR), 4, '0'), '.mat') WHEN 2 THEN concat('A', p_size, CASE WHEN p_partkey % 2 = 0 THEN '_IN' ELSE '_OUT' END, '_S', p_partkey % 4, '_slice_', p_partkey, '.mat')
  WHEN 3 THEN concat('background_slice_', p_partkey, '.mat') ELSE concat('unit', p_size, 'C_1_Ascend_c', p_partkey % 20, '_u', p_partkey % 3, '_d', p_partkey % 4, '.mat') END AS name FROM part)"""


def capture_names(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = (F.when(k % 5 == 0, F.concat(F.lit("T"), pad(s, 4), F.lit("_D"), pad(k % 10, 2), F.lit("_S"), pad(k % 7, 4), F.lit(".mat")))
            .when(k % 5 == 1, F.concat(F.lit("T"), s + 10000, F.lit("_S"), pad(k % 7, 4), F.lit(".mat")))
            .when(k % 5 == 2, F.concat(F.lit("A"), s, F.when(k % 2 == 0, "_IN").otherwise("_OUT"), F.lit("_S"), k % 4, F.lit("_slice_"), k, F.lit(".mat")))
            .when(k % 5 == 3, F.concat(F.lit("background_slice_"), k, F.lit(".mat")))
            .otherwise(F.concat(F.lit("unit"), s, F.lit("C_1_Ascend_c"), k % 20, F.lit("_u"), k % 3, F.lit("_d"), k % 4, F.lit(".mat"))))
    return v.table(spark, sf, "part").select("p_partkey", name.alias("name"))


_X = lambda p, k: f"nullif(regexp_extract(name, '{p}', {k}), '')"


@query("parse_capture_path", with_(CAP) + f"""SELECT p_partkey, CASE WHEN regexp_matches(name, '{ops.CLASS_SEGMENT}') THEN 'class_segment' WHEN regexp_matches(name, '{ops.SLICE}') THEN 'slice' WHEN regexp_matches(name, '{ops.UNIT_DAY}') THEN 'unit_day' END AS layout,
 coalesce({_X(ops.CLASS_SEGMENT, 1)}, {_X(ops.SLICE, 1)}, {_X(ops.UNIT_DAY, 1)}) AS class_code, {_X(ops.CLASS_SEGMENT, 2)} AS distance, coalesce({_X(ops.CLASS_SEGMENT, 3)}, {_X(ops.SLICE, 3)}) AS segment,
 coalesce({_X(ops.SLICE, 2)}, {_X(ops.UNIT_DAY, 2)}) AS state, {_X(ops.SLICE, 4)} AS slice_no, {_X(ops.UNIT_DAY, 3)} AS channel, {_X(ops.UNIT_DAY, 4)} AS unit, {_X(ops.UNIT_DAY, 5)} AS day FROM cp""")
def _(spark, sf):
    return capture_names(spark, sf).select("p_partkey", ops.parse_capture_path(F.col("name")).alias("f")).select("p_partkey", "f.*")


@query("join_anonymous_labels", with_(CAP) + "SELECT p_partkey AS anonymous_id, CASE WHEN p_partkey % 9 <> 0 THEN name END AS original_name FROM cp")
def _(spark, sf):
    """Label lines are written as text files and read back."""
    names = capture_names(spark, sf)
    path = sinks.scratch(spark, "labels")
    names.where("p_partkey % 9 <> 0").select(F.concat_ws(" ", "name", F.col("p_partkey").cast("string")).alias("value")).write.text(path)
    files = names.select(F.col("p_partkey").cast("string").alias("anonymous_id"))
    return ops.join_anonymous_labels(files, spark.read.text(path)).select(F.col("anonymous_id").cast("long").alias("anonymous_id"), "original_name")


@query("reject_partial_files", "SELECT concat('raw/', o_orderkey) AS path FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <= 200000")
def _(spark, sf):
    o = v.table(spark, sf, "orders")
    path = F.concat(F.lit("raw/"), F.col("o_orderkey").cast("string"))
    listing = o.select(path.alias("path")).unionByName(o.where("o_orderstatus = 'P'").select(F.concat(path, F.lit(ops.PARTIAL)).alias("path")))
    return ops.partial_files(listing, o.where("o_totalprice > 200000").select(path.alias("path"))).select("path")


@query("read_label_contract", "SELECT CAST(n_regionkey AS VARCHAR) AS dataset, n_name AS name, concat('class', n_nationkey % 3) AS canonical, n_regionkey <> 2 AS license_verified FROM nation")
def _(spark, sf):
    n = v.table(spark, sf, "nation")
    per = n.groupBy(F.col("n_regionkey").cast("string").alias("dataset"), (F.col("n_regionkey") != 2).alias("ok")).agg(
        F.map_from_entries(F.collect_list(F.struct("n_name", F.concat(F.lit("class"), F.col("n_nationkey") % 3)))).alias("labels"))
    doc = per.select(F.to_json(F.struct(F.create_map("dataset", F.struct("labels", F.col("ok").alias("license_verified"))).alias("datasets"))).alias("value"))
    path = sinks.scratch(spark, "contract")
    doc.write.text(path)
    labels, flags = ops.label_contract(spark.read.text(path))
    return labels.join(flags.select("dataset", "license_verified"), "dataset")


@query("write_window_cache", with_(FR) + """SELECT domain, recording_id, count(*) AS windows, min(start) AS first_start, max("end") AS last_end, true AS verified FROM fr GROUP BY ALL""")
def _(spark, sf):
    f = framed(spark, sf)
    m = sinks.write_window_cache(f, sinks.scratch(spark, "cache"), "domain")
    want = f.groupBy("domain", "recording_id").agg(F.count("*").alias("windows"))
    bad = sinks.cache_faults(m, want, ["domain", "recording_id"]).agg(F.count("*").alias("n"))
    return m.withColumn("verified", bad.scalar() == 0)


@query("write_feature_manifest", with_(W) + "SELECT vec_id, recording_id, round(list_min(i)::DOUBLE, 6) AS i_min, round(list_max(i)::DOUBLE, 6) AS i_max, round(list_min(q)::DOUBLE, 6) AS q_min, round(list_max(q)::DOUBLE, 6) AS q_max, 32 / 1e8::DOUBLE AS duration_s FROM w")
def _(spark, sf):
    m = sinks.feature_manifest(v.iq_windows(spark, sf), ["vec_id", "recording_id"], {"i": "i", "q": "q"}, 1.0e8)
    path = sinks.scratch(spark, "manifest")
    m.write.json(path)
    back = spark.read.schema(m.schema).json(path)
    return back.select("vec_id", "recording_id", *r6("i_min", "i_max", "q_min", "q_max"), "duration_s")


@query("export_summary", with_(FR) + """, n AS (SELECT recording_id, count(*) AS k FROM fr GROUP BY ALL) SELECT recording_id, k AS available, least(k, 3) AS exported FROM n""")
def _(spark, sf):
    f = framed(spark, sf)
    available = f.groupBy("recording_id").agg(F.count("*").alias("available"))
    return sinks.export_summary(available, wo.cap_windows_even(f, ["recording_id"], 8, 3), "recording_id")


def tree_sql(rows, columns):
    """The hash tree as SQL text."""
    parts = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f""", t0 AS (SELECT h, count(*) AS n FROM (SELECT sha256(concat_ws('|', {parts})) AS h FROM {rows}) GROUP BY h),
 t1 AS (SELECT sha256(concat_ws('|', h, n)) AS t, substr(h, 1, 6) AS k, n FROM t0), t2 AS (SELECT sha256(string_agg(t, '' ORDER BY t)) AS t, substr(k, 1, 3) AS k, sum(n) AS n FROM t1 GROUP BY t1.k),
 t3 AS (SELECT sha256(string_agg(t, '' ORDER BY t)) AS t, sum(n) AS n FROM t2 GROUP BY k) SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(sha256(string_agg(t, '' ORDER BY t))) AS sha256 FROM t3"""


@query("write_relations", with_(REL) + tree_sql("rel", ["sample_index", "nuisance", "severity", "winner", "loser"]).replace("sha256(sha256(string_agg(t, '' ORDER BY t)))", "sha256(string_agg(t, '' ORDER BY t))"))
def _(spark, sf):
    return sinks.write_relations(relations(spark, sf), sinks.scratch(spark, "relations"), ["sample_index", "nuisance", "severity", "winner", "loser"])


@query("stable_content_hash", "WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents)" + tree_sql("d", ["doc_id", "lang", "source", "n_chars"]).replace("sha256(sha256(string_agg(t, '' ORDER BY t)))", "sha256(string_agg(t, '' ORDER BY t))"))
def _(spark, sf):
    return sinks.content_hash(v.table(spark, sf, "documents"), ["doc_id", "lang", "source", "n_chars"])


@query("write_results_null_safe", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem""")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem").withColumn(
        "ratio", F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), float("nan")).when(F.col("l_discount") == 0, float("inf")).otherwise(F.round(F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0.0)), 6)))
    path = sinks.scratch(spark, "results")
    out = sinks.null_safe(li.select("ratio", "l_orderkey", "l_linenumber"))
    out.write.parquet(path)
    return spark.read.parquet(path)
