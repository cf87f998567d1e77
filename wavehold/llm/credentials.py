"""Secrets by multipart credential linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, text_or_empty

# (kind, role, pattern, group whose length counts, least length); the first three are reported by themselves
KINDS = (
    ("assign", "secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "secret", r"[0-9a-f]{32,}", 0, 32),
    ("ident", "identifier", r"""(?i)(user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)""", 2, 3),
    ("endpoint", "endpoint", r"""[a-z][a-z0-9+.-]+://[A-Za-z0-9_.@:-]+""", 0, 8),
    ("weak", "secret", r"""(?i)(pwd|passphrase|private_?key|credential|bearer|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
)
STRONG = 3
SCOPE = 200
BIN = 256  # under twice the scope, so that a bin never holds both edges of a scope


def _matches(text: Column, k: int) -> Column:
    """Of one kind's matches in a text: kind, lengths between matches, match lengths, and which are long enough."""
    _, _, pattern, group, least = KINDS[k]
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    counted = F.regexp_extract_all(text, rx, F.lit(group))
    return F.when(F.size(found) > 0, F.struct(
        F.lit(k).alias("kind"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.transform(found, F.length).alias("sizes"),
        F.transform(counted, lambda x: F.length(x) >= least).alias("whole"),
    ))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): every row's (doc_id, key, hash), and the spans found in it.

    spans is (key, hash, kind, start, end) in code points, end exclusive. Base kinds (assign,
    access, hex) are all there. An identifier, endpoint or weak secret is reported only in company:
    its scope, SCOPE code points to either side, must hold a base span of another role, or parts of
    both other roles. Parts meet in bins of the text, pre-aggregated by role, so a text with very
    many parts makes no pairs of them. Null and empty texts have no spans. A row is known by id and
    text hash: rows equal in both share their spans, and a null id is one like any other.
    """
    text = text_or_empty(F.col(text_col))
    found = F.filter(F.array(*[_matches(F.col("text"), k) for k in range(len(KINDS))]), lambda x: x.isNotNull())
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("hash"), found.alias("found"))
    docs = stored(docs, "matches")
    one = docs.where(F.size("found") > 0).dropDuplicates(["key", "hash"]).select("key", "hash", F.explode("found").alias("m"))
    flat = one.select("key", "hash", "m.kind", F.posexplode(F.arrays_zip(
        F.slice("m.gaps", F.lit(1), F.size("m.sizes")).alias("gap"), F.col("m.sizes").alias("size"), F.col("m.whole").alias("whole"))).alias("n", "x"))
    run = Window.partitionBy("key", "hash", "kind").orderBy("n")
    parts = flat.withColumn("end", F.sum(F.col("x.gap") + F.col("x.size")).over(run).cast("int")).where("x.whole").select(
        "key", "hash", "kind", (F.col("end") - F.col("x.size")).alias("start"), "end")
    parts = cut(parts)
    role = F.element_at(F.lit([{"identifier": 0, "secret": 1, "endpoint": 2}[r] for _, r, *_ in KINDS]), F.col("kind") + 1)
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN).cast("int"), F.floor(hi / BIN).cast("int")))
    by_bin = parts.select(
        "key", "hash", role.alias("role"), (F.col("kind") < STRONG).alias("strong"), "start", "end", bins(F.col("start"), F.col("end") - 1).alias("bin"),
    ).groupBy("key", "hash", "bin", "role", "strong").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.where(F.col("kind") >= STRONG).select(
        "key", "hash", "kind", "start", "end", role.alias("own"), (F.col("start") - SCOPE).alias("lo"), (F.col("end") + SCOPE).alias("hi"),
    ).withColumn("bin", bins(F.greatest("lo", F.lit(0)), F.col("hi") - 1))
    met = weak.join(by_bin, ["key", "hash", "bin"]).where((F.col("role") != F.col("own")) & (F.col("first") < F.col("hi")) & (F.col("last") > F.col("lo")))
    linked = met.groupBy("key", "hash", "kind", "start", "end").agg(F.max("strong").alias("strong"), F.min("role").alias("r0"), F.max("role").alias("r1"))
    linked = linked.where("strong OR r0 < r1").select("key", "hash", "kind", "start", "end")
    return docs.select("doc_id", "key", "hash"), parts.where(F.col("kind") < STRONG).union(linked)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), one row per row of `df`; spans are (start, kind number, end) in order."""
    docs, spans = scan(df, id_col, text_col)
    by_doc = spans.groupBy("key", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return docs.join(by_doc, ["key", "hash"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def named(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.lit([k for k, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
