"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (3, 4, 5, 6)


@dataclass
class Model:
    """Weights (0 or more) of cues; a cue is a lower-case word (`=word`) or the beginning of longer words (`word`)."""

    bias: float = -4.0
    weights: dict[str, float] = field(default_factory=dict)


def cues_of(token: str) -> list[str]:
    """Candidate cues of a token between white space: its words and their beginnings."""
    out = []
    for word in LETTERS.findall(token):
        out.append("=" + word)
        out += [word[:n] for n in PREFIXES if len(word) > n]
    return out


def training_rows(labels: DataFrame, keep: Column, rows: int, label_col: str = "toxic", seed: int = 17) -> DataFrame:
    """About `rows` labelled ids at most, half of them per class: the documented bound of the fit.

    A doc_id with several labels counts as toxic when one of them says so; null ids and labels are left out.
    """
    one = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    count = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, rows / 2 / max(1, count.get(1, 0))).otherwise(rows / 2 / max(1, count.get(0, 0)))
    return one.where(draw < share)


def fit(documents: DataFrame, sample: DataFrame, cues: int = 50_000, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Learn cue weights from document labels; sentence labels are never seen.

    `sample` is (doc_id, y) of bounded size, so it may be broadcast; its documents are counted whole,
    in Spark, and only cues with a likelihood ratio statistic of 20 or more and four times the clean
    rate are kept, at most `cues`. Their occurrences by sentence come to the driver, where gradient
    descent fits P(doc) = 1 - prod(1 - p(sentence)). A sentence without cues has probability 0. One
    class alone, or no cue, gives an empty model, which scores 0.
    """
    texts = documents.select("doc_id", text_or_empty(F.col("text")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    totals = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen)), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["cue", "a", "c"])
            seen.clear()
            return batch

        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for cue in {c for token in set(text.lower().split()) for c in cues_of(token)}:
                    seen.setdefault(cue, [0, 0])[y] += 1
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    p = (a + c) / (pos + neg)
    g = 2 * (part(a, p * pos) + part(c, p * neg) + part(pos - a, (1 - p) * pos) + part(neg - c, (1 - p) * neg))
    counts = texts.mapInArrow(count, "cue string, a bigint, c bigint").groupBy("cue").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    chosen = counts.withColumn("g", g).where((F.col("g") >= 20) & ((a + 0.5) / pos >= 4 * (c + 0.5) / neg)).orderBy(F.desc("g"), "cue").limit(cues).collect()
    names = {r["cue"]: k for k, r in enumerate(chosen)}
    if not names:
        return Model()
    known = documents.sparkSession.sparkContext.broadcast(names)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = known.value
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for d, y, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                none = len(out)
                for m in SENTENCE.finditer(text.lower()):
                    cues = [hit[q] for token in m.group().split() for q in cues_of(token) if q in hit]
                    if cues:
                        out.append((d, y, cues))
                if len(out) == none:
                    out.append((d, y, []))
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, _, _ in out], pa.int64()), pa.array([y for _, y, _ in out], pa.int32()), pa.array([q for _, _, q in out], pa.list_(pa.int32()))],
                ["doc_id", "y", "cues"])

    bags = texts.mapInArrow(occurrences, "doc_id bigint, y int, cues array<int>").orderBy("doc_id", "cues").collect()
    doc = np.unique([r["doc_id"] for r in bags], return_inverse=True)[1]
    y = np.zeros(doc.max() + 1)
    y[doc] = [r["y"] for r in bags]
    sentence = np.repeat(np.arange(len(bags)), [len(r["cues"]) for r in bags])
    cue = np.array([q for r in bags for q in r["cues"]], np.int64)
    model = Model()
    w, move = np.full(len(names), 0.1), np.zeros(len(names))
    soft = lambda z: np.logaddexp(0, z)
    pull = 1 / len(y)
    for _ in range(steps):
        z = model.bias + np.bincount(sentence, w[cue], len(bags))
        q = np.exp(-np.bincount(doc, soft(z) - soft(model.bias), len(y)))
        of_doc = np.where(y == 1, -q / np.maximum(1 - q, 0.02), pos / neg)
        slope = of_doc[doc] / (1 + np.exp(-z))
        move = 0.9 * move - rate * (np.bincount(cue, slope[sentence], len(w)) * pull * 50 + decay * w)
        w = np.clip(w + move, 0, 12)
    model.weights = {n: float(round(w[k], 6)) for n, k in names.items() if w[k] > 1e-3}
    return model


def score(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`documents` with score and offending: array of (start, end, score) of sentences at or over `threshold`.

    Whole texts are read, in code points; null and empty texts score 0. Columns named like the
    results are replaced, all others pass through. An empty model scores 0 everywhere.
    """
    documents = documents.drop("score", "offending")
    columns, at = documents.columns, documents.columns.index(text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base, weights = math.log1p(math.exp(m.bias)), m.weights
        heavy: dict[str, float] = {}
        plain: set[str] = set()

        def judge(text: str) -> tuple[float, list[dict]]:
            nonlocal plain
            text = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            tokens = set(text.split())
            new = tokens.difference(plain).difference(heavy)
            for t in new:
                v = sum(weights.get(c, 0.0) for c in cues_of(t))
                if v > 0:
                    heavy[t] = v
                else:
                    plain.add(t)
            if len(plain) > 500_000:
                plain = set()
            if len(heavy) > 500_000:
                heavy.clear()
                heavy.update({t: v for t in tokens if (v := sum(weights.get(c, 0.0) for c in cues_of(t))) > 0})
            if tokens.isdisjoint(heavy):
                return 0.0, []
            whole, found = 0.0, []
            for s in SENTENCE.finditer(text):
                # a sentence's last word has lost the mark that its token in the text ends with
                z = sum(heavy[t] if t in heavy else 0.0 if t in plain else sum(weights.get(c, 0.0) for c in cues_of(t)) for t in s.group().split())
                if z > 0:
                    u = float(np.logaddexp(0, m.bias + z)) - base
                    whole += u
                    if (p := -math.expm1(-u)) >= threshold:
                        found.append({"start": s.start(), "end": s.end(), "score": p})
            return -math.expm1(-whole), found

        for batch in batches:
            done = [judge(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([p for p, _ in done], pa.float64()), pa.array([f for _, f in done], spans)], [*columns, "score", "offending"])

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(place))])
    return documents.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose label may not be learned: CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_tables(documents: DataFrame, labels: DataFrame, rows: int = 20_000) -> Model:
    return fit(documents, training_rows(labels, ~held_out(F.col("doc_id")), rows))
