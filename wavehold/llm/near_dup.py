"""MinHash near-dedup, with odd sketches between banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored, text_or_empty
from .linking import Judge, linked_groups

WORDS = 5
SKETCH_BITS = 512
RARE = 8  # documents of a crowd that have a shingle, up to which it is a rare one
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit values of each text's word shingles.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. Fewer words than a
    shingle make one shingle of the whole; no words make the empty set.
    """
    from xxhash import xxh3_64_intdigest

    words = [t.translate(LOWER).split() for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(count.sum()))
    weights = _mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    if len(flat) >= WORDS:
        rolled = sum(flat[k : len(flat) - WORDS + 1 + k] * weights[k] for k in range(WORDS))
        rolled = _mixed(rolled)
    out, at = [], 0
    for n in count.tolist():
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            short = (flat[at : at + n] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(_mixed(np.array([short ^ _MIX], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Band values (n, bands) and odd sketches (n, SKETCH_BITS / 64) of sets that are not empty.

    A sketch starts empty; each of the bands * rows MinHash samples flips the bit that its number
    and value hash to. Where two sets agree in a sample the flips cancel, so the bits in which two
    sketches differ tell in how many samples the sets differ.
    """
    k = bands * rows
    lane = _mixed(np.arange(1, k + 1, dtype=np.uint64) * _MIX + np.uint64(seed))
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((k, len(sets)), np.uint64)
    for i in range(k):
        least[i] = np.minimum.reduceat((flat ^ lane[i]) * (lane[i] | np.uint64(1)), starts)
    least = _mixed(least.T + lane)
    turn = _mixed(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(seed + 77)) | np.uint64(1)
    band = _mixed((least.reshape(len(sets), bands, rows) * turn).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
    bit = (least % np.uint64(SKETCH_BITS)).astype(np.int64) + SKETCH_BITS * np.arange(len(sets))[:, None]
    odd = (np.bincount(bit.ravel(), minlength=SKETCH_BITS * len(sets)) & 1).astype(np.uint8).reshape(len(sets), SKETCH_BITS)
    return band, np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def sketch_limit(similarity: float, samples: int, deviations: float = 4.0) -> int:
    """Differing bits that a pair at the threshold exceeds with negligible chance."""
    differ = samples * (1 - similarity)
    bits = SKETCH_BITS / 2 * (1 - math.exp(-4 * differ / SKETCH_BITS))
    slope = 2 * math.exp(-4 * differ / SKETCH_BITS)
    spread = math.sqrt(samples * similarity * (1 - similarity) * slope**2 + SKETCH_BITS / 4 * (1 - math.exp(-8 * differ / SKETCH_BITS)))
    return math.ceil(bits + deviations * spread)


def _signed(df: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for k in range(0, len(ids), 64):
                sets = shingle_sets(texts[k : k + 64])
                full = [s for s in sets if len(s)]
                band, sketch = signatures(full, bands, rows) if full else (np.zeros((0, bands), np.uint64), np.zeros((0, SKETCH_BITS // 64), np.uint64))
                b, o = iter(band.astype(np.int64)), iter(sketch.astype(np.int64))
                cols = [[], [], []]
                for s in sets:
                    cols[0].append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                    cols[1].append(next(b) if len(s) else [])
                    cols[2].append(next(o) if len(s) else [])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[k : k + 64], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(cols[0], pa.binary()),
                    pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "same", "bands", "sketch"])

    return df.mapInArrow(run, "doc_id bigint, n_shingles bigint, same binary, bands array<bigint>, sketch array<bigint>")


class _ShingleJudge(Judge):
    """Odd sketches as the quick test, full shingle sets as the last word."""

    def __init__(self, texts: DataFrame, repeated: DataFrame, percent: int, samples: int):
        """`repeated` is (id, same) of the ids that have several rows, with the digest of the set that stands for the id."""
        self.all_texts, self.repeated, self.percent, self.limit = texts, repeated, percent, sketch_limit(percent / 100, samples)
        self.bounded = False

    def gather(self, ids: DataFrame) -> None:
        # one text an id: each copy of a row would count its shingles once more, and the bounds of `near` would be too low
        found = self.all_texts.join(ids, "id", "left_semi")
        repeated = cut(self.repeated.join(ids, "id", "left_semi"))
        if repeated.limit(1).count():
            of_class = found.join(repeated, "id").select("id", "text", "same").mapInArrow(_of_class, "id bigint, text string")
            found = found.join(repeated, "id", "left_anti").union(of_class.groupBy("id").agg(F.min("text").alias("text")))
        self.texts = stored(found, "candidate-texts")

    def near(self, a: str, b: str) -> Column:
        bits = [F.bit_count(F.col(f"sketch_{a}")[k].bitwiseXOR(F.col(f"sketch_{b}")[k])) for k in range(SKETCH_BITS // 64)]
        n, m = F.col(f"n_shingles_{a}"), F.col(f"n_shingles_{b}")
        most = F.least(n, m)
        if self.bounded:
            # shingles that no other document in question has are in no common set; in a crowd, the rare
            # ones are in it only where both name them
            most = F.least(n - F.col(f"alone_{a}"), m - F.col(f"alone_{b}"))
            common = F.size(F.array_intersect(f"rare_{a}", f"rare_{b}"))
            both = F.col(f"rare_{a}").isNotNull() & F.col(f"rare_{b}").isNotNull()
            most = F.when(both, F.least(most, common + F.least(n - F.col(f"loose_{a}"), m - F.col(f"loose_{b}")))).otherwise(most)
        return (sum(bits[1:], bits[0]) <= self.limit) & (100 * most >= self.percent * (n + m - most))

    def refined(self, items: DataFrame) -> DataFrame:
        self.bounded = True
        some = self.texts.join(items.select("id", "crowded"), "id").select("id", "crowded", "text")
        sets = some.mapInArrow(_shingles, "id bigint, crowded boolean, shingle bigint")
        found = sets.groupBy("shingle").agg(F.count("*").alias("n"), F.count_if("crowded").alias("in_crowd"), F.min("id").alias("id"))
        alone = found.where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
        seldom = found.where(F.col("in_crowd").between(1, RARE)).select("shingle", "in_crowd")
        loose = sets.where("crowded").join(seldom, "shingle").groupBy("id").agg(
            F.count("*").alias("loose"), F.collect_list(F.when(F.col("in_crowd") > 1, F.col("shingle"))).alias("rare"))
        # a document with few shingles of its own is in the middle of its crowd
        out = items.join(alone, "id", "left").join(loose, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        none = F.array().cast("array<bigint>")
        return out.withColumns({
            "order": F.col("alone"), "loose": F.when(F.col("crowded"), F.coalesce("loose", F.lit(0))), "rare": F.when(F.col("crowded"), F.coalesce("rare", none)),
        })

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs with 100 * common >= percent * united."""
        percent = self.percent
        rows = pairs.join(self.texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
            self.texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
                keep = []
                for k in range(len(a)):
                    if last[0] != a[k]:
                        last = (a[k], shingle_sets([ta[k].as_py()])[0])
                    one, two = last[1], shingle_sets([tb[k].as_py()])[0]
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * common >= percent * (len(one) + len(two) - common):
                        keep.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

        return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) whose shingle set has the digest `same`."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        texts, same = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
        keep = [xxh3_128_digest(s.tobytes()) == d for k in range(0, len(texts), 64) for s, d in zip(shingle_sets(texts[k : k + 64]), same[k : k + 64])]
        yield batch.select(["id", "text"]).filter(pa.array(keep, pa.bool_()))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for k in range(0, len(texts), 64):
            sets = shingle_sets(texts[k : k + 64])
            row = pa.array(np.repeat(np.arange(k, k + len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(sets).view(np.int64))], ["id", "crowded", "shingle"])


def near_duplicates(df: DataFrame, percent: int = 85, bands: int = 21, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `df`.

    Documents whose sets of five-word shingles have a Jaccard similarity of `percent` / 100 or more
    are linked. Equal sets are one class from the start, so crowds of copies weigh as much as one
    document. Classes that share a MinHash band meet as linked_groups has it, odd sketches drop those
    far below the threshold, and the full sets decide. In crowds of near copies the shingles that a
    document shares with no other candidate bound its similarity, which spares the pairs of a crowd. With 21 bands of 6 a pair just at 0.85 is missed with a
    chance of 5e-5, with 32 bands of 5 one at 0.80 with 3e-6. Null, empty and blank texts have the
    empty set and are linked with nothing, not even each other. A null id takes no part: its
    component is null and it is kept. Rows with the same id are one document, of the text with the
    least class. An empty table gives no rows; other columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    signed = stored(_signed(texts, bands, rows), "minhash")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    # an id is one document: of several classes that it is the least id of, the least one is compared
    of_id = classes.groupBy("id").agg(F.min("same").alias("same"), F.count("*").alias("n"))
    other = cut(classes.join(of_id.where("n > 1").select("id", F.col("same").alias("first")), "id").where("same != first").select("same"))
    single = classes.join(other, "same", "left_anti")
    several = full.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    repeated = of_id.select("id", "same").join(several, "id")
    postings = single.select("id", F.explode("bands").alias("key"))
    groups = linked_groups(postings, single.select("id", "n_shingles", "sketch"), _ShingleJudge(texts, repeated, percent, bands * rows))
    of_class = cut(classes.select("same", "id").join(groups, "id", "left").select("same", F.coalesce("component", "id").alias("component")))
    rows_of = signed.select("doc_id", "n_shingles", "same").join(of_class, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows_of.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, percent: int = 80, bands: int = 32, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `df` of which each group keeps one document, with all their columns."""
    lost = near_duplicates(df, percent, bands, rows, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return df.join(lost, F.col(id_col).cast("long") == F.col("__id"), "left_anti")
