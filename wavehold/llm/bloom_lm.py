"""Word n-gram scoring from a log-frequency Bloom filter."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, shuffles_dropped, stored, text_or_empty

BASE = 1.5  # of the quantised counts
PROBES = 5  # hash functions for each level: 1 in 32 absent n-grams seems to be there once
MIXED = 100.0  # pseudo-counts of the shorter history's probability
BEGIN, END = b"\n<s>", b"\n</s>"  # no word holds a line feed
U = np.uint64

#: least count of each level, from 1: level q holds counts in [LEVELS[q - 1], LEVELS[q])
LEVELS = np.array(sorted({math.ceil(BASE**k) for k in range(100)}), np.float64)
VALUES = np.r_[0.0, (LEVELS[:-1] + LEVELS[1:] - 1) / 2]  # the count that a level stands for; 0 is absent


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _positions(keys: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Bits of (n-gram, level), one after another, each under its filter's size."""
    with np.errstate(over="ignore"):
        h = mix(keys + U(level) * U(0x9E3779B97F4A7C15))
        step = mix(h ^ U(0xD1B54A32D192ED03)) | U(1)
        for _ in range(PROBES):
            yield h % sizes
            h = h + step


def filter_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(packed bits, their number): each n-gram at all levels up to that of its count."""
    level = np.searchsorted(LEVELS, counts, side="right")
    size = max(64, math.ceil(int(level.sum()) * PROBES / math.log(2)) + 7 & ~7)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _positions(keys[level >= q], q, U(size)):
            bits[at] = True
    return np.packbits(bits, bitorder="little"), size


class Segments:
    """Filters of several segments, side by side. An n-gram is in segment key % n_segments."""

    def __init__(self, bits: np.ndarray, offsets: np.ndarray, sizes: np.ndarray):
        self.bits, self.offsets, self.sizes = bits, offsets, sizes  # offsets in bits, as uint64

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 if absent: probed level by level until one is missing. Never too low."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        of = keys % U(len(self.sizes))
        q = 1
        while len(alive):
            ok = np.ones(len(alive), bool)
            seg = of[alive]
            for at in _positions(keys[alive], q, self.sizes[seg]):
                at = at + self.offsets[seg]
                ok &= (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) == 1
            alive = alive[ok]
            out[alive] = q
            q += 1
        return out


class Tokens:
    """Tokens of some texts: words with A-Z lowered and an end each, and their n-gram keys."""

    def __init__(self, texts: list[bytes], order: int):
        import xxhash

        words, sizes = [], []
        for t in texts:
            w = t.lower().split()  # bytes: only A-Z change, and only the six white characters part words
            words += w
            sizes.append(len(w) + 2)
        found = pa.array(words, pa.binary()).dictionary_encode()
        _, edges, data = found.dictionary.buffers()
        edges, data = np.frombuffer(edges, np.int32)[: len(found.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        known = (BEGIN, END, *(data[a:b] for a, b in zip(edges, edges[1:])))
        kinds = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        sizes = np.array(sizes, np.int64)
        ids, end = np.full(sizes.sum(), -1, np.int64), np.cumsum(sizes)
        ids[end - sizes], ids[end - 1] = 0, 1
        ids[ids < 0] = found.indices.to_numpy() + np.int64(2)
        self._place(kinds, ids, sizes, order)

    @classmethod
    def again(cls, kinds: np.ndarray, ids: np.ndarray, sizes: np.ndarray, order: int) -> Tokens:
        """Tokens of texts from the hashes of their words, the place of each token's word among these, and the texts' tokens."""
        out = cls.__new__(cls)
        out._place(kinds, ids, sizes, order)
        return out

    def _place(self, kinds: np.ndarray, ids: np.ndarray, sizes: np.ndarray, order: int) -> None:
        self.kinds, self.ids, self.sizes = kinds, ids, sizes
        start = np.cumsum(self.sizes) - self.sizes
        at = np.arange(len(ids)) - np.repeat(start, self.sizes)
        self.real = at > 0  # places of tokens; the others are where texts begin
        self.start = start
        h = self.kinds[ids]
        self.grams, self.valid = [h], [np.ones(len(ids), bool)]
        with np.errstate(over="ignore"):
            for n in range(2, order + 1):
                key = np.zeros(len(ids), np.uint64)
                key[1:] = mix(self.grams[-1][:-1] * U(0x9E3779B97F4A7C15) + h[1:] + U(n))
                self.grams.append(key)
                self.valid.append(at >= n - 1)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.start) if len(self.start) else np.zeros(0)

    def log_probability(self, level: Callable[[int, np.ndarray], np.ndarray], total: int, kinds: int) -> np.ndarray:
        """log10 probability of each text; `level(n, keys)` gives the quantised levels of n-grams, probed once each.

        P_1 adds one to every count; P_n(w | h) = (c(h w) + MIXED * P_(n-1)) / (c(h) + MIXED). No n-gram
        counts more than its first words and its last word do.
        """
        estimate = [VALUES[level(1, self.kinds)][self.ids]]
        for n, (key, valid) in enumerate(zip(self.grams[1:], self.valid[1:]), 2):
            once, of = np.unique(key[valid], return_inverse=True)
            estimate.append(np.zeros(len(key)))
            estimate[-1][valid] = VALUES[level(n, once)][of]
        p = (estimate[0] + 1) / (total + kinds + 1)
        for n in range(1, len(self.grams)):
            history = np.r_[0.0, estimate[n - 1][:-1]]
            seen = np.minimum(np.minimum(estimate[n], history), estimate[0])
            p = np.where(self.valid[n], (seen + MIXED * p) / (history + MIXED), p)
        return self.per_text(np.where(self.real, np.log10(p), 0.0))


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to texts of about `size` bytes together; a text is never cut."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        k = 0
        while k < len(ends):
            before = ends[k - 1] if k else 0
            stop = max(k + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(k, stop - k), column.slice(k, stop - k).to_pylist()
            k = stop


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of many (keys, counts), by key."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as hold all of them, lowest bytes first; the width comes before them."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(data: bytes) -> np.ndarray:
    """What _narrow was given, as uint64."""
    part = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, : data[0]] = part.T
    return out.view("<u8").ravel()


def _to_segments(keys: np.ndarray, segments: int) -> tuple[np.ndarray, list[tuple[int, int, int, bytes]]]:
    """(order, [(segment, a, b, packed)]): the ascending keys by segment, and those of each as steps of key // segments."""
    seg = (keys % U(segments)).astype(np.min_scalar_type(segments))
    order = np.argsort(seg, kind="stable")
    seg, q = seg[order], keys[order] // U(segments)
    step = q.copy()
    step[1:] -= q[:-1]
    stretches = list(_stretches(seg))
    first = [a for a, _ in stretches]
    step[first] = q[first]
    return order, [(int(seg[a]), a, b, _narrow(step[a:b])) for a, b in stretches]


def _from_segment(packed: bytes, segment: int, segments: int) -> np.ndarray:
    return np.cumsum(_wide(packed), dtype=np.uint64) * U(segments) + U(segment)


FILTER = "segment int, bits binary, size bigint, words binary, word_counts binary, n_words bigint, n_tokens bigint"


class BloomModel:
    """What `train` found: a stored table of filter segments, with the exact counts of their words beside them."""

    def __init__(self, table: DataFrame, order: int, segments: int):
        self.table, self.order, self.segments = table, order, segments
        got = table.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(F.octet_length("bits"))).first()
        self.total, self.kinds, self.bytes = (int(x or 0) for x in got)

    def words(self) -> DataFrame:
        """(key, count) of every token of the training texts."""
        def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, "<i8")), pa.array(np.frombuffer(c, "<i8"))], ["key", "count"])

        return self.table.select("words", "word_counts").mapInArrow(unfold, "key bigint, count bigint")


def train(df: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20, buffered: int = 2_000_000) -> BloomModel:
    """Count all n-grams up to `order` of the rows' whole texts and hold their quantised counts in Bloom filters.

    Tasks sum what they read by n-gram and send a segment's keys and counts as two packed values; a segment's task
    adds up, sets the bits of every n-gram and keeps the exact counts of its words. The number of segments follows the
    bytes of the texts, and each segment's bits follow its n-grams; nothing is left out. N-grams are
    known by 64-bit hashes.
    """
    rows = df.select(text_or_empty(F.col(text_col)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    segments = 1 + size // segment_bytes
    out = pa.schema([("segment", pa.int32()), ("n", pa.int8()), ("keys", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(order)]
        begin = None

        def flush() -> Iterator[pa.RecordBatch]:
            for n, parts in enumerate(held):
                if not parts:
                    continue
                keys, counts = _summed(parts)
                parts.clear()
                begun = (n == 0) & (keys == begin)  # texts begun: a history, not a token
                for kind, mine in ((0, begun), (n + 1, ~begun)):
                    order, packed = _to_segments(keys[mine], segments)
                    many = counts[mine][order]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([seg for seg, *_ in packed], pa.int32()), pa.array(np.full(len(packed), kind, np.int8)),
                        pa.array([p for *_, p in packed], pa.binary()), pa.array([_narrow(many[a:b]) for _, a, b, _ in packed], pa.binary()),
                    ], schema=out)

        size = 0
        for _, texts in _pieces(batches):
            t = Tokens(texts, order)
            begin = t.kinds[0]
            held[0].append((t.kinds, np.bincount(t.ids, minlength=len(t.kinds))))
            for n in range(1, order):
                once, many = np.unique(t.grams[n][t.valid[n]], return_counts=True)
                held[n].append((once, many))
                size += len(once)
            if size > buffered:
                yield from flush()
                size = 0
        yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            keys, counts = _summed([(k, c) for k, _, c in parts])
            none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            words, exact = _summed([none, *((k, c) for k, n, c in parts if n == 1)])
            words, exact = words[exact > 0], exact[exact > 0]
            bits, bit_count = filter_of(keys[counts > 0], counts[counts > 0])
            row = {
                "segment": [at], "bits": [bits.tobytes()], "size": [bit_count], "words": [words.astype("<u8").tobytes()],
                "word_counts": [exact.astype("<i8").tobytes()], "n_words": [len(words)], "n_tokens": [int(exact.sum())],
            }
            return pa.RecordBatch.from_pydict(row, schema=made)

        at, parts = None, []
        for batch in batches:
            for seg, n, keys, many in zip(*(c.to_pylist() for c in batch.columns)):
                if at != seg:
                    if parts:
                        yield done()
                    at, parts = seg, []
                parts.append((_from_segment(keys, seg, segments), n, _wide(many).astype(np.int64)))
        if parts:
            yield done()

    made = pa.schema([("segment", pa.int32()), ("bits", pa.binary()), ("size", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    counts = rows.mapInArrow(count, "segment int, n tinyint, keys binary, counts binary")
    with shuffles_dropped(df.sparkSession):
        table = counts.repartition("segment").sortWithinPartitions("segment").mapInArrow(build, FILTER)
        return BloomModel(stored(table, "bloom-segments"), order, segments)


def _flat(model: BloomModel) -> dict:
    """All segments as plain arrays, brought one partition at a time; absent ones hold no n-gram."""
    sizes = np.full(model.segments, 64, np.uint64)
    for r in model.table.select("segment", "size").collect():
        sizes[r["segment"]] = r["size"]
    offsets = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()) // 8, np.uint8)
    for r in model.table.select("segment", "bits").toLocalIterator():
        at = int(offsets[r["segment"]]) // 8
        bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return {"bits": bits, "sizes": sizes, "offsets": offsets}


def _head(words: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(least count, keys, counts) of the most frequent words, at most `most`; keys ascend."""
    rows = words.groupBy(F.floor(F.log2("count")).cast("int").alias("bits")).count().collect()  # 64 at most
    least, held = (1 << 63) - 1, 0
    for r in sorted(rows, key=lambda r: -r["bits"]):
        held += r["count"]
        if held > most:
            break
        least = 1 << r["bits"]
    top = words.where(F.col("count") >= least).toArrow()
    keys, counts = top.column("key").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(keys)
    return least, keys[order], counts[order]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that take no part in training; a null id does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))


SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<bigint>"


def score(df: DataFrame, model: BloomModel, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 128 << 20, head: int = 1_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `df`.

    score is the model's log10 probability of the text and its end, from the filter alone. base_score adds
    log10((c + 1) / (N + V + 1)) over the tokens with their exact counts c; n_known of them have c > 0.

    The filter goes to the workers while it has at most `broadcast_bytes`. Exact counts of the `head` most
    frequent words at most go along; the other words of a text, all of them rare, meet theirs in a join. A larger
    filter stays where it is: the distinct n-grams of each block of texts are sent to its segments, and their
    levels and exact counts come back, which gives the same scores. Null and empty texts are one end token.
    A null id is not held out. Repeated rows each give a row; an empty table gives none.
    """
    spark = df.sparkSession
    order, total, kinds = model.order, model.total, model.kinds
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(F.col(text_col)).alias("text")).withColumn("row", F.monotonically_increasing_id())
    if model.bytes > broadcast_bytes:
        return _scored_by_segments(rows, model)
    words = model.words()
    least, keys, counts = _head(words, head)
    known = spark.sparkContext.broadcast({"keys": keys, "counts": counts})
    whole = math.log10(total + kinds + 1)

    def scored(batch: pa.RecordBatch, t: Tokens, level: Callable[[int, np.ndarray], np.ndarray]) -> pa.RecordBatch:
        top = known.value
        at = np.minimum(np.searchsorted(top["keys"], t.kinds), max(0, len(top["keys"]) - 1))
        found = top["keys"][at] == t.kinds if len(top["keys"]) else np.zeros(len(t.kinds), bool)
        exact = np.where(found, top["counts"][at], 0) if len(top["keys"]) else np.zeros(len(t.kinds), np.int64)
        in_head, real = found[t.ids], t.real
        base = t.per_text(np.where(real & in_head, np.log10(exact[t.ids] + 1.0) - whole, 0.0))
        # words beyond the head, once for each text
        text = np.repeat(np.arange(len(t.sizes)), t.sizes)
        rest = np.flatnonzero(real & ~in_head)
        once, times = np.unique(text[rest] * len(t.kinds) + t.ids[rest], return_counts=True)
        edge = np.searchsorted(once // max(1, len(t.kinds)), np.arange(len(t.sizes) + 1)).astype(np.int32)
        rare = t.kinds[once % max(1, len(t.kinds))].view(np.int64)
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        return pa.RecordBatch.from_arrays([
            column("row"), column("doc_id"), column("held_out"), pa.array(t.sizes - 1), pa.array(t.per_text((real & in_head).astype(np.int64))), pa.array(base),
            pa.array(t.log_probability(level, total, kinds)), pa.ListArray.from_arrays(pa.array(edge), pa.array(rare)), pa.ListArray.from_arrays(pa.array(edge), pa.array(times)),
        ], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])

    sent = spark.sparkContext.broadcast(_flat(model))

    def whole_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Segments(sent.value["bits"], sent.value["offsets"], sent.value["sizes"])
        for batch, texts in _pieces(batches):
            yield scored(batch, Tokens(texts, order), lambda n, keys: f.levels(keys))

    out = stored(rows.mapInArrow(whole_filter, SCORED), "scored-texts")
    rare = out.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    rare = rare.join(words.where(F.col("count") < least), "key", "left")
    seen = F.coalesce("count", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * (F.log10(seen + 1.0) - F.lit(whole))).alias("rest"))
    return out.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


BLOCK = "block bigint, doc_ids array<bigint>, held_out array<boolean>, sizes binary, kinds binary, ids binary"


def _scored_by_segments(rows: DataFrame, model: BloomModel, block_tokens: int = 1_000_000) -> DataFrame:
    """The same scores where the filter is too large to send: n-grams travel to their segments, levels and counts back to the texts.

    Texts become tokens once and do not travel: blocks of about `block_tokens` of them (a text is never cut) are
    written as the hashes of their words and each token's word, in buckets in which the answers meet them. A block
    asks for each of its n-grams once, in 6 bytes or so, and gets the answers in the order of its questions.
    """
    spark, order, total, vocabulary, segments = rows.sparkSession, model.order, model.total, model.kinds, model.segments
    whole = math.log10(total + vocabulary + 1)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            kinds = np.unique(np.concatenate([t.kinds for _, t in held]))
            ids = np.concatenate([np.searchsorted(kinds, t.kinds)[t.ids] for _, t in held])
            often = np.argsort(-np.bincount(ids, minlength=len(kinds)), kind="stable")  # frequent words have small numbers
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            of = lambda name: [x for b, _ in held for x in b.column(b.schema.get_field_index(name)).to_pylist()]
            row = {
                "block": [held[0][0].column(held[0][0].schema.get_field_index("row"))[0].as_py()], "doc_ids": [of("doc_id")], "held_out": [of("held_out")],
                "sizes": [_narrow(np.concatenate([t.sizes for _, t in held]))], "kinds": [kinds[often].astype("<u8").tobytes()], "ids": [_narrow(rank[ids])],
            }
            return pa.RecordBatch.from_pydict(row, schema=made)

        held, size = [], 0
        for batch, texts in _pieces(batches):
            held.append((batch.select(["row", "doc_id", "held_out"]), Tokens(texts, 1)))
            size += len(held[-1][1].ids)
            if size >= block_tokens:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    made = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("kinds", pa.binary()), ("ids", pa.binary())])

    def opened(row: dict) -> Tokens:
        ids, sizes = (_wide(row[c]).astype(np.int64) for c in ("ids", "sizes"))
        return Tokens.again(np.frombuffer(row["kinds"], "<u8"), ids, sizes, order)

    def questions(t: Tokens) -> Iterator[tuple[int, np.ndarray]]:
        """(n, ascending keys): each n-gram of the block once."""
        yield 1, np.sort(t.kinds)
        for n, (key, valid) in enumerate(zip(t.grams[1:], t.valid[1:]), 2):
            key = np.sort(key[valid])
            yield n, key[np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            for n, keys in questions(opened(row)):
                _, packed = _to_segments(keys, segments)
                yield pa.RecordBatch.from_arrays([
                    pa.array([seg for seg, *_ in packed], pa.int32()), pa.array(np.full(len(packed), row["block"], np.int64)),
                    pa.array(np.full(len(packed), n, np.int8)), pa.array([p for *_, p in packed], pa.binary()),
                ], ["segment", "block", "n", "keys"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers() -> pa.RecordBatch:
            sizes = np.array([len(k) for *_, k in held])
            keys, single = np.concatenate([k for *_, k in held]), np.repeat([n == 1 for _, n, _ in held], sizes)
            level, many = here.levels(keys) if here else np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            if len(words):
                spot = np.minimum(np.searchsorted(words, keys[single]), len(words) - 1)
                many[single] = np.where(words[spot] == keys[single], exact[spot], 0)
            ends = np.cumsum(sizes)
            parts = [slice(e - k, e) for e, k in zip(ends, sizes)]
            return pa.RecordBatch.from_arrays([
                pa.array([block for block, *_ in held], pa.int64()), pa.array([at] * len(held), pa.int32()), pa.array([n for _, n, _ in held], pa.int8()),
                pa.array([_narrow(level[p]) for p in parts], pa.binary()), pa.array([_narrow(many[p]) if n == 1 else b"" for p, (_, n, _) in zip(parts, held)], pa.binary()),
            ], ["block", "segment", "n", "levels", "counts"])

        at, here, words, exact = None, None, None, None
        for batch in batches:
            seg = batch.column(0).to_numpy()
            block, kind, keys = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for a, b in _stretches(seg):
                if at != seg[a]:
                    at, here, words, exact = int(seg[a]), None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                held, size = [], 0
                for k in range(a, b):
                    if block[k] < 0:  # the segment itself comes first
                        bits, bit_count, words, exact = (batch.column(c)[k].as_py() for c in range(4, 8))
                        here = Segments(np.frombuffer(bits, np.uint8), np.zeros(1, np.uint64), np.array([bit_count], np.uint64))
                        words, exact = np.frombuffer(words, "<u8"), np.frombuffer(exact, "<i8")
                        continue
                    held.append((block[k], kind[k], _from_segment(keys[k], at, segments)))
                    size += len(held[-1][2])
                    if size > 500_000:
                        yield answers()
                        held, size = [], 0
                if held:
                    yield answers()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            t, got = opened(row), sorted(row["answers"], key=lambda a: (a["n"], a["segment"]))
            level, exact = {}, None
            for n, keys in questions(t):
                by_segment, _ = _to_segments(keys, segments)
                back = np.empty(len(keys), np.int64)
                back[by_segment] = np.concatenate([_wide(a["levels"]) for a in got if a["n"] == n] or [[]])
                level[n] = back
                if n == 1:
                    exact = np.empty(len(keys), np.int64)
                    exact[by_segment] = np.concatenate([_wide(a["counts"]) for a in got if a["n"] == 1])
            place = np.empty(len(t.kinds), np.int64)  # of each word among the ascending ones
            place[np.argsort(t.kinds)] = np.arange(len(t.kinds))
            level[1], exact = level[1][place], exact[place]
            base = t.per_text(np.where(t.real, (np.log10(exact + 1.0) - whole)[t.ids], 0.0))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(t.sizes - 1), pa.array(t.per_text((t.real & (exact > 0)[t.ids]).astype(np.int64))),
                pa.array(base), pa.array(t.log_probability(lambda n, keys: level[n], total, vocabulary)),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    name = f"token_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.mapInArrow(encoded, BLOCK).write.bucketBy(buckets, "block").option("path", fresh_path(spark, "token-blocks"))
    writer.option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asks = blocks.mapInArrow(asked, "segment int, block bigint, n tinyint, keys binary")
    heads = model.table.select("segment", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("tinyint").alias("n"), none("binary", "keys"), "bits", "size", "words", "word_counts")
    both = asks.select("*", none("binary", "bits"), none("bigint", "size"), none("binary", "words"), none("binary", "word_counts")).unionByName(heads)
    answers = both.repartition("segment").sortWithinPartitions("segment", "block").mapInArrow(answered, "block bigint, segment int, n tinyint, levels binary, counts binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("n", "segment", "levels", "counts")).alias("answers"))
    with shuffles_dropped(spark):
        out = blocks.join(answers, "block").mapInArrow(told, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
        out = stored(out, "scored-texts")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """[a, b) of equal neighbours."""
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)]
    return zip(edge.tolist(), np.r_[edge[1:], len(values)].astype(int).tolist())
