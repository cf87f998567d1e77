"""Token ids in blocks of fixed-width bits."""

from __future__ import annotations

import gc
import os
import string
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

BLOCK_SCHEMA = (
    "part int, block int, first_doc bigint, last_doc bigint, n_docs int, n_ids bigint, bits int, "
    "doc_ids binary, doc_starts binary, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """Least number of bits that tells `vocabulary` ids apart."""
    return max(1, (int(vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int, step: int = 1 << 16) -> bytes:
    """Ids one after another, `bits` bits each, low bit first. An id that needs more bits is an error."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    step -= step % 8  # whole bytes at every step's end
    parts = []
    for k in range(0, len(ids), step):
        b = np.unpackbits(ids[k : k + step].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        parts.append(np.packbits(b[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a payload; only the bytes that hold them are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    first, last = start * bits // 8, -(-stop * bits // 8)
    b = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    off = start * bits - 8 * first
    b = b[off : off + (stop - start) * bits].reshape(-1, bits)
    wide = np.zeros((len(b), 32), np.uint8)
    wide[:, :bits] = b
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _kept(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks find it warm."""
    home = sys.modules.setdefault("_wavehold_worker_state", types.ModuleType("_wavehold_worker_state"))
    return home.__dict__.setdefault(name, {})


class _WordEncoder:
    """bytes of texts -> little-endian uint32 ids, by the tokenizers library over distinct words.

    White space ends words in this tokenizer and never reaches an id, so a text's ids are those of
    its parts between ASCII white space; and a part's last marks are a word of their own after
    letters. Letters only: many such words go to the library as one text, and each ends with an id
    that marks a word's end. Other parts are encoded one by one. The ids of all remembered parts lie in
    one array; beyond twice `limit` parts only the `limit` used last are kept.
    """

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.at: dict[str, int] = {}  # part -> its place in the arrays, in that order
        self.pool, self.first, self.size, self.used = np.zeros(0, "<u4"), *(np.zeros(0, np.int64) for _ in range(3))
        self.clock = 0

    def _single(self, parts: list[str]) -> tuple[np.ndarray, list[int]]:
        ids = [e.ids for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for own in ids for i in own], "<u4"), [len(own) for own in ids]

    def _letters(self, words: list[str], joined: int = 256) -> tuple[np.ndarray, list[int]]:
        flat, sizes = [], []
        groups = [words[k : k + joined] for k in range(0, len(words), joined)]
        for some, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and stop[-1] == len(ids):
                own = np.diff(stop, prepend=0).tolist()
            else:
                ids, own = self._single(some)
            flat.append(ids)
            sizes += own
        return np.concatenate(flat), sizes

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and where each part's ids begin."""
        count = self.size[places]
        stop = np.concatenate([[0], np.cumsum(count)])
        return self.pool[np.repeat(self.first[places] - stop[:-1], count) + np.arange(stop[-1])], stop

    def _remember(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray | list[int]) -> None:
        sizes = np.asarray(sizes, np.int64)
        self.at.update(zip(parts, range(len(self.at), len(self.at) + len(parts))))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size, self.pool = np.concatenate([self.size, sizes]), np.concatenate([self.pool, ids])
        self.used = np.concatenate([self.used, np.full(len(parts), self.clock)])

    def _places(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))

    def _forget(self) -> None:
        keep = np.sort(np.argsort(self.used, kind="stable")[-self.limit :])
        parts = list(self.at)
        (self.pool, stop), self.used = self._gathered(keep), self.used[keep]
        self.at = {parts[k]: n for n, k in enumerate(keep.tolist())}
        self.first, self.size = stop[:-1], np.diff(stop)

    def learn(self, parts: list[str]) -> None:
        """Remember parts that are not remembered yet, each given once."""
        letters, rest, ended = [], [], []
        for w in parts:
            stem = w.rstrip(string.punctuation)
            if not stem.isalpha():
                rest.append(w)
            elif len(stem) == len(w):
                letters.append(w)
            else:
                ended.append((w, stem, w[len(stem) :]))
        letters += {s for _, s, _ in ended if s not in self.at}.difference(letters)
        rest += {t for _, _, t in ended if t not in self.at}.difference(rest)
        for some, encode in ((letters, self._letters), (rest, self._single)):
            for k in range(0, len(some), 8_192):
                self._remember(some[k : k + 8_192], *encode(some[k : k + 8_192]))
        if ended:
            words, *both = zip(*ended)
            ids, stop = self._gathered(np.stack([self._places(x) for x in both], axis=1).ravel())
            self._remember(list(words), ids, np.diff(stop[::2]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        flat, at = self.encode_many(texts)
        return [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one place more than texts).

        Arrow splits the texts and numbers their different parts; each of those is looked up once.
        """
        # the library looks for special tokens before it lowers letters, and so must this
        split = pc.ascii_split_whitespace(pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_string()))
        parts = split.flatten().dictionary_encode()
        seen = parts.dictionary.to_pylist()
        if len(self.at) > 2 * self.limit:
            self._forget()
        self.clock += 1
        places = self._places(seen)
        new = np.flatnonzero(places < 0).tolist()
        if new:
            some = [seen[k] for k in new]
            self.learn(some)
            places[new] = self._places(some)
        self.used[places] = self.clock
        flat, stop = self._gathered(places[parts.indices.to_numpy()])
        return flat, stop[split.offsets.to_numpy()]


def _stretches(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """[first, last) of stretches with about `most` bytes, or of one larger text."""
    first = held = 0
    for k, t in enumerate(texts, 1):
        held += len(t)
        if held >= most or k == len(texts):
            yield first, k
            first, held = k, 0


def _library_encoder(path: str, limit: int):
    state = _kept(f"words {path}")
    if not state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and the library's own threads cost more than they save
        state["encoder"] = _WordEncoder(path, limit)
    return state["encoder"].encode_many


def write_blocks(
    df: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    block_ids: int = 1 << 18, parts: int | None = None, word_limit: int = 250_000,
) -> None:
    """Encode whole texts and write their ids as bit-packed blocks under `path` (Parquet as the container).

    Documents are range-partitioned and sorted by id (nulls first); each ends with `end_id`. A block
    holds whole documents until it has `block_ids` ids, so a very long document makes one large
    block. Its row names the ids it holds, the first id position of each document (doc_starts) and
    the payload, all readable with np.frombuffer. Null and empty texts are just the end id. Rows with
    the same id stay apart, in any order. An empty table writes no block.
    """
    bits = bits_for(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _library_encoder(tokenizer, word_limit), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        block, held, pending = 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal block, held, pending
            docs, ids = [d for d, _ in pending], [x for _, own in pending for x in (own, end)]
            starts = np.concatenate([[0], np.cumsum([len(x) + 1 for _, x in pending])]).astype("<i8")
            known = [d for d in docs if d is not None]
            row = {
                "part": [part], "block": [block], "first_doc": [known[0] if known else None], "last_doc": [known[-1] if known else None],
                "n_docs": [len(docs)], "n_ids": [int(starts[-1])], "bits": [bits],
                # a null id is the least long, which also sorts first
                "doc_ids": [np.array([-(1 << 63) if d is None else d for d in docs], "<i8").tobytes()],
                "doc_starts": [starts.tobytes()], "payload": [pack(np.concatenate(ids), bits)],
            }
            block, held, pending = block + 1, 0, []
            return pa.RecordBatch.from_pydict(row, schema=schema)

        gc.disable()  # words and ids make no cycles, and looking for some among millions takes a fifth of the time
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                for k, n in _stretches(texts, 8 << 20):
                    flat, at = encoder(texts[k:n])
                    for d, a, b in zip(ids[k:n], at[:-1].tolist(), at[1:].tolist(), strict=True):
                        pending.append((d, flat[a:b]))
                        held += b - a + 1
                        if held >= block_ids:
                            yield flush()
            if pending:
                yield flush()
        finally:
            gc.enable()

    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()),
        ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.binary()), ("doc_starts", pa.binary()), ("payload", pa.binary()),
    ])
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # so that equal and null ids are spread
    rows = rows.repartitionByRange(parts, "doc_id", "tie") if parts else rows.repartitionByRange("doc_id", "tie")
    rows.sortWithinPartitions("doc_id").mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the files at `path`."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    heads = blocks.select("part", "block", "n_ids")
    # ids before a part: one row per part; before a block: inside its part
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("w"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = heads.select("part", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("b0")).join(parts, "part")
    at = cut(at.select("part", "block", (F.col("b0") + F.col("w0")).cast("long").alias("base")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                docs, starts = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_starts"], "<i8")
                crc = [zlib.crc32(unpack(r["payload"], r["bits"], a, b).tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["part"]] * len(docs), pa.int32()), pa.array([r["block"]] * len(docs), pa.int32()),
                    pa.array([None if d == -(1 << 63) else d for d in docs.tolist()], pa.int64()), pa.array(starts[:-1], pa.int64()),
                    pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64()),
                ], ["part", "block", "doc_id", "own", "n_tokens", "ids_crc32"])

    docs = blocks.select("part", "block", "bits", "doc_ids", "doc_starts", "payload").mapInArrow(
        measure, "part int, block int, doc_id bigint, own bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(at, ["part", "block"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """Random access: one document's ids. Block bounds prune the files, its offsets the payload."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for r in blocks.select("bits", "doc_ids", "doc_starts", "payload").toLocalIterator():
        at = np.flatnonzero(np.frombuffer(r["doc_ids"], "<i8") == doc_id)
        if len(at):
            starts = np.frombuffer(r["doc_starts"], "<i8")
            return unpack(bytes(r["payload"]), r["bits"], int(starts[at[0]]), int(starts[at[0] + 1]))
    return None
