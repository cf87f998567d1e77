"""Byte-level BPE with segment trees over adjacent pair ranks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .packing import _kept

# The white space and the word pattern of this kind of tokenizer.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.int64(1) << 62
FEW = 8  # rows under which a batch of trees costs more than single ones
LONGEST = 128  # pairs from which a word has a tree of its own


class Merges:
    """Vocabulary, pair ranks and word splitting of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        # printable Latin-1 bytes stand for themselves, the others for code points from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
        hidden = [b for b in range(256) if b not in set(shown)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        byte = {c: b for b, c in char.items()}
        self.first = np.array([vocab[char[b]] for b in range(256)], np.int64)
        special = {x["content"]: x["id"] for x in file.get("added_tokens", ()) if x.get("special")}
        self.special = special
        bytes_of = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t not in special}
        bytes_of |= {i: t.encode() for t, i in special.items()}
        shown_as = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.flat = np.frombuffer(b"".join(shown_as), np.uint8)
        self.size_of = np.array([len(x) for x in shown_as], np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        code = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, self.rank_of = code[order], order.astype(np.int64)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = dict(zip(code.tolist(), range(len(code)), strict=True))
        self.words = regex.compile(WORDS).findall
        spaces = [c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c)]
        self.joints = [x for c in spaces for x in (c + " ", " " + c)]
        self.space = regex.compile(f"[{SPACE}]").match
        self.parts = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda t: [t]

    def ranks(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs: rank, then position, so that the least is the leftmost lowest rank."""
        want = (a << 32) | b
        k = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        return np.where(self.codes[k] == want, (self.rank_of[k] << 32) | at, NONE)

    def one(self, word: bytes) -> list[int]:
        """Ids of one word: a segment tree in a list, three point updates a merge."""
        n = len(word)
        sym, nxt, prv = self.first[np.frombuffer(word, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(0, (n - 2).bit_length()) if n > 1 else 1
        none, rank = int(NONE), self.rank
        tree = [none] * (2 * size)
        leaf = lambda i, j: (r << 32) | i if (r := rank.get((sym[i] << 32) | sym[j])) is not None else none
        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        if size == 1:
            tree[1] = tree[size]
        while (root := tree[1]) != none:
            i, j = root & 0xFFFFFFFF, nxt[root & 0xFFFFFFFF]
            sym[i] = int(self.new[root >> 32])
            k, p = nxt[j], prv[i]
            nxt[i], sym[j] = k, -1
            changed = [(j, none), (i, leaf(i, k) if k < n else none)]
            if k < n:
                prv[k] = i
            if p >= 0:
                changed.append((p, leaf(p, i)))
            for at, value in changed:
                if at >= n - 1:
                    continue  # the last symbol starts no pair
                at += size
                tree[at] = value
                while at > 1:
                    at >>= 1
                    tree[at] = min(tree[2 * at], tree[2 * at + 1])
        return [s for s in sym if s >= 0]

    def many(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) of distinct words; words of like length share one batch of trees."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(1 << max(0, (len(w) - 2).bit_length()) if len(w) > 1 else 1, []).append(k)
        for size, at in by_size.items():
            if size >= LONGEST or len(at) < FEW:
                for k in at:
                    out[k] = np.array(self.one(words[k]), "<u4").tobytes()
                continue
            for lo in range(0, len(at), 8192):
                some = at[lo : lo + 8192]
                for k, ids in zip(some, self._batch([words[k] for k in some], size), strict=True):
                    out[k] = ids
        return out

    def _batch(self, words: list[bytes], size: int) -> list[bytes]:
        m, width = len(words), size + 1
        length = np.fromiter(map(len, words), np.int64, m)
        sym = np.full((m, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < length[:, None]
        sym[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.broadcast_to(np.arange(1, width + 2), (m, width + 1)).copy()
        prv = nxt - 2
        tree = np.full((m, 2 * size), NONE)
        paired = inside[:, 1 : size + 1]
        row, col = np.nonzero(paired)
        leaves = np.full((m, size), NONE)
        leaves[row, col] = self.ranks(sym[row, col], sym[row, col + 1], col)
        tree[:, size:] = leaves
        k = size // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root & 0xFFFFFFFF
            j = nxt[rows, i]
            made = self.new[root >> 32]
            k, p = nxt[rows, j], prv[rows, i]
            sym[rows, i], sym[rows, j], nxt[rows, i] = made, -1, k
            right, left = k < length[rows], p >= 0
            prv[rows[right], k[right]] = i[right]
            own = np.full(len(rows), NONE)
            own[right] = self.ranks(made[right], sym[rows[right], k[right]], i[right])
            before = self.ranks(sym[rows[left], p[left]], made[left], p[left])
            r = np.concatenate([rows, rows, rows[left]])
            at = np.concatenate([j, i, p[left]])
            value = np.concatenate([np.full(len(rows), NONE), own, before])
            valid = at < size
            r, at = r[valid], at[valid] + size
            tree[r, at] = value[valid]
            for _ in range(size.bit_length() - 1):
                at >>= 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
            rows = rows[tree[rows, 1] != NONE]
        live = sym >= 0
        flat, ends = sym[live].astype("<u4").tobytes(), 4 * np.cumsum(live.sum(1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def units(self, text: str) -> list[str]:
        """A text cut before single spaces that part two words; words never reach across such a cut."""
        if "\0" not in text and text[0] != " " and text[-1] != " " and not any([x in text for x in self.joints]):
            return text.replace(" ", "\0 ").split("\0")
        parts = text.split(" ")
        groups = [[parts[0]]]
        for p in parts[1:]:
            last = groups[-1][-1]
            if last and p and not self.space(last[-1]) and not self.space(p[0]):
                groups.append([p])
            else:
                groups[-1].append(p)
        return [" " * (k > 0) + " ".join(g) for k, g in enumerate(groups)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; ids outside the vocabulary give nothing, broken UTF-8 the replacement character."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.size_of))]
        size = self.size_of[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return ""
        at = np.repeat(self.start_of[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.flat[at].tobytes().decode("utf-8", "replace")


class Encoder:
    """Texts to ids; units between single spaces are encoded once and remembered.

    The memory has two generations of `limit` entries: when the young one is full it becomes the
    old one, and what is still used moves on, so that common units stay and rare ones go.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.merges, self.limit = Merges(path), limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, units: list[str]) -> None:
        split = list(map(self.merges.words, units))
        words = list({w for s in split for w in s})
        ids = dict(zip(words, self.merges.many([w.encode() for w in words]), strict=True))
        self.young.update((u, ids[s[0]] if len(s) == 1 else b"".join([ids[w] for w in s])) for u, s in zip(units, split, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special, plan, seen = self.merges.special, [], set()
        for text in texts:
            plan.append([])
            for piece in self.merges.parts(text):
                if piece in special:
                    plan[-1].append(np.array([special[piece]], "<u4").tobytes())
                elif piece:
                    units = self.merges.units(piece)
                    plan[-1].append(units)
                    seen.update(units)
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        new = seen.difference(self.young)
        old = [u for u in new if u in self.old]
        self.young.update(zip(old, map(self.old.__getitem__, old), strict=True))
        new = list(new.difference(old))
        for k in range(0, len(new), 50_000):
            self.learn(new[k : k + 50_000])
        get = self.young.__getitem__
        return [np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in doc]), "<u4") for doc in plan]


def _encoder(path: str) -> Encoder:
    state = _kept(f"bpe {path}")
    if "encoder" not in state:
        state["encoder"] = Encoder(path)
    return state["encoder"]


def _with(df: DataFrame, **fields: T.DataType) -> tuple[DataFrame, T.StructType]:
    """`df` without columns of these names, and the schema with them at the end."""
    df = df.drop(*fields)
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields.items():
        schema = schema.add(name, kind)
    return df, schema


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _mapped(df: DataFrame, schema: T.StructType, source: str, work, rows: int = 256) -> DataFrame:
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                some = batch.slice(k, rows)
                yield pa.RecordBatch.from_arrays([*some.columns, *work(some.column(at).to_pylist())], schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`df` with the ids of every whole text; null and empty texts have none.

    A special token's own string in a text is that token, as in the tokenizers library. A column
    named like the result is replaced; all others pass through. The file must lie at the same path
    on every executor. An empty table gives an empty table.
    """
    df, schema = _with(df, **{out_col: T.ArrayType(T.IntegerType())})
    return _mapped(df, schema, text_col, lambda texts: [_lists(_encoder(tokenizer).encode([t or "" for t in texts]))])


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`df` with the text of every list of ids; null lists give an empty text, null and unknown ids nothing."""
    df, schema = _with(df, **{out_col: T.StringType()})
    return _mapped(df, schema, ids_col, lambda ids: [pa.array([_encoder(tokenizer).merges.decode([i for i in x or () if i is not None]) for x in ids], pa.string())])


def encode_decode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Both in one pass over the texts."""
    df, schema = _with(df, **{ids_col: T.ArrayType(T.IntegerType()), out_col: T.StringType()})

    def both(texts):
        coder = _encoder(tokenizer)
        ids = coder.encode([t or "" for t in texts])
        return [_lists(ids), pa.array([coder.merges.decode(x) for x in ids], pa.string())]

    return _mapped(df, schema, text_col, both)
