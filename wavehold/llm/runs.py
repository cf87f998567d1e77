"""Runs of repeated words, found in a Re-Pair grammar of the word ids."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, runs_sha256 string, collapsed_sha256 string"
)
PRIMES = (2_147_483_629, 2_147_483_587)


def planted(words: np.ndarray, h: int) -> np.ndarray:
    """Word numbers of a text whose hash `h` asks for a repeated tail, in the order they take."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i < a, i, a + (i - a) % p)]


class _Rules:
    """Nonterminals of one round of Re-Pair: where each occurs, and its first place as (start, mid, stop)."""

    def __init__(self, starts: np.ndarray, rule: np.ndarray, first: np.ndarray, mid: np.ndarray, stop: np.ndarray):
        order = np.argsort(rule, kind="stable")
        self.starts, self.at = starts[order], np.searchsorted(rule[order], np.arange(len(first) + 1))
        self.first, self.mid, self.stop = first, mid, stop


def re_pair(words: np.ndarray, ends: np.ndarray) -> tuple[list[_Rules], np.ndarray, np.ndarray]:
    """Grammar of texts that lie one after another in `words`, each up to its place in `ends`.

    The most frequent pairs are replaced first. Pairs that touch no more frequent pair do not wait
    for each other: one round replaces them all, wherever they occur twice or more without overlap,
    and the next round counts anew, until no pair occurs twice. Returns the rules, round by round,
    and what is left of the texts: the start of each symbol, and the text that it is in.
    """
    n = len(words)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    symbol, start = words.astype(np.int64), np.arange(n)
    fresh, rounds = int(words.max(initial=-1)) + 1, []
    while len(symbol) > 1:
        k = len(symbol)
        key = symbol[:-1] * fresh + symbol[1:]
        key[text[:-1] != text[1:]] = -1
        # in aaaa only every other pair counts
        same = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        odd = (np.arange(k - 1) - np.repeat(same, np.diff(np.r_[same, k - 1]))) & 1
        place = np.flatnonzero((odd == 0) & (key >= 0))
        kinds, of, count = np.unique(key[place], return_inverse=True, return_counts=True)
        rank = np.zeros(k + 1, np.int64)  # of the pair at each place, shifted by one; 0: none that repeats
        order = np.empty(len(kinds), np.int64)
        order[np.argsort(count, kind="stable")] = np.arange(1, len(kinds) + 1)
        order[count < 2] = 0
        rank[place + 1] = order[of]
        here = rank[1:-1]
        chosen = np.flatnonzero((here > 0) & (here >= rank[:-2]) & (here >= rank[2:]))
        if not len(chosen):
            break
        names, rule, uses = np.unique(here[chosen], return_inverse=True, return_counts=True)
        keep = uses[rule] > 1
        chosen, rule = chosen[keep], rule[keep]
        if not len(chosen):
            break
        names, first, rule = np.unique(rule, return_index=True, return_inverse=True)
        after = np.r_[start[1:], n]
        after[np.flatnonzero(text[:-1] != text[1:])] = ends[text[:-1][text[:-1] != text[1:]]]
        after[-1] = ends[-1]
        at = chosen[first]
        rounds.append(_Rules(start[chosen], rule, start[at], start[at + 1], after[at + 1]))
        symbol[chosen] = fresh + rule
        fresh += len(names)
        left = np.ones(k, bool)
        left[chosen + 1] = False
        symbol, start, text = symbol[left], start[left], text[left]
        if fresh > 1 << 31:  # keys of two symbols must fit in 63 bits
            break
    return rounds, start, text


class _Words:
    """Words of several texts: earlier and later places of a word, and equality of stretches by two prefix hashes."""

    def __init__(self, words: np.ndarray, seed: int = 7):
        self.n = n = len(words)
        self.words = words
        self.order = np.argsort(words, kind="stable")
        self.spot = np.empty(n, np.int64)
        self.spot[self.order] = np.arange(n)
        self.sorted = words[self.order] * n + self.order
        rng = np.random.default_rng(seed)
        self.power, self.sums = [], []
        for p in PRIMES:
            base, code = int(rng.integers(1 << 20, p)), rng.integers(1, p, int(words.max(initial=0)) + 1).astype(np.uint64)
            power = np.ones(n + 1, np.uint64)
            size = 1
            while size <= n:  # doubling
                more = power[: min(size, n + 1 - size)]
                power[size : size + len(more)] = more * np.uint64(pow(base, size, p)) % np.uint64(p)
                size *= 2
            terms = code[words] * power[:n] % np.uint64(p)
            self.power.append(power)
            self.sums.append(np.r_[np.uint64(0), np.cumsum(terms) % np.uint64(p)])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` words from a and from b > a agree."""
        out = np.ones(len(a), bool)
        for p, power, sums in zip(PRIMES, self.power, self.sums):
            p = np.uint64(p)
            x, y = (sums[a + size] + p - sums[a]) % p, (sums[b + size] + p - sums[b]) % p
            out &= x * power[b - a] % p == y
        return out

    def same_before(self, at: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, distance) of all earlier places of the word at each place, up to `far` words away."""
        low = np.searchsorted(self.sorted, self.words[at] * self.n + np.maximum(at - far, 0))
        many = self.spot[at] - low
        row = np.repeat(np.arange(len(at)), many)
        return row, at[row] - self.order[np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(row))]

    def same_after(self, at: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = np.searchsorted(self.sorted, self.words[at] * self.n + np.minimum(at + far, self.n - 1), side="right")
        many = high - self.spot[at] - 1
        row = np.repeat(np.arange(len(at)), many)
        return row, self.order[np.repeat(self.spot[at] + 1 - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(row))] - at[row]

    def extent(self, low: np.ndarray, high: np.ndarray, q: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of period q around [low, high), which has it, inside [s, e): by bisection."""
        a, b = np.zeros_like(low), low - s
        while (open_ := a < b).any():
            mid = (a + b + 1) // 2
            ok = self.equal(low - mid, low - mid + q, mid)
            a, b = np.where(open_ & ok, mid, a), np.where(open_ & ~ok, mid - 1, b)
        left = low - a
        a, b = np.zeros_like(high), e - high
        while (open_ := a < b).any():
            mid = (a + b + 1) // 2
            ok = self.equal(high - q, high, mid)
            a, b = np.where(open_ & ok, mid, a), np.where(open_ & ~ok, mid - 1, b)
        return left, high + a


def crossing(w: _Words, s: np.ndarray, b: np.ndarray, e: np.ndarray, step: int = 1 << 15) -> tuple[np.ndarray, ...]:
    """(node, start, stop, period) of runs across the inner boundary b of nodes [s, e), as far as the node reaches.

    A run of four periods has two of them on one side of the boundary: a square that ends or begins
    there. Its halves begin with equal words, so only distances of equal words are tried.
    """
    found = []
    wide = np.flatnonzero(e - s >= 6)
    for k in range(0, len(wide), step):
        node = wide[k : k + step]
        S, B, E = s[node], b[node], e[node]
        row, q = w.same_before(B - 1, (B - S) // 2)
        ok = w.equal(B[row] - 2 * q, B[row] - q, q)
        row, q = row[ok], q[ok]
        parts = [(row, B[row] - 2 * q, B[row], q)]
        row, q = w.same_after(B, (E - B) // 2)
        ok = w.equal(B[row], B[row] + q, q)
        row, q = row[ok], q[ok]
        parts.append((row, B[row], B[row] + 2 * q, q))
        row, low, high, q = (np.concatenate(x) for x in zip(*parts))
        low, high = w.extent(low, high, q, S[row], E[row])
        ok = (high - low >= np.maximum(6, 4 * q)) & (low < B[row]) & (high > B[row])
        found.append((node[row[ok]], low[ok], high[ok], q[ok]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    node, low, high, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, high, low, node))  # of one stretch the smallest period
    node, low, high, q = node[order], low[order], high[order], q[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(node)]
    return node[new], low[new], high[new], q[new]


def maximal(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the stretches those that lie in no other of their period; of equal ones that with the smallest period."""
    order = np.lexsort((-high, low, q))
    low, high, q = low[order], high[order], q[order]
    reach = np.maximum.accumulate(high + q * (int(high.max(initial=0)) + 1))  # of this period so far
    inside = np.r_[False, (reach[:-1] >= (high + q * (int(high.max(initial=0)) + 1))[1:])][: len(low)]
    low, high, q = low[~inside], high[~inside], q[~inside]
    order = np.lexsort((q, high, low))
    low, high, q = low[order], high[order], q[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(low)]
    return low[new], high[new], q[new]


def text_runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of texts that lie one after another, by start, then period."""
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, none
    rounds, start, text = re_pair(words, ends)
    w = _Words(words)
    found = []
    for rules in rounds:
        node, low, high, q = crossing(w, rules.first, rules.mid, rules.stop)
        many = rules.at[node + 1] - rules.at[node]  # translated to every place where the rule is used
        pick = np.repeat(rules.at[node] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        shift = rules.starts[pick] - np.repeat(rules.first[node], many)
        found.append((np.repeat(low, many) + shift, np.repeat(high, many) + shift, np.repeat(q, many)))
    # the start rule of each text, as a balanced tree over its symbols
    while len(start) > 1:
        head = np.r_[True, text[1:] != text[:-1]]
        turn = np.arange(len(start)) - np.maximum.accumulate(np.where(head, np.arange(len(start)), 0))
        left = np.flatnonzero((turn[:-1] % 2 == 0) & ~head[1:])
        if not len(left):
            break
        after = np.where(np.r_[head[1:], True], ends[text], np.r_[start[1:], 0])
        _, low, high, q = crossing(w, start[left], start[left + 1], after[left + 1])
        found.append((low, high, q))
        start, text = start[turn % 2 == 0], text[turn % 2 == 0]
    low, high, q = maximal(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 3
    for a, b, p in zip(low.tolist(), high.tolist(), q.tolist()):  # the hashes only propose
        if not np.array_equal(words[a : b - p], words[a + p : b]):
            raise ArithmeticError(f"stretches with equal hashes differ at word {a}")
    order = np.lexsort((q, low))
    return low[order], high[order], q[order]


def _report(texts: list[list[bytes]], hashes: list[int] | None) -> list[dict]:
    """One record per text."""
    known: dict[bytes, int] = {}
    ids = []
    for k, t in enumerate(texts):
        one = np.array([known.setdefault(x, len(known)) for x in t], np.int64)
        ids.append(planted(one, hashes[k]) if hashes else one)
    words = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    ends = np.cumsum([len(x) for x in ids])
    low, high, q = text_runs(words, ends)
    at = np.searchsorted(low, np.r_[0, ends])
    spell, out = list(known), []
    for k, one in enumerate(ids):
        off = int(ends[k]) - len(one)
        runs = [(int(a) - off, int(b - a), int(p)) for a, b, p in zip(*(x[at[k] : at[k + 1]] for x in (low, high, q)))]
        if runs:
            stays = np.ones(len(one), bool)
            for a, size, p in runs:
                stays[a + p : a + size] = False
            kept = [spell[i] for i in one[stays].tolist()]
        else:
            kept = texts[k] if not hashes or hashes[k] % 10 else [spell[i] for i in one.tolist()]
        best = None
        for r in runs:  # greatest length / period, compared exactly; runs come by start, then period
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        out.append({
            "n_words": len(one), "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2], "runs": [dict(zip(("start", "length", "period"), r)) for r in runs],
            "runs_sha256": sha256("".join(f"{a},{b},{p}\n" for a, b, p in runs).encode()).hexdigest(),
            "collapsed_sha256": sha256(b" ".join(kept)).hexdigest(),
        })
    return out


def repeated_runs(df: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text", words_at_once: int = 300_000) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, runs_sha256, collapsed_sha256), one row per row of `df`.

    A run is a stretch of words with smallest period q, at least 6 words and 4 periods long, that
    cannot be made longer with that period. start, length and period are those of the run with the
    greatest length / period (ties: smallest start, then period), null without runs. `runs` lists all
    by start, then period; the first hash is of their lines, the second of the words that stay when
    each run keeps its first period only.

    Texts of about `words_at_once` words share one Re-Pair grammar; a longer text has its own and is
    never cut. Runs across the boundary inside a nonterminal are sought once, at its first place, and
    moved to the others. With `plant`, an id whose CRC-32 is a multiple of 10 has part of its words
    replaced by repeats first (`planted`). Null and empty texts have no words and no runs; a null id
    is never planted. Repeated rows each give a row; other columns are not read. An empty table gives
    no rows.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            rows = [{"doc_id": d} | r for d, r in zip(docs, _report(texts, hashes if plant else None), strict=True)]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        docs, hashes, texts, held = [], [], [], 0
        for batch in batches:
            for d, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = t.split()  # bytes: exactly the six ASCII white characters
                if texts and held + len(words) > words_at_once:
                    yield flush()
                    docs, hashes, texts, held = [], [], [], 0
                docs.append(d)
                hashes.append(h)
                texts.append(words)
                held += len(words)
        if texts:
            yield flush()

    crc = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(1))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), crc.alias("h"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(scan, SCHEMA)
