"""Counter-keyed draws computed beside the rows: permutations of positions, and resamples in blocks.

Both need only a row's position in its group and the group's size, so any task can work out all
draws of its own rows, in any order, and only sums leave it.
"""

from __future__ import annotations

import hashlib

import numpy as np

M32 = np.uint64(0xFFFFFFFF)
BLOCK = 4096  # positions of a resample that are drawn together
STEP = 0x9E3779B9


def keyed(seed: int, group: tuple, draws: range, *last) -> np.ndarray:
    """32 bits for each draw: md5 of seed, group, draw and what else names the use."""
    head, tail = "".join(f"{x}|" for x in (seed, *group)), "".join(f"|{x}" for x in last)
    return np.array([int(hashlib.md5(f"{head}{b}{tail}".encode()).hexdigest()[:8], 16) for b in draws], np.uint64)


def rounds_for(n: int) -> int:
    return 24 + 4 * int(n).bit_length()


def round_keys(seed: int, group: tuple, draws: range, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rounds, draws) mirrors below n, and keys of the coins."""
    both = [np.stack([keyed(seed, group, draws, r, use) for r in range(rounds_for(n))]) for use in ("mirror", "coin")]
    return both[0] * np.uint64(n) >> np.uint64(32), both[1]


def permuted(keys: tuple[np.ndarray, np.ndarray], position: np.ndarray, n: int) -> np.ndarray:
    """(draws, rows): where each draw's permutation of [0, n) puts each position.

    Swap-or-not: each round mirrors the positions at a random place and tosses one coin for each
    mirrored pair, whether it changes places. So it is one to one, whatever n is.
    """
    draws = keys[0].shape[1]
    v = np.broadcast_to(position.astype(np.uint64), (draws, len(position))).copy()
    n = np.uint64(n)
    for mirror, coin in zip(*keys):
        other = (mirror[:, None] + n - v) % n
        t = (np.maximum(v, other) * np.uint64(STEP) + coin[:, None]) & M32
        v = np.where((t * t) >> np.uint64(31) & np.uint64(1) == 1, other, v)
    return v.astype(np.int64)


def mix32(x: np.ndarray) -> np.ndarray:
    """Even spread of 32-bit counters."""
    x = x & M32
    x = (x ^ x >> np.uint64(16)) * np.uint64(0x85EBCA6B) & M32
    x = (x ^ x >> np.uint64(13)) * np.uint64(0xC2B2AE35) & M32
    return x ^ x >> np.uint64(16)


def block_counts(seed: int, group: tuple, n: int, block: int, draws: int) -> np.ndarray:
    """How many of a draw's n slots fall in a block, for all draws: down a tree of binomial splits.

    A node's generator is keyed by the node, so every block sees the same splits above it.
    """
    counts, low, high = np.full(draws, n, np.int64), 0, -(-n // BLOCK)
    while high - low > 1:
        mid = (low + high) // 2
        whole, left = min(n, high * BLOCK) - low * BLOCK, (mid - low) * BLOCK
        name = "|".join(str(x) for x in (seed, *group, low, high))
        rng = np.random.Generator(np.random.Philox(key=int(hashlib.md5(name.encode()).hexdigest(), 16)))
        taken = rng.binomial(counts, left / whole)
        counts, low, high = (taken, low, mid) if block < mid else (counts - taken, mid, high)
    return counts


def slots(base: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(draw, position in the block) of every slot that falls in a block of `size` rows."""
    draw = np.repeat(np.arange(len(base)), counts)
    slot = np.arange(len(draw)) - np.repeat(np.cumsum(counts) - counts, counts)
    x = mix32(base[draw] + slot.astype(np.uint64) * np.uint64(STEP))
    return draw, (x * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def slot_cells(base: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """draw * size + position of every slot, as `slots` deals them, in 32-bit arithmetic that wraps by itself."""
    steps = np.uint32(STEP)
    with np.errstate(over="ignore"):
        first = base.astype(np.uint32) - (np.cumsum(counts) - counts).astype(np.uint32) * steps
        x = np.repeat(first, counts)
        x += np.arange(len(x), dtype=np.uint32) * steps
    # mix32, in place
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    if size & (size - 1) == 0:
        cell = (x >> np.uint32(33 - size.bit_length())).astype(np.int64) if size > 1 else np.zeros(len(x), np.int64)
    else:
        wide = x.astype(np.uint64)
        wide *= np.uint64(size)
        wide >>= np.uint64(32)
        cell = wide.view(np.int64)
    cell += np.repeat(np.arange(len(base)) * size, counts)
    return cell


def resampled(seed: int, group: tuple, n: int, block: int, draws: int, values: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """(draws, columns): sums over each draw's slots in a block of the rows' values (rows, columns).

    So few draws at a time that the slots stay in a core's cache.
    """
    counts, out = block_counts(seed, group, n, block, draws), np.zeros((draws, values.shape[1]))
    bases, size = keyed(seed, group, range(draws), block), len(values)
    step = max(1, at_once // max(1, int(counts.max(initial=1)), size))
    for k in range(0, draws, step):
        some = slice(k, min(draws, k + step))
        cell = slot_cells(bases[some], counts[some], size)
        times = np.bincount(cell, minlength=(some.stop - k) * size).reshape(some.stop - k, size)
        out[some] = times.astype(np.float64) @ values
    return out


# ---- the same in DuckDB's SQL, for groups of one block ----


def sql_base(seed: str, group: list[str], draw: str, *last: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join([seed, *group, draw, *last])})), 1, 8))::UBIGINT"


def sql_slots(source: str, group: list[str], seed: str, draws: int, out: str, part: tuple = ()) -> str:
    """`out`(part, group, draw, loc): position of each slot; `source` has (part, group, sz) with sz up to BLOCK.

    Only `group` keys the draws, so parts with equal groups are resampled alike.
    """
    head = "".join(f"{c}, " for c in (*part, *group))
    m = 4294967295
    return f""", {out}_a AS (SELECT {head}sz, draw, {sql_base(seed, group, 'draw', '0')} AS base FROM {source}, range({draws}) d(draw)),
 {out}_b AS (SELECT {head}sz, draw, (base + slot * {STEP}) & {m} AS x FROM {out}_a, LATERAL (SELECT unnest(range(sz))::UBIGINT AS slot)),
 {out}_c AS (SELECT {head}sz, draw, (xor(x, x >> 16) * {0x85EBCA6B}) & {m} AS x FROM {out}_b),
 {out}_d AS (SELECT {head}sz, draw, (xor(x, x >> 13) * {0xC2B2AE35}) & {m} AS x FROM {out}_c),
 {out} AS (SELECT {head}draw, CAST((xor(x, x >> 16) * sz::UBIGINT) >> 32 AS BIGINT) AS loc FROM {out}_d)"""


def sql_permuted(source: str, group: list[str], seed: str, draws: int, out: str) -> str:
    """`out`(group, draw, pos, moved) for every position of `source`(group, pos, n)."""
    g = ", ".join(group)
    other = "((key[1] + n_ - acc[1]) % n_)"
    t = f"((greatest(acc[1], {other}) * {STEP} + key[2]) & 4294967295)"
    key = lambda use: sql_base(seed, group, "draw", "r", f"'{use}'")
    return f""", {out}_h AS (SELECT DISTINCT {g}, n::UBIGINT AS n_ FROM {source}),
 {out}_k AS (SELECT {g}, n_, draw, list([({key('mirror')} * n_) >> 32, {key('coin')}] ORDER BY r) AS keys
  FROM {out}_h, range({draws}) d(draw), LATERAL (SELECT unnest(range(24 + 4 * CAST(floor(log2(n_)) + 1 AS BIGINT))) AS r) GROUP BY ALL),
 {out} AS (SELECT {g}, draw, pos, CAST(list_reduce(list_prepend([pos::UBIGINT], k.keys),
  lambda acc, key: [CASE WHEN (({t} * {t}) >> 31) & 1 = 1 THEN {other} ELSE acc[1] END])[1] AS BIGINT) AS moved FROM {source} s JOIN {out}_k k USING ({g}))"""
