"""Window table -> feature table.

Array maths runs on Arrow batches inside one narrow ``mapInArrow`` stage: no shuffle, and
each distinct raw map is computed once per window however many configurations use it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import kernels as k


SAMPLES = 1 << 18


def batch_signal(batch: pa.RecordBatch, i: str = "i", q: str | None = "q"):
    """Yield (row indexes, complex matrix) per window length in an Arrow batch.

    Pieces hold at most ``SAMPLES`` samples, so a kernel's working set does not depend on the
    session's Arrow batch size.
    """
    names = batch.schema.names
    real = batch.column(names.index(i))
    lengths = np.asarray(real.value_lengths())
    has_q = q in names and batch.column(names.index(q)).null_count < len(batch)
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        step = max(1, SAMPLES // int(length))
        for first in range(0, len(same), step):
            rows = same[first : first + step]
            take = pa.array(rows)

            def dense(column):
                flat = batch.column(names.index(column)).take(take).flatten()
                return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(length))

            x = dense(i)
            yield rows, x + 1j * dense(q) if has_q else x.astype(complex)


def list_column(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values.reshape(len(values), -1), dtype=np.float64)
    size = flat.shape[1]
    offsets = np.arange(0, len(flat) * size + 1, size, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))


def map_windows(
    windows: DataFrame,
    keep: list[str],
    families: dict[str, Callable[[np.ndarray], np.ndarray]],
    i: str = "i",
    q: str | None = "q",
) -> DataFrame:
    """One row per window and family: ``keep``, family, values (row-major)."""
    used = [*keep, i] + ([q] if q and q in windows.columns else [])
    source = windows.select(*used)
    kept_fields = [source.schema[name] for name in keep]
    schema = source.select(*keep).schema.add("family", "string").add("values", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, x in batch_signal(batch, i, q):
                base = [batch.column(batch.schema.names.index(f.name)).take(pa.array(rows)) for f in kept_fields]
                for family, kernel in families.items():
                    columns = [*base, pa.array([family] * len(rows)), list_column(kernel(x))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "family", "values"])

    return source.mapInArrow(run, schema)


def nested_column(maps: list[np.ndarray]) -> pa.Array:
    """One list of flattened maps per row."""
    flat = np.concatenate([m.reshape(len(m), -1) for m in maps], axis=1).astype(np.float64)
    sizes = [m[0].size for m in maps]
    inner = np.arange(len(flat))[:, None] * flat.shape[1] + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inner = pa.ListArray.from_arrays(pa.array(np.append(inner.ravel(), flat.size).astype(np.int32)), pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, len(maps), dtype=np.int32)), inner)


def map_bank(windows: DataFrame, keep: list[str], families: dict[str, Callable[[np.ndarray], np.ndarray]], i: str = "i", q: str = "q") -> DataFrame:
    """One row per window: ``keep``, maps (in the order of ``families``). All maps of a window stay together."""
    source = windows.select(*keep, i, q)
    schema = source.select(*keep).schema.add("maps", T.ArrayType(T.ArrayType(T.DoubleType())))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, x in batch_signal(batch, i, q):
                base = [batch.column(batch.schema.names.index(name)).take(pa.array(rows)) for name in keep]
                yield pa.RecordBatch.from_arrays([*base, nested_column([kernel(x) for kernel in families.values()])], names=[*keep, "maps"])

    return source.mapInArrow(run, schema)


def long_values(features: DataFrame, keep: list[str]) -> DataFrame:
    return features.select(*keep, "family", F.posexplode("values").alias("pos", "value"))


# JVM forms of the cheap per-sample maps.


def real_imag(windows: DataFrame) -> DataFrame:
    return windows.withColumn("channel_0", F.col("i")).withColumn("channel_1", F.col("q"))


def magnitude_phase(windows: DataFrame) -> DataFrame:
    """log1p magnitude and phase over pi."""
    size = F.zip_with("i", "q", lambda a, b: F.log1p(F.hypot(a.cast("double"), b.cast("double"))))
    turn = F.zip_with("i", "q", lambda a, b: F.atan2(b.cast("double"), a.cast("double")) / np.pi)
    return windows.withColumn("channel_0", size).withColumn("channel_1", turn)


def frame_energy(i: str, q: str, frame: int, hop: int) -> Column:
    """Mean power of each frame, as an array."""
    return F.expr(
        f"transform(sequence(0, size({i}) - {frame}, {hop}), s -> aggregate(zip_with(slice({i}, s + 1, {frame}), "
        f"slice({q}, s + 1, {frame}), (a, b) -> cast(a as double) * a + cast(b as double) * b), 0.0D, (t, p) -> t + p) / {frame})"
    )


def zigzag_rank(row: Column, column: Column, size: int) -> Column:
    """0-based zigzag position of a cell of a size x size grid, in closed form."""
    d = row + column
    before = F.when(d < size, d * (d + 1) / 2).otherwise(
        size * size - (2 * size - 1 - d) * (2 * size - d) / 2
    )
    low = F.greatest(F.lit(0), d - (size - 1))
    inside = F.when(d % 2 == 1, row - low).otherwise(column - low)
    return (before + inside).cast("long")


@dataclass(frozen=True)
class Config:
    """One representation; ``raw`` names the maps it needs so equal maps are shared."""

    stable_id: str
    families: str = "WC"
    bins: int = 16
    j: int = 4
    q: int = 2
    cyclic: int = 8
    frame: int = 128
    hop: int = 32
    normalization: str = "percentile"
    permuted: bool = False

    def raw(self) -> dict[str, tuple]:
        """family -> key of the raw map."""
        keys = {
            "W": ("W", self.bins, self.j, self.q),
            "C": ("C", self.bins, self.cyclic, self.permuted, self.frame, self.hop),
            "E": ("E", self.bins, self.frame, self.hop),
            "S": ("S", self.bins, self.frame, self.hop),
            "I": ("I", self.bins),
            "Q": ("Q", self.bins),
            "V": ("V", self.bins),
        }
        return {family: keys[family] for family in self.families}


def selection_bank(cyclic=(4, 8, 16), bins=(8, 16, 32), **common) -> list[Config]:
    """The 25 candidates that compete in source selection."""
    base = dict(cyclic=cyclic[1], bins=bins[1], **common)
    make = lambda name, families="WC", **own: Config(name, families, **{**base, **own})
    masks = [make(n, f) for n, f in (("W", "W"), ("C", "C"), ("W+C", "WC"), ("W+C+E", "WCE"), ("W+C+E+S", "WCES"))]
    wavelets = [make(f"wst_J{j}Q{q}", "W", j=j, q=q) for j in (3, 4, 5) for q in (1, 2, 4)]
    cyclics = [make(f"cyclic_A{a}", "C", cyclic=a) for a in cyclic]
    cyclics.append(make("cyclic_permuted", "C", permuted=True))
    norms = [make(f"norm_{n}", normalization=n) for n in ("percentile", "zscore", "none")]
    sizes = [make(f"resolution_{b}", bins=b) for b in bins]
    return [*masks, *wavelets, *cyclics, *norms, *sizes, make("STFT", "S")]


def fixed_bank(cyclic=(4, 8, 16), bins=(8, 16, 32), **common) -> list[Config]:
    """The 12 fixed members used for the instability / degradation question."""
    base = dict(cyclic=cyclic[1], bins=bins[1], **common)
    make = lambda name, families="WC", **own: Config(name, families, **{**base, **own})
    classical = [make("raw_iq", "IQ"), make("log_stft", "S"), make("cwt", "V")]
    wavelets = [make(f"wst_J{j}Q2", "W", j=j) for j in (3, 4, 5)]
    cyclics = [make(f"cyclic_A{a}", "C", cyclic=a) for a in cyclic]
    sizes = [make(f"wst_cyclic_resolution_{b}", bins=b) for b in bins]
    return [*classical, *wavelets, *cyclics, *sizes]


def raw_key(key: tuple) -> str:
    return "/".join(map(str, key))


def raw_kernel(key: tuple, alphas: dict[tuple[int, bool], list[float]]) -> Callable:
    """Kernel of one raw map; ``alphas`` gives the fitted cyclic frequencies."""
    kind, bins, *rest = key
    if kind == "W":
        return lambda x: k.scattering(x, rest[0], rest[1], bins)
    if kind == "C":
        chosen = alphas[(rest[0], rest[1])]
        return lambda x: k.coherence_map(x, chosen, bins, rest[2], rest[3])
    if kind == "E":
        return lambda x: k.energy(x, bins, *rest)
    if kind == "S":
        return lambda x: k.log_stft(x, bins, *rest)
    if kind == "V":
        return lambda x: k.cwt_frequency(x, bins)
    part = 0 if kind == "I" else 1
    return lambda x: k.raw_iq(x, bins)[:, part]


def raw_maps(windows: DataFrame, keep: list[str], configs: list[Config], alphas) -> DataFrame:
    """Every distinct raw map of a bank, once per window; ``family`` holds the map key."""
    keys = sorted({key for c in configs for key in c.raw().values()}, key=str)
    return map_windows(windows, keep, {raw_key(key): raw_kernel(key, alphas) for key in keys})


def bank_members(configs: list[Config]) -> Column:
    """Array of (config_id, member family, raw map key): explode it to fan maps out to configs."""
    return F.array(
        *[
            F.struct(F.lit(c.stable_id).alias("config_id"), F.lit(f).alias("member"), F.lit(raw_key(key)).alias("raw"))
            for c in configs
            for f, key in c.raw().items()
        ]
    )


def representation_bank(raw: DataFrame, configs: list[Config]) -> DataFrame:
    """Config rows referring to shared raw maps; the fan-out is a narrow explode."""
    wanted = F.filter(bank_members(configs), lambda m: m["raw"] == F.col("family"))
    d = raw.withColumn("_m", F.explode(wanted))
    kept = [c for c in raw.columns if c not in ("family", "values")]
    return d.select(*kept, F.col("_m.config_id").alias("config_id"), F.col("_m.member").alias("family"), "values")
