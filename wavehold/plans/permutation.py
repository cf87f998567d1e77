"""Ridge probes refitted on permuted labels, by the thousand.

Features never move for a draw: labels of all draws are worked out beside the rows from their
positions, and per-task sums of them leave. A fit on fixed rows has one Gram matrix per key,
factorised once for a chunk of draws; only the right-hand sides change.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..operators.probe import centred
from ..session import cut
from .draws import permuted, round_keys
from .ranking import blocked_row_number, text_block

CHUNK = 256  # draws that are solved and scored together
FLUSH = 16 << 20  # doubles held by one task before partial sums are emitted
SEEN = 8 << 20  # bytes of feature vectors that meet the weights in one task
ROWS = 2048  # recordings of a probe that are ranked together


def _positions(rows: DataFrame, keys: list[str], block: Column | None) -> DataFrame:
    """Adds _pos (from 0, by recording id), _n and _upto (class, rows up to and with it)."""
    placed = blocked_row_number(rows, keys, ["recording_id"], text_block(rows, "recording_id") if block is None else block, "_pos")
    sizes = rows.groupBy(*keys, "cls").agg(F.count("*").alias("n"))
    packed = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("_c"), F.sum("n").alias("_n"))
    packed = packed.select(*keys, "_n", F.expr("transform(_c, x -> x.cls)").alias("_cls"), F.expr(
        "transform(_c, (x, k) -> aggregate(slice(_c, 1, k + 1), 0L, (t, y) -> t + y.n))").alias("_upto"))
    return placed.withColumn("_pos", F.col("_pos") - 1).join(packed, keys)


def _labels(seed: int, key: tuple, draws: range, pdf: pd.DataFrame) -> np.ndarray:
    """(draws, rows) class of each row in each draw; class counts stay."""
    first = pdf.iloc[0]
    n = int(first["_n"])
    moved = permuted(round_keys(seed, key, draws, n), pdf["_pos"].to_numpy(np.int64), n)
    return np.asarray(first["_cls"])[np.searchsorted(np.asarray(first["_upto"]), moved, side="right")]


def _chunks(draws: int) -> list[range]:
    return [range(k, min(draws, k + CHUNK)) for k in range(0, draws, CHUNK)]


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _key_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys])


def _sums(rows: DataFrame, keys: list[str], classes: int, draws: int, seed: int) -> DataFrame:
    """(keys, chunk, r, sums): row r of [x 1]'Y over a chunk's draws; chunk -1 holds [x 1]'[x 1], -2 the true labels' Y."""
    schema = _key_schema(rows, keys).add("chunk", T.IntegerType()).add("r", T.IntegerType()).add("sums", T.ArrayType(T.DoubleType()))

    def run(frames):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for (key, chunk), total in held.items():
                out = pd.DataFrame({"chunk": np.int32(chunk), "r": np.arange(len(total), dtype=np.int32), "sums": list(total)})
                yield out.assign(**dict(zip(keys, key)))[[*keys, "chunk", "r", "sums"]]
            held.clear()

        for frame in frames:
            for key, pdf in frame.groupby(keys, sort=False):
                x = _stack(pdf["values"]) - _stack(pdf["_m"])
                z = np.column_stack([x, np.ones(len(x))])
                hot = lambda labels: (labels[..., None] == np.arange(classes)).astype(np.float64)
                parts = {-1: z.T @ z, -2: z.T @ hot(pdf["cls"].to_numpy())}
                for chunk, some in enumerate(_chunks(draws)):
                    y = hot(_labels(seed, key, some, pdf))  # draws, rows, classes
                    parts[chunk] = np.einsum("rd,brc->dbc", z, y, optimize=True).reshape(z.shape[1], -1)
                for chunk, part in parts.items():
                    at = (key, chunk)
                    held[at] = held[at] + part if at in held else part
                if sum(t.size for t in held.values()) > FLUSH:
                    yield from flush()
        yield from flush()

    partial = rows.select(*keys, "cls", "values", "_m", "_pos", "_n", "_cls", "_upto").mapInPandas(run, schema)
    total = partial.withColumn("_v", array_to_vector("sums")).groupBy(*keys, "chunk", "r")
    return total.agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("sums"))


def _solved(gram: np.ndarray, target: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(scale, weights) of centred sums; the last row of the weights is the intercept."""
    d = len(gram) - 1
    n = gram[d, d]
    scale = np.maximum(np.sqrt(np.maximum(np.diag(gram)[:d] / n, 0.0)), 1e-6)
    lhs = gram[:d, :d] / scale[:, None] / scale + l2 * np.eye(d)
    weights = np.linalg.solve(lhs, target[:d] / scale[:, None])
    return scale, np.vstack([weights, target[d] / (n + l2)])


def permuted_fits(fit_rows: DataFrame, keys: list[str], classes: int, draws: int, seed: int, l2: float, block: Column | None = None) -> DataFrame:
    """(keys, chunk, mean, scale, weights) of ridge probes on `draws` permutations of each key's labels; chunk -2 is the true fit."""
    rows, _ = centred(_positions(fit_rows, keys, block), keys)
    sums = cut(_sums(rows, keys, classes, draws, seed))
    gram = sums.where("chunk = -1").select(*keys, "r", F.col("sums").alias("gram"))
    mean = rows.groupBy(*keys).agg(F.first("_m").alias("mean"))
    schema = _key_schema(rows, keys).add("chunk", T.IntegerType()).add("mean", T.ArrayType(T.DoubleType()))
    schema = schema.add("scale", T.ArrayType(T.DoubleType())).add("weights", T.ArrayType(T.DoubleType()))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        scale, weights = _solved(_stack(pdf["gram"]), _stack(pdf["sums"]), l2)
        out = pdf.iloc[:1][[*keys, "chunk", "mean"]].copy()
        out["scale"], out["weights"] = [scale], [weights.ravel()]
        return out

    return sums.where("chunk <> -1").join(gram, [*keys, "r"]).join(mean, keys).groupBy(*keys, "chunk").applyInPandas(solve, schema)


def permuted_cells(fits: DataFrame, eval_rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """(keys, draw, truth, pred, n) of evaluation rows under every fit; draw -1 is the true fit.

    Vectors are sent once, to blocks of about SEEN bytes; the weights visit each block, a chunk of
    draws at a time. Counts leave.
    """
    size = eval_rows.groupBy(*keys).agg(F.ceil(F.sum(F.size("values").cast("long")) * 8 / F.lit(SEEN)).cast("int").alias("_blocks"))
    x = eval_rows.join(size, keys).select(
        *keys, F.pmod(F.xxhash64("recording_id"), F.col("_blocks")).cast("int").alias("_block"), F.lit(-3).alias("chunk"), F.col("cls").cast("int").alias("cls"),
        F.col("values").cast("array<double>").alias("values"), F.lit(None).cast("array<double>").alias("mean"), F.lit(None).cast("array<double>").alias("scale"))
    w = cut(fits).join(size, keys).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "chunk", F.lit(None).cast("int").alias("cls"), F.col("weights").alias("values"), "mean", "scale")
    schema = _key_schema(eval_rows, keys)
    for c in ("draw", "truth", "pred"):
        schema = schema.add(c, T.IntegerType())
    schema = schema.add("n", T.LongType())

    def run(frames):
        at, held = None, []
        for frame in frames:
            for key, pdf in frame.groupby([*keys, "_block"], sort=False):
                if at != key:
                    at, held = key, []
                own = pdf["chunk"] == -3
                if own.any():
                    held.append((_stack(pdf["values"][own]), pdf["cls"][own].to_numpy(int)))
                for row in pdf[~own].itertuples(index=False):
                    if not held:
                        continue
                    x, truth = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
                    z = np.column_stack([(x - np.asarray(row.mean)) / np.asarray(row.scale), np.ones(len(x))])
                    w = np.asarray(row.values).reshape(z.shape[1], -1)
                    fits, counts = w.shape[1] // classes, 0
                    step = max(1, (4 << 20) // w.shape[1])
                    for k in range(0, len(z), step):
                        pred = (z[k : k + step] @ w).reshape(-1, fits, classes).argmax(axis=2)
                        cell = (np.arange(fits) * classes + truth[k : k + step, None]) * classes + pred
                        counts = counts + np.bincount(cell.ravel(), minlength=fits * classes * classes)
                    hit = np.flatnonzero(counts)
                    first = -1 if row.chunk == -2 else row.chunk * CHUNK
                    out = pd.DataFrame({"draw": (first + hit // classes**2).astype(np.int32), "truth": (hit // classes % classes).astype(np.int32), "pred": (hit % classes).astype(np.int32), "n": counts[hit]})
                    yield out.assign(**dict(zip(keys, key)))[[*keys, "draw", "truth", "pred", "n"]]

    both = x.unionByName(w).repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "chunk")
    return both.mapInPandas(run, schema).groupBy(*keys, "draw", "truth", "pred").agg(F.sum("n").alias("n"))


def probe_null(recordings: DataFrame, keys: list[str], classes: int, draws: int, seed: int, l2: float = 0.05, block: Column | None = None) -> DataFrame:
    """(keys, draw, accuracy) of the halves probe under permuted domains.

    In each draw every other recording of a (permuted) domain fits, by recording id, and the rest
    is scored, so each draw has a Gram matrix of its own. A block of recordings needs only how many
    of each domain come before it: counts per (block, draw, domain) are what blocks tell each other.
    """
    rows, _ = centred(_positions(recordings, keys, block), keys)
    rows = cut(rows.withColumn("_block", F.floor(F.col("_pos") / ROWS).cast("int")).select(*keys, "_block", "_pos", "_n", "_cls", "_upto", "values", "_m"))
    parts = _chunks(draws)
    schema = _key_schema(rows, keys).add("_block", T.IntegerType()).add("part", T.IntegerType()).add("counts", T.ArrayType(T.DoubleType()))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hot = lambda some: (_labels(seed, key[:-1], some, pdf)[..., None] == np.arange(classes)).sum(axis=1)
        out = pd.DataFrame({"_block": np.int32(key[-1]), "part": np.arange(len(parts), dtype=np.int32), "counts": [hot(s).ravel().astype(float) for s in parts]})
        return out.assign(**dict(zip(keys, key)))[[*keys, "_block", "part", "counts"]]

    counts = rows.groupBy(*keys, "_block").applyInPandas(count, schema)
    flat = counts.select(*keys, "_block", "part", F.posexplode("counts").alias("slot", "c"))
    before = Window.partitionBy(*keys, "part", "slot").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("b", F.coalesce(F.sum("c").over(before), F.lit(0.0)))
    told = flat.groupBy(*keys, "_block", "part").agg(F.array_sort(F.collect_list(F.struct("slot", "b"))).alias("s"))
    told = cut(told.select(*keys, "_block", "part", F.expr("transform(s, x -> x.b)").alias("before")))

    def halves(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame):
        """For each part: labels (draws, rows), and which rows fit."""
        pdf = pdf.sort_values("_pos")
        z = np.column_stack([_stack(pdf["values"]) - _stack(pdf["_m"]), np.ones(len(pdf))])
        for part, b in zip(told["part"], told["before"]):
            labels = _labels(seed, key[:-1], parts[part], pdf)
            hot = (labels[..., None] == np.arange(classes)).astype(np.float64)
            rank = np.take_along_axis(np.cumsum(hot, axis=1) + np.asarray(b).reshape(-1, 1, classes), labels[..., None], axis=2)[..., 0]
            yield part, z, labels, hot, rank % 2 == 1

    moments = _key_schema(rows, keys).add("draw", T.IntegerType()).add("r", T.IntegerType()).add("sums", T.ArrayType(T.DoubleType()))

    def fit_half(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, z, _, hot, fits in halves(key, pdf, told):
            for b, draw in enumerate(parts[part]):
                one = z[fits[b]]
                total = one.T @ np.column_stack([one, hot[b][fits[b]]])
                out.append(pd.DataFrame({"draw": np.int32(draw), "r": np.arange(len(total), dtype=np.int32), "sums": list(total)}))
        frame = pd.concat(out) if out else pd.DataFrame({"draw": [], "r": [], "sums": []})
        return frame.assign(**dict(zip(keys, key)))[[*keys, "draw", "r", "sums"]]

    met = lambda fn, out: rows.groupBy(*keys, "_block").cogroup(told.groupBy(*keys, "_block")).applyInPandas(fn, out)
    sums = met(fit_half, moments).withColumn("_v", array_to_vector("sums")).groupBy(*keys, "draw", "r").agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("sums"))
    solved = _key_schema(rows, keys).add("draw", T.IntegerType()).add("weights", T.ArrayType(T.DoubleType()))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _stack(pdf.sort_values("r")["sums"])
        d = len(total) - 1
        n, shift = total[d, d], total[:d, d] / total[d, d]  # this half's mean, of centred values
        gram, target = total[:, : d + 1].copy(), total[:, d + 1 :].copy()
        target[:d] -= shift[:, None] * target[d]
        gram[:d, :d] -= n * np.outer(shift, shift)
        scale, w = _solved(gram, target, l2)
        raw = w[:d] / scale[:, None]
        out = pdf.iloc[:1][[*keys, "draw"]].copy()
        out["weights"] = [np.vstack([raw, w[d] - shift @ raw]).ravel()]
        return out

    model = cut(sums.groupBy(*keys, "draw").applyInPandas(solve, solved))
    model = model.withColumn("part", F.floor(F.col("draw") / CHUNK).cast("int")).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("draw", "weights"))).alias("s"))
    model = model.select(*keys, "part", F.expr("transform(s, x -> x.weights)").alias("weights"))
    told = told.join(model, [*keys, "part"])
    hits = _key_schema(rows, keys).add("draw", T.IntegerType()).add("hit", T.LongType()).add("n", T.LongType())

    def score_half(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        weights, out = dict(zip(told["part"], told["weights"])), []
        for part, z, labels, _, fits in halves(key, pdf, told):
            w = np.stack([np.asarray(x) for x in weights[part]]).reshape(len(parts[part]), z.shape[1], classes)
            right = np.einsum("rd,bdc->brc", z, w, optimize=True).argmax(axis=2) == labels
            out.append(pd.DataFrame({"draw": np.array(parts[part], np.int32), "hit": (right & ~fits).sum(axis=1), "n": (~fits).sum(axis=1)}))
        frame = pd.concat(out) if out else pd.DataFrame({"draw": [], "hit": [], "n": []})
        return frame.assign(**dict(zip(keys, key)))[[*keys, "draw", "hit", "n"]]

    return met(score_half, hits).groupBy(*keys, "draw").agg((F.sum("hit") / F.sum("n")).alias("accuracy"))
