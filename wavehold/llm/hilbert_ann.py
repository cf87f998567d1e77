"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

GRID_BITS = 8
DIMENSIONS = 6
TIE_BITS = 14  # below the curve's 48 bits, so that crowds of almost equal vectors spread over blocks
STEPS = 2048  # of the distribution function of an axis


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places (uint64) of grid cells (n, d) along the Hilbert curve, by Skilling's transposed form."""
    x = cells.T.astype(np.uint64)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[d - 1] & np.uint64(1 << level)) != 0, turn ^ np.uint64((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return key


@dataclass
class Curves:
    """Orderings: a projection, the distribution along its axes, its shift, and the keys that open each block."""

    planes: np.ndarray  # (orderings, width, DIMENSIONS)
    steps: np.ndarray  # (orderings, DIMENSIONS, STEPS + 1), quantiles of the sample
    shift: np.ndarray  # (orderings, DIMENSIONS)
    opens: list[np.ndarray]

    def keys(self, c: int, unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        # the grid is as fine as rows are dense: a tight cluster has the share of the cells that it has of the rows
        at, even = unit @ self.planes[c], np.linspace(0, 1, STEPS + 1)
        share = np.stack([np.interp(at[:, j], self.steps[c, j], even) for j in range(at.shape[1])], 1)
        cells = np.minimum((share + self.shift[c]) / 1.5 * (1 << GRID_BITS), (1 << GRID_BITS) - 1).astype(np.uint64)
        salted = (ids.astype(np.uint64) + np.uint64(c * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
        tie = ((salted ^ (salted >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TIE_BITS)  # other in each ordering
        return (hilbert_keys(cells, GRID_BITS) << np.uint64(TIE_BITS)) | tie

    def blocks(self, c: int, unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.opens[c], self.keys(c, unit, ids), side="right")


def fit(sample: np.ndarray, ids: np.ndarray, orderings: int, blocks: int, seed: int = 3) -> Curves:
    """Curves for unit vectors, their grids and about equal blocks fitted on a sample."""
    rng, width = np.random.default_rng(seed), sample.shape[1]
    dims = min(DIMENSIONS, width)
    planes = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims] for _ in range(orderings)])
    at = np.einsum("nw,cwd->cnd", sample, planes)
    steps = np.quantile(at, np.linspace(0, 1, STEPS + 1), axis=1).transpose(1, 2, 0)
    curves = Curves(planes, steps, rng.uniform(0, 0.5, (orderings, dims)), [])
    for c in range(orderings):
        ordered = np.sort(curves.keys(c, sample, ids))
        curves.opens.append(np.unique(ordered[[len(ordered) * k // blocks for k in range(1, blocks)]]) if blocks > 1 else ordered[:0])
    return curves


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): rows with an id and a vector that is not zero and has finite components only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = 20, blocks: int = 40,
    reach: int = 2, sample_rows: int = 20_000, chunk: int = 20_000, seed: int = 3,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to `k` rows of largest cosine for each query row.

    Equal vectors are one class: it is indexed once, asked once, and stands for its `k` + 1 smallest
    ids when rows are ranked. Each ordering projects unit vectors to 6 random axes, shifts a grid of
    256 cells of about equal mass over each and puts all classes in Hilbert order, ties by a hash of its own, cut
    into `blocks` ranges of about equal size; grids and cuts are fitted on about `sample_rows` classes,
    every class is indexed. A query meets its own block and
    `reach` blocks to either side, in every ordering; what the windows find is merged and ranked by
    the exact cosine in double precision, ties by smaller id. So a query sees a fixed share of the
    table in each ordering: 64 independent dimensions have no shorter way to a recall of 0.9, and
    with these numbers it is about 0.98. Fewer than 64 rows a block make fewer blocks, so small
    tables are searched whole. `is_query` is a condition on vec_id.

    Null, zero and non-finite vectors and null ids take no part, nor do vectors of another width
    than most have. Rows with the query's own id are not its neighbours; rows repeated under one id
    count once. Blocks of more than `chunk` rows or queries are compared in chunks.
    """
    rows = usable(df, id_col, vector_col)
    widths = rows.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("q")).orderBy(F.desc("n"), "w").first()
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if widths is None or not widths["q"]:
        return empty
    width = widths["w"]
    rows = rows.where(F.size("vector") == width).select("vec_id", "vector", F.struct(F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")).alias("same"))
    asking = rows.where(is_query).select("vec_id", "same").distinct()
    # the limit by rank is applied before the shuffle, too, so that no task reads a whole crowd
    few = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("same").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = few.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    classes = classes.join(asking.select("same", F.lit(True).alias("query")).distinct(), "same", "left").withColumn("query", F.coalesce("query", F.lit(False)))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    n, queries = classes.agg(F.count("*"), F.count_if("query")).first()
    blocks = min(blocks, max(1, n // 64))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30))
    some = (classes.where(share) if n > 64 else classes).select("vec_id", "vector").toPandas()
    if not len(some):
        some = classes.limit(64).select("vec_id", "vector").toPandas()
    curves = spark.sparkContext.broadcast(fit(_unit(np.stack(some["vector"])), some["vec_id"].to_numpy(), orderings, blocks, seed))
    row_chunks, query_chunks = -(-2 * n // (blocks * chunk)), -(-2 * queries * (2 * reach + 1) // (blocks * chunk))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve = curves.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            unit = _unit(_matrix(batch.column(2), width))
            for c in range(orderings):
                at = curve.blocks(c, unit, ids)
                for query in (False, True):
                    pick, to = (np.flatnonzero(asks), np.arange(-reach, reach + 1)) if query else (np.arange(len(ids)), np.array([0]))
                    row, block = np.repeat(pick, len(to)), (at[pick][:, None] + to).ravel()
                    inside = (block >= 0) & (block < blocks)
                    row, block = row[inside], block[inside]
                    own, other = (query_chunks, row_chunks) if query else (row_chunks, query_chunks)
                    mine = (ids[row].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % own
                    row, block, mine = np.repeat(row, other), np.repeat(block, other), np.repeat(mine, other)
                    theirs = np.tile(np.arange(other), len(row) // other)
                    a, b = (theirs, mine) if query else (mine, theirs)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(row), c), pa.int32()), pa.array(block, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                        pa.array(np.full(len(row), query)), pa.array(ids[row]), batch.column(2).take(pa.array(row)), batch.column(3).take(pa.array(row)),
                    ], ["ordering", "block", "a", "b", "query", "vec_id", "vector", "class"])

    placed = classes.select("vec_id", "query", "vector", "class").mapInArrow(
        place, "ordering int, block int, a int, b int, query boolean, vec_id bigint, vector array<double>, class bigint")

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("query").to_numpy()
        ids, own, x = group.column("vec_id").to_numpy(), group.column("class").to_numpy(), _matrix(group.column("vector").combine_chunks(), width)
        x = x / np.abs(x).max(1, keepdims=True)
        size = np.sqrt((x * x).sum(1))
        cid, found, c, cs, qid, q, qs = ids[~asks], own[~asks], x[~asks], size[~asks], own[asks], x[asks], size[asks]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(qid), 256):
            part = slice(lo, lo + 256)
            rough = (q[part] @ c.T) / qs[part][:, None] / cs
            if not rough.size:
                continue
            kth = -np.partition(-rough, k, axis=1)[:, k] if len(cid) > k + 1 else np.full(len(rough), -1.5)
            r, j = np.nonzero(rough >= kth[:, None] - 1e-9)
            exact = (q[part][r] * c[j]).sum(1) / (qs[part][r] * cs[j])  # one order of addition for every pair
            order = np.lexsort((cid[j], -exact, r))
            r, j, exact = r[order], j[order], exact[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            out.append((qid[part][r][nth <= k], found[j][nth <= k], exact[nth <= k]))  # one more, as one may hold the query only
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"ask": pa.array(cols[0], pa.int64()), "class": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = placed.groupBy("ordering", "block", "a", "b").applyInArrow(compare, "ask bigint, class bigint, score double")
    order = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    merged = found.groupBy("ask", "class").agg(F.max("score").alias("score")).join(classes.select("class", F.explode("ids").alias("vec_id")), "class")
    best = merged.groupBy("ask", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", order("ask")).where(F.col("nth") <= k + 1)
    best = cut(best.join(classes.select("same", F.col("class").alias("ask")), "ask").select("same", "vec_id", "score"))
    each = asking.withColumnRenamed("vec_id", "query_id").join(best, "same").where("vec_id != query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", order("query_id"))
    return each.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scanned_share(orderings: int = 20, blocks: int = 40, reach: int = 2) -> float:
    """Share of a large table that a query meets at most."""
    return 1 - math.pow(1 - (2 * reach + 1) / blocks, orderings)
