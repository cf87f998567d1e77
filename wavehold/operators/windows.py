"""Framing long signals and choosing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranking import BLOCK_IDS, blocked_row_number, blocked_running_sum, density_block, text_block


def window_count(n: Column, length: int, hop: int) -> Column:
    return F.greatest(F.lit(0), F.lit(1) + F.floor((n - length) / F.lit(hop))).cast("long")


def number_samples(samples: DataFrame, keys: list[str], order: list[str], width: int = BLOCK_IDS) -> DataFrame:
    """0-based position ``n`` of each sample in its recording.

    Work is cut where samples lie, not by the clock: a burst of any density is spread over blocks of
    about ``width`` samples, and quiet recordings are not torn into empty hours.
    """
    block = density_block(samples, [*keys, *order], width)
    return blocked_row_number(samples, keys, order, block, "n").withColumn("n", F.col("n") - 1)


def signal_chunks(samples: DataFrame, keys: list[str], halo: int = 0, chunk: int = 4096) -> DataFrame:
    """Samples packed into arrays of ``chunk`` values plus ``halo`` values of the next chunk.

    Group size is bounded by chunk + halo whatever the recording length.
    """
    if halo > chunk:
        raise ValueError("halo must not exceed the chunk")
    own = F.floor(F.col("n") / F.lit(chunk)).cast("long")
    shared = (own > 0) & (F.col("n") % chunk < halo)
    homes = F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))
    return (
        samples.withColumn("chunk_no", F.explode(homes))
        .groupBy(*keys, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("_x"))
        .select(*keys, "chunk_no", F.expr("transform(_x, s -> s.v)").alias("x"))
    )


def frame_samples(samples: DataFrame, keys: list[str], length: int, hop: int, chunk: int = 4096) -> DataFrame:
    """Windows of ``length`` every ``hop`` samples from a long table of (keys, n, v)."""
    if chunk % hop:
        raise ValueError("chunk must be a multiple of the hop")
    chunks = signal_chunks(samples, keys, max(length - hop, 0), chunk)
    last = F.least(F.lit(chunk - hop), F.size("x") - length)
    offsets = F.when(F.size("x") >= length, F.sequence(F.lit(0), last, F.lit(hop)))
    framed = chunks.withColumn("_o", F.explode(offsets))
    return framed.select(
        *keys,
        (F.col("chunk_no") * chunk + F.col("_o")).alias("start"),
        (F.col("chunk_no") * chunk + F.col("_o") + length).alias("end"),
        F.slice("x", F.col("_o") + 1, length).alias("x"),
    )


def spread_kept(rank: Column, m: Column, k: int) -> Column:
    """Is 0-based ``rank`` one of k evenly spread positions among m (truncated spacing)?"""
    if k == 1:
        return rank == 0
    slot = F.ceil(rank * F.lit(k - 1) / F.greatest(m - 1, F.lit(1))).cast("long")
    back = F.floor(slot * (m - 1) / F.lit(k - 1)).cast("long")
    return (m <= k) | ((slot < k) & (back == rank))


def cap_windows_even(framed: DataFrame, keys: list[str], hop: int, k: int) -> DataFrame:
    """Keep at most k evenly spread windows of each recording."""
    counts = framed.groupBy(*keys).agg(F.count("*").alias("_m"))
    d = framed.join(counts, keys)
    rank = F.floor(F.col("start") / F.lit(hop)).cast("long")
    return d.where(spread_kept(rank, F.col("_m"), k)).drop("_m")


def respect_continuity(framed: DataFrame, block: int) -> DataFrame:
    """Drop windows that cross a continuity block."""
    return framed.where(F.floor(F.col("start") / F.lit(block)) == F.floor((F.col("end") - 1) / F.lit(block)))


def first_window(windows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Earliest window of each recording as a partial aggregate, not a sort."""
    packed = F.struct(*columns)
    return windows.groupBy(*keys).agg(F.min_by(packed, F.col("start")).alias("_w")).select(*keys, "_w.*")


def global_order(framed: DataFrame, hop: int) -> DataFrame:
    """0-based position of every window in (recording_id, start) order over the whole table.

    Only per-recording counts are ordered; windows add their own rank from ``start``.
    """
    counts = framed.groupBy("recording_id").agg(F.count("*").alias("_m"))
    upto = blocked_running_sum(
        counts, [], ["recording_id"], text_block(counts, "recording_id"), {"_upto": F.col("_m")}
    ).select("recording_id", (F.col("_upto") - F.col("_m")).alias("_before"))
    rank = F.col("_before") + F.floor(F.col("start") / F.lit(hop)).cast("long")
    return framed.join(upto, "recording_id").withColumn("position", rank).drop("_before")


def cap_candidates_global(framed: DataFrame, hop: int, k: int) -> DataFrame:
    ordered = global_order(framed, hop)
    total = framed.agg(F.count("*").alias("m"))
    return ordered.withColumn("_m", total.scalar()).where(spread_kept(F.col("position"), F.col("_m"), k)).drop("_m")


def frames_in_window(windows: DataFrame, frame: int, hop: int, column: str = "x") -> DataFrame:
    """Zero-padded frames inside each window."""
    missing = F.greatest(F.lit(0), F.lit(frame) - F.size(column))
    padded = F.concat(F.col(column), F.array_repeat(F.lit(0.0).cast("float"), missing))
    d = windows.withColumn("_p", padded)
    d = d.withColumn("frame_no", F.explode(F.sequence(F.lit(0), F.floor((F.size("_p") - frame) / F.lit(hop)).cast("int"))))
    return d.withColumn("frame", F.slice("_p", F.col("frame_no") * hop + 1, frame)).drop("_p")


TENSOR_BYTES = 4 * 16 * 16 * 4  # four families of 16 x 16 float32
CASES = 32


def memory_plan(recordings: DataFrame, keys: list[str], length: int, hop: int, per_recording: int = 16) -> DataFrame:
    """Upper bounds of cached and relation bytes from sample counts ``n`` alone."""
    k = F.least(window_count(F.col("n"), length, hop), F.lit(per_recording))
    t = recordings.groupBy(*keys).agg(F.count("*").alias("recordings"), F.sum(k).alias("windows"))
    return (
        t.withColumn("cached_bytes", F.col("windows") * (length * 8 + TENSOR_BYTES))
        .withColumn("relation_rows", F.col("recordings") * CASES)
        .withColumn("relation_bytes", F.col("relation_rows") * (2 * length * 8 + 2 * TENSOR_BYTES))
    )
