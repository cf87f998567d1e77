import random
import re
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from wavehold.llm.common import fresh_path
from wavehold.llm.digest_index import DigestIndex, drop_duplicates
from wavehold.llm.ranges import range_of, splitters
from wavehold.llm.sharding import shard_rows, write_shards

LAST = float("inf")


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), LAST if i is None else i))
    best = {p: min(g)[1] for p, g in groups.items()}
    return sorted(((i, None if best[plain(t)] == LAST else best[plain(t)], len(groups[plain(t)])) for i, t in rows), key=str)


def test_batch_equals_brute_force(spark, odd):
    index = DigestIndex(spark, fresh_path(spark, "index"), buckets=4)
    got = index.add(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert {bytes(r.digest).hex() for r in got} == {sha256(plain(t).encode()).hexdigest() for _, t in rows}


def test_index_persists_and_is_idempotent(spark):
    at = fresh_path(spark, "index")
    one = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "ab")], "doc_id bigint, text string")
    two = spark.createDataFrame([(9, "a  b  "), (10, "d"), (11, "d ")], "doc_id bigint, text string")
    index = DigestIndex(spark, at, buckets=4)
    first = index.add(one, batch="one").collect()
    spark.sql(f"DROP TABLE {index.name}")  # external: the files stay
    again = DigestIndex(spark, at, buckets=4)
    assert again.table().count() == 2
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.add(two, batch="two").collect()}
    assert got == {9: (1, 3, False), 10: (11, 2, False), 11: (11, 2, True)}
    assert sorted(again.add(one, batch="one").collect()) == sorted(first)
    assert again.table().count() == 3


def test_filter_keeps_columns_and_unknown_ids(spark, odd, none):
    index = DigestIndex(spark, fresh_path(spark, "index"), buckets=2)
    kept = drop_duplicates(odd, index)
    assert kept.columns == odd.columns
    # of the empty texts the first with an id and most code points is 4; the repeated row 5 shares its fate
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [4, 5, 5, 6, 7, 8, 9, 10, 11, 13]
    assert index.add(none).count() == 0
    assert drop_duplicates(none, index).count() == 0


def test_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = DigestIndex(spark, fresh_path(spark, "index"), buckets=4).add(df)
    assert got.where("keep_id = 0 AND group_size = 1000").count() == 1000
    assert got.where("kept").count() == 2001


def dealt(rows, shards):
    """Shard and slot of (id, text) rows by walking the key order."""
    keyed = sorted((int(md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, i, t) for i, t in rows)
    total, before, slots, out = sum(k[2] for k in keyed), 0, {}, []
    for _, _, size, i, t in keyed:
        s = before * shards // total
        out.append((i, size, zlib.crc32((t or "").encode()), s, slots.setdefault(s, 0)))
        slots[s] += 1
        before += size
    return out


@pytest.mark.parametrize("per_task", [3, 500_000])
def test_shards_equal_brute_force(spark, odd, per_task):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = shard_rows(odd, 3, per_task=per_task).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(dealt(rows, 3), key=str)


def test_shards_of_hot_text_are_near_equal(spark):
    random.seed(2)
    rows = [(i, "copy " * 40 if i % 3 == 0 else "x" * random.randint(0, 900)) for i in range(2000)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), 8, per_task=50).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(dealt(rows, 8))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 901


def test_overfull_ranges_are_subdivided(spark):
    # sizes sit on one key, so that the size-weighted sample leaves the small rows in overfull ranges
    df = spark.range(4000).select(F.col("id").alias("hi"), F.lit(0).cast("long").alias("lo"), F.when(F.col("id") < 5, 100_000).otherwise(1).alias("size"))
    cuts = splitters(df, "hi", "lo", "size", per_task=200)
    most = df.groupBy(range_of("hi", "lo", cuts)).count().agg(F.max("count")).first()[0]
    assert most <= 400 and cuts == sorted(set(cuts))


def test_written_shards_and_empty(spark, none):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    at = fresh_path(spark, "shards")
    dealt_rows = write_shards(df, 4, at)
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(at).collect()} == {(r.doc_id, r.shard) for r in dealt_rows.collect()}
    assert shard_rows(none, 8).count() == 0


def test_written_shards_keep_columns_of_the_same_names(spark, odd):
    path = fresh_path(spark, "shards")
    df = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    dealt = {r.doc_id: (r.shard, r.slot) for r in write_shards(df, 3, path).collect()}
    rows = spark.read.parquet(path).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == dealt
    assert {(r.shard_of_row, r.slot_of_row, r.score) for r in rows} == {("shard", "slot", "score")}
