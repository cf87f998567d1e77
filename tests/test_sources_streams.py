import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavehold.sources import files, sinks
from wavehold.streaming import jobs


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_manifest_and_repeated_ids(spark, folder):
    rec = {"recording_id": "a", "dataset": "d", "path": "p", "label": "x", "is_background": False, "sample_count": 7, "metadata": {"unit": "u1"}}
    with open(f"{folder}/m.json", "w") as f:
        json.dump({"schema_version": "v1", "recordings": [rec, {**rec, "recording_id": "b"}]}, f, indent=1)
    m = files.require_unique(files.read_manifest(spark, folder))
    assert m.count() == 2 and m.first()["metadata"] == {"unit": "u1"}
    with pytest.raises(ValueError):
        files.require_unique(m.unionByName(m))


def test_raw_files_round_trip_in_chunks(spark, folder):
    x = np.random.default_rng(0).normal(size=(10, 2)).astype("<f4")
    x.tofile(f"{folder}/a.iq")
    raw = files.read_binary(spark, folder, "*.iq")
    out = sorted(files.ingest_interleaved(raw, chunk=4).collect(), key=lambda r: r["chunk_no"])
    assert [len(r["i"]) for r in out] == [4, 4, 2]
    assert np.allclose(np.concatenate([r["q"] for r in out]), x[:, 1])
    assert files.inventory(raw).first()["bytes"] == 80
    twice = spark.createDataFrame([("p", b"a"), ("p", b"b"), ("p", b"a"), ("q", b"a")], "path string, content binary")
    assert files.inventory(twice).count() == 3


def test_changed_and_missing_files(spark):
    s = "path string, sha256 string"
    out = files.checksum_faults(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], s), spark.createDataFrame([("a", "1"), ("b", "9")], s))
    assert {(r["path"], r["fault"]) for r in out.collect()} == {("b", "changed"), ("c", "missing")}


def test_capture_names(spark):
    names = ["T0000_D00_S0000.mat", "T10000_S0000.mat", "A1_IN_S0_slice_1.mat", "background_slice_24.mat", "mavic3C_1_Ascend_c17_u1_d2.mat", "odd.bin"]
    d = spark.createDataFrame([(n,) for n in names], "name string").select("name", files.parse_capture_path(F.col("name")).alias("f")).select("name", "f.*")
    out = {r["name"]: r.asDict() for r in d.collect()}
    assert out[names[0]]["distance"] == "00" and out[names[1]]["distance"] is None and out[names[1]]["class_code"] == "T10000"
    assert (out[names[2]]["class_code"], out[names[2]]["state"], out[names[2]]["segment"]) == ("A1", "IN", "0")
    assert out[names[3]]["class_code"] == "background" and out[names[3]]["segment"] is None
    assert [out[names[4]][k] for k in ("class_code", "state", "channel", "unit", "day")] == ["mavic3C_1", "Ascend", "17", "1", "2"]
    assert out["odd.bin"]["layout"] is None


def test_anonymous_names_and_partial_downloads(spark):
    f = spark.createDataFrame([("0",), ("1",)], "anonymous_id string")
    lines = spark.createDataFrame([("A1_IN_S0_slice_47.mat 0",)], "value string")
    assert {r["anonymous_id"]: r["original_name"] for r in files.join_anonymous_labels(f, lines).collect()} == {"0": "A1_IN_S0_slice_47.mat", "1": None}
    listing = spark.createDataFrame([("a",), ("a.aria2",), ("b",), ("c",), ("c.aria2",)], "path string")
    drop = spark.createDataFrame([("c",)], "path string")
    assert [r["path"] for r in files.partial_files(listing, drop).collect()] == ["a"]
    with pytest.raises(RuntimeError):
        files.require_complete(listing, drop)


def test_content_hash_ignores_order_but_not_copies(spark):
    d = spark.createDataFrame([(k % 50, f"v{k % 50}") for k in range(60)], "a int, b string")
    h = lambda x: sinks.content_hash(x, ["a", "b"]).first()["sha256"]
    assert h(d) == h(d.orderBy(F.desc("a")).repartition(7))
    odd = lambda a, b: h(spark.createDataFrame([(a, b)], "a string, b string"))
    assert odd("a|b", "c") != odd("a", "b|c") and odd(None, "c") != odd("", "c")
    assert h(d) != h(d.distinct()) and h(d) != h(d.withColumn("b", F.when(F.col("a") > 0, F.col("b"))))


def test_null_safe_results(spark):
    d = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.5, 3)], "v double, k int")
    assert sinks.null_safe(d).columns == ["k", "v"]
    assert {r["k"]: r["v"] for r in sinks.null_safe(d).collect()} == {1: None, 2: None, 3: 1.5}


def test_window_cache_checks(spark):
    w = spark.createDataFrame([("d", "r", 0, 4), ("d", "r", 4, 8), ("e", "s", 0, 4)], "domain string, recording_id string, start long, end long")
    m = sinks.write_window_cache(w, sinks.scratch(spark, "t"), "domain")
    want = w.groupBy("domain", "recording_id").agg(F.count("*").alias("windows"))
    assert sinks.cache_faults(m, want, ["domain", "recording_id"]).isEmpty()
    assert sinks.cache_faults(m, want.withColumn("windows", F.lit(9)), ["domain", "recording_id"]).count() == 2


def event_files(spark, folder, parts):
    for k, rows in enumerate(parts):
        df = spark.createDataFrame([(i, t, u, "e", v, "{}") for i, t, u, v in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{folder}/in/p{k}")
    return f"{folder}/in/*"


def first_of(stream):
    return jobs.first_sample(jobs.drain_whole(jobs.first_sample_parts(stream, "1 hour", "1 day"), jobs.PART, "t1"))


def detected(stream):
    return jobs.running_detection(jobs.drain_whole(jobs.detection_parts(stream, F.col("v"), "1 hour", "1 day"), jobs.PART, "t2"), 5.0)


def test_updates_over_many_files_equal_the_batch_answer(spark, folder):
    parts = [[(1, "2024-01-01 00:10:00", 1, 2.0), (2, "2024-01-01 05:00:00", 2, 4.0)], [(3, "2024-01-01 00:05:00", 1, 6.0)], [(4, "2024-01-01 06:30:00", 2, 8.0)]]
    src = event_files(spark, folder, parts)
    stream = lambda: jobs.event_stream(spark, src, files_per_batch=1)
    first = {r["recording_id"]: r["event_id"] for r in first_of(stream()).collect()}
    assert first == {"1": 3, "2": 2}
    det = {r["recording_id"]: (r["score"], r["samples"], r["detected"]) for r in detected(stream()).collect()}
    assert det == {"1": (4.0, 2, False), "2": (6.0, 2, True)}


def test_state_is_dropped_behind_the_watermark_and_parts_merge(spark, folder):
    """Recordings come and go over ten days; recording 7 returns on the last one."""
    parts = [[(100 * day + k, f"2024-01-{day + 1:02d} {k:02d}:00:00", 10 * day + k % 5, float(k)) for k in range(20)] for day in range(10)]
    parts[0].append((1, "2024-01-01 03:30:00", 7, 2.0))
    parts[9] += [(2, "2024-01-10 04:00:00", 7, 9.0), (3, "2024-01-10 05:00:00", 7, None)]
    src = event_files(spark, folder, parts)
    stream = lambda: jobs.event_stream(spark, src, files_per_batch=1)
    rows = [r for part in parts for r in part]
    out = jobs.drain_counted(jobs.first_sample_parts(stream(), "6 hours", "12 hours"), jobs.PART, "gone")
    assert out.dropped == 0
    held, seen = out.state_rows, len({(r[1][:10], int(r[1][11:13]) // 6, r[2]) for r in rows})
    assert max(held) <= 45 < seen and any(b < a for a, b in zip(held, held[1:]))
    want = {}
    for event, ts, user, _ in rows:
        want[str(user)] = min(want.get(str(user), (ts, event)), (ts, event))
    assert {r["recording_id"]: r["event_id"] for r in jobs.first_sample(out.rows).collect()} == {u: e for u, (_, e) in want.items()}

    out = jobs.drain_counted(jobs.detection_parts(stream(), F.col("v"), "6 hours", "12 hours"), jobs.PART, "gone2")
    assert out.dropped == 0 and max(out.state_rows) <= 45
    got = {r["recording_id"]: (r["score"], r["samples"], r["detected"]) for r in jobs.running_detection(out.rows, 6.0).collect()}
    for user in {r[2] for r in rows}:
        mine = [r[3] for r in rows if r[2] == user]
        scored = [v for v in mine if v is not None]
        mean = sum(scored) / len(scored)
        assert got[str(user)] == (pytest.approx(mean), len(mine), mean >= 6.0)
    assert len(got) == len({r[2] for r in rows})


def test_rows_behind_the_watermark_are_dropped(spark, folder):
    parts = [[(1, "2024-01-03 00:00:00", 1, 2.0)], [(2, "2024-01-03 01:00:00", 1, 4.0)], [(3, "2024-01-01 00:00:00", 1, 6.0)]]
    src = event_files(spark, folder, parts)
    w = jobs.frame_windows(jobs.event_stream(spark, src, 1), "1 hour", "1 hour", "6 hours", F.count("*").alias("samples"))
    keys = ["recording_id", "domain", "start", "end"]
    out = jobs.drain_counted(w, keys, "late")
    assert out.rows.count() == 2 and out.dropped == 1
    with pytest.raises(RuntimeError):
        jobs.drain_whole(w, keys, "late")


def test_a_backlog_in_one_batch_loses_nothing(spark, folder):
    parts = [[(1, "2024-01-03 00:00:00", 1, 2.0)], [(2, "2024-01-03 01:00:00", 1, 4.0)], [(3, "2024-01-01 00:00:00", 1, 6.0)]]
    src = event_files(spark, folder, parts)
    w = jobs.frame_windows(jobs.event_stream(spark, src), "1 hour", "1 hour", "6 hours", F.count("*").alias("samples"))
    assert jobs.drain_whole(w, ["recording_id", "domain", "start", "end"], "backlog").count() == 3


def test_ledger_sums_over_batches(spark, folder):
    src = event_files(spark, folder, [[(1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:00:01", 2, 1.0)], [(3, "2024-01-01 00:00:02", 1, 1.0)], [(4, "2024-01-01 00:00:03", 1, 1.0)]])
    ids = spark.createDataFrame([("1", 3), ("2", 1)], "recording_id string, sample_count long")
    out = jobs.ledgered_stream(jobs.event_stream(spark, src, 1), ids, f"{folder}/whole")
    assert sorted((r["recording_id"], r["samples"]) for r in out.collect()) == [("1", 3), ("2", 1)]
    more = spark.createDataFrame([("1", 4), ("2", 1)], "recording_id string, sample_count long")
    with pytest.raises(RuntimeError):  # one sample of recording 1 never came
        jobs.ledgered_stream(jobs.event_stream(spark, src, 1), more, f"{folder}/short")


def test_ledger_reads_each_recording_once(spark, folder):
    src = event_files(spark, folder, [[(1, "2024-01-01 00:00:00", 1, 1.0)], [(2, "2024-01-01 00:00:00", 2, 1.0)]])
    ids = spark.createDataFrame([("1",), ("2",)], "recording_id string")
    base = f"{folder}/run"
    out = jobs.ledgered_stream(jobs.event_stream(spark, src, 1), ids, base)
    assert sorted((r["recording_id"], r["samples"]) for r in out.collect()) == [("1", 1), ("2", 1)]
    again = jobs.ledgered_stream(jobs.event_stream(spark, src, 1), ids, base)  # resume: nothing is read twice
    assert again.count() == 2
    ledger = jobs.Ledger(spark, f"{base}/ledger")
    ledger.record(spark.createDataFrame([("1",), ("1",)], "recording_id string"), 9)
    assert {r["recording_id"]: r["samples"] for r in ledger.done().collect()} == {"1": 1, "2": 1}
    with pytest.raises(PermissionError):
        ledger.begin(ids.limit(1))


def test_incomplete_set_cannot_be_committed(spark, folder):
    src = event_files(spark, folder, [[(1, "2024-01-01 00:00:00", 1, 1.0)]])
    ids = spark.createDataFrame([("1",), ("2",)], "recording_id string")
    with pytest.raises(RuntimeError):
        jobs.ledgered_stream(jobs.event_stream(spark, src, 1), ids, f"{folder}/run")
