import pytest
from pyspark.sql import functions as F

from wavehold.operators import splits as s, windows as w


def test_even_cap_keeps_first_middle_last(spark):
    d = spark.createDataFrame([("r", 64 * k) for k in range(15)], "recording_id string, start long")
    assert sorted(r["start"] for r in w.cap_windows_even(d, ["recording_id"], 64, 3).collect()) == [0, 448, 896]
    assert [r["start"] for r in w.cap_windows_even(d, ["recording_id"], 64, 1).collect()] == [0]


@pytest.mark.parametrize("k,m", [(3, 15), (5, 7), (40, 333), (2, 9), (7, 7), (9, 4)])
def test_spread_positions(spark, k, m):
    want = set(range(m)) if m <= k else {j * (m - 1) // (k - 1) for j in range(k)}
    d = spark.range(m).where(w.spread_kept(F.col("id"), F.lit(m), k))
    assert {r["id"] for r in d.collect()} == want


@pytest.mark.parametrize("chunk", [16, 32, 4096])
def test_frames_do_not_depend_on_chunks(spark, chunk):
    n = {"a": 100, "b": 15, "c": 16, "d": 41}
    d = spark.createDataFrame([(r, k, float(k)) for r, size in n.items() for k in range(size)], "recording_id string, n long, v double").repartition(5)
    out = sorted((r["recording_id"], r["start"], r["x"]) for r in w.frame_samples(d, ["recording_id"], 16, 8, chunk).collect())
    want = sorted((r, s0, [float(x) for x in range(s0, s0 + 16)]) for r, size in n.items() for s0 in range(0, size - 15, 8))
    assert out == want


def test_continuity_of_cached_windows(spark):
    d = spark.createDataFrame([(x, x + 64) for x in range(0, 193, 32)], "start long, end long")
    assert sorted(r["start"] for r in w.respect_continuity(d, 64).collect()) == [0, 64, 128, 192]


@pytest.fixture(scope="module")
def corpus(spark):
    data = [(f"{d}-{c}-{g}", f"{d}-{c}-{g}", d, c) for d in ("d0", "d1", "d2") for c in ("x", "y") for g in range(4)]
    return spark.createDataFrame(data, "recording_id string, group_id string, domain string, label string")


def test_roles_are_disjoint_complete_and_order_free(spark, corpus):
    a = s.split_roles(corpus, ["d0", "d1", "d2"])
    b = s.split_roles(corpus.orderBy(F.desc("recording_id")).repartition(3), ["d0", "d1", "d2"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert s.role_overlaps(a, ["fold_id"]).isEmpty()
    per = a.where("role <> 'held_target'").groupBy("fold_id", "domain", "label").agg(F.count_distinct("role").alias("n")).collect()
    assert {r["n"] for r in per} == {4}
    assert a.where("role = 'held_target' and domain <> fold_id").isEmpty()


def test_sparse_stratum_goes_to_fit_and_validation(spark, corpus):
    extra = spark.createDataFrame([("b1", "b1", "d0", "background"), ("b2", "b2", "d0", "background")], corpus.schema)
    out = s.assign_group_roles(corpus.unionByName(extra), sparse=True).where("label = 'background'")
    assert {r["role"] for r in out.collect()} == {"source_fit", "source_validation"}


def test_overlaps_and_unknown_ids(spark):
    m = spark.createDataFrame([("f", "r1", "a"), ("f", "r1", "b"), ("f", "r1", "c"), ("f", "r2", "a")], "fold_id string, recording_id string, role string")
    assert s.role_overlaps(m, ["fold_id"]).count() == 3
    roles = spark.createDataFrame([("r1",), ("zz",)], "recording_id string")
    _, unknown = s.materialize_roles(roles, m, "recording_id")
    assert [r["recording_id"] for r in unknown.collect()] == ["zz"]


def test_a_stratum_without_support_stops_the_split(spark, corpus):
    short = corpus.where("NOT (domain = 'd1' AND label = 'x' AND group_id LIKE '%-3')")
    with pytest.raises(ValueError):
        s.split_roles(short, ["d0", "d1", "d2"])


def test_a_burst_is_spread_and_gives_the_same_windows(spark):
    d = spark.range(30_000).select(
        F.lit("r").alias("recording_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 11).alias("ts"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("v"))
    numbered = w.number_samples(d.repartition(4), ["recording_id"], ["ts", "event_id"], width=1000)
    got = {r["start"]: r["x"] for r in w.frame_samples(numbered, ["recording_id"], 16, 8, chunk=64).collect()}
    want = sorted(range(30_000), key=lambda k: (k % 11, k))
    assert got == {s: [float(k) for k in want[s : s + 16]] for s in range(0, 30_000 - 15, 8)}
