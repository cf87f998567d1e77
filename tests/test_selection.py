import numpy as np
import pytest
from pyspark.sql import functions as F

from wavehold.operators import relations as rel, selection as s

SCHEMA = "fold string, stable_id string, sensitivity double, macro_f1 double, latency_ms double, bytes_per_sample double, macs double, feasible boolean"


def test_front_and_choice(spark):
    d = spark.createDataFrame([("f", "A", 0.2, 0.80, 2.0, 1.0, 1.0, True), ("f", "B", 0.1, 0.79, 1.0, 1.0, 1.0, True), ("f", "C", 0.3, 0.70, 3.0, 1.0, 1.0, True), ("f", "Z", 0.0, 0.99, 0.1, 0.1, 0.1, False)], SCHEMA)
    assert sorted(r["stable_id"] for r in s.pareto_front(d, ["fold"]).collect()) == ["A", "B"]
    assert s.select_unique(d, ["fold"]).first()["selected"] == "B"


def test_repeated_ids_are_refused(spark):
    d = spark.createDataFrame([("f", "A", 0.2, 0.8, 2.0, 1.0, 1.0, True)] * 2, SCHEMA)
    with pytest.raises(Exception, match="unique"):
        s.pareto_front(d, ["fold"]).collect()


@pytest.mark.parametrize("blocks", [1, 4, 16])
def test_front_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(blocks)
    v = np.round(rng.random((300, 5)), 1)
    v[:40] = v[0]
    data = [("f", f"c{k}", *map(float, (r[0], -r[1], r[4], r[2], r[3])), True) for k, r in enumerate(v)]
    d = spark.createDataFrame(data, SCHEMA).repartition(6)
    p = v
    dom = [any((o <= c + 1e-12).all() and (o < c - 1e-12).any() for o in p) for c in p]
    want = sorted(f"c{k}" for k, b in enumerate(dom) if not b)
    assert sorted(r["stable_id"] for r in s.pareto_front(d, ["fold"], blocks).collect()) == want


def test_tolerance_chain_is_not_cut_by_thinning(spark):
    """A beats B and B beats C only within the tolerance; A does not beat C."""
    t = 0.8e-12
    rows = [("f", "A", 0.0, 0.5, 1.0, 1.0, 2 * t, True), ("f", "B", 0.0 - 2e-12 * 0, 0.5, 1.0 + 3e-12, 1.0, t, True), ("f", "C", 0.0, 0.5, 1.0 + 6e-12, 1.0, 0.0, True)]
    d = spark.createDataFrame(rows, SCHEMA)
    vec = {r[1]: np.array([r[2], -r[3], r[5], r[6], r[4]]) for r in rows}
    want = sorted(c for c in vec if not any((vec[o] <= vec[c] + 1e-12).all() and (vec[o] < vec[c] - 1e-12).any() for o in vec if o != c))
    for blocks in (1, 3):
        assert sorted(r["stable_id"] for r in s.pareto_front(d, ["fold"], blocks).collect()) == want


def test_displacement_and_order_of_reductions(spark):
    d = spark.createDataFrame([([0.0, 0.0], [0.4, 0.1]), ([1.0, 1.0], [0.9, 1.3])], "clean array<double>, perturbed array<double>")
    assert sorted(r["displacement"] for r in s.linf_displacement(d).collect()) == pytest.approx([0.3, 0.4])
    rows = [("d", "r", f, v) for f, vs in (("W", (1.0, 0.0, 0.0)), ("C", (0.0, 1.0, 0.0))) for v in vs]
    m = s.recording_family_medians(spark.createDataFrame(rows, "domain string, recording_id string, family string, displacement double"), [])
    assert s.reduce_domains(m, []).first()["instability"] == 0.0


def test_similarity_rule(spark):
    d = spark.createDataFrame([("same", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ("far", [1.0, 0.0], [0.0, 1.0]), ("sizes", [0.0, 1.0], [0.0, 0.5, 1.0])], "k string, left array<double>, right array<double>")
    out = {r["k"]: r for r in s.representation_similarity(d, ["k"]).collect()}
    assert out["same"]["degenerate"] and not out["far"]["degenerate"] and out["sizes"]["degenerate"]


def test_unavailable_probe_never_passes(spark):
    d = spark.createDataFrame([("W", True, 0.1, False, 0.3, 0.4, False), ("C", True, 0.1, False, float("nan"), 0.4, False), ("E", True, None, False, 0.1, 0.4, True), ("S", True, None, False, None, None, True)],
                              "family string, selected boolean, delta double, degenerate boolean, probe double, shuffle_q95 double, only_family boolean")
    assert {r["family"]: r["retain"] for r in s.channel_retention(d).collect()} == {"W": True, "C": False, "E": True, "S": False}


def evidence(spark):
    rows = [(k, f"r{k}", 0, "awgn", 10.0, f, float(a), float(b)) for k in range(2) for f, a, b in ((0, 0.1, 0.9), (1, 0.2, 0.5), (2, 0.05, 0.1))]
    return spark.createDataFrame(rows, "sample_index int, recording_id string, truth int, nuisance string, severity double, family int, risk double, margin double")


def test_only_comparable_pairs_become_relations(spark):
    out = rel.build_relations(evidence(spark)).collect()
    assert {(r["winner"], r["loser"]) for r in out} == {(0, 1)} and len(out) == 2
    w = rel.relation_weights(rel.build_relations(evidence(spark)))
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_relation_loss(spark):
    r = rel.build_relations(evidence(spark))
    for gates, want in (([1.0, 0.0, 0.0], 0.0), ([0.0, 0.5, 0.0], 0.7)):
        g = spark.createDataFrame([(k, gates) for k in range(2)], "sample_index int, gate array<double>")
        assert rel.relation_loss(r, g).first()["loss"] == pytest.approx(want)
    with pytest.raises(Exception, match="without gate"):
        rel.relation_loss(r, spark.createDataFrame([(0, [0.0, 0.0, 0.0])], "sample_index int, gate array<double>")).collect()


def test_shuffle_keeps_counts_and_moves(spark):
    rows = [(k, f"r{k % 7}", k % 2, "n", 1.0, k % 3, 3) for k in range(60)]
    d = spark.createDataFrame(rows, "sample_index int, recording_id string, truth int, nuisance string, severity double, winner int, loser int")
    out = rel.require_changed(rel.shuffle_relations(d, 5)).collect()
    for y in (0, 1):
        a = sorted(r["old_winner"] for r in out if r["truth"] == y)
        assert a == sorted(r["winner"] for r in out if r["truth"] == y)
    same = d.withColumn("winner", F.lit(1))
    with pytest.raises(RuntimeError):
        rel.require_changed(rel.shuffle_relations(same, 5))


def test_weighted_sampling_hits_each_interval(spark):
    d = spark.createDataFrame([(k, 0, 1, w) for k, w in enumerate((0.5, 0.25, 0.25))], "sample_index int, winner int, loser int, weight double")
    u = spark.createDataFrame([(0.0,), (0.499999,), (0.5,), (0.74,), (0.75,), (0.999999,)], "u double")
    out = {r["u"]: r["sample_index"] for r in rel.sample_relations(d, u).collect()}
    assert out == {0.0: 0, 0.499999: 0, 0.5: 1, 0.74: 1, 0.75: 2, 0.999999: 2}


def test_every_draw_meets_one_interval(spark):
    n = 3000
    d = spark.range(n).select(F.col("id").cast("int").alias("sample_index"), F.lit(0).alias("winner"), F.lit(1).alias("loser"), F.lit(1.0 / n).alias("weight"))
    u = spark.range(20_000).select((F.col("id") / 20_000.0).alias("u")).union(d.select((F.col("sample_index") * F.lit(1.0 / n)).alias("u"))).union(spark.createDataFrame([(1 - 2.0**-53,)], "u double"))
    out = rel.sample_relations(d, u)
    assert out.count() == 20_000 + n + 1
