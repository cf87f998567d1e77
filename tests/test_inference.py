import numpy as np
import pytest
from pyspark.sql import functions as F

from wavehold.operators import audits, decisions
from wavehold.plans import bank, resampling as rs


def test_draws_do_not_depend_on_partitioning(spark):
    c = spark.createDataFrame([("k", "s", 0, 1, 5), ("k", "s", 0, 0, 3), ("k", "t", 1, 1, 4)], "key string, fold string, truth int, pred int, n long")
    a = rs.draw_cells(c, ["key"], ["fold", "truth"], ["pred"], 30, 1).collect()
    b = rs.draw_cells(c.repartition(3), ["key"], ["fold", "truth"], ["pred"], 30, 1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_draws_keep_stratum_sizes_and_means(spark, monkeypatch):
    c = spark.createDataFrame([("s", 0, 1, 60), ("s", 0, 0, 40), ("s", 1, 1, 30)], "fold string, truth int, pred int, n long")
    for block in (4096, 16):  # one block, and several with the splits above them
        monkeypatch.setattr(rs.dr, "BLOCK", block)
        d = rs.draw_cells(c, [], ["fold", "truth"], ["pred"], 400, 3)
        per = d.groupBy("draw", "truth").agg(F.sum("m").alias("m"))
        assert {(r["truth"], r["m"]) for r in per.select("truth", "m").distinct().collect()} == {(0, 100), (1, 30)}
        mean = d.where("truth = 0 and pred = 1").agg(F.sum("m")).first()[0] / 400
        assert mean == pytest.approx(60, abs=1.2)


def test_recording_draws_and_their_sums_agree(spark, monkeypatch):
    r = spark.createDataFrame([("a", f"r{k:03d}", [float(k), 1.0]) for k in range(50)] + [("b", "x", [2.0, 1.0])], "fold string, recording_id string, v array<double>")
    for block in (4096, 8):
        monkeypatch.setattr(rs.dr, "BLOCK", block)
        d = rs.draw_recordings(r, ["fold"], 40, 7, ["v"], F.substring("recording_id", 1, 3)).collect()
        assert len({x["recording_id"] for x in d if x["fold"] == "a"}) == 50
        want = {}
        for x in d:
            a, n = want.get((x["fold"], x["draw"]), (0, 0))
            want[x["fold"], x["draw"]] = (a + x["m"] * x["v"][0], n + x["m"])
        got = {(x["fold"], x["draw"]): tuple(x["sums"]) for x in rs.draw_sums(r, ["fold"], "v", 40, 7, F.substring("recording_id", 1, 3)).collect()}
        assert got == want and {n for (f, _), (_, n) in got.items() if f == "a"} == {50}
        assert sorted(map(str, d)) == sorted(map(str, rs.draw_recordings(r.repartition(3), ["fold"], 40, 7, ["v"], F.substring("recording_id", 1, 3)).collect()))


def test_one_block_has_no_interval(spark):
    d = spark.createDataFrame([("one", 1, 2.0), ("one", 1, 4.0), ("two", 1, 2.0), ("two", 2, 4.0)], "k string, b int, v double")
    out = {r["k"]: r for r in rs.block_bootstrap_ci(d, ["k"], "b", "v", 50, 1, F.lit(0)).collect()}
    assert out["one"]["low"] is None and out["two"]["low"] == 2.0


def midrank(v):
    return np.array([(np.sum(v < x) + 1 + np.sum(v <= x)) / 2 for x in v])


def numpy_statistic(l, f, h, macs, res):
    out = []
    for d in range(len(l)):
        x = np.column_stack([np.ones(l.shape[1]), midrank(f[d]), midrank(macs), midrank(res)])
        proj = lambda v: midrank(v) - x @ (np.linalg.pinv(x) @ midrank(v))
        a, b = proj(l[d]), proj(f[d] - h[d])
        out.append(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    return out


@pytest.mark.parametrize("flat", [False, True])
def test_partial_rank_statistic_equals_pseudoinverse(spark, flat):
    g = np.random.default_rng(4)
    l, f, h = g.random((3, 12)), np.round(g.random((3, 12)), 1), g.random((3, 12))
    macs, res = g.random(12), np.array([8.0, 16.0, 32.0] * 4)
    if flat:
        res = np.ones(12)
    rows = [(f"d{d}", c, *map(float, (l[d, c], f[d, c], h[d, c], macs[c], res[c]))) for d in range(3) for c in range(12)]
    df = spark.createDataFrame(rows, "fold string, config int, instability double, source_f1 double, held_f1 double, log_macs double, resolution double")
    got = {r["fold"]: r["statistic"] for r in bank.partial_rank_statistic(df, ["fold"]).collect()}
    assert [got[f"d{d}"] for d in range(3)] == pytest.approx(numpy_statistic(l, f, h, macs, res))


def test_degenerate_bank_is_null(spark):
    rows = [("d", c, 1.0, 0.5, 0.5, float(c), 1.0) for c in range(12)]
    df = spark.createDataFrame(rows, "fold string, config int, instability double, source_f1 double, held_f1 double, log_macs double, resolution double")
    assert bank.partial_rank_statistic(df, ["fold"]).first()["statistic"] is None


def test_union_of_comparisons(spark):
    rows = [("e", "a", 0.01, 0.02, 0.03, 0.04, True, True), ("e", "b", 0.2, 0.01, 0.01, 0.01, True, True)]
    s = "x string, candidate string, p_instability_vs_w double, p_instability_vs_stft double, p_f1_vs_w double, p_f1_vs_stft double, feasible boolean, measurement_valid boolean"
    assert decisions.intersection_union(spark.createDataFrame(rows, s), ["x"]).first()["raw_p"] == pytest.approx(0.08)
    bad = [rows[0], (*rows[1][:7], False)]
    assert decisions.intersection_union(spark.createDataFrame(bad, s), ["x"]).first()["status"] == "untestable"


def test_deletion_tradeoff_and_finalisation(spark):
    d = spark.createDataFrame([("e", "W", 0.01, 0.9, 0.2), ("e", "C", 0.03, 0.9, 0.2), ("g", "W", 0.01, 0.999, 0.001)], "x string, family string, raw_p double, cosine double, nmae double")
    assert {r["x"]: r["raw_p"] for r in decisions.deletion(d, ["x"]).collect()} == {"e": 0.03, "g": 1.0}
    t = spark.createDataFrame([("a", 0.01, 0.02, True, True, True), ("b", 0.01, 0.02, False, True, True), ("c", 0.01, None, True, True, True)], "x string, p_performance double, p_latency double, bytes_reduced boolean, macs_reduced boolean, measurement_valid boolean")
    assert {r["x"]: (r["status"], r["raw_p"]) for r in decisions.cost_tradeoff(t).collect()} == {"a": ("ok", 0.02), "b": ("ok", 1.0), "c": ("untestable", None)}
    raw = spark.createDataFrame([(x, h, "ok" if x == "e" or h != "H4" else "untestable", p) for x in "eg" for h, p in (("H1", 0.001), ("H2", 0.2), ("H3", 0.01), ("H4", 0.04))], "x string, hypothesis string, status string, raw_p double")
    out = {(r["x"], r["hypothesis"]): r["status"] for r in decisions.finalize(raw, ["x"]).collect()}
    assert out[("e", "H1")] == "supported" and out[("e", "H2")] == "negative" and out[("g", "H1")] == "untestable"


def test_near_duplicates_match_brute_force_even_in_one_crowd(spark):
    """Equal prints, a tight crowd of thousands, loose neighbours around the threshold, and strangers."""
    g = np.random.default_rng(8)
    base, far = g.normal(size=(2, 129))
    v = np.concatenate([base + g.normal(size=(2500, 129)) * 1e-5, base + g.normal(size=(60, 129)) * 0.03, far + g.normal(size=(40, 129)) * 0.025, g.normal(size=(40, 129))])
    v[:5], v[2600:2603] = v[0], v[2600]
    v -= v.mean(1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    roles = np.array(["a", "b", "c"])[np.arange(len(v)) % 3]
    df = spark.createDataFrame([(f"r{k:04d}", str(roles[k]), v[k].tolist()) for k in range(len(v))], "recording_id string, role string, unit array<double>")
    got = {r["recording_id"]: (r["role"], r["class_id"], r["class_size"], r["links"]) for r in audits.near_duplicates(df, 0.999).collect()}
    links = ((v @ v.T >= 0.999) & (roles[:, None] != roles)).sum(1)
    first = {}
    for k in range(len(v)):
        first.setdefault(v[k].tobytes(), []).append(k)
    want = {f"r{k:04d}": (str(roles[k]), f"r{m[0]:04d}", len(m), int(links[k])) for m in first.values() for k in m}
    assert [(k, got[k], want[k]) for k in sorted(want) if got.get(k) != want[k]][:5] == [] and len(got) == len(want)
    assert len(set(links.tolist())) > 5


def test_probe_needs_two_recordings_per_domain(spark):
    rows = [("k", f"r{n}", n % 2, [float(n % 2), 1.0]) for n in range(8)] + [("u", "x", 0, [1.0, 0.0]), ("u", "y", 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, recording_id string, cls int, values array<double>")
    out = {r["g"]: r["accuracy"] for r in audits.probe_accuracy(df, ["g"], F.lit(0)).collect()}
    assert out["k"] == 1.0 and out["u"] is None
