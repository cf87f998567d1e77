import numpy as np
import pytest
from pyspark.sql import functions as F

from wavehold.operators import costs, fit, probe
from wavehold.operators.transforms import Config, fixed_bank, selection_bank, zigzag_rank
from wavehold.functions.kernels import zigzag

rng = np.random.default_rng(2)


@pytest.fixture(scope="module")
def data(spark):
    x = rng.normal(size=(120, 6)) * [1, 2, 3, 1, 1, 5] + 1
    y = rng.integers(0, 3, 120)
    roles = np.where(np.arange(120) < 90, "source_fit", "held_target")
    rows = [(k, "f", str(roles[k]), int(y[k]), x[k].tolist()) for k in range(120)]
    return x, y, spark.createDataFrame(rows, "id long, fold_id string, role string, cls int, values array<double>").repartition(5)


def direct_ridge(x, y, l2, dual=False):
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    t = np.eye(3)[y]
    if dual:
        return mean, scale, z.T @ np.linalg.solve(z @ z.T + l2 * np.eye(len(z)), t)
    return mean, scale, np.linalg.solve(z.T @ z + l2 * np.eye(z.shape[1]), z.T @ t)


def test_ridge_from_sums_equals_direct_primal_and_dual(data):
    x, y, df = data
    row = probe.fit_ridge(df, ["fold_id"], 3).first()
    got = np.array(row["weights"]).reshape(7, 3)
    for dual in (False, True):
        assert np.allclose(got, direct_ridge(x[:90], y[:90], 0.01, dual)[2], atol=1e-8)
    assert row["n"] == 90


def test_both_scoring_paths_agree(data):
    x, y, df = data
    model = probe.fit_ridge(df, ["fold_id"], 3)
    a = {r["id"]: r["probs"] for r in probe._score_sent(df, model, ["fold_id"], ["id"], 3).collect()}
    b = {r["id"]: r["probs"] for r in probe._score_joined(df, model, ["fold_id"], ["id"], 3).collect()}
    mean, scale, w = direct_ridge(x[:90], y[:90], 0.01)
    l = np.column_stack([(x - mean) / scale, np.ones(120)]) @ w
    e = np.exp(l - l.max(1, keepdims=True))
    for k in range(120):
        assert np.allclose(a[k], b[k]) and np.allclose(a[k], e[k] / e[k].sum())


def test_partial_sums_may_be_flushed(data, monkeypatch):
    _, _, df = data
    before = np.array(probe.fit_ridge(df, ["fold_id"], 3).first()["weights"])
    monkeypatch.setattr(probe, "FLUSH", 1)
    assert np.allclose(before, probe.fit_ridge(df, ["fold_id"], 3).first()["weights"])


def test_normalisers_see_source_fit_only(data):
    x, _, df = data
    p = fit.fit_percentile(df, ["fold_id"]).first()
    low, high = np.percentile(x[:90], [1, 99])
    assert p["offset"] == pytest.approx(low) and p["scale"] == pytest.approx(high - low)
    z = fit.fit_zscore(df, ["fold_id"]).first()
    assert z["offset"] == pytest.approx(x[:90].mean()) and z["scale"] == pytest.approx(x[:90].std())
    a, b = fit.channel_standardizer(df, ["fold_id"]).first(), fit.channel_stats_one_pass(df, ["fold_id"]).first()
    assert a["mean"] == pytest.approx(b["mean"]) and a["scale"] == pytest.approx(b["scale"])
    out = fit.apply_normalizer(df, fit.fit_percentile(df, ["fold_id"]), ["fold_id"])
    assert out.select(F.max(F.array_max("values")), F.min(F.array_min("values"))).first() == (1.0, 0.0)


def test_missing_class_fails(data):
    _, _, df = data
    with pytest.raises(Exception, match="does not occur"):
        fit.class_weights(df, "cls", 4).collect()


def test_temperature_recovers_a_scale(spark):
    g = np.random.default_rng(9)
    z = g.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(g.choice(3, p=r)) for r in p]
    df = spark.createDataFrame([("k", str(n % 50), y[n], (z[n] * 3).tolist()) for n in range(4000)], "k string, recording_id string, truth int, logits array<double>")
    r = fit.fit_temperature(df, ["k"]).first()
    assert r["temperature"] == pytest.approx(3.0, rel=0.1) and not r["at_bound"]


def test_costs_and_budget(spark):
    full = Config("x", "WCES")
    row = costs.representation_cost(spark.createDataFrame([(4096,)], "n int"), [full]).first()
    assert row["bytes_per_sample"] == 4096.0
    assert len(selection_bank()) == 25 and len({c.stable_id for c in selection_bank()}) == 25 and len(fixed_bank()) == 12
    d = spark.createDataFrame([("a", 4096.0, 100.0, 1e8, True), ("b", 8192.0, 100.0, 1e8, False)], "c string, bytes_per_sample double, batch1_latency_ms double, estimated_macs double, measurement_valid boolean")
    out = {r["c"]: r for r in costs.budget_check(d).collect()}
    assert out["a"]["feasible"] and out["b"]["failures"] == ["invalid_batch1_latency_measurement", "bytes_per_sample"]
    seeds = spark.createDataFrame([(10.0, 20.0, 10.0, 64.0, 3.0, 2.0, 5.0, True), (10.0, 20.0, 10.0, 64.0, 3.0, 2.0, 7.0, True)],
                                  "parameters double, model_macs double, representation_macs double, bytes_per_sample double, model_ms double, representation_ms double, peak_bytes double, valid boolean")
    e = costs.ensemble_cost(seeds, []).first()
    assert (e["macs"], e["median_ms"], e["peak_bytes"]) == (50.0, 8.0, 7.0)


def test_zigzag_closed_form(spark):
    n = 6
    order = {rc: k for k, rc in enumerate(zigzag(n))}
    d = spark.createDataFrame(list(order), "r int, c int").select("r", "c", zigzag_rank(F.col("r"), F.col("c"), n).alias("k"))
    assert {(x["r"], x["c"]): x["k"] for x in d.collect()} == order


def test_ridge_keeps_its_digits_far_from_zero(spark):
    """Mean 1e8 and deviation 1 give the weights and predictions of a centred solve."""
    import numpy as np
    from wavehold.operators import probe

    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    near = rng.normal(size=(300, 5)) + np.eye(5)[y]
    rows = [(str(k % 2), "source_fit", int(y[k]), (near[k] + 1e8).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, role string, cls int, values array<double>").repartition(4)
    for r in probe.fit_ridge(df, ["g"], 3, 0.01).collect():
        x, t = (near + 1e8 - 1e8)[int(r["g"]) :: 2], y[int(r["g"]) :: 2]
        z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
        want = np.linalg.solve(z.T @ z + 0.01 * np.eye(6), z.T @ np.eye(3)[t])
        assert np.allclose(r["scale"], x.std(0), rtol=1e-6) and np.allclose(np.array(r["mean"]) - 1e8, x.mean(0), atol=1e-6)
        assert np.allclose(np.array(r["weights"]).reshape(6, 3), want, atol=1e-6)
    whole = probe.fit_ridge(df, [], 3, 0.01).first()
    assert np.allclose(whole["scale"], (near + 1e8 - 1e8).std(0), rtol=1e-6)
