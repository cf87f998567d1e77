import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavehold.operators import metrics as m
from wavehold.plans.resampling import holm


def test_windows_are_averaged_before_scoring(spark):
    d = spark.createDataFrame(
        [("r1", 0, [0.9, 0.1]), ("r1", 0, [0.4, 0.6]), ("r2", 1, [0.3, 0.7]), ("r2", 1, [0.4, 0.6])], "recording_id string, truth int, probs array<double>")
    r = m.recording_mean_probs(d, [], 2)
    assert m.macro_f1(m.cells(r, []), []).first()["macro_f1"] == 1.0


def test_mixed_labels_in_a_recording_fail(spark):
    d = spark.createDataFrame([("r", 0, [1.0, 0.0]), ("r", 1, [0.0, 1.0])], "recording_id string, truth int, probs array<double>")
    with pytest.raises(Exception, match="differs inside a group"):
        m.recording_mean_probs(d, [], 2).collect()


def test_macro_f1_over_the_union_of_labels(spark):
    truth, pred = [0, 0, 1, 1, 2], [0, 3, 1, 0, 2]
    d = spark.createDataFrame(list(zip(truth, pred)), "truth int, pred int")
    t, p = np.array(truth), np.array(pred)
    f = []
    for c in sorted(set(truth) | set(pred)):
        tp, n, s = ((t == c) & (p == c)).sum(), (p == c).sum(), (t == c).sum()
        a, b = tp / max(n, 1), tp / max(s, 1)
        f.append(2 * a * b / max(a + b, 1e-12))
    assert m.macro_f1(m.cells(d, []), []).first()["macro_f1"] == pytest.approx(np.mean(f))
    assert m.confusion_matrix(m.cells(d, []), []).count() == 16


def test_argmax_takes_the_first_of_equals(spark):
    d = spark.createDataFrame([([0.4, 0.4, 0.2],)], "probs array<double>")
    assert d.select(m.argmax("probs").alias("k")).first()["k"] == 0


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.where(rng.random(400) < 0.4, 0.5, np.round(rng.random(400), 2))  # one score holds much of the data
    return y, s, spark.createDataFrame([(k, int(a), float(b)) for k, (a, b) in enumerate(zip(y, s))], "recording_id long, y int, score double")


def test_auroc_is_the_pairwise_statistic(scored):
    y, s, d = scored
    diff = s[y == 1][:, None] - s[y == 0][None]
    assert m.auroc(d, []).first()["auroc"] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_average_precision_breaks_ties_by_id(scored):
    y, s, d = scored
    z = y[np.argsort(-s, kind="stable")]
    want = (np.cumsum(z) / np.arange(1, len(z) + 1) * z).sum() / z.sum()
    assert m.average_precision(d, [], F.floor(F.col("recording_id") / 16)).first()["auprc"] == pytest.approx(want)


def test_single_class_scores_are_null(spark):
    d = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.4)], "recording_id long, y int, score double")
    assert m.auroc(d, []).first()["auroc"] is None


def test_threshold_and_area(spark):
    d = spark.createDataFrame([(0, 0.1, "a"), (0, 0.2, "a"), (0, 0.3, "b"), (0, 0.9, "b"), (1, 0.95, "b")], "y int, score double, domain string")
    assert m.source_thresholds(d, ["domain"]).agg(F.max("threshold")).first()[0] == 0.9
    c = spark.createDataFrame([("s", -10.0, 0.2), ("s", 0.0, 0.6), ("s", 10.0, 1.0), ("t", 1.0, 0.3)], "k string, severity double, value double")
    area = {r["k"]: r["area"] for r in m.curve_area(c, ["k"]).collect()}
    assert area["s"] == pytest.approx(0.6) and area["t"] is None


def test_calibration_against_numpy(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(3), 60)
    p[0] = [1.0, 0.0, 0.0]
    t = rng.integers(0, 3, 60)
    t[0] = 0
    d = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "truth int, probs array<double>").withColumn("pred", m.argmax("probs"))
    conf, hit = p.max(1), p.argmax(1) == t
    edges, ece = np.linspace(0, 1, 11), 0.0
    for k in range(10):
        mask = (conf >= edges[k]) & ((conf <= edges[k + 1]) if k == 9 else (conf < edges[k + 1]))
        if mask.any():
            ece += mask.mean() * abs(conf[mask].mean() - hit[mask].mean())
    r = m.calibration(d.withColumn("g", F.lit(1)), ["g"]).first()
    assert r["ece"] == pytest.approx(ece)
    assert r["brier"] == pytest.approx(((p - np.eye(3)[t]) ** 2).sum(1).mean())
    assert r["nll"] == pytest.approx(-np.log(np.clip(p[np.arange(60), t], 1e-12, 1)).mean())


def test_holm_and_midranks(spark):
    p = spark.createDataFrame([("e", "a", 0.01), ("e", "b", 0.03), ("e", "c", 0.2), ("e", "d", 0.04), ("e", "x", None)], "e string, h string, p double")
    out = {r["h"]: r["holm_p"] for r in holm(p, ["e"], "h", "p").collect()}
    assert out["x"] is None
    assert {k: v for k, v in out.items() if v is not None} == pytest.approx({"a": 0.04, "b": 0.09, "c": 0.2, "d": 0.09})
    d = spark.createDataFrame([("g", v) for v in (3.0, 1.0, 3.0, 2.0)], "g string, v double")
    assert sorted((r["v"], r["midrank"]) for r in m.midranks(d, ["g"], "v").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_effect_size_edges(spark):
    d = spark.createDataFrame([("one", 0.3), ("flat", 0.2), ("flat", 0.2), ("zero", 0.0), ("zero", 0.0), ("ok", 0.1), ("ok", 0.3)], "k string, diff double")
    out = {r["k"]: r["d"] for r in m.cohens_d(d, ["k"], "diff").collect()}
    assert out["one"] is None and math.isinf(out["flat"]) and out["zero"] == 0.0
    assert out["ok"] == pytest.approx(0.2 / np.std([0.1, 0.3], ddof=1))
