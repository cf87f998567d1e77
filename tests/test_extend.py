"""Extension points against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavehold.operators import extend as ex
from wavehold.operators.fit import source_only


def test_frame_table_function(spark):
    ex.register_frame(spark, "frame_t")
    rows = [(1, [float(k) for k in range(10)]), (2, [1.0]), (3, []), (4, None)]
    d = spark.createDataFrame(rows, "id int, x array<double>")
    out = spark.sql("SELECT d.id, f.* FROM {d} d, LATERAL frame_t(d.x, 4, 3) f", d=d).collect()
    want = [(1, s, s + 4, rows[0][1][s : s + 4]) for s in (0, 3, 6)]
    assert sorted(map(tuple, out)) == want


def test_user_perturbation_has_a_generator_per_window(spark):
    noisy = lambda x, g, s: x + s * g.normal(size=len(x))
    x = np.random.default_rng(3).normal(size=(9, 2, 6))
    d = spark.createDataFrame([(k, *w.tolist(), "kept") for k, w in enumerate(x)], "id long, i array<double>, q array<double>, note string")
    seed = lambda window, case: 100 + 10 * window + case
    runs = [ex.perturb_user(d.repartition(n), noisy, (0.5, 2.0), seed, "id") for n in (1, 5)]
    a, b = ({(r["id"], r["severity_index"]): (r["i"], r["q"], r["note"]) for r in run.collect()} for run in runs)
    assert a == b and len(a) == 18
    for (k, c), (i, q, note) in a.items():
        want = noisy(x[k, 0] + 1j * x[k, 1], np.random.default_rng(100 + 10 * k + c), (0.5, 2.0)[c])
        assert np.allclose(i, want.real) and np.allclose(q, want.imag) and note == "kept"


def test_user_perturbation_of_nulls_and_faults(spark):
    d = spark.createDataFrame([(1, None, None), (2, [], [])], "id long, i array<double>, q array<double>")
    out = {r["id"]: r["i"] for r in ex.perturb_user(d, lambda x, g, s: x, (1.0,), lambda w, c: w + c, "id").collect()}
    assert out == {1: None, 2: []}
    bad = spark.createDataFrame([(1, [1.0], [0.0])], d.schema)
    for function in (lambda x, g, s: x[:0], lambda x, g, s: x / 0.0 * np.nan):
        with pytest.raises(Exception, match="keeps the length"):
            ex.perturb_user(bad, function, (1.0,), lambda w, c: w + c, "id").collect()


class Centred:
    families = ("plain", "sign")

    def fit(self, source, keys):
        return source.groupBy(*keys).agg(F.avg("v").alias("centre"))

    def transform_by_family(self, windows, parameters, keys):
        d = windows.join(parameters, keys).withColumn("plain", F.array(F.col("v") - F.col("centre")))
        return d.withColumn("sign", F.array(F.signum(F.col("v")))).drop("centre")


def test_representation_is_fitted_on_source_rows_only(spark):
    s = "fold_id string, role string, v double"
    rows = spark.createDataFrame([("a", "source_fit", 1.0), ("a", "source_fit", 3.0), ("a", "held_target", 100.0), ("b", "source_fit", -1.0)], s)
    fitted = ex.fit_representation(Centred(), rows, ["fold_id"])
    out = {(r["fold_id"], r["v"]): r["values"] for r in fitted.transform(rows).collect()}
    assert out == {("a", 1.0): [-1.0, 1.0], ("a", 3.0): [1.0, 1.0], ("a", 100.0): [98.0, 1.0], ("b", -1.0): [0.0, -1.0]}
    frozen = lambda d: {r["fold_id"]: r["sha256"] for r in ex.fit_representation(Centred(), d, ["fold_id"]).source_artifact().collect()}
    before = frozen(rows)
    assert frozen(rows.where("role = 'source_fit'")) == before  # target rows do not touch it
    moved = frozen(rows.withColumn("v", F.when(F.col("fold_id") == "a", F.col("v") + 1).otherwise(F.col("v"))))
    assert moved["a"] != before["a"] and moved["b"] == before["b"]


def resampled(values, function, draws, seed=5):
    g = np.random.default_rng(seed)
    return np.quantile([function([values[k] for k in g.integers(0, len(values), len(values))]) for _ in range(draws)], [0.025, 0.975])


def test_user_statistic_of_sums(spark):
    g = np.random.default_rng(1)
    blocks = [g.normal(5, 1 + k % 3, size=3 + k % 4) for k in range(40)]
    rows = [("k", b, float(z)) for b, block in enumerate(blocks) for z in block] + [("one", 0, 1.0), ("one", 0, 2.0), ("k", 0, None)]
    d = spark.createDataFrame(rows, "k string, block long, z double")
    sums = {"n": F.when(F.col("z").isNotNull(), 1.0), "x": F.col("z"), "xx": F.col("z") ** 2}
    spread = lambda s: F.sqrt(s["xx"] / s["n"] - (s["x"] / s["n"]) ** 2)
    out = {r["k"]: r for r in ex.bootstrap_of_sums(d, ["k"], "block", sums, spread, 4000, 7, F.lit(0)).collect()}
    assert out["k"]["blocks"] == 40 and np.isclose(out["k"]["estimate"], np.concatenate(blocks).std())
    low, high = resampled(blocks, lambda drawn: np.concatenate(drawn).std(), 4000)
    assert abs(out["k"]["low"] - low) < 0.05 and abs(out["k"]["high"] - high) < 0.05
    assert out["one"]["blocks"] == 1 and out["one"]["low"] is None and np.isclose(out["one"]["estimate"], 0.5)


def test_user_statistic_of_rows(spark):
    x = np.random.default_rng(2).exponential(size=61)
    d = spark.createDataFrame([("k", k, float(z)) for k, z in enumerate(x)], "k string, recording_id long, z double")
    median = lambda value, weight: F.percentile(value, F.lit(0.5), F.col(weight))
    out = ex.bootstrap_of_values(d, ["k"], "z", median, 2000, 7, F.lit(0)).first()
    assert out["blocks"] == 61 and np.isclose(out["estimate"], np.median(x))
    low, high = resampled(list(x), np.median, 4000)
    assert abs(out["low"] - low) < 0.1 and abs(out["high"] - high) < 0.1


def test_extension_points_on_empty_tables(spark):
    empty = spark.createDataFrame([], "fold_id string, role string, v double, recording_id long")
    assert ex.fit_representation(Centred(), empty, ["fold_id"]).transform(empty).isEmpty()
    assert source_only(empty).isEmpty()
    assert ex.bootstrap_of_sums(empty, ["fold_id"], "recording_id", {"x": F.col("v")}, lambda s: s["x"], 10, 1, F.lit(0)).isEmpty()
