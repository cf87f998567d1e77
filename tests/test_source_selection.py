"""Feature vectors are put together where their window's maps are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavehold.operators import transforms as tr
from wavehold.plans import quantiles as qt, source_selection as ss

KERNELS = {"w": lambda x: np.abs(x)[:, :3], "c": lambda x: x.real, "e": lambda x: np.abs(x[:, :2]) ** 2}
MEMBERS = [("d0", "A", "W", "w", "none"), ("d0", "A", "E", "e", "energy"), ("d0", "A", "C", "c", "percentile"), ("d1", "B", "C", "c", "zscore")]


@pytest.fixture
def placed(spark):
    g = np.random.default_rng(4)
    roles = lambda k: [("d0", "source_fit" if k < 3 else "held_target"), ("d1", "source_fit" if k > 1 else "source_selection")]
    rows = [(n, f"r{n % 5}", n % 2, roles(n % 5), g.normal(size=4).tolist(), g.normal(size=4).tolist()) for n in range(60)]
    return spark.createDataFrame(rows, "vec_id long, recording_id string, cls int, roles array<struct<fold_id string, role string>>, i array<double>, q array<double>")


def test_bank_rows_hold_the_maps_of_the_long_form(placed):
    bank = {r["vec_id"]: r["maps"] for r in tr.map_bank(placed, ["vec_id"], KERNELS).collect()}
    for r in tr.map_windows(placed, ["vec_id"], KERNELS).collect():
        assert bank[r["vec_id"]][list(KERNELS).index(r["family"])] == r["values"]


def test_vectors_are_assembled_without_a_shuffle(placed):
    raw = tr.map_bank(placed, ["vec_id", "recording_id", "cls", "roles"], KERNELS)
    scalers = ss.fit_scalers(raw, KERNELS, MEMBERS)
    fitted = {(r["fold_id"], r["family"], r["mode"]): (r["offset"], r["scale"]) for r in scalers.collect()}
    out = ss.assembled(raw, KERNELS, MEMBERS, scalers)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    maps = {r["vec_id"]: r["maps"] for r in raw.collect()}
    rows = out.collect()
    assert len(rows) == 36 + 60 and {r["role"] for r in rows} == {"source_fit", "source_selection"}
    for r in rows:
        w, c, e = (np.array(m) for m in maps[r["vec_id"]])
        (po, p), (zo, z), energy = fitted["d0", "c", "percentile"], fitted["d1", "c", "zscore"], fitted["d0", "e", "energy"][1]
        want = (c - zo) / z if r["config_id"] == "B" else np.concatenate([w, np.clip((c - po) / p, 0, 1), np.log1p(e / energy)])
        assert np.allclose(r["values"], want, rtol=1e-6, atol=1e-7)


def test_refined_quantiles_leave_the_values_where_they_are(spark, monkeypatch):
    """The tables of ranks are small; joins with them must not shuffle every value in each pass."""
    sizes = []
    monkeypatch.setattr(qt, "sized", lambda df, keep=qt.sized: sizes.append(keep(df)) or sizes[-1])
    d = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    got = {r["k"]: (r["a"], r["b"]) for r in qt.exact_quantiles(d, ["k"], "v", {"a": 0.01, "b": 0.99}, limit=100).collect()}
    v = np.arange(4000) * 7919 % 4001
    assert got == {k: tuple(pytest.approx(x) for x in np.quantile(v[k::2], [0.01, 0.99])) for k in (0, 1)}
    assert sizes and all("LocalTableScan" in s._jdf.queryExecution().executedPlan().toString() for s in sizes)
