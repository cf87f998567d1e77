"""Permuted ridge probes against plain refits, draw by draw."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wavehold.plans import draws as dr, permutation as pm


def table(spark, n, far=0.0, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in ("a", "b"):
        for k in range(n if g == "a" else n + 4):
            c = int(rng.integers(classes))
            rows.append((g, f"r{k:04d}", c, [float(v) for v in rng.normal(size=4) + far + np.eye(4)[c] * 1.5], "fit" if k % 3 else "eval"))
    return rows, spark.createDataFrame(rows, "g string, recording_id string, cls int, values array<double>, part string")


def labels(rows, key, seed, draws):
    """Labels in id order of each draw, from the cumulative class counts."""
    cls = np.array([r[2] for r in rows])
    order = np.sort(cls)
    return order[dr.permuted(dr.round_keys(seed, (key,), range(draws), len(cls)), np.arange(len(cls)), len(cls))]


def refit(x, y, classes, l2):
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.linalg.solve(z.T @ z + l2 * np.eye(z.shape[1]), z.T @ np.eye(classes)[y])
    return lambda v: (np.column_stack([(v - mean) / scale, np.ones(len(v))]) @ w).argmax(1)


def test_cells_equal_refits(spark, monkeypatch):
    monkeypatch.setattr(pm, "CHUNK", 7)
    monkeypatch.setattr(pm, "SEEN", 200)
    for far in (0.0, 1e8):
        rows, df = table(spark, 40, far)
        fits = pm.permuted_fits(df.where("part = 'fit'"), ["g"], 3, 20, 5, 0.05, F.lit(0))
        got = pm.permuted_cells(fits, df.where("part = 'eval'"), ["g"], 3).collect()
        want = Counter()
        for g in ("a", "b"):
            fit = sorted((r for r in rows if r[0] == g and r[4] == "fit"), key=lambda r: r[1])
            ev = [r for r in rows if r[0] == g and r[4] == "eval"]
            x, e = np.array([r[3] for r in fit]) - far, np.array([r[3] for r in ev]) - far
            for b, y in enumerate([*labels(fit, g, 5, 20), np.array([r[2] for r in fit])]):
                want.update((g, -1 if b == 20 else b, r[2], int(p)) for r, p in zip(ev, refit(x, y, 3, 0.05)(e)))
        assert {(r.g, r.draw, r.truth, r.pred): r.n for r in got} == want


def test_probe_null_equals_refits_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(pm, "ROWS", 6)
    monkeypatch.setattr(pm, "CHUNK", 5)
    rows, df = table(spark, 31, seed=2)
    got = {(r.g, r.draw): r.accuracy for r in pm.probe_null(df, ["g"], 3, 12, 9, block=F.lit(0)).collect()}
    assert len(got) == 24
    for g in ("a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        x = np.array([r[3] for r in own])
        for b, y in enumerate(labels(own, g, 9, 12)):
            train = np.zeros(len(y), bool)
            for c in range(3):
                train[np.flatnonzero(y == c)[::2]] = True
            assert np.isclose(got[g, b], (refit(x[train], y[train], 3, 0.05)(x[~train]) == y[~train]).mean())
