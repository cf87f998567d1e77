"""Draws are made once per set of strata, in 32 bits, and their sums travel together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wavehold.plans import draws as dr, resampling as rs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4096])
def test_cells_are_the_slots(size):
    counts = np.random.default_rng(size).binomial(size * 3, 0.3, 50)
    base = dr.keyed(3, ("s",), range(50), 1)
    draw, at = dr.slots(base, counts, size)
    assert (dr.slot_cells(base, counts, size) == draw * size + at).all()


@pytest.mark.parametrize("name, sets", [("decision_ladders", 1), ("finalize_hypotheses", 3), ("h1_intersection_union", 1), ("h3_deletion", 1)])
def test_one_set_of_draws_for_equal_strata(spark, monkeypatch, name, sets):
    made, whole = [], rs.draw_sums
    monkeypatch.setattr(rs, "draw_sums", lambda rows, stratum, *more, **named: made.append(tuple(stratum)) or whole(rows, stratum, *more, **named))
    assert entry.queries()[name](spark, SF).columns[0] == "experiment"
    assert len(made) == len(set(made)) == sets


def test_sums_of_draws_travel_in_few_rows(spark, monkeypatch):
    r = spark.createDataFrame([("a", f"r{k:03d}", [float(k), 1.0]) for k in range(50)], "fold string, recording_id string, v array<double>")
    read = lambda: {x["draw"]: tuple(x["sums"]) for x in rs.draw_sums(r, ["fold"], "v", 1010, 7, F.lit(0)).collect()}
    want = read()
    monkeypatch.setattr(rs, "TOGETHER", 7)
    assert read() == want and sorted(want) == list(range(1010)) and {s[1] for s in want.values()} == {50.0}
