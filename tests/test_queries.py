"""Registered queries against their SQL twins; WAVEHOLD_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from wavehold import catalog

SF = "/root/testdata/sf0.001"
FEW = ("held_domain_macro_f1", "macro_f1", "frame_windows", "assign_source_roles", "scattering_map", "fit_ridge", "source_instability",
       "pareto_front", "build_relations", "bootstrap_macro_f1", "stable_content_hash", "average_precision")
NAMES = sorted(catalog.load()[0]) if os.environ.get("WAVEHOLD_ALL") else FEW


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        assert got
        return
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == check.rows_of(names, cur.fetchall())


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.load()[0]) <= set(entry.queries())
