import duckdb
import numpy as np
import pytest

from wavehold.plans import draws as dr


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000])
def test_permutations_are_one_to_one_and_need_no_neighbours(n):
    base = dr.round_keys(7, ("g",), range(50), n)
    whole = dr.permuted(base, np.arange(n), n)
    assert (np.sort(whole, axis=1) == np.arange(n)).all()
    some = np.arange(n)[::3]
    assert (dr.permuted(tuple(k[:, 10:20] for k in base), some, n) == whole[10:20][:, some]).all()


def test_permutations_are_even():
    """Every arrangement of four, and every pair of places among ten, is about as frequent as any other."""
    p = dr.permuted(dr.round_keys(3, (), range(24_000), 4), np.arange(4), 4)
    seen = np.unique(p @ [64, 16, 4, 1], return_counts=True)[1]
    assert len(seen) == 24 and ((seen - 1000) ** 2 / 1000).sum() < 60  # 23 degrees of freedom
    p = dr.permuted(dr.round_keys(4, (), range(18_000), 10), np.arange(10), 10)
    for a, b in ((0, 1), (2, 9), (5, 6)):
        seen = np.bincount(p[:, a] * 10 + p[:, b], minlength=100).reshape(10, 10)
        assert (np.diag(seen) == 0).all()
        assert ((seen[~np.eye(10, dtype=bool)] - 200) ** 2 / 200).sum() < 150  # 89 degrees of freedom


def test_resample_counts_have_the_multinomial_moments():
    n, draws = 2 * dr.BLOCK + 500, 600
    counts = np.stack([dr.block_counts(5, ("s",), n, b, draws) for b in range(3)])
    assert (counts.sum(axis=0) == n).all()
    share = np.array([dr.BLOCK, dr.BLOCK, 500]) / n
    assert np.abs(counts.mean(axis=1) - n * share).max() < 5 * np.sqrt(n / draws)
    assert np.allclose(counts.var(axis=1), n * share * (1 - share), rtol=0.25)
    size = 40
    one = dr.resampled(6, ("s",), size, 0, 4000, np.eye(size))
    assert (one.sum(axis=1) == size).all()
    assert abs(one.var() - (1 - 1 / size)) < 0.03 and np.abs(one.mean(axis=0) - 1).max() < 0.08
    assert (dr.resampled(6, ("s",), size, 0, 4000, np.eye(size), at_once=500) == one).all()


def test_sql_twins_agree():
    con = duckdb.connect()
    for n in (1, 5, 16, 61):
        sql = f"WITH s AS (SELECT 'a' AS g, i AS pos, {n} AS n FROM range({n}) t(i)){dr.sql_permuted('s', ['g'], '11', 30, 'p')} SELECT draw, pos, moved FROM p ORDER BY draw, pos"
        got = np.array(con.execute(sql).fetchall())
        assert (got[:, 2].reshape(30, n) == dr.permuted(dr.round_keys(11, ("a",), range(30), n), np.arange(n), n)).all()
        sql = f"WITH s AS (SELECT 'a' AS g, {n} AS sz){dr.sql_slots('s', ['g'], '11', 30, 'p')} SELECT draw, loc, count(*) FROM p GROUP BY ALL ORDER BY 1, 2"
        want = dr.resampled(11, ("a",), n, 0, 30, np.eye(n))
        assert con.execute(sql).fetchall() == [(a, b, int(want[a, b])) for a, b in zip(*np.nonzero(want))]
