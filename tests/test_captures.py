import numpy as np
import pytest

from wavehold.sources import captures


def test_one_long_file_is_many_tasks_and_a_slice_opens_its_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    i, q = rng.normal(size=(2, 10_003)).astype("<f4")
    folder = f"file://{tmp_path}/raw"
    captures.write_capture(folder, "long.iq", i, q)
    captures.write_capture(folder, "short.iq", i[:5], q[:5])
    captures.write_capture(folder, "empty.iq", i[:0], q[:0])
    df = captures.read_captures(spark, folder, chunk=16, partition_bytes=4096)
    assert df.rdd.getNumPartitions() == 21  # 20 stretches of 32 chunks, and the short file
    rows = sorted(df.where("path = 'long.iq'").collect(), key=lambda r: r.chunk_no)
    assert [r.chunk_no for r in rows] == list(range(626)) and len(rows[-1].i) == 3
    assert np.array_equal(np.concatenate([r.i for r in rows]).astype("<f4"), i)
    assert np.array_equal(np.concatenate([r.q for r in rows]).astype("<f4"), q)
    part = df.where("path = 'long.iq' AND chunk_no >= 100 AND chunk_no < 130")
    assert part.rdd.getNumPartitions() == 1
    assert sorted(r.chunk_no for r in part.collect()) == list(range(100, 130))
    assert df.where("chunk_no = 625").count() == 1 and df.where("chunk_no = 9999").count() == 0
    assert [len(r.i) for r in captures.read_captures(spark, folder + "/short.iq", chunk=4).collect()] == [4, 1]


def test_odd_bytes_are_an_error(spark, tmp_path):
    (tmp_path / "bad.iq").write_bytes(b"123456789")
    with pytest.raises(Exception, match="whole I/Q pairs"):
        captures.read_captures(spark, f"file://{tmp_path}").count()
