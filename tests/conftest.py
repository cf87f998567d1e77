import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from wavehold.session import local_session

    s = local_session("tests", "4")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    def collect(df, *order):
        out = [r.asDict() for r in df.collect()]
        return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out

    return collect
