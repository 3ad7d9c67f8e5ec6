import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pricelens.session import get_session
    s = get_session("local[4]", app="pricelens-tests", shuffle_partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pricelens-test-ckpt-"))
    yield s


def rows(df, *cols):
    cols = cols or df.columns
    return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}


def approx(a, b, tol=1e-6):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol
