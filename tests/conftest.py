import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "pulsegrid-tests", "6g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Build an event table from arrays (rec defaults to one recording)."""
    def make(x, y, t, p=None, rec="r"):
        n = len(t)
        d = pd.DataFrame({"rec_id": rec if not np.isscalar(rec) else [rec] * n, "seq": np.arange(n), "x": np.broadcast_to(x, n),
                          "y": np.broadcast_to(y, n), "p": np.ones(n, int) if p is None else np.broadcast_to(p, n), "t": t})
        return spark.createDataFrame(d.astype({"x": "int32", "y": "int32", "p": "int32", "seq": "int64", "t": "int64"}),
                                     "rec_id string, seq long, x int, y int, p int, t long")
    return make


def bursts(freq, seconds, per=20, seed=0, width=0.2):
    """Event times (us) bunched into a fifth of every period."""
    r = np.random.default_rng(seed)
    k = np.repeat(np.arange(int(seconds * freq)), per)
    return np.sort(((k + width * r.random(len(k))) / freq * 1e6).astype(np.int64))
