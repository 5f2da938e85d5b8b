"""Streams lose nothing: windows open at the end, rows out of order over several micro-batches, repeated batches."""
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.schema import EVENTS
from pulsegrid.streaming import stream as st


@pytest.fixture()
def feed(spark, tmp_path):
    """A folder of files, one to a micro-batch, each with rows from the whole time."""
    def make(rows, files=3):
        rows = list(rows)
        random.Random(5).shuffle(rows)
        for k in range(files):
            spark.createDataFrame(rows[k::files], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return st.with_event_time(st.read_event_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    return make


def rows(n=400):
    r = random.Random(1)
    return [(f"r{k % 2}", k, r.randrange(8), r.randrange(8), k % 2, r.randrange(20_000_000)) for k in range(n)]


def test_every_window_is_written(feed):
    data = rows()
    got = {(r.rec_id, r.bin): r.n for r in st.run_to_end(feed(data), lambda s: st.event_rate(s, 700_000), "rate").collect()}
    want = {}
    for e in data:
        want[e[0], e[5] // 700_000] = want.get((e[0], e[5] // 700_000), 0) + 1
    assert got == want


def test_every_session_is_written(feed):
    data = [("r", k, 0, 0, 1, t) for k, t in enumerate([0, 5, 100, 104, 108, 9_000_000])]
    got = st.run_to_end(feed(data), lambda s: st.sessions(s, 50), "sessions").collect()
    assert sorted((r.t0, r.t1, r.n) for r in got) == [(0, 55, 2), (100, 158, 3), (9_000_000, 9_000_050, 1)]


def test_two_aggregations_in_a_row_are_emptied(feed):
    data = [("r", k, 1, 1, 1, k * 25_000 + 7) for k in range(400)]
    got = st.run_to_end(feed(data), lambda s: st.spectra(s, 4_000_000, 4_000_000, 100.0, 2.0, 49.0, 16, 10), "spectra").collect()
    assert sorted((r.t0, r.n_events) for r in got) == [(0, 160), (4_000_000, 160), (8_000_000, 80)]
    assert all(abs(r.peak_freq - 40.0) < 0.3 for r in got)


def test_late_rows_survive_a_repeated_batch(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for t in ([10_000, 20_000], [1_000, 30_000], [2_000, 29_000]):
        spark.createDataFrame([("r", k, 0, 0, 1, x) for k, x in enumerate(t)], EVENTS).coalesce(1).write.mode("append").parquet(path)
        st.late_rows(st.read_event_stream(spark, path), out, 5_000)
    got = spark.read.parquet(f"{out}/late").orderBy("epoch").collect()
    assert [(r.epoch, r.n_late, r.oldest) for r in got] == [(1, 1, 1_000), (2, 1, 2_000)]
    assert spark.read.parquet(f"{out}/seen/epoch=2").select(F.max("newest")).first()[0] == 30_000
