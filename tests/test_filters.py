"""Exact small cases and brute force for the denoise filters, batch and streaming."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import background as bg, denoise as dn
from pulsegrid.sources.sinks import shared_folder
from pulsegrid.streaming import stream as st


def kept(df):
    return sorted(r.seq for r in df.select("seq").collect())


def brute_refractory(x, y, t, p):
    last, out = {}, []
    for i in range(len(t)):
        k = (x[i], y[i])
        if t[i] - last.get(k, -10**15) >= p:
            out.append(i)
            last[k] = t[i]
    return out


def brute_baf(x, y, t, dt):
    last, out = {}, []
    for i in range(len(t)):
        near = [last.get((x[i] + a, y[i] + b), -10**15) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
        if t[i] - max(near) <= dt:
            out.append(i)
        last[(x[i], y[i])] = t[i]
    return out


def scene(seed=0, n=600):
    """One pixel holds half of all events and never pauses, so its chain crosses every chunk."""
    r = np.random.default_rng(seed)
    t = np.sort(r.integers(0, 60_000, n))
    hot = r.random(n) < 0.5
    return np.where(hot, 3, r.integers(0, 8, n)), np.where(hot, 3, r.integers(0, 8, n)), t


@pytest.mark.parametrize("period,chunk", [(70, 200), (450, 1000), (5000, 5000)])
def test_refractory_matches_sequential(events, period, chunk):
    x, y, t = scene()
    assert kept(dn.refractory_filter(events(x, y, t), period, chunk)) == brute_refractory(x, y, t, period)


def test_refractory_dead_time_runs_from_kept_event(events):
    assert kept(dn.refractory_filter(events(5, 5, [0, 600, 1200, 100_000]), 1000)) == [0, 2, 3]


@pytest.mark.parametrize("dt,chunk", [(300, 1000), (4000, 4000)])
def test_baf_matches_sequential(events, dt, chunk):
    x, y, t = scene(2)
    assert kept(dn.baf_filter(events(x, y, t), dt, chunk)) == brute_baf(x, y, t, dt)


def test_stuck_pixel_dropped(events):
    r = np.random.default_rng(1)
    x, y = np.r_[r.integers(0, 50, 5000), np.full(2000, 5)], np.r_[r.integers(0, 50, 5000), np.full(2000, 5)]
    e = events(x, y, np.arange(7000))
    assert dn.hot_pixel_mask(e, 99.9).where("x = 5 AND y = 5").count() == 0
    assert dn.hot_pixel_mask(events([1, 2, 3], 0, [0, 1, 2]), 99.0).count() == 0     # a uniform scene goes entirely


def test_chain_masks_see_the_original(events):
    x, y, t = scene(4)
    p = np.arange(600) % 2
    got = kept(dn.denoise_chain(events(x, y, t, p), "on", None, 450, 300))
    both = set(brute_refractory(x, y, t, 450)) & set(brute_baf(x, y, t, 300))
    assert got == sorted(i for i in both if p[i] == 1)


def test_reference_at_zero_pulse_is_empty(spark, events):
    pulses = spark.createDataFrame([("r", k, k * 1000) for k in range(5)], "rec_id string, k long, t long")
    e = events([1, 1, 5], 1, [10, 1010, 2020])
    assert bg.rotation_reference(e, pulses, 8, 8, 1).count() == 0
    assert kept(bg.rotation_foreground(e, pulses, 8, 8, 2, 36)) == [2]              # same phase and pixel as event 0 goes


def test_stream_filters_carry_state_between_batches(spark, events):
    x, y, t = scene(7)
    e = events(x, y, t)
    folder = shared_folder(spark, "stream-test")
    for lo, hi in ((0, 20_000), (20_000, 40_000), (40_000, 60_001)):                # three files, in time order
        e.where(F.col("t").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(folder)

    def ordered():
        return st.read_event_stream(spark, folder, e.schema, files_per_trigger=1)

    outs = [st.run_available(st.refractory(ordered(), 450), "r"), st.run_available(st.baf(ordered(), 300, 4), "b")]
    got_r, got_b = kept(outs[0]), kept(outs[1])
    assert got_r == brute_refractory(x, y, t, 450)
    assert got_b == brute_baf(x, y, t, 300)


def test_baf_is_judged_batch_by_batch(spark, events):
    """Pieces longer than a batch and batches of several pieces give the same; no piece is gathered in Python."""
    r = np.random.default_rng(8)
    n = 900
    t, x, y = np.sort(r.integers(0, 6000, n)), r.integers(0, 20, n), r.integers(0, 20, n)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("5", "64"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            out = dn.baf_filter(events(x, y, t), 40, 500, tile=8)
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
            assert kept(out) == brute_baf(x, y, t, 40)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
