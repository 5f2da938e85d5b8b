"""Fast sums against the sums themselves, and series of any length against one transform of the whole."""
import numpy as np
import pandas as pd
import pytest

from conftest import bursts
from pulsegrid.functions.spectral import transform_rows
from pulsegrid.operators import fourier as fo, spectra as sp


def test_fast_sums_equal_direct_sums(spark, events):
    r = np.random.default_rng(3)
    t = np.sort(r.integers(0, 3_600_000_000, 3000))                        # an hour
    e = events(0, 0, t, r.integers(0, 2, 3000))
    f = 40.0 + 0.7 * np.arange(90)
    z = np.exp(-2j * np.pi * np.outer(f, t / 1e6))
    got = sp.nudft(e, ["rec_id"], f.tolist()).orderBy("k").toPandas()
    assert np.allclose(got.power, np.abs(z.sum(1)) ** 2 / 3000 ** 2, atol=1e-9)
    w = e.toPandas().sort_values("seq").p.to_numpy() - e.toPandas().p.mean()
    got = sp.nudft(e, ["rec_id"], f.tolist(), "p").orderBy("k").toPandas()
    assert np.allclose(got.power, np.abs((z * w).sum(1)) ** 2 / 3000 ** 2, atol=1e-9)


def test_cost_follows_events_and_grid(spark, events):
    """Spreading makes a fixed number of rows for each event, however many frequencies are asked for."""
    e = events(0, 0, np.arange(100) * 1000)
    plan = sp.nufft_spectrum(e, 10.0, 800.0, 5000)._jdf.queryExecution().toString()
    assert plan.count("Generate explode") <= 4 and "Generate posexplode" not in plan


def test_lomb_scargle_literal(spark, events):
    t = np.sort(np.random.default_rng(0).integers(0, 2_000_000, 500))
    got = sp.lomb_scargle(events(0, 0, t), 5.0, 60.0, 40, literal=True).orderBy("k").toPandas()
    ts = (t - t[0]) / 1e6
    y = np.sin(2 * np.pi * ts)
    w = 2 * np.pi * (5.0 + np.arange(40) * 55.0 / 39)
    tau = np.arctan2(np.sin(2 * np.outer(w, ts)).sum(1), np.cos(2 * np.outer(w, ts)).sum(1)) / (2 * w)
    a = w[:, None] * (ts[None] - tau[:, None])
    want = ((y * np.cos(a)).sum(1) ** 2 / (np.cos(a) ** 2).sum(1) + (y * np.sin(a)).sum(1) ** 2 / (np.sin(a) ** 2).sum(1)) / (y * y).sum()
    assert np.allclose(got.power, want, atol=1e-9)


@pytest.mark.parametrize("n", [97, 1000, 1024, 4999])
@pytest.mark.parametrize("kind", ["power", "raw"])
def test_blocks_equal_one_transform(spark, n, kind):
    r = np.random.default_rng(n)
    at = np.sort(r.choice(n, n // 3, replace=False))
    c = r.integers(1, 9, len(at))
    got = fo.long_power(spark.createDataFrame(pd.DataFrame({"g": 1, "n_bins": n, "bin": at, "c": c})), ["g"], kind).orderBy("k").toPandas()
    x = np.zeros(n)
    x[at] = c
    want = transform_rows(x[None], kind)[0]
    assert got.k.tolist() == list(range(n // 2 + 1)) and np.allclose(got.power, want, rtol=1e-8, atol=want.max() * 1e-10)


def test_long_and_short_routes_agree(spark, events, monkeypatch):
    e = events(np.arange(4000) % 3, 0, bursts(20, 10.0)[:4000])
    track = spark.createDataFrame([("r", 1, int(t), 1.0, 0.0, 4.0, 4.0) for t in range(0, 10_000_000, 500_000)], "rec_id string, target_id long, t long, cx double, cy double, dx double, dy double")

    def run():
        a = sp.region_spectrum(e, ["rec_id", "x"], 200.0, 5.0, 90.0).select("x", "n_events", "peak_freq", "peak_power", "snr", "harmonic").orderBy("x").toPandas()
        b = sp.flicker_map(e, 5.0, 90.0, 200.0, 2, 10).orderBy("cx").drop("rec_id").toPandas()
        c = sp.region_band_snr(e, ["rec_id"], 200.0, (15.0, 25.0), 5.0).select("band_snr").toPandas()
        d = sp.blade_fft(e, track, 5.0, 90.0, 0.005).select("peak_hz", "snr").toPandas()
        return a, b, c, d

    short = run()
    monkeypatch.setattr(sp, "LONG", 16)
    for x, y in zip(short, run()):
        assert np.allclose(x.to_numpy(float), y.to_numpy(float), rtol=1e-6)


def test_an_hour_long_series(spark, events):
    """7.2 million bins: the line of a faint tone, with no row longer than the square root of the grid."""
    t = np.sort(np.concatenate([np.arange(0, 3_600_000_000, 5_000_000) + 3, (np.arange(60_000) * 1_000_000 // 211.0) * 12]).astype(np.int64))
    t = t[t < 3_600_000_000]
    t[-1] = 3_600_000_000
    assert int(t[-1] - t[0]) * 2000 // 1_000_000 > sp.LONG
    got = sp.region_spectrum(events(0, 0, t), ["rec_id"], 2000.0, 10.0, 800.0).first()
    counts = np.bincount(np.minimum(((t - t[0]) / 500.0).astype(np.int64), int((t[-1] - t[0]) // 500) - 1))
    want = transform_rows(counts[None].astype(float), "power")[0]
    lo, hi = int(np.ceil(10.0 * len(counts) / 2000.0)), int(np.floor(800.0 * len(counts) / 2000.0))
    k = lo + int(np.argmax(want[lo:hi + 1]))
    assert abs(got.peak_freq - k * 2000.0 / len(counts)) < 1e-6 and abs(got.peak_power / want[k] - 1) < 1e-6
    assert abs(got.snr / (want[k] / (np.median(want[1:]) + 1e-12)) - 1) < 1e-4
