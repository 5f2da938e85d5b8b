"""Planted signals: spectra, combs, alignment, audio, coherence, ladders."""
import numpy as np
import pandas as pd

from conftest import bursts
from pulsegrid.operators import fusion as fu, kpi, ladder as ld, signal as sg, spectra as sp


def test_region_spectrum_finds_137_hz(events):
    r = sp.region_spectrum(events(10, 10, bursts(137, 1.5)), ["rec_id"]).first()
    assert abs(r.peak_freq - 137) < 5 and r.snr > 5


def test_region_spectrum_matches_numpy(events):
    t = bursts(90, 0.7, 6, seed=3)
    r = sp.region_spectrum(events(1, 1, t), ["rec_id"], 1000.0, 20.0, 400.0).first()
    n = int((t[-1] - t[0]) / 1000)
    sig = np.histogram(t, t[0] + np.arange(n + 1) * 1000.0)[0].astype(float)
    s = np.abs(np.fft.rfft((sig - sig.mean()) * np.hanning(n))) / n
    s[1:-1] *= 2
    p, f = s ** 2, np.fft.rfftfreq(n, 0.001)
    assert np.allclose(r.power, p) and np.isclose(r.peak_freq, f[(f >= 20) & (f <= 400)][np.argmax(p[(f >= 20) & (f <= 400)])])
    assert np.isclose(r.snr, r.peak_power / (np.median(p[1:]) + 1e-12))


def test_flicker_cell(events):
    t = bursts(220, 1.0, 10)
    m = sp.flicker_map(events(12, 12, t), cell=8).collect()
    assert len(m) == 1 and (m[0].cx, m[0].cy) == (1, 1) and abs(m[0].dominant_freq - 220) < 12


def test_spectrogram_matches_direct(events):
    t = bursts(100, 1.0, 8, seed=2)
    got = sp.spectrogram(events(1, 1, t), ["rec_id"], 1000.0, 128, 0.75).toPandas()
    n = int((t[-1] - t[0]) / 1000)
    sig = np.histogram(t, t[0] + np.arange(n + 1) * 1000.0)[0].astype(float)
    from pulsegrid.functions.spectral import tukey
    seg, w = sig[32 * 3:32 * 3 + 128], tukey(128)
    want = (np.abs(np.fft.rfft((seg - seg.mean()) * w)) / w.sum()) ** 2
    assert np.allclose(got[got.seg == 3].sort_values("k").power, want)


def test_spin_period(events):
    r = np.random.default_rng(0)
    rev = np.repeat(np.arange(12), 400)
    t = np.sort(np.r_[((rev * 0.73 + 0.1 + r.normal(0, 0.02, len(rev))) * 1e6), r.uniform(0, 9e6, 1500)].astype(np.int64))
    p = sg.estimate_spin_period(events(0, 0, np.clip(t, 0, None))).first()
    assert abs(p.period_s - 0.73) < 0.73 * 0.05


def envelope_pair(spark, peak_e, peak_a, n=1000):
    i = np.arange(n)
    bump = lambda c: np.exp(-0.5 * ((i * 0.01 - c) / 0.4) ** 2)
    mk = lambda v: spark.createDataFrame(pd.DataFrame({"key": "k", "i": i, "v": v}))
    return sg.envelope(mk(bump(peak_e)), ["key"], "i", "v", 0.01), sg.envelope(mk(bump(peak_a)), ["key"], "i", "v", 0.01)


def test_offsets(spark):
    for e, a in ((5.0, 2.0), (2.0, 7.0)):
        r = sg.cross_correlate(*envelope_pair(spark, e, a), 0.01, 12.0).first()
        assert abs(r.offset_s - (e - a)) < 0.05


def tone(spark, f=520.0, rate=8000, seconds=3.0):
    t = np.arange(int(rate * seconds)) / rate
    x = sum(a * np.sin(2 * np.pi * f * h * t) for h, a in ((1, 1.0), (2, 0.5), (3, 0.3))) + np.random.default_rng(0).normal(0, 0.05, len(t))
    return spark.createDataFrame(pd.DataFrame({"rec_id": "mic", "i": np.arange(len(t)), "amp": x}))


def test_acoustic_track(spark):
    d = fu.acoustic_track(tone(spark), 8000).toPandas()
    mid = d[(d.frame > 3) & (d.frame < d.frame.max() - 3)]
    assert abs(mid.f0.median() - 520) <= 8 and mid.conf.median() > 0.8


def test_convergence_of_matching_tracks(spark):
    t = np.linspace(0, 5e6, 60).astype(int)
    mk = lambda f, c: spark.createDataFrame(pd.DataFrame({"rec_id": "r", "t": t, "step": np.arange(60), "f0": f, "conf": c, "snr": 9.0}))
    a, e = mk(520.0, 0.95), mk(530.0, 0.85)
    j = fu.with_acoustic(e, a, ["rec_id"])
    c = fu.convergence(j, ["rec_id"])
    assert c.first().temporal_overlap > 0.9 and c.first().band_agreement > 0.8
    assert fu.fuse_confidence(j, a, e, c, ["rec_id"]).first().p_fused > 0.6


def test_coherence_of_a_shared_tone(spark, events):
    f, rate = 150.0, 8000
    t = bursts(f, 4.0, 5)
    boxes = spark.createDataFrame([("r", k, k * 100_000, 0, 0, 9, 9) for k in range(1, 40)], "rec_id string, step long, t long, x0 int, y0 int, x1 int, y1 int")
    n = np.arange(rate * 4)
    au = spark.createDataFrame(pd.DataFrame({"rec_id": "m", "i": n, "amp": np.sin(2 * np.pi * f * n / rate) + np.random.default_rng(1).normal(0, 0.5, len(n))}))
    plan = spark.createDataFrame([("r", "m", 0.0)], "rec_id string, audio_id string, offset_s double")
    c = fu.cross_coherence(events(4, 4, t), boxes, au, rate, plan, (60.0, 400.0), 1000.0, 256).first()
    assert abs(c.peak_hz - f) < 6 and c.peak_coh > 0.8


def test_rotor_ladder(events):
    r, v = np.random.default_rng(2), -1800.0
    for f in (150, 200, 250):
        k = np.repeat(np.arange(int(0.15 * f)), 30)
        ts = (k + 0.12 * r.random(len(k))) / f
        x = np.round(300 + v * ts + r.normal(0, 0.4, len(k))).astype(int)
        o = np.argsort(ts)
        d = ld.ladder_signature(events(x[o], 5, (ts[o] * 1e6).astype(np.int64)), ["rec_id"]).first()
        assert d.detected and abs(d.blade_hz - f) < 0.12 * f, (f, d)


def test_prop_range_and_warning_time(spark):
    D = np.array([5.0, 8, 10, 12, 15, 18])
    d = spark.createDataFrame(pd.DataFrame({"rec_id": "r", "range_m": D, "snr": 50 * (8 / D) ** 2, "t_s": np.arange(6.0), "apparent_px": 9.0}))
    r = kpi.prop_frequency_range(d, ["rec_id"], 4.0, 0.2, 50.0, 320).first()
    assert r.model == "snr_fit" and abs(r.slope + 2) < 0.05 and abs(r.capability_range_m - 28.28) < 0.05
    c = spark.createDataFrame(pd.DataFrame({"rec_id": "r", "range_m": np.linspace(20, 5, 7), "t_s": np.linspace(0, 3, 7), "d": 20.0}))
    w = kpi.time_to_contact(c, ["rec_id"], "d").first()
    assert np.isclose(w.closing_speed_mps, 5.0) and np.isclose(w.ttc_first_s, 4.0)


def test_isi_and_nudft_agree(events):
    t = np.arange(0, 1_000_000, 5000)
    e = events(0, 0, t)
    f = sp.isi_frequency(e, ["rec_id"]).first().freq_hz
    p = sp.nudft(e, ["rec_id"], [150.0, 200.0, 250.0]).toPandas().set_index("k").power
    assert 180 < f < 220 and p[1] > 0.99 and p[0] < 0.01


def test_blocks_do_not_change_smoothing(spark, monkeypatch):
    """Index gaps at block edges: the same values for small and large blocks, and those of plain Python."""
    r = np.random.default_rng(2)
    idx = np.cumsum(r.integers(1, 90, 300))
    v = r.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"rec_id": "r", "i": idx, "v": v, "w": 1.0}))

    def run(size):
        monkeypatch.setattr(sg, "BLOCK", size)
        a = sg.ema(df, ["rec_id"], "i", ["v"]).orderBy("i").toPandas().v_ema
        b = sg.rolling_median(df, ["rec_id"], "i", "v", "w").orderBy("i").toPandas().ridge
        c = sg.local_maxima(df, ["rec_id"], "i", "v").count()
        return a.to_numpy(), b.to_numpy(), c

    small, large = run(64), run(1 << 20)
    assert np.allclose(small[0], large[0]) and np.allclose(small[1], large[1]) and small[2] == large[2]
    want = [v[0]]
    for x in v[1:]:
        want.append(want[-1] * 0.5 + x * 0.5)
    assert np.allclose(small[0], want)
    assert np.allclose(small[1], [np.median(v[max(0, k - 2):k + 3]) for k in range(300)])


def test_silent_stretches_count(events):
    """Two bursts with a pause: a row for every segment, and no power in the silent ones."""
    t = np.concatenate([bursts(100, 1.0), 3_000_000 + bursts(100, 1.0)])
    sg_rows = sp.spectrogram(events(3, 3, t), ["rec_id"]).groupBy("seg").sum("power").toPandas()
    n_bins = int((t.max() - t.min()) / 500) + 1
    assert sorted(sg_rows.seg) == list(range((n_bins - 256) // 64 + 1)) and (sg_rows["sum(power)"] == 0).sum() > 20


def test_coherence_is_low_when_one_side_is_mostly_silent(spark, events):
    rate, n = 2000, 16_000
    rng = np.random.default_rng(0)
    tone = np.sin(2 * np.pi * 400 * np.arange(n) / rate) + 0.1 * rng.normal(size=n)
    audio = spark.createDataFrame(pd.DataFrame({"rec_id": "a", "i": np.arange(n), "amp": tone}))
    ev = events(5, 5, np.sort(bursts(400, 2.0, per=8)))
    boxes = spark.createDataFrame([("r", int(t), 0.0, 0.0, 10.0, 10.0) for t in range(0, 8_000_001, 100_000)], "rec_id string, t long, x0 double, y0 double, x1 double, y1 double")
    plan = spark.createDataFrame([("r", "a", 0.0)], "rec_id string, audio_id string, offset_s double")
    got = fu.cross_coherence(ev, boxes, audio, rate, plan, nperseg=256).first()
    assert got.n_segments == (n - 256) // 128 + 1 and got.peak_coh < 0.5
    assert fu.cross_coherence(ev, boxes, audio, rate, plan, nperseg=32_768).count() == 0


def test_calibration_keeps_detections_of_equal_proxy(spark):
    d = spark.createDataFrame([("a", 0.5)] * 3 + [("b", 0.0), ("b", 1.0)], "rec_id string, rel_distance double")
    r = {(x.rec_id, x.rel_distance): x.distance_m for x in kpi.calibrate_range(d, ["rec_id"], 5.0, 40.0).collect()}
    assert kpi.calibrate_range(d, ["rec_id"], 5.0, 40.0).count() == 5
    assert np.isnan(r["a", 0.5]) and (r["b", 0.0], r["b", 1.0]) == (5.0, 40.0)


def test_target_size_of_boxes_that_do_not_vary(spark):
    from pulsegrid.operators import geometry as geo
    d = spark.createDataFrame([("a", 32.0, 2.0), ("a", 32.0, 4.0), ("b", 8.0, 4.0)], "rec_id string, n_px double, distance_m double").selectExpr("*", "32d AS focal_px")
    r = {x.rec_id: x.r2 for x in geo.fit_target_size(d, ["rec_id"]).collect()}
    assert r["a"] == -np.inf and np.isnan(r["b"])
