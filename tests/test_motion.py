"""Planted motion for contrast maximisation, accumulated combs, and storage pruning."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import bursts
from pulsegrid.operators import asof, contrast as cm, detect as dt, ladder as ld, movers as mv, rotation as rot, select as sel, spectra as sp
from pulsegrid.plans import jobs
from pulsegrid.sources import events as src, sinks
from pulsegrid.streaming import stream as st


def moving(events, vx=100.0, vy=-50.0, n=900, seed=0):
    """Three bright points moving together for 0.2 s."""
    r = np.random.default_rng(seed)
    t = np.sort(r.integers(0, 200_000, n))
    k = r.integers(0, 3, n)
    x = np.array([10, 22, 15])[k] + vx * t / 1e6
    y = np.array([25, 30, 40])[k] + vy * t / 1e6
    return events(np.floor(x).astype(int), np.floor(y).astype(int), t)


def test_velocity_search_finds_the_motion(events):
    e = moving(events).withColumns({"t_ref": F.lit(100_000.0), "bx0": F.lit(0), "by0": F.lit(0)})
    v = cm.estimate_velocity(e, ["rec_id"], 64, 64, 200.0, 3, 5, 1.0).first()
    assert abs(v.vx - 100) < 35 and abs(v.vy + 50) < 35


@pytest.mark.parametrize("blur", [0.0, 1.0])
def test_parts_of_a_group_give_the_same_velocity(events, monkeypatch, blur):
    e = moving(events).withColumns({"t_ref": F.lit(100_000.0), "bx0": F.lit(0), "by0": F.lit(0)})
    whole = cm.estimate_velocity(e, ["rec_id"], 64, 64, 200.0, 3, 5, blur).first()
    monkeypatch.setattr(cm, "BLOCK", 100)
    parts = cm.estimate_velocity(e, ["rec_id"], 64, 64, 200.0, 3, 5, blur).first()
    assert np.allclose([whole.vx, whole.vy, whole.focus], [parts.vx, parts.vy, parts.focus])


def test_one_search_equals_exploded_candidates(events):
    """Focus of every candidate of a level against images counted in the JVM."""
    e = moving(events, n=300).withColumns({"t_ref": F.lit(100_000.0), "bx0": F.lit(0), "by0": F.lit(0)})
    vx, vy = cm.Zoom(120.0, 1, 4, 1.0).candidates(0, 0.0, 0.0)
    c = e.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(vx, vy))], "cand int, vx double, vy double")
    want = cm.focus(cm.build_iwe(e.crossJoin(c), ["rec_id"], 64, 64, 1.5), ["rec_id"], 64, 64).toPandas().set_index("cand").focus
    got = cm.sharpness(cm.images(e.toPandas(), vx, vy, 64, 64), 1.5, "variance")
    assert np.allclose([got[k] for k in want.index], want)


def test_blurred_focus_matches_dense_numpy(events):
    e = moving(events, 0.0, 0.0, 300).withColumns({"t_ref": F.lit(0.0), "bx0": F.lit(0), "by0": F.lit(0), "cand": F.lit(0),
                                                   "vx": F.lit(0.0), "vy": F.lit(0.0)})
    got = cm.focus(cm.build_iwe(e, ["rec_id"], 48, 48, 1.0), ["rec_id"], 48, 48).first().focus
    img = np.zeros((48, 48))
    for r in e.select("x", "y").collect():
        img[r.y, r.x] += 1
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    k /= k.sum()
    pad = np.pad(img, 4, mode="symmetric")
    b = np.apply_along_axis(lambda a: np.convolve(a, k, "valid"), 0, pad)
    b = np.apply_along_axis(lambda a: np.convolve(a, k, "valid"), 1, b)
    assert np.isclose(got, b.var())


def test_rigid_fit_recovers_rotation(spark):
    xy = np.random.default_rng(1).uniform(0, 100, (30, 2))
    c = xy.mean(0)
    rows = [("r", float(x), float(y), float(5 - 0.3 * (y - c[1])), float(-2 + 0.3 * (x - c[0]))) for x, y in xy]
    f = cm.fit_rigid_motion(spark.createDataFrame(rows, "rec_id string, x double, y double, vx double, vy double"), ["rec_id"]).first()
    assert np.allclose([f.v0x, f.v0y, f.omega], [5, -2, 0.3])


def test_accumulated_comb_over_passes(events):
    r, v, f = np.random.default_rng(3), 1800.0, 150.0
    k = np.repeat(np.arange(22), 12)
    xs = [np.round(12 * k + r.uniform(0, 12) + r.normal(0, 0.6, len(k))).astype(int) for _ in range(4)]
    x = np.concatenate(xs)
    e = events(x, 0, np.arange(len(x))).withColumn("pass", F.floor(F.col("seq") / len(k)))
    c = ld.accumulate_comb(e, ["rec_id"], "pass", v).first()
    assert c.n_passes == 4 and abs(c.blade_hz - f) < 0.1 * f


def test_survey_links_passes_and_accumulates_their_comb(spark):
    """The tracks are those of link_tracks; the accumulated rate is that of a plain mean of the passes' autocorrelations."""
    from pulsegrid.plans import fusion_catalog as cat
    from pulsegrid.plans.views import Views
    v = Views(spark, "/root/testdata/sf0.1")
    rows = cat.scan(v, ld.scan_rotation, gate_deg=10.0).toPandas()
    tracks = ld.scan_tracks(cat.scan(v), v.pulses, 10.0).toPandas().set_index(["rec_id", "track_id"])
    on = rows[rows.track_id.notna()].groupby(["rec_id", "track_id"])
    assert len(on) == len(tracks) > 0 and not rows[~rows.matches_template].track_id.notna().any()
    for k, g in on:
        assert len(g) == g.n_passes.iloc[0] == tracks.n_passes[k] and np.allclose(g.omega_deg_s, tracks.omega_deg_s[k])
    tested = ld._survey(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 10.0, 80.0, 30.0, 12, 0.15, 0.2)[2].where("detected").select("rec_id", "rev", "bin")
    tested = {tuple(r) for r in tested.collect()}
    e = ld.scan_cells(v.px_events, v.telemetry, v.pulses, 50.0, 32, 30.0).select("rec_id", "rev", "bin", "x").toPandas().groupby(["rec_id", "rev", "bin"]).x
    sweep = {r.rec_id: abs(r.sweep_px_s) for r in ld.sweep_velocity(ld.rotation_period(v.pulses), 50.0, 32).collect()}
    for rec, g in rows.groupby("rec_id"):
        xs = [e.get_group(k).to_numpy(float) for k in g[g.matches_template][["rec_id", "rev", "bin"]].itertuples(index=False, name=None) if k in tested]
        acc, used = np.zeros(4000), 0
        for x in xs:
            lo, hi = np.percentile(x, [0.5, 99.5])
            if len(x) >= 60 and hi - lo >= 3:
                h = np.histogram(x, bins=max(int(hi - lo), 8), range=(lo, hi))[0].astype(float)
                a = np.correlate(h - h.mean(), h - h.mean(), "full")[len(h) - 1:]
                if a[0] > 0:
                    acc[:len(a)] += a / a[0]
                    used += 1
        acc = np.round(acc / max(used, 1), 9)
        lags = range(max(round(sweep[rec] / 80), 2), round(sweep[rec] / 10) + 1)
        peaks = [k for k in lags if acc[k] > 0 and acc[k] >= acc[k - 1] and acc[k] >= acc[k + 1]] if len(xs) >= 2 and used else []
        want = round(sweep[rec] / min(k for k in peaks if acc[k] >= 0.6 * max(acc[peaks])), 1) if peaks else None
        got = g.accumulated_blade_hz.iloc[0]
        assert (np.isnan(got) if want is None else abs(got - want) < 0.11), (rec, got, want, len(xs), used)
    assert rows.accumulated_blade_hz.notna().any()


def test_accumulated_comb_takes_each_recordings_sweep(spark, events):
    r = np.random.default_rng(3)
    k = np.repeat(np.arange(22), 12)
    x = np.concatenate([np.round(12 * k + r.uniform(0, 12) + r.normal(0, 0.6, len(k))).astype(int) for _ in range(4)])
    e = events(x, 0, np.arange(len(x))).withColumn("pass", F.floor(F.col("seq") / len(k)))
    both = e.unionByName(e.withColumn("rec_id", F.lit("s")))
    sweep = spark.createDataFrame([("r", -1800.0), ("s", 3600.0)], "rec_id string, sweep_px_s double")
    got = {c.rec_id: c.blade_hz for c in ld.accumulate_comb(both, ["rec_id"], "pass", sweep).collect()}
    assert got["r"] == ld.accumulate_comb(e, ["rec_id"], "pass", 1800.0).first().blade_hz
    assert got["s"] == ld.accumulate_comb(e, ["rec_id"], "pass", 3600.0).first().blade_hz


def test_fixed_bearing_is_recovered_per_revolution(spark, events):
    """A source at 200 deg seen by a sensor turning at 360 deg/s with a 50 deg field of view."""
    tel = spark.createDataFrame([("r", k * 10_000, (3.6 * k) % 360.0) for k in range(502)], "rec_id string, t long, azimuth double")
    pulses = spark.createDataFrame([("r", k, k * 1_000_000) for k in range(6)], "rec_id string, k long, t long")
    r = np.random.default_rng(4)
    rev = np.repeat(np.arange(5), 300)
    off = r.uniform(-24, 24, len(rev))                       # pan relative to the source
    t = ((rev + (200 - off) / 360) * 1e6).astype(np.int64)
    x = np.round(160 - off * 320 / 50).astype(int)           # bearing sign -1
    o = np.argsort(t)
    p = mv.per_pass_centroids(events(np.clip(x, 0, 319)[o], 160, t[o]), tel, pulses, 50.0, 320, 320).toPandas()
    assert len(p) == 5 and (abs(p.bearing_deg - 200) < 1.0).all()
    w = rot.world_azimuth(events([160], 0, [250_000]), tel, 50.0, 320).first()
    assert abs(w.az - 90) < 1e-6


def test_stored_tables_are_pruned(spark, events):
    r = np.random.default_rng(0)
    e = events(r.integers(0, 32, 500), r.integers(0, 32, 500), np.sort(r.integers(0, 9_000_000, 500)))
    path = sinks.shared_folder(spark, "pruned")
    sinks.write_event_table(e, path)
    back = sel.select_window(src.read_events(spark, path), 3.0, 4.5, (0, 0, 16, 16)).select("rec_id", "t")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "t_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(t,3000000)" in plan.split("PushedFilters")[1] and "p:int" not in plan.split("ReadSchema")[1]
    want = sel.select_window(e, 3.0, 4.5, (0, 0, 16, 16)).count()
    assert back.count() == want


def test_events_are_not_shuffled_for_telemetry(spark, monkeypatch):
    """Attaching telemetry to events leaves the event side of the join in place."""
    tel = spark.createDataFrame([("r0", k * 1000, 1.0 * k) for k in range(50)], "rec_id string, t long, azimuth double")
    e = spark.range(1000).selectExpr("concat('r', id % 1) AS rec_id", "id AS seq", "1 AS x", "1 AS y", "1 AS p", "id AS t")
    j = rot.azimuth_interp(e, tel)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    many = asof.asof(e, tel, ["rec_id"], F.col("t"))
    monkeypatch.setattr(asof, "BROADCAST_ROWS", 10)
    few = asof.asof(e, tel, ["rec_id"], F.col("t"))
    assert many.exceptAll(few).count() == 0 and few.count() == 1000


def test_stream_spectra_match_batch(spark, events):
    t = bursts(120, 2.5, 12)
    folder = sinks.shared_folder(spark, "spectra")
    e = events(5, 5, t)
    e.write.parquet(folder)
    s = st.with_event_time(st.read_event_stream(spark, folder, e.schema))
    got = st.run_to_end(s, lambda q: st.spectra(q, 500_000, 500_000, 1000.0, 50.0, 400.0, 16), "out").toPandas()
    assert len(got) == 5 and (abs(got.peak_freq - 120) < 3).all()
    ref = sp.region_spectrum(events(5, 5, t[(t >= 500_000) & (t < 1_000_000)]), ["rec_id"], 1000.0, 50.0, 400.0).first()
    assert abs(ref.peak_freq - 120) < 3


def test_time_surface_steps_match_a_carried_surface(events):
    """The horizon form against a surface carried from step to step."""
    r = np.random.default_rng(5)
    t = np.sort(r.integers(0, 900_000, 1500))
    x, y = r.integers(0, 9, 1500), r.integers(0, 7, 1500)
    e = events(x, y, t)
    none = e.where("x < 0").groupBy("rec_id", "x", "y").count()
    got = {(q.step, q.x, q.y) for q in dt.surface_steps(e, 0.01, 0.05, 0.03, none).collect()}
    want, last, i, k = set(), {}, 0, 0
    while i < len(t) and t[i] < 30_000:
        i += 1
    while 30_000 + (k + 1) * 10_000 < t[-1]:
        ct = 30_000 + (k + 1) * 10_000
        while i < len(t) and t[i] < ct:
            last[(x[i], y[i])] = t[i]
            i += 1
        v = {c: np.exp((s - ct) / 1e6 / 0.05) for c, s in last.items()}
        v = {c: q for c, q in v.items() if q > 0.1}
        if v:
            thr = np.mean(list(v.values())) + np.std(list(v.values()))
            want |= {(k, *map(int, c)) for c, q in v.items() if q > thr}
        k += 1
    assert got == want and len(want) > 200


@pytest.mark.parametrize("dropout", [False, True])
def test_track_study_marks_dropouts(events, dropout):
    t = bursts(200, 1.5, 30)
    if dropout:
        t = t[(t < 600_000) | (t > 900_000)]
    x = 10 + np.random.default_rng(6).integers(0, 6, len(t))
    y = 10 + np.random.default_rng(7).integers(0, 6, len(t))
    o = jobs.track_study(events(x, y, t), 32, 32, 50.0, 0.05, min_pixels=10)
    assert o["range"].where("after_dropout").count() == (1 if dropout else 0)
    lost = o["lost"].first()
    assert (lost.n_lost >= 5) == dropout
