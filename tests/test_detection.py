"""Blobs, trackers and detectors on planted scenes."""
import numpy as np
import pandas as pd
import pytest

from conftest import bursts
from pulsegrid.functions import blobs
from pulsegrid.operators import detect as dt, trackers as tr, user
from pulsegrid.sources import events as src


def flood(mask):
    lab, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if lab[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not lab[a, b]:
                lab[a, b] = n
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return lab


@pytest.mark.parametrize("seed", range(6))
def test_labels_match_flood_fill(seed):
    m = np.random.default_rng(seed).random((17, 23)) < 0.25 + 0.08 * seed
    assert (blobs.label(m) == flood(m)).all()


def test_morphology_borders():
    m = np.zeros((7, 7), bool)
    m[0, 0] = m[3, 3] = True
    d = blobs.cross_morph(m, 1, 0)
    assert d.sum() == 3 + 5
    assert not blobs.cross_morph(np.ones((5, 5), bool), 0, 1)[0].any()             # outside counts as empty
    assert blobs.box_close(m, 1)[3, 3]


def test_two_blobs_in_one_frame(events):
    g = [(x, y) for x in range(3, 9) for y in range(3, 9)] + [(x, y) for x in range(20, 27) for y in range(18, 25)]
    x, y = map(np.array, zip(*g))
    keep, d = dt.isolate_target(events(x, y, np.arange(len(g))), 10_000, 32, 32, 20, 1, 1)
    rows = d.orderBy("cx").collect()
    assert [round(r.cx, 1) for r in rows] == [5.5, 23.0] and keep.count() == len(g)


def line_dets(spark, n=20, gap=()):
    rows = [("r", k, 0, k * 10_000, 10.0 + 2 * k, 50.0) for k in range(n) if k not in gap] + \
           [("r", k, 1, k * 10_000, 200.0 - k, 150.0) for k in range(n)]
    d = pd.DataFrame(rows, columns=["rec_id", "step", "blob", "t", "cx", "cy"])
    return spark.createDataFrame(d.assign(x0=d.cx - 2, y0=d.cy - 2, x1=d.cx + 2, y1=d.cy + 2, freq_hz=200.0, snr=9.0, harmonic=1.0))


def test_multi_tracker_coasts_over_gaps(spark):
    got = tr.multi_tracker(line_dets(spark, gap=(8, 9, 10)), 30.0).toPandas()
    assert sorted(got.groupby("target_id").size()) == [17, 20]
    far = tr.multi_tracker(line_dets(spark, gap=tuple(range(5, 18))), 30.0, max_missed=3).toPandas()
    assert far.target_id.nunique() == 3                                            # dropped, then respawned


def trajectory(spark):
    rng = np.random.default_rng(0)
    k = np.arange(25)
    rows = pd.concat([pd.DataFrame({"azimuth_deg": (350 + 1.2 * k + rng.normal(0, 0.1, 25)) % 360, "elev_deg": 3.0, "obj": 0}),
                      pd.DataFrame({"azimuth_deg": 120 - 0.8 * k, "elev_deg": -4.0, "obj": 1})])
    return spark.createDataFrame(rows.assign(rec_id="r", step=np.r_[k, k], t=np.r_[k, k] * 100_000, range_m=10.0,
                                             cx=np.r_[10 + 2 * k, 200 - 3 * k].astype(float), cy=np.r_[40 + 0 * k, 90 + k].astype(float)))


@pytest.mark.parametrize("name,kw", [("nearest", {}), ("kalman", {}), ("staring_kvf", {})])
def test_trackers_follow_two_targets(spark, name, kw):
    t = dt.run_tracker(name, trajectory(spark), True, **kw).toPandas()
    assert sorted(t.groupby("target_id").size())[-2:] == [25, 25]


def test_single_tracker_gate(spark):
    t = trajectory(spark).where("obj = 0").toPandas()
    t.loc[3, "elev_deg"] = 60.0
    assert tr.single_tracker(spark.createDataFrame(t)).count() == 24


def test_link_tracks_recovers_the_drift(spark):
    d = pd.DataFrame({"rec_id": "r", "rev": range(6), "bearing_deg": [(355 + 3 * k) % 360 for k in range(6)], "blade_hz": 210.0,
                      "range_m": 20.0, "comb_strength": 0.5})
    per = spark.createDataFrame([("r", 1.5)], "rec_id string, period_s double")
    t = tr.link_tracks(spark.createDataFrame(d), per).first()
    assert t.n_passes == 6 and abs(t.offset_per_rev_deg - 3) < 1e-9 and abs(t.omega_deg_s - 2) < 1e-9


def test_flutter_detector_finds_the_planted_target(events):
    r = np.random.default_rng(7)
    t = bursts(200, 1.2, 60)
    x = (10 + 15 * t / 1.2e6 + r.integers(0, 6, len(t))).astype(int)
    y = 20 + r.integers(0, 6, len(t))
    nt = r.integers(0, 1_200_000, 800)                     # the noise density of a 320 x 320 sensor at 30,000 ev/s
    o = np.argsort(np.r_[t, nt], kind="stable")
    e = events(np.r_[x, r.integers(0, 48, 800)][o], np.r_[y, r.integers(0, 48, 800)][o], np.r_[t, nt][o])
    d = dt.flutter_detect(e, 48, 48, 50.0, **{**dt.preset("drone"), "harmonic_gate": 0.0}, min_pixels=25, suppress=False).toPandas()
    assert len(d) > 10 and abs(d.freq_hz.median() - 200) < 10 and d.target_id.nunique() <= 3


def test_words_drop_data_before_the_first_time(spark):
    cd = lambda p, low, x, y, m: (p << 60) | (low << 54) | (x << 43) | (y << 32) | m
    th = lambda h: ((8 << 60) | (h << 32)) - (1 << 64)
    w = [cd(1, 5, 3, 4, 1), th(10), cd(1, 5, 3, 4, 0b101), th(7), cd(0, 1, 9, 9, 1)]
    d = spark.createDataFrame([("r", i, v) for i, v in enumerate(w)], "rec_id string, word_idx long, word long")
    got = src.ingest_event_words(d).orderBy("word_idx", "bit").collect()
    assert [(r.x, r.y, r.p, r.t) for r in got] == [(3, 4, 1, 645), (5, 4, 1, 645), (9, 9, 0, 641)]   # time never falls


def test_first_gap(spark):
    c = src.coverage_spans(spark.createDataFrame([("r", 0, 5), ("r", 3, 9), ("r", 12, 20)], "rec_id string, a long, b long"), ["rec_id"])
    g = src.first_gap(c, ["rec_id"], 0, 30).first()
    assert (g.gap_a, g.gap_b) == (9, 12)
    assert src.first_gap(c, ["rec_id"], 12, 20).count() == 0


def test_user_return_forms(spark):
    items = [(4, 6), {"bbox": (0, 0, 10, 4)}, {"x": 1, "y": 2, "w": 4, "conf": 0.5}, {"label": "a"}, (5, 5, (1, 2, 3, 4)), (5, 5, 1, 2, 3, 4, 9), 7, {"cx": 3, "cy": 3, "h": 6, "id": 40}]
    rows = [{"rec_id": "r", "window": 0, **d} for d in (user.said(it, i) for i, it in enumerate(items)) if d]
    got = {r.det: r for r in user.one_form(spark.createDataFrame([tuple(d[c.split()[0]] for c in user.SAID_SCHEMA.split(", ")) for d in rows], user.SAID_SCHEMA)).collect()}
    assert set(got) == {0, 1, 2, 4, 5, 40}
    assert (got[0].x0, got[0].y1) == (-6.0, 16.0) and (got[1].cx, got[1].cy) == (5.0, 2.0)
    assert (got[2].x1, got[2].y0, got[2].score) == (3.0, 0.0, 0.5)
    assert got[4].x0 == got[5].x0 == 1.0 and (got[40].x0, got[40].y0) == (-7.0, 0.0)


def test_tracks_beyond_six_are_kept():
    tk = tr.MultiTrack()
    cands = [(100.0 * k, 0.0, (0, 0, 1, 1)) for k in range(9)]
    assert len(tk.update(0, cands)) == 9
    assert [i for _, i, _, _ in tk.update(3, [(100.0 * k + 6, 0.0, (0, 0, 1, 1)) for k in range(9)])] == list(range(9))


def test_windows_are_joined_without_sorting_the_events(spark, events):
    """Dealt out or not, boxes have the same lines, and no plan sorts the events for the least count."""
    t = bursts(200, 1.0, 10)
    ev = events(np.arange(len(t)) % 4, 2, t)
    assert dt.dealt(ev, 300_000, 10).rdd.getNumPartitions() == -(-len(t) // 10) and dt.dealt(ev, 300_000).rdd.getNumPartitions() == ev.rdd.getNumPartitions()
    b = spark.createDataFrame([("r", k, 1, 20_000 * k, 0, 0, 4, 4) for k in range(1, 50)], "rec_id string, step long, blob int, t long, x0 int, y0 int, x1 int, y1 int")
    one = dt.box_lines(ev, b, 0.3, 2000.0, 80.0, 800.0, 40)
    two = dt.box_lines(dt.dealt(ev, 300_000, 10), b, 0.3, 2000.0, 80.0, 800.0, 40)
    assert "SortMergeJoin" not in one._jdf.queryExecution().toString()
    assert one.count() > 40 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_quantiles_leave_other_rows_where_they_are(spark):
    from pulsegrid.operators.quantiles import exact_quantiles
    d = spark.range(1001).selectExpr("id % 2 AS k", "id / 10.0D AS v")
    q = exact_quantiles(d, ["k"], {"m": ("v", 0.5, 1.0)})
    assert "SortMergeJoin" not in q._jdf.queryExecution().sparkPlan().toString()
    assert {r.k: round(r.m, 6) for r in q.collect()} == {0: 50.0, 1: 50.0}
