"""The array trackers against one dense filter a track, and state that does not grow."""
import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import trackers as tr


def test_drift_equals_dense_filters():
    r = np.random.default_rng(0)
    d = tr.Drift()
    d.add(r.normal(size=(3, 2)), 1.0, 50.0)
    x = [np.array([*d.at[k], 0.0, 0.0]) for k in range(3)]
    P = [np.diag([1.0, 1.0, 50.0, 50.0]) for _ in range(3)]
    H, R = np.eye(4)[:2], np.diag([0.5, 0.2])
    for dt in (0.1, 0.7, 0.25):
        q = 3.0
        d.advance(dt, q * dt ** 3 / 3, q * dt ** 2 / 2, q * dt)
        A = np.eye(4) + dt * np.eye(4, k=2)
        Q = np.kron(np.array([[dt ** 3 / 3, dt ** 2 / 2], [dt ** 2 / 2, dt]]), np.eye(2)) * q
        z = r.normal(size=(3, 2))
        for k in range(3):
            x[k], P[k] = A @ x[k], A @ P[k] @ A.T + Q
            S = H @ P[k] @ H.T + R
            assert np.allclose(np.diag(S), d.pp[k] + [0.5, 0.2])
        rows = np.array([0, 2])
        d.correct(rows, z[rows] - d.at[rows], np.array([0.5, 0.2]))
        for k in rows:
            K = P[k] @ H.T @ np.linalg.inv(H @ P[k] @ H.T + R)
            x[k], P[k] = x[k] + K @ (z[k] - H @ x[k]), (np.eye(4) - K @ H) @ P[k]
        for k in range(3):
            assert np.allclose(x[k], [*d.at[k], *d.speed[k]])
            assert np.allclose(P[k], [[d.pp[k, 0], 0, d.pv[k, 0], 0], [0, d.pp[k, 1], 0, d.pv[k, 1]], [d.pv[k, 0], 0, d.vv[k, 0], 0], [0, d.pv[k, 1], 0, d.vv[k, 1]]])


def test_cheapest_takes_the_globally_best_pairs():
    i, k = tr.cheapest(np.array([[3.0, 1.0, 9.0], [2.0, 1.5, 4.0]]), 3.5)
    assert list(zip(i, k)) == [(0, 1), (1, 0)]


@pytest.mark.parametrize("retire", [True, False])
def test_silent_tracks_leave_the_state(retire):
    f = tr.BearingFilters(True, 400.0, (0.6, 0.6), 13.8, 0.8, 1e5, 0.3, retire)
    for k in range(200):
        f.step(float(k), np.array([(37.0 * k) % 360]), np.array([20.0 * (k % 7)]), np.array([np.nan]))
    assert len(f.ids) <= 1 if retire else len(f.ids) > 1
    lines = tr.BearingLines(1.0, 1.0, 5)
    for k in range(300):
        lines.pass_by(k, np.array([(37.0 * k) % 360]))
    assert len(lines.line) <= 6


def test_bearing_wraps_and_crossing_targets_keep_their_names(spark):
    t = np.arange(40)
    rows = [pd.DataFrame({"rec_id": "r", "step": t, "t": t * 50_000, "azimuth_deg": (a + s * t * 0.05 * 20) % 360, "elev_deg": e, "range_m": 9.0, "obj": o})
            for o, (a, s, e) in enumerate([(350.0, 1, 0.0), (20.0, -1, 6.0)])]
    got = tr.kalman_tracker(spark.createDataFrame(pd.concat(rows)), True).toPandas()
    assert got.target_id.nunique() == 2 and (got.groupby("target_id").size() == 40).all()
    assert got.groupby("target_id").elev_deg.std().max() < 0.5 and got.azimuth_deg.between(0, 360).all()


def test_vitality_of_a_steady_target(spark):
    t = np.arange(20)
    d = pd.DataFrame({"rec_id": "r", "step": t, "t": t * 100_000, "cx": 10.0 + t, "cy": 5.0, "obj": 0})
    got = tr.kvf_tracker(spark.createDataFrame(d)).orderBy("t").toPandas()
    want = [0.35]
    for _ in range(19):
        want.append(min(1.0, max(0.0, want[-1] - 0.06) + 0.18))
    assert np.allclose(got.vitality, want) and got.track_id.nunique() == 1


def test_lines_fit_the_slope_over_the_wrap():
    f = tr.BearingLines(6.0, 18.0, 100)
    for rev in range(8):
        ids, slopes = zip(*f.pass_by(rev, np.array([(350.0 + 4.0 * rev) % 360, 100.0])))
    assert ids == (0, 1) and np.allclose(slopes, (4.0, 0.0))
