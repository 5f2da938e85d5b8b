"""Boxes found by a space-time grid: every match, few candidates, crowded cells, both ways to join."""
import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import denoise as dn, grid, spectra as sp, tracks as tk


@pytest.fixture()
def crowd(spark, events):
    r = np.random.default_rng(6)
    n = 4000
    x, y, t = r.integers(0, 300, n), r.integers(0, 300, n), np.sort(r.integers(0, 5_000_000, n))
    x[:1500], y[:1500] = 17, 17                                              # a third at one pixel
    t[:1500] = np.sort(r.integers(0, 300_000, 1500))
    b = pd.DataFrame({"rec_id": "r", "box": np.arange(200), "x0": r.uniform(-20, 290, 200), "y0": r.uniform(-20, 290, 200), "a": r.integers(0, 5_000_000, 200)})
    b["x1"], b["y1"], b["b"] = b.x0 + r.uniform(0, 30, 200), b.y0 + r.uniform(0, 30, 200), b.a + r.integers(0, 900_000, 200)
    b.loc[:3, ["x0", "y0", "x1", "y1"]] = [10.0, 10.0, 30.0, 30.0]
    b.loc[:3, ["a", "b"]] = [0, 2_000_000]
    b.loc[4, ["x0", "x1"]] = [-1e9, 1e9]
    ev = pd.DataFrame({"x": x, "y": y, "t": t, "seq": np.arange(n)})
    want = sorted((int(e), int(k.box)) for k in b.itertuples()
                  for e in ev.seq[(ev.t >= k.a) & (ev.t < k.b) & (ev.x >= k.x0) & (ev.x < k.x1) & (ev.y >= k.y0) & (ev.y < k.y1)])
    return events(x, y, t), spark.createDataFrame(b), want


@pytest.mark.parametrize("most,rows", [(500_000, 1_000_000), (0, 1_000_000), (0, 100)])
def test_grid_join_finds_every_match(crowd, monkeypatch, most, rows):
    ev, boxes, want = crowd
    monkeypatch.setattr(grid, "BROADCAST_ROWS", most)
    monkeypatch.setattr(grid, "CELL_ROWS", rows)
    assert sorted((r.seq, r.box) for r in grid.grid_join(ev, boxes, 500_000).select("seq", "box").collect()) == want


def test_candidates_stay_near_the_matches(crowd):
    ev, boxes, want = crowd
    near = grid.grid_join(ev.where("seq >= 1500"), boxes.where("box > 4"), 250_000, exact=False).count()
    exact = sum(e >= 1500 and k > 4 for e, k in want)
    assert exact <= near <= 12 * max(exact, 50) and near < 2500 * 195 / 50


def test_box_at_a_time_and_moving_box(spark, events):
    r = np.random.default_rng(1)
    x, y, t = r.integers(0, 60, 2000), r.integers(0, 60, 2000), np.sort(r.integers(0, 3_000_000, 2000))
    ev = events(x, y, t)
    at = np.array([100_000, 700_000, 1_500_000, 2_600_000])
    b = pd.DataFrame({"rec_id": "r", "t": at, "x0": [5, 10, 20, 0], "y0": [5, 0, 20, 0], "x1": [25, 40, 50, 9], "y1": [40, 30, 45, 9]})
    for strict in (True, False):
        got = sorted((q.seq, q.box_t) for q in tk.box_asof(ev, spark.createDataFrame(b), strict).collect())
        k = np.maximum(np.searchsorted(at, t, "left" if strict else "right") - 1, 0)
        hit = (t >= at[0]) & (t < at[-1]) & (x >= b.x0[k]) & (x < b.x1[k]) & (y >= b.y0[k]) & (y < b.y1[k])
        assert got == [(int(s), int(at[k[s]])) for s in np.flatnonzero(hit)]
    tr = pd.DataFrame({"rec_id": "r", "target_id": 7, "t": at, "cx": [10.0, 30, 35, 50], "cy": [10.0, 20, 40, 10], "dx": [8.0, 10, 6, 12], "dy": [8.0, 4, 10, 6]})
    got = sorted(q.seq for q in sp.moving_box_gate(ev, spark.createDataFrame(tr), 1.0).collect())
    f = {c: np.interp(t, at, tr[c]) for c in ("cx", "cy", "dx", "dy")}
    hit = (t >= at[0]) & (t <= at[-1]) & (abs(x - f["cx"]) <= f["dx"] / 2 + 1) & (abs(y - f["cy"]) <= f["dy"] / 2 + 1)
    assert got == np.flatnonzero(hit).tolist() and len(got) > 20


def test_neighbour_filter_sends_few_rows(events):
    r = np.random.default_rng(2)
    n = 20_000
    ev = events(r.integers(0, 256, n), r.integers(0, 256, n), np.sort(r.integers(0, 2_000_000, n)))
    assert dn.pieces(ev, 5000, 1_000_000, 64).count() < 1.2 * n
    assert "Window" not in dn.baf_filter(ev, 5000)._jdf.queryExecution().toString()
