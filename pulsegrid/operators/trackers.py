"""Trackers as sequential folds keyed by recording over detection tables."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..schema import US
from .folds import fold
from .select import drop_rule_outliers


def _frames(handle):
    """Group consecutive rows of one time step; the last step is flushed by a sentinel row."""
    buf: list = []

    def feed(row):
        out = []
        if buf and (row.last or row.step != buf[0].step):
            out = handle(list(buf))
            buf.clear()
        if not row.last:
            buf.append(row)
        return out
    return feed


def _closed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Append one closing row per key so that the final step is emitted by the fold."""
    end = df.groupBy(*keys).agg(F.max("step").alias("step"))
    return df.withColumn("last", F.lit(False)).unionByName(
        end.withColumn("last", F.lit(True)), allowMissingColumns=True)


# ------------------------------------------------------------------ image-plane multi-target
class MultiTrack:
    """All live tracks as arrays: position, velocity, box, age of the last hit.

    A step moves every track by its velocity, takes one distance matrix of tracks and candidates, gives each track
    in order of age the nearest candidate that is left inside the gate, and updates all hit tracks at once.
    """

    def __init__(self, gate=60.0, max_missed=8, max_tracks=None, smooth=0.4):
        self.gate, self.max_missed, self.max_tracks, self.smooth = gate, max_missed, max_tracks, smooth
        self.ids, self.missed = np.zeros(0, int), np.zeros(0, int)
        self.at, self.speed, self.box = np.zeros((0, 2)), np.zeros((0, 2)), np.zeros((0, 4))
        self.started, self.step = 0, None

    def _keep(self, which: np.ndarray):
        self.ids, self.missed, self.at, self.speed, self.box = (v[which] for v in (self.ids, self.missed, self.at, self.speed, self.box))

    def update(self, step: int, cands: list[tuple]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``cands`` = (x, y, box); returns (candidate index, track id, position, box)."""
        silent = 0 if self.step is None else step - self.step - 1
        self.step = step
        self._keep(self.missed + silent <= self.max_missed)
        self.missed = self.missed + silent
        before = self.at + silent * self.speed
        self.at = before + self.speed
        seen = np.array([c[:2] for c in cands], float).reshape(-1, 2)
        boxes = np.array([c[2] for c in cands], float).reshape(-1, 4)
        pick = assign(np.hypot(*(self.at[:, None, :] - seen[None]).transpose(2, 0, 1)), self.gate)
        hit = pick >= 0
        s, k = self.smooth, pick[hit]
        self.at[hit] = (1 - s) * seen[k] + s * self.at[hit]
        self.speed[hit] = self.at[hit] - before[hit]
        self.box[hit] = s * self.box[hit] + (1 - s) * boxes[k]
        self.missed = np.where(hit, 0, self.missed + 1)
        out = list(zip(k.tolist(), self.ids[hit].tolist(), self.at[hit].copy(), self.box[hit].copy()))
        self._keep(self.missed <= self.max_missed)
        fresh = np.setdiff1d(np.arange(len(cands)), k)
        if self.max_tracks is not None:
            fresh = fresh[:max(0, self.max_tracks - len(self.ids))]
        ids = self.started + np.arange(len(fresh))
        self.started += len(fresh)
        out += zip(fresh.tolist(), ids.tolist(), seen[fresh], boxes[fresh])
        self.ids, self.missed = np.concatenate([self.ids, ids]), np.concatenate([self.missed, np.zeros(len(fresh), int)])
        self.at, self.speed = np.concatenate([self.at, seen[fresh]]), np.concatenate([self.speed, np.zeros((len(fresh), 2))])
        self.box = np.concatenate([self.box, boxes[fresh]])
        return out


def assign(distance: np.ndarray, gate: float) -> np.ndarray:
    """For each row in order the nearest column that is free and nearer than ``gate``, or -1."""
    d = np.where(distance < gate, distance, np.inf)
    pick = np.full(len(d), -1)
    for k in range(len(d)):
        if d.shape[1] and np.isfinite(d[k].min()):
            pick[k] = d[k].argmin()
            d[:, pick[k]] = np.inf
    return pick


MULTI_SCHEMA = ("rec_id string, target_id long, step long, t long, cx double, cy double, x0 double, y0 double, "
                "x1 double, y1 double, freq_hz double, snr double, harmonic double")


def multi_tracker(cands: DataFrame, gate: float = 60.0, max_missed: int = 8, max_tracks: int | None = None,
                  smooth: float = 0.4, min_len: int = 2) -> DataFrame:
    """Track candidates (rec_id, step, blob, t, cx, cy, box, freq_hz, snr, harmonic) per recording."""
    def make():
        tk = MultiTrack(gate, max_missed, max_tracks, smooth)

        def handle(rows):
            hits = tk.update(int(rows[0].step), [(r.cx, r.cy, (r.x0, r.y0, r.x1, r.y1)) for r in rows])
            return [(rows[k].rec_id, i, int(rows[k].step), int(rows[k].t), float(c[0]), float(c[1]), *map(float, b),
                     rows[k].freq_hz, rows[k].snr, rows[k].harmonic) for k, i, c, b in hits]
        return _frames(handle)

    cols = ["rec_id", "step", "t", "cx", "cy", "x0", "y0", "x1", "y1", "freq_hz", "snr", "harmonic", "blob"]
    out = fold(_closed(cands.select(*cols), ["rec_id"]), ["rec_id"], ["last", "step", "blob"], MULTI_SCHEMA, make)
    long = out.groupBy("rec_id", "target_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_len)
    return out.join(long, ["rec_id", "target_id"], "left_semi")


# ------------------------------------------------------------------ bearing trackers
def _ang(a, b):
    return (a - b + 180.0) % 360.0 - 180.0


LINK_SCHEMA = "rec_id string, target_id long, step long, t long, azimuth_deg double, elev_deg double, range_m double"


def nearest_tracker(traj: DataFrame, gate_deg: float = 8.0, max_gap_s: float = 2.0) -> DataFrame:
    """Greedy linker on the last raw bearing and elevation.

    A track silent for longer than the gap can never match again, so it leaves the state.
    """
    def make():
        live: list[list] = []
        nxt = [0]

        def step(r):
            live[:] = [tr for tr in live if (r.t - tr[1]) / US <= max_gap_s]
            best = None
            for tr in live:
                d = math.hypot(_ang(r.azimuth_deg, tr[2]), r.elev_deg - tr[3])
                if d < gate_deg and (best is None or d < best[0]):
                    best = (d, tr)
            if best is None:
                tr = [nxt[0], r.t, 0.0, 0.0]
                nxt[0] += 1
                live.append(tr)
            else:
                tr = best[1]
            tr[1:] = [r.t, r.azimuth_deg, r.elev_deg]
            return [(r.rec_id, tr[0], r.step, r.t, r.azimuth_deg, r.elev_deg, r.range_m)]
        return step

    cols = ["rec_id", "step", "t", "azimuth_deg", "elev_deg", "range_m", "obj"]
    return fold(traj.select(*cols), ["rec_id"], ["t", "obj"], LINK_SCHEMA, make)


def single_tracker(traj: DataFrame, mad_k: float = 6.0) -> DataFrame:
    """One target: the MAD gate around the median elevation."""
    return drop_rule_outliers(traj, ["rec_id"], "elev_deg", mad_k, eps=1e-6).withColumn("target_id", F.lit(0).cast("long"))


class Drift:
    """Constant-velocity filters of many points at once.

    Both coordinates of a point move and are measured independently of each other, so a filter is two of two states: place and
    speed with the three numbers of their covariance, kept as (points, 2) arrays.
    """

    FIELDS = ("at", "speed", "pp", "pv", "vv")

    def __init__(self):
        for name in self.FIELDS:
            setattr(self, name, np.zeros((0, 2)))

    def __len__(self):
        return len(self.at)

    def keep(self, which: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, getattr(self, name)[which])

    def add(self, at: np.ndarray, pp: float, vv: float):
        still = np.zeros_like(at)
        for name, rows in zip(self.FIELDS, (at, still, still + pp, still, still + vv)):
            setattr(self, name, np.concatenate([getattr(self, name), rows]))

    def advance(self, dt: float, pp: float, pv: float, vv: float):
        """Move by ``dt`` and widen the covariance by the noise of that time."""
        self.at = self.at + dt * self.speed
        self.pp = self.pp + dt * (2 * self.pv + dt * self.vv) + pp
        self.pv, self.vv = self.pv + dt * self.vv + pv, self.vv + vv

    def correct(self, rows: np.ndarray, off: np.ndarray, noise: np.ndarray):
        """Take in measurements that lie ``off`` from where points ``rows`` were expected."""
        near, far = self.pp[rows] / (self.pp[rows] + noise), self.pv[rows] / (self.pp[rows] + noise)
        self.at[rows] += near * off
        self.speed[rows] += far * off
        self.vv[rows] -= far * self.pv[rows]
        self.pv[rows] *= 1 - near
        self.pp[rows] *= 1 - near


def cheapest(cost: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) from the cheapest on, each row and column once, up to ``most``."""
    left, pairs = np.where(cost <= most, cost, np.inf), []
    while left.size and np.isfinite(left.min()):
        i, k = np.unravel_index(left.argmin(), left.shape)
        pairs.append((i, k))
        left[i], left[:, k] = np.inf, np.inf
    rows = np.array(pairs, int).reshape(-1, 2)
    return rows[:, 0], rows[:, 1]


class BearingFilters:
    """The live tracks of a recording in bearing and elevation, a step at a time."""

    def __init__(self, wrap: bool, q: float, noise: tuple[float, float], gate: float, max_gap_s: float, spread: float, alpha: float, retire: bool):
        self.wrap, self.q, self.noise, self.gate = wrap, q, np.square(noise), gate
        self.max_gap_s, self.spread, self.alpha, self.retire = max_gap_s, spread, alpha, retire
        self.move, self.now, self.started = Drift(), None, 0
        self.ids, self.seen, self.reach = np.zeros(0, int), np.zeros(0), np.zeros(0)

    def step(self, t: float, az: np.ndarray, el: np.ndarray, reach: np.ndarray) -> list[tuple]:
        """(measurement, track, azimuth, elevation, range) for every measurement of a time; ranges may be NaN."""
        dt = 0.0 if self.now is None else t - self.now
        self.now = t
        self.move.advance(dt, self.q * dt ** 3 / 3, self.q * dt ** 2 / 2, self.q * dt)
        off = np.stack(np.broadcast_arrays(az - self.move.at[:, :1], el - self.move.at[:, 1:]), axis=-1)
        if self.wrap:
            off[..., 0] = (off[..., 0] + 180.0) % 360.0 - 180.0
        cost = (off ** 2 / (self.move.pp + self.noise)[:, None]).sum(-1)
        i, k = cheapest(cost, self.gate)
        self.move.correct(i, off[i, k], self.noise)
        self.seen[i] = t
        old, new = self.reach[i], reach[k]
        self.reach[i] = np.where(np.isnan(new), old, np.where(np.isnan(old), new, (1 - self.alpha) * old + self.alpha * new))
        out = list(zip(k, self.ids[i], *self.move.at[i].T, self.reach[i]))
        fresh = np.setdiff1d(np.arange(len(az)), k)
        ids = self.started + np.arange(len(fresh))
        self.started += len(fresh)
        at = np.stack([az[fresh], el[fresh]], axis=1)
        self.move.add(at, 1.0, self.spread)
        self.ids, self.seen, self.reach = np.append(self.ids, ids), np.append(self.seen, np.full(len(fresh), t)), np.append(self.reach, reach[fresh])
        out += zip(fresh, ids, *at.T, reach[fresh])
        if self.retire:
            stay = t - self.seen <= self.max_gap_s
            self.move.keep(stay)
            self.ids, self.seen, self.reach = self.ids[stay], self.seen[stay], self.reach[stay]
        return out


def kalman_tracker(traj: DataFrame, wrap: bool, q: float = 400.0, r_az: float = 0.6, r_el: float = 0.6,
                   gate_chi2: float = 13.8, max_gap_s: float = 0.8, confirm_hits: int = 3,
                   init_vel_var: float = 1e5, range_alpha: float = 0.3, min_len: int = 3,
                   retire_by_update: bool = True) -> DataFrame:
    """Constant-velocity Kalman tracks in bearing and elevation.

    A track that has had no measurement for ``max_gap_s`` leaves the state.  In the original the gap is measured from the
    last prediction and so never ends a track; ``retire_by_update=False`` does the same.
    """
    def make():
        live = BearingFilters(wrap, q, (r_az, r_el), gate_chi2, max_gap_s, init_vel_var, range_alpha, retire_by_update)

        def handle(rows):
            az, el, reach = (np.array([getattr(r, c) for r in rows], float) for c in ("azimuth_deg", "elev_deg", "range_m"))
            reach[~np.isfinite(reach)] = np.nan
            return [(rows[k].rec_id, int(i), int(rows[k].step), int(rows[k].t), float(a), float(e), None if np.isnan(d) else float(d))
                    for k, i, a, e, d in live.step(rows[0].t / US, az, el, reach)]
        return _frames(handle)

    cols = ["rec_id", "step", "t", "azimuth_deg", "elev_deg", "range_m", "obj"]
    out = fold(_closed(traj.select(*cols), ["rec_id"]), ["rec_id"], ["last", "step", "obj"], LINK_SCHEMA, make)
    n = out.groupBy("rec_id", "target_id").agg(F.count("*").alias("_n")).where(
        F.col("_n") >= max(min_len, confirm_hits))
    out = out.join(n, ["rec_id", "target_id"], "left_semi")
    return out.withColumn("azimuth_deg", F.col("azimuth_deg") - F.floor(F.col("azimuth_deg") / 360.0) * 360.0) if wrap else out


KVF_SCHEMA = "rec_id string, track_id long, step long, t long, cx double, cy double, vitality double"


class Vital:
    """Image-plane filters with a vitality that hits raise and time lowers; a point without any is dropped."""

    #: Vitality and variance of a new track.
    BIRTH, SPREAD = 0.35, 50.0

    def __init__(self, gate: float, hit: float, fade: float, death: float, process: float, noise: float):
        self.gate, self.hit, self.fade, self.death, self.process, self.noise = gate, hit, fade, death, process, np.full(2, noise)
        self.move, self.now, self.started = Drift(), None, 0
        self.ids, self.vital = np.zeros(0, int), np.zeros(0)

    def take(self, t: float, place: np.ndarray) -> tuple[int, float]:
        """The track that a detection goes to, and its vitality after it."""
        dt = 0.0 if self.now is None else max(t - self.now, 0.0)
        self.now = t
        self.move.advance(dt, *(self.process * (dt + 1e-3) * np.array([1.0, 0.0, 1.0])))
        self.vital = np.maximum(0.0, self.vital - self.fade * dt)
        off = place - self.move.at
        far = np.hypot(off[:, 0], off[:, 1])
        if len(far) and far.min() < self.gate:
            k = int(far.argmin())
            self.move.correct(np.array([k]), off[[k]], self.noise)
            self.vital[k] = min(1.0, self.vital[k] + self.hit)
        else:
            k = len(far)
            self.move.add(place[None], self.SPREAD, self.SPREAD)
            self.ids, self.vital = np.append(self.ids, self.started), np.append(self.vital, self.BIRTH)
            self.started += 1
        out = int(self.ids[k]), float(self.vital[k])
        stay = self.vital >= self.death
        self.move.keep(stay)
        self.ids, self.vital = self.ids[stay], self.vital[stay]
        return out


def kvf_tracker(traj: DataFrame, gate_px: float = 45.0, vit_hit: float = 0.18, vit_miss_rate: float = 0.6,
                confirm: float = 0.7, death: float = 0.08, min_points: int = 4, process_noise: float = 8.0,
                meas_noise: float = 16.0) -> DataFrame:
    """Image-plane Kalman tracks with an evidential vitality score."""
    def make():
        live = Vital(gate_px, vit_hit, vit_miss_rate, death, process_noise, meas_noise)

        def step(r):
            track, vital = live.take(r.t / US, np.array([r.cx, r.cy], float))
            return [(r.rec_id, track, r.step, r.t, r.cx, r.cy, vital)]
        return step

    cols = ["rec_id", "step", "t", "cx", "cy", "obj"]
    out = fold(traj.select(*cols), ["rec_id"], ["t", "obj"], KVF_SCHEMA, make)
    good = out.groupBy("rec_id", "track_id").agg(F.max("vitality").alias("max_vitality"), F.count("*").alias("_n")) \
              .where((F.col("max_vitality") >= confirm) & (F.col("_n") >= min_points)).drop("_n")
    return out.join(good, ["rec_id", "track_id"])


ROTOR_SCHEMA = ("rec_id string, track_id long, rev long, bearing_deg double, blade_hz double, range_m double, "
                "offset_deg double")


class BearingLines:
    """Tracks whose bearing follows a line over revolutions; a line is the sums of its least-squares fit, a row of ``sums``."""

    def __init__(self, gate: float, first_gate: float, max_silent: int):
        self.gate, self.first_gate, self.max_silent, self.started = gate, first_gate, max_silent, 0
        #: id, revolution and bearing of the last pass, the same unwrapped, slope, first revolution
        self.line = np.zeros((0, 6))
        #: passes, sums of revolution, bearing, revolution squared, their product
        self.sums = np.zeros((0, 5))

    def pass_by(self, rev: int, bearing: np.ndarray) -> list[tuple[int, float]]:
        """Track and slope for each detection of a revolution, the strongest first."""
        stay = rev - self.line[:, 1] <= self.max_silent
        self.line, self.sums = self.line[stay], self.sums[stay]
        expected = self.line[:, 2] + self.line[:, 4] * (rev - self.line[:, 1])
        far = np.abs(_ang(bearing[:, None], expected[None]))
        gates = np.where(self.sums[:, 0] >= 2, self.gate, self.first_gate)
        pick = assign(np.where(far <= gates, far, np.inf), np.inf)
        fresh = np.flatnonzero(pick < 0)
        new = np.zeros((len(fresh), 6))
        new[:, 0] = self.started + np.arange(len(fresh))
        new[:, 1], new[:, 5], new[:, 2], new[:, 3] = rev, rev, bearing[fresh], bearing[fresh]
        self.started += len(fresh)
        pick[fresh] = len(self.line) + np.arange(len(fresh))
        self.line, self.sums = np.concatenate([self.line, new]), np.concatenate([self.sums, np.zeros((len(fresh), 5))])
        hit = self.line[pick]
        hit[:, 3] += _ang(bearing, hit[:, 3])
        x, y = rev - hit[:, 5], hit[:, 3]
        total = self.sums[pick] + np.stack([np.ones_like(x), x, y, x * x, x * y], axis=1)
        n, sx, sy, sxx, sxy = total.T
        spread = n * sxx - sx * sx
        hit[:, 4] = np.where((n >= 2) & (spread > 0), (n * sxy - sx * sy) / np.where(spread > 0, spread, 1.0), 0.0)
        hit[:, 1], hit[:, 2] = rev, bearing
        self.line[pick], self.sums[pick] = hit, total
        return list(zip(hit[:, 0].astype(int).tolist(), hit[:, 4].tolist()))


def _linked(dets: DataFrame, gate_deg: float, init_gate_deg: float | None, strength: str, max_silent: int) -> DataFrame:
    """The detections with the number of their track and the track's slope so far."""
    def make():
        live = BearingLines(gate_deg, 3.0 * gate_deg if init_gate_deg is None else init_gate_deg, max_silent)

        def handle(rows):
            rev = int(rows[0].step)
            linked = live.pass_by(rev, np.array([r.bearing_deg for r in rows], float))
            return [(r.rec_id, i, rev, r.bearing_deg, r.blade_hz, r.range_m, slope) for r, (i, slope) in zip(rows, linked)]
        return _frames(handle)

    d = dets.select("rec_id", F.col("rev").alias("step"), "bearing_deg", "blade_hz", "range_m",
                    (-F.col(strength)).alias("rank"))
    return fold(_closed(d, ["rec_id"]), ["rec_id"], ["last", "step", "rank", "bearing_deg"], ROTOR_SCHEMA, make)


def pass_tracks(dets: DataFrame, period: DataFrame, gate_deg: float = 6.0, min_passes: int = 2) -> DataFrame:
    """Matched detections of tracks of ``min_passes`` or more: track_id, n_passes, offset_per_rev_deg and omega_deg_s of their track."""
    w = Window.partitionBy("rec_id", "track_id")
    rows = _linked(dets, gate_deg, None, "comb_strength", 1000)
    rows = rows.withColumns({"n_passes": F.count("*").over(w), "offset_per_rev_deg": F.max_by("offset_deg", "rev").over(w)}).where(F.col("n_passes") >= min_passes)
    omega = F.coalesce(F.col("offset_per_rev_deg") / F.col("period_s"), F.lit(0.0)).alias("omega_deg_s")
    return rows.join(period, "rec_id", "left").select("rec_id", "rev", "bearing_deg", F.lit(True).alias("matches_template"), "track_id", "n_passes", "offset_per_rev_deg", omega)


def link_tracks(dets: DataFrame, period: DataFrame, gate_deg: float = 6.0, init_gate_deg: float | None = None,
                min_passes: int = 2, strength: str = "comb_strength", max_silent: int = 1000) -> DataFrame:
    """Link detections across revolutions with a predicted bearing; slope per revolution = motion.

    ``dets`` has rec_id, rev, bearing_deg, blade_hz, range_m and the strength column; ``period`` has
    rec_id, period_s.  A track without a pass for ``max_silent`` revolutions leaves the state.
    """
    rows = _linked(dets, gate_deg, init_gate_deg, strength, max_silent)
    g = rows.groupBy("rec_id", "track_id").agg(
        F.count("*").alias("n_passes"), F.median("bearing_deg").alias("bearing_deg"), F.median("blade_hz").alias("median_blade_hz"),
        F.stddev_pop("blade_hz").alias("_sd"), F.count("blade_hz").alias("_nf"), F.median("range_m").alias("range_m"),
        F.max_by("offset_deg", "rev").alias("offset_per_rev_deg"),
        F.sort_array(F.collect_set("rev")).alias("revs")).where(F.col("n_passes") >= min_passes)
    stab = F.when((F.col("_nf") > 1) & (F.col("median_blade_hz") > 0), F.greatest(
        F.lit(0.0), 1.0 - F.col("_sd") / F.col("median_blade_hz"))).otherwise(1.0)
    return g.withColumn("blade_hz_stability", stab).join(period, "rec_id", "left").withColumn(
        "omega_deg_s", F.coalesce(F.col("offset_per_rev_deg") / F.col("period_s"), F.lit(0.0))).drop("_sd", "_nf", "period_s")


VEL_SCHEMA = "rec_id string, step long, vx double, vy double"


def velocity_smoother(vel: DataFrame, q: float = 120.0, r: float = 60.0) -> DataFrame:
    """Random-walk Kalman smoothing of per-window velocities; gaps carry the last estimate."""
    def make():
        st = {"x": None, "p": 1e4}

        def step(w):
            z = None if w.vx is None or np.isnan(w.vx) else np.array([w.vx, w.vy])
            if st["x"] is None:
                if z is not None:
                    st["x"] = z
                return [(w.rec_id, w.step, *(z if z is not None else (None, None)))]
            st["p"] += q
            if z is not None:
                k = st["p"] / (st["p"] + r)
                st["x"] = st["x"] + k * (z - st["x"])
                st["p"] *= 1 - k
            return [(w.rec_id, w.step, float(st["x"][0]), float(st["x"][1]))]
        return step
    return fold(vel.select("rec_id", "step", "vx", "vy"), ["rec_id"], ["step"], VEL_SCHEMA, make)

