"""Blob detection per frame and the detectors built on it.

Frames are independent: pixels are de-duplicated and counted natively, one bounded row per frame
(at most the sensor's pixels) goes through an Arrow batch for morphology and labelling, and
everything after that is joins, spectra and small folds.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import tables
from ..functions.angles import elevation, pinhole_range, relative_distance
from ..functions.blobs import frame_blobs
from ..functions.spectral import band_slice
from ..schema import US
from ..session import cut_lineage
from . import background as bg
from .asof import small
from .denoise import PIXEL, hot_pixels
from .geometry import build_trajectory
from .kpi import target_rollup
from .movers import per_pass_centroids
from .raster import spans
from .rotation import world_azimuth
from .signal import ema, radial_velocity
from .spectra import blade_fft, region_spectrum
from .trackers import kalman_tracker, kvf_tracker, multi_tracker, nearest_tracker, single_tracker
from .tracks import in_box_events, top_blob_per_frame

#: Events of a task that joins them with overlapping windows.
TASK_EVENTS = 100_000

BLOB = T.ArrayType(T.StructType([
    T.StructField("blob", T.IntegerType()), T.StructField("area", T.LongType()),
    *[T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")],
    T.StructField("n_events", T.LongType()), T.StructField("mx", T.DoubleType()), T.StructField("my", T.DoubleType()),
    *[T.StructField(c, T.IntegerType()) for c in ("ex0", "ey0", "ex1", "ey1")],
    T.StructField("pixels", T.ArrayType(T.LongType()))]))


def label_frames(framed: DataFrame, width: int, height: int, min_pixels: int, dilate: int = 2, erode: int = 1,
                 close: int = 0, min_events: int | None = None) -> DataFrame:
    """Blobs of every frame: ``framed`` has (rec_id, step, x, y); one output row per blob.

    Frames with fewer events than ``min_events`` (default: the pixel gate) hold no blobs.
    """
    need = min_pixels if min_events is None else min_events

    @F.pandas_udf(BLOB)
    def find(px: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, c in zip(px, n):
            p = np.asarray(p, np.int64)
            out.append(frame_blobs(p % width, p // width, np.asarray(c, np.int64), (height, width), min_pixels,
                                   dilate, erode, close))
        return pd.Series(out, index=px.index)

    per = (framed.groupBy("rec_id", "step", (F.col("y") * width + F.col("x")).cast("long").alias("px"))
           .agg(F.count("*").alias("n"))
           .groupBy("rec_id", "step").agg(F.collect_list("px").alias("px"), F.collect_list("n").alias("n"),
                                          F.sum("n").alias("tot")).where(F.col("tot") >= need))
    return per.select("rec_id", "step", F.explode(find("px", "n")).alias("b")).select("rec_id", "step", "b.*")


def cluster_frames(ev: DataFrame, dt_us: int, width: int, height: int, min_pixels: int = 40, dilate: int = 2,
                   erode: int = 1, origin: DataFrame | None = None) -> DataFrame:
    """Detector variant: box-centre centroid, area gate; frame k covers [t0 + k dt, t0 + (k+1) dt).

    ``origin`` (rec_id, t0, t_end) defaults to time zero; frames must end before ``t_end``.
    """
    e = _steps(ev, dt_us, origin)
    b = label_frames(e, width, height, min_pixels, dilate, erode)
    t = (F.col("step") + 1) * dt_us
    if origin is not None:
        b = b.join(origin, "rec_id")
        t = F.col("t0") + t
    return b.select("rec_id", "step", "blob", t.alias("t"), ((F.col("x0") + F.col("x1")) / 2.0).alias("cx"),
                    ((F.col("y0") + F.col("y1")) / 2.0).alias("cy"), "x0", "y0", "x1", "y1", "area")


def _steps(ev: DataFrame, dt_us: int, origin: DataFrame | None) -> DataFrame:
    if origin is None:
        return ev.withColumn("step", F.floor(F.col("t") / dt_us))
    e = ev.join(origin, "rec_id").where(F.col("t") >= F.col("t0"))
    e = e.withColumn("step", F.floor((F.col("t") - F.col("t0")) / dt_us))
    return e.where(F.col("t0") + (F.col("step") + 1) * dt_us < F.col("t_end")).drop("t0", "t_end")


def isolate_target(ev: DataFrame, dt_us: int, width: int, height: int, min_pixels: int = 60, dilate: int = 3,
                   erode: int = 1, from_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Event variant: returns (kept events, detections with event-mean centroids).

    Blobs need ``min_pixels`` of area and of events; kept events lie in any blob large enough.
    Frames start at time zero, or at the first candidate event with ``from_first``.
    """
    e = ev
    if from_first:
        e = ev.join(ev.groupBy("rec_id").agg(F.min("t").alias("_o")), "rec_id")
    o = F.col("_o") if from_first else F.lit(0)
    e = e.withColumn("step", F.floor((F.col("t") - o) / dt_us))
    b = cut_lineage(label_frames(e, width, height, min_pixels, dilate, erode))
    px = b.select("rec_id", "step", F.explode("pixels").alias("px"))
    keep = e.withColumn("px", (F.col("y") * width + F.col("x")).cast("long")).join(px, ["rec_id", "step", "px"], "left_semi")
    t = (F.col("step") * dt_us + dt_us / 2).cast("long")
    d = b.where(F.col("n_events") >= min_pixels)
    if from_first:
        d = d.join(e.groupBy("rec_id").agg(F.first("_o").alias("_o")), "rec_id").withColumn("_t", t + F.col("_o"))
    else:
        d = d.withColumn("_t", t)
    d = d.select("rec_id", "step", "blob", F.col("_t").alias("t"), F.col("mx").alias("cx"), F.col("my").alias("cy"),
                 F.col("ex0").alias("x0"), F.col("ey0").alias("y0"), F.col("ex1").alias("x1"), F.col("ey1").alias("y1"),
                 "area", "n_events", (F.col("ex1") - F.col("ex0")).cast("double").alias("dx"),
                 (F.col("ey1") - F.col("ey0")).cast("double").alias("dy"))
    return keep.select(*ev.columns), d


# ------------------------------------------------------------------ spectral verification
def dealt(ev: DataFrame, window_us: int, rows: int = TASK_EVENTS) -> DataFrame:
    """Events by recording and window, in as many tasks as their number asks for; few events stay where they are."""
    n = -(-ev.count() // rows)
    return ev if n <= ev.sparkSession.sparkContext.defaultParallelism else ev.repartition(n, "rec_id", F.floor(F.col("t") / window_us))


def box_lines(ev: DataFrame, blobs: DataFrame, window_s: float, fs: float, fmin: float, fmax: float,
              min_events: int) -> DataFrame:
    """In-box spectral line per (rec_id, step, blob) over the trailing window.

    Windows overlap, so an event becomes a row for each of some dozen boxes; many events are dealt out first.
    """
    key = ["rec_id", "step", "blob"]
    e = in_box_events(dealt(ev, int(round(window_s * US))), blobs, int(round(window_s * US)), ["step", "blob"])
    return region_spectrum(e, key, fs, fmin, fmax, min_events=min_events + 1).select(
        *key, F.col("peak_freq").alias("freq_hz"), "snr", "harmonic", "n_events")


def localize_targets(tracks: DataFrame, fov_deg: float, width: int, height: int, target_m: float = 0.22,
                     tel: DataFrame | None = None, az_sign: float = -1.0) -> DataFrame:
    """World bearing, elevation, range and proxy from the box diagonal of each track point."""
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    t = world_azimuth(tracks, tel, fov_deg, width, az_sign, x="cx", out="azimuth_deg")
    return t.withColumns({"elev_deg": elevation("cy", fov_deg, width, height), "apparent_px": size,
                          "range_m": pinhole_range(size, fov_deg, width, target_m), "rel_distance": relative_distance(size),
                          "t_s": F.col("t") / US})


def foreground(ev: DataFrame, pos_only: bool, suppress: bool) -> DataFrame:
    """Clustering stream: hot pixels and (staring) persistent pixels removed, ON events only."""
    out = ev.join(hot_pixels(ev, 99.97), PIXEL, "left_anti")
    if suppress:
        s = spans(ev).select("rec_id", F.col("t_first").alias("_a"),
                             F.least(F.lit(US), F.floor((F.col("t_last") - F.col("t_first")) * 0.3)).alias("_w"))
        learn = ev.join(small(s), "rec_id").where(F.col("t") < F.col("_a") + F.col("_w"))
        pc = learn.groupBy(*PIXEL).agg(F.count("*").alias("n"))
        thr = pc.groupBy("rec_id").agg(F.greatest(F.percentile("n", 0.995), F.lit(1.0)).alias("_thr"))
        out = out.join(pc.join(thr, "rec_id").where("n >= _thr"), PIXEL, "left_anti")
    out = out.select(*ev.columns)
    return out.where("p = 1") if pos_only else out


def detection_origin(ev: DataFrame, calibration_s: float = 0.05) -> DataFrame:
    return spans(ev).select("rec_id", (F.col("t_first") + int(round(calibration_s * US))).alias("t0"), F.col("t_last").alias("t_end"))


def flutter_candidates(ev: DataFrame, width: int, height: int, band: tuple[float, float], snr_gate: float = 4.0,
                       harmonic_gate: float = 0.0, fft_fs: float = 2000.0, fft_window_s: float = 0.3,
                       fft_min_events: int = 40, dt_s: float = 0.02, min_pixels: int = 40, dilate: int = 2, erode: int = 1,
                       pos_only: bool = True, suppress: bool = True, gated: bool = True,
                       calibration_s: float = 0.05) -> DataFrame:
    """Blobs per step with their in-box line; gated by SNR and overtones, or merely annotated."""
    fs = max(fft_fs, 2.2 * band[1])
    fg = foreground(ev, pos_only, suppress)
    blobs = cut_lineage(cluster_frames(fg, int(round(dt_s * US)), width, height, min_pixels, dilate, erode,
                                       detection_origin(ev, calibration_s)))
    lines = box_lines(ev, blobs, fft_window_s, fs, *band, fft_min_events)
    key = ["rec_id", "step", "blob"]
    if gated:
        ok = lines.where(F.col("freq_hz").isNotNull() & (F.col("snr") >= snr_gate) & (F.col("harmonic") >= harmonic_gate))
        return blobs.join(ok.drop("n_events"), key)
    return blobs.join(lines.drop("n_events"), key, "left").fillna(0.0, ["freq_hz", "snr", "harmonic"])


def flutter_detect(ev: DataFrame, width: int, height: int, fov_deg: float, band: tuple[float, float] = (80.0, 800.0),
                   target_m: float = 0.22, tel: DataFrame | None = None, tracker: dict | None = None,
                   **kw) -> DataFrame:
    """Cluster, verify by spectrum, track and localise: one row per track point.

    On a rotating sensor (with telemetry) no pixel is background for long, so nothing is suppressed unless asked for.
    """
    kw.setdefault("suppress", tel is None)
    c = flutter_candidates(ev, width, height, band, **kw)
    tr = multi_tracker(c.withColumn("blob", _rank_by_area()), **(tracker or {}))
    return localize_targets(tr, fov_deg, width, height, target_m, tel)


def _rank_by_area() -> Column:
    """Strongest area first, as candidates are handed to the tracker."""
    return F.row_number().over(Window.partitionBy("rec_id", "step").orderBy(F.desc("area"), "blob"))


def preset(name: str) -> dict:
    """Band, gates and rate of a named signature."""
    _, lo, hi, snr, harm = next(s for s in tables.SIGNATURES if s[0] == name)
    return {"band": (lo, hi), "snr_gate": snr, "harmonic_gate": 0.34 if harm else 0.0, "fft_fs": max(2000.0, 2.5 * hi)}


def flutter_presets(ev: DataFrame, names: list[str], width: int, height: int, fov_deg: float, **kw) -> DataFrame:
    """The detector run with several signature presets; one summary row per target."""
    outs = None
    for n in names:
        d = flutter_detect(ev, width, height, fov_deg, **{**preset(n), **kw})
        r = target_rollup(d, ["rec_id", "target_id"]).withColumn("signature", F.lit(n))
        outs = r if outs is None else outs.unionByName(r)
    return outs


def blob_tracker_detect(ev: DataFrame, width: int, height: int, fov_deg: float, **kw) -> DataFrame:
    """Every blob is tracked; the spectrum only annotates."""
    return flutter_detect(ev, width, height, fov_deg, gated=False, **kw)


def single_centroid_detect(ev: DataFrame, width: int, height: int, fov_deg: float, band=(80.0, 800.0), fft_fs: float = 2000.0,
                           dt_s: float = 0.02, min_pixels: int = 30, dilate: int = 2, erode: int = 1, window_s: float = 0.3,
                           fft_every_s: float = 0.5, fft_min_events: int = 40, target_m: float = 0.22,
                           calibration_s: float = 0.05) -> DataFrame:
    """Strongest raw blob per step, smoothed centroid, sparse spectra.

    A spectrum is due once ``fft_every_s`` has passed since the last one that had enough events;
    that choice walks the per-step table (one row per step) in the small fold below.
    """
    dt = int(round(dt_s * US))
    blobs = cut_lineage(cluster_frames(ev, dt, width, height, min_pixels, dilate, erode, detection_origin(ev, calibration_s)))
    top = top_blob_per_frame(blobs)
    sm = ema(top, ["rec_id"], "step", ["cx", "cy"])
    lines = box_lines(ev, top, window_s, max(fft_fs, 2.2 * band[1]), *band, fft_min_events)
    due = _sparse(lines.select("rec_id", "step").withColumn("t", F.col("step") * dt), int(fft_every_s * US))
    ann = lines.join(due, ["rec_id", "step"], "left_semi").select("rec_id", "step", "freq_hz", "snr", "harmonic")
    out = sm.withColumns({"cx": F.col("cx_ema"), "cy": F.col("cy_ema")}).drop("cx_ema", "cy_ema") \
            .join(ann, ["rec_id", "step"], "left").fillna(0.0, ["freq_hz", "snr", "harmonic"]) \
            .withColumn("target_id", F.lit(0).cast("long"))
    return localize_targets(out, fov_deg, width, height, target_m)


def _sparse(rows: DataFrame, every_us: int) -> DataFrame:
    """Rows at least ``every_us`` after the last chosen one, per recording."""
    from .folds import fold

    def make():
        last = [None]

        def step(r):
            if last[0] is None or r.t - last[0] >= every_us:
                last[0] = r.t
                return [(r.rec_id, r.step)]
            return []
        return step
    return fold(rows, ["rec_id"], ["step"], "rec_id string, step long", make)


def lost_steps(ev: DataFrame, track: DataFrame, dt_s: float, calibration_s: float = 0.05) -> DataFrame:
    """Steps, detections and the share of lost steps per recording."""
    dt = int(round(dt_s * US))
    o = detection_origin(ev, calibration_s)
    n = F.greatest(F.ceil((F.col("t_end") - F.col("t0") - dt) / dt), F.lit(0))
    return (o.select("rec_id", n.alias("n_steps")).join(
        track.groupBy("rec_id").agg(F.count("*").alias("n_detected")), "rec_id", "left")
        .withColumn("n_detected", F.coalesce("n_detected", F.lit(0)))
        .withColumn("n_lost", F.col("n_steps") - F.col("n_detected"))
        .withColumn("lost_frac", F.col("n_lost") / F.greatest("n_steps", F.lit(1))))


# ------------------------------------------------------------------ time-surface tracker
def surface_steps(ev: DataFrame, dt_s: float, tau_s: float, calibration_s: float, noise: DataFrame) -> DataFrame:
    """Per step: pixels whose decayed last-event value exceeds mean + deviation of the visible ones.

    Values fall below the visible level (0.1) after tau ln 10, so each event concerns only the few
    steps of that horizon and no surface is carried along.
    """
    dt, horizon = int(round(dt_s * US)), int(np.ceil(tau_s * np.log(10.0) * US))
    c0 = int(round(calibration_s * US))
    end = ev.groupBy("rec_id").agg(F.max("t").alias("_end"))
    lo = F.greatest(F.floor((F.col("t") - c0) / dt), F.lit(0))
    hi = F.floor((F.col("t") + horizon - c0) / dt) - 1
    s = (ev.where(F.col("t") >= c0).join(noise.select(*PIXEL), PIXEL, "left_anti").where(hi >= lo)
         .withColumn("step", F.explode(F.sequence(lo, hi)))
         .groupBy("rec_id", "step", "x", "y").agg(F.max("t").alias("_t")))
    ct = c0 + (F.col("step") + 1) * dt
    s = s.join(end, "rec_id").where(ct < F.col("_end")).withColumn("v", F.exp((F.col("_t") - ct) / US / tau_s)).where("v > 0.1")
    thr = s.groupBy("rec_id", "step").agg((F.avg("v") + F.stddev_pop("v")).alias("_thr"))
    return s.join(thr, ["rec_id", "step"]).where(F.col("v") > F.col("_thr")).select("rec_id", "step", "x", "y", ct.alias("t"))


def freq_verified_tracker(ev: DataFrame, width: int, height: int, band=(80.0, 800.0), dt_s: float = 0.01, tau_s: float = 0.05,
                          calibration_s: float = 0.03, min_cluster: int = 20, fs: float = 1000.0, window_s: float = 0.3,
                          min_events: int = 40, amplitude: float = 0.10, close_radius: int = 3, pos_only: bool = True,
                          max_tracks: int | None = None, gate: float = 80.0, max_missed: int = 10, noise_thresh: int = 2) -> DataFrame:
    """Time-surface clusters verified by the absolute in-band amplitude, then tracked."""
    from .spectra import spectra
    on = ev.where("p = 1") if pos_only else ev
    noise = bg.mc_noise_mask(on, thresh=noise_thresh)
    b = cut_lineage(label_frames(surface_steps(on, dt_s, tau_s, calibration_s, noise), width, height, min_cluster,
                                 close=close_radius, min_events=1).drop("pixels"))
    dt, c0 = int(round(dt_s * US)), int(round(calibration_s * US))
    b = b.withColumn("t", c0 + (F.col("step") + 1) * dt)
    key = ["rec_id", "step", "blob"]
    wide = b.withColumns({"x1": F.col("x1") + 1, "y1": F.col("y1") + 1})       # closed box on both sides
    e = in_box_events(dealt(ev, int(round(window_s * US))), wide, int(round(window_s * US)), ["step", "blob"])
    n_bins = int(np.ceil(window_s * fs - 1e-9)) - 1
    cnt = e.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > min_events)
    bins = (e.join(small(cnt.select(*key)), key, "left_semi").withColumn("bin", F.floor((F.col("t") - F.col("dt") + int(window_s * US)) / (US / fs)).cast("int"))
            .where(F.col("bin") < n_bins).groupBy(*key, "bin").agg(F.count("*").alias("c")).withColumn("n_bins", F.lit(n_bins)))
    sp = spectra(bins, key, "plain")
    step = F.lit(fs / n_bins)
    inb, lo = band_slice(F.col("power"), step, *band)
    peak = F.array_max(inb)
    ok = sp.select(*key, peak.alias("amp"), ((lo + F.array_position(inb, peak) - 1) * step).alias("freq_hz")).where(F.col("amp") > amplitude)
    c = b.join(ok, key).withColumns({
        "cx": (F.col("x0") + F.col("x1")) / 2.0, "cy": (F.col("y0") + F.col("y1")) / 2.0, "snr": F.col("amp"),
        "harmonic": F.lit(0.0)})
    return multi_tracker(c.withColumn("blob", _rank_by_area()), gate, max_missed, max_tracks, 0.4)


# ------------------------------------------------------------------ rotation front end
def rotation_front_end(ev: DataFrame, pulses: DataFrame | None, tel: DataFrame | None, fov_deg: float, width: int, height: int,
                       dt_us: int = 10_000, min_pixels: int = 80, dilate: int = 3, erode: int = 1, n_rotations: int = 1,
                       n_phase: int = 360, hot_pct: float = 99.95, target_m: float = 0.0, bg_window_s: float = 1.0) -> dict[str, DataFrame]:
    """Background drop, isolation, trajectory and (rotating) per-pass centroids."""
    if tel is not None:
        fg = bg.rotation_foreground(ev, pulses, width, height, n_rotations, n_phase, hot_pixels(ev, hot_pct))
    else:
        fg = bg.staring_drop(ev, bg_window_s, hot_pct=hot_pct)
    keep, dets = isolate_target(fg, dt_us, width, height, min_pixels, dilate, erode)
    traj = build_trajectory(dets, tel, fov_deg, width, height, target_m).withColumn("obj", F.col("blob"))
    out = {"keep": keep, "detections": dets, "trajectory": traj}
    if tel is not None:
        out["passes"] = per_pass_centroids(keep, tel, pulses, fov_deg, width, height, target_m)
    return out


def run_tracker(name: str, traj: DataFrame, wrap: bool, **params) -> DataFrame:
    """Named tracker over a trajectory."""
    if name == "kalman":
        return kalman_tracker(traj, wrap, **params)
    if name == "nearest":
        return nearest_tracker(traj, **params)
    if name == "single":
        return single_tracker(traj, **params)
    if name == "staring_kvf":
        return kvf_tracker(traj, **params).withColumnRenamed("track_id", "target_id")
    raise ValueError(f"unknown tracker {name!r}")


def linked_targets(tracks: DataFrame, traj: DataFrame, ev: DataFrame | None = None) -> DataFrame:
    """Track points with box size, distance proxy, radial velocity and (staring) blade rate.

    Sizes come from the trajectory row the point was made from.
    """
    d = traj.select("rec_id", "step", "t", F.col("cx").alias("tx"), F.col("cy").alias("ty"), "dx", "dy")
    w = Window.partitionBy("rec_id", "target_id", "step").orderBy("gap")
    j = (tracks.join(d, ["rec_id", "step", "t"]))
    gap = F.abs(F.col("cx") - F.col("tx")) + F.abs(F.col("cy") - F.col("ty")) if "cx" in tracks.columns else F.col("tx") * 0
    j = j.withColumn("gap", gap).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "gap")
    size = F.col("dy") if ev is None else F.hypot("dx", "dy")
    j = j.withColumns({"t_s": F.col("t") / US, "apparent_px": size, "rel_distance": relative_distance(size, 1000.0)})
    j = radial_velocity(j, ["rec_id", "target_id"])
    if ev is None:
        return j
    blade = blade_fft(ev, j.select("rec_id", "target_id", "t", F.col("tx").alias("cx"), F.col("ty").alias("cy"), "dx", "dy"),
                      min_events=32).select("rec_id", "target_id", F.col("peak_hz").alias("blade_hz"), F.col("snr").alias("blade_snr"))
    return j.join(blade, ["rec_id", "target_id"], "left")

