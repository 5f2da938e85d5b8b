"""Queries for blobs, detectors and trackers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as dt, geometry as geo, trackers as tr, tracks as tk
from ..session import cut_lineage
from .registry import query
from .tracks_catalog import DETS, ROLL, dets

# Connected components in SQL: closing with a cross, then the smallest reachable pixel per component
CC = {
    "occ": "SELECT rec_id, t // 250000 AS step, x, y, count(*) AS n FROM px_events GROUP BY ALL",
    "big": "SELECT rec_id, step FROM occ GROUP BY ALL HAVING sum(n) >= 3",
    "dil": """SELECT DISTINCT rec_id, step, x+dx AS x, y+dy AS y FROM occ JOIN big USING (rec_id, step),
        (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) WHERE x+dx BETWEEN 0 AND 31 AND y+dy BETWEEN 0 AND 31""",
    "ero": """SELECT a.rec_id, a.step, a.x, a.y FROM dil a JOIN (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) ON true
        JOIN dil b ON a.rec_id=b.rec_id AND a.step=b.step AND b.x=a.x+dx AND b.y=a.y+dy GROUP BY ALL HAVING count(*) = 5""",
    "reach": """SELECT rec_id, step, x, y, y*32+x AS l FROM ero UNION
        SELECT e.rec_id, e.step, e.x, e.y, r.l FROM reach r JOIN ero e ON e.rec_id=r.rec_id AND e.step=r.step AND abs(e.x-r.x)<=1 AND abs(e.y-r.y)<=1""",
    "comp": "SELECT rec_id, step, x, y, min(l) AS l FROM reach GROUP BY ALL",
    "blobs": """SELECT rec_id, step, l, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x)+1 AS x1, max(y)+1 AS y1 FROM comp GROUP BY ALL HAVING count(*) >= 3""",
    "eblob": """SELECT rec_id, step, l, sum(n) AS n_events, sum(x*n)/CAST(sum(n) AS DOUBLE) AS cx, sum(y*n)/CAST(sum(n) AS DOUBLE) AS cy, min(x) AS x0, min(y) AS y0, max(x)+1 AS x1, max(y)+1 AS y1, any_value(area) AS area
        FROM occ JOIN comp USING (rec_id, step, x, y) JOIN (SELECT rec_id, step, l, area FROM blobs) USING (rec_id, step, l) GROUP BY ALL HAVING sum(n) >= 3""",
}


@query("rec_id step:l cx:d cy:d x0:i y0:i x1:i y1:i area:l", "SELECT *, (x0+x1)/2.0 AS cx, (y0+y1)/2.0 AS cy FROM blobs", views=CC)
def label_blobs(v):
    return dt.cluster_frames(v.px_events, 250_000, 32, 32, 3, 1, 1)


@query("rec_id step:l t:l cx:d cy:d x0:i y0:i x1:i y1:i area:l n_events:l", "SELECT *, step*250000+125000 AS t FROM eblob", views=CC)
def isolate_target(v):
    return dt.isolate_target(v.px_events, 250_000, 32, 32, 3, 1, 1)[1]


@query("rec_id step:l area:l x0:i y0:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, step ORDER BY area DESC, y0, x0) AS rn FROM blobs) WHERE rn = 1", views=CC)
def top_blob_per_frame(v):
    return tk.top_blob_per_frame(dt.cluster_frames(v.px_events, 250_000, 32, 32, 3, 1, 1))


TONE_KW = {"min_pixels": 4, "suppress": False, "fft_min_events": 40, "erode": 0}


@query("rec_id target_id:l step:l cx:d cy:d freq_hz:d4 snr:d2 harmonic:d4 azimuth_deg:d range_m:d")
def flutter_detect(v):
    return dt.flutter_detect(v.px_tone, 32, 32, 50.0, **{**TONE_KW, **dt.preset("drone"), "harmonic_gate": 0.0})


@query("rec_id target_id:l signature n:l median_freq_hz:d4 confidence:d4")
def flutter_presets(v):
    return dt.flutter_presets(v.px_tone, ["drone", "insect"], 32, 32, 50.0, **TONE_KW)


@query("rec_id target_id:l step:l cx:d cy:d freq_hz:d4 snr:d2")
def blob_tracker_detect(v):
    return dt.blob_tracker_detect(v.px_tone, 32, 32, 50.0, **TONE_KW)


@query("rec_id step:l cx:d cy:d freq_hz:d4 snr:d2 range_m:d")
def single_centroid_detect(v):
    return dt.single_centroid_detect(v.px_tone, 32, 32, 50.0, min_pixels=4, erode=0)


@query("rec_id n_steps:l n_detected:l n_lost:l lost_frac:d")
def lost_steps(v):
    return dt.lost_steps(v.px_tone, dt.single_centroid_detect(v.px_tone, 32, 32, 50.0, min_pixels=4, erode=0), 0.02)


def cands(v):
    d = dets(v)
    return d.withColumns({"blob": F.col("target_id"), "x0": F.col("cx") - F.col("dx") / 2, "y0": F.col("cy") - F.col("dy") / 2,
                          "x1": F.col("cx") + F.col("dx") / 2, "y1": F.col("cy") + F.col("dy") / 2})


@query("rec_id target_id:l step:l t:l cx:d cy:d x0:d y1:d")
def multi_tracker(v):
    return tr.multi_tracker(cands(v), gate=6.0, max_missed=2)


def traj(v):
    t = geo.build_trajectory(v.quads, v.telemetry, 50.0, 32, 32, 0.2)
    return t.withColumn("obj", F.col("target_id")).drop("target_id")


@query("rec_id target_id:l step:l azimuth_deg:d elev_deg:d")
def nearest_tracker(v):
    return tr.nearest_tracker(traj(v), 20.0, 2.0)


@query("rec_id step:l obj:l elev_deg:d", """SELECT q.*, target_id AS obj FROM (SELECT *, (16.0-cy)*(50.0/32) AS elev_deg FROM quads) q JOIN (SELECT rec_id, median((16.0-cy)*(50.0/32)) AS med FROM quads GROUP BY rec_id) USING (rec_id) JOIN
  (SELECT rec_id, median(abs((16.0-cy)*(50.0/32) - med)) AS mad FROM quads JOIN (SELECT rec_id, median((16.0-cy)*(50.0/32)) AS med FROM quads GROUP BY rec_id) USING (rec_id) GROUP BY rec_id) USING (rec_id)
  WHERE abs(elev_deg - med) < 0.68*1.4826*(mad + 1e-6)""")
def single_tracker(v):
    return tr.single_tracker(traj(v), 0.68)


@query("rec_id target_id:l step:l azimuth_deg:d4 elev_deg:d4 range_m:d4")
def kalman_tracker(v):
    return tr.kalman_tracker(traj(v), True, r_az=6.0, r_el=3.0)


@query("rec_id track_id:l step:l cx:d cy:d max_vitality:d")
def kvf_tracker(v):
    return tr.kvf_tracker(traj(v), gate_px=12.0)


@query("rec_id target_id:l step:l cx:d cy:d freq_hz:d4 snr:d4")
def freq_verified_tracker(v):
    return dt.freq_verified_tracker(v.px_tone, 32, 32, min_cluster=4, close_radius=1, amplitude=0.05, noise_thresh=12)


@query("rec_id step:l t:l azimuth_deg:d3 elev_deg:d range_m:d area:l n_events:l")
def rotation_front_end(v):
    return dt.rotation_front_end(v.px_events, v.pulses, v.telemetry, 50.0, 32, 32, 250_000, 3, 1, 1, 3, 36, 99.9, 0.2)["trajectory"]


@query("rec_id target_id:l step:l rel_distance:d radial_velocity:d4")
def linked_tracker_detect(v):
    f = dt.rotation_front_end(v.px_events, v.pulses, v.telemetry, 50.0, 32, 32, 250_000, 3, 1, 1, 3, 36, 99.9, 0.2)
    t = cut_lineage(f["trajectory"])
    return dt.linked_targets(dt.run_tracker("nearest", t, True, gate_deg=30.0), t)


@query("rec_id target_id:l n:l median_freq_hz:d confidence:d pass_rate:d", "SELECT r.*, n/60.0 AS pass_rate FROM roll r", views={**DETS, "roll": ROLL})
def targets_to_report(v):
    from ..operators.kpi import target_rollup
    return target_rollup(dets(v), ["rec_id", "target_id"]).withColumn("pass_rate", F.col("n") / 60.0)


@query("rec_id target_id:l step:l apparent_px:d rel_distance:d radial_velocity:d blade_hz:d4")
def tracking_report(v):
    q = v.quads
    t = q.withColumn("obj", F.col("target_id"))
    return dt.linked_targets(q.select("rec_id", "target_id", "step", "t", "cx", "cy"), t.drop("target_id"), v.px_events)


