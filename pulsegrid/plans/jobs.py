"""End-to-end jobs: each returns its result tables as lazy DataFrames, ready for a sink."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import detect as dt, fusion as fu, kpi, movers as mv, raster as ra, rotation as rot
from ..operators import signal as sg, spectra as sp, tracks as tk
from ..schema import US
from ..session import cut_lineage


def overview(ev: DataFrame, pulses: DataFrame | None = None, bin_us: int = 10_000) -> dict[str, DataFrame]:
    """Summary, rate series and the frame at the densest moment."""
    rate = ra.event_rate(ev, bin_us)
    top = rate.groupBy("rec_id").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("_bin"))
    s = ra.spans(ev).join(top, "rec_id")
    near = ev.join(s, "rec_id").where(F.floor((F.col("t") - F.col("t_first")) / bin_us) == F.col("_bin"))
    frame = near.groupBy("rec_id", "x", "y").agg(F.count("*").alias("count"))
    return {"summary": ra.recording_summary(ev, pulses), "rate": rate, "densest_frame": frame}


def detect(ev: DataFrame, width: int, height: int, fov_deg: float, **kw) -> dict[str, DataFrame]:
    """Detector run with its flat detections and per-target table."""
    d = cut_lineage(dt.flutter_detect(ev, width, height, fov_deg, **kw))
    key = ["rec_id", "target_id"]
    return {"detections": kpi.detections_table(d.drop("apparent_px"), key), "targets": kpi.target_rollup(d, key)}


def track_study(ev: DataFrame, width: int, height: int, fov_deg: float, dt_s: float = 0.085, **kw) -> dict[str, DataFrame]:
    """Single-target study: range against time with dropouts, lock score and lost steps."""
    d = cut_lineage(dt.single_centroid_detect(ev, width, height, fov_deg, dt_s=dt_s, **kw))
    w = Window.partitionBy("rec_id").orderBy("t")
    rng = d.select("rec_id", "step", "t", "range_m", ((F.col("t") - F.lag("t").over(w)) > 1.8 * dt_s * US).alias("after_dropout"))
    return {"range": rng, "lock": kpi.lock_score(d, ["rec_id"], 1.0 / dt_s), "lost": dt.lost_steps(ev, d, dt_s)}


def tracking(ev: DataFrame, pulses: DataFrame, tel: DataFrame, fov_deg: float, width: int, height: int,
             trackers: dict[str, dict], **front) -> DataFrame:
    """Named trackers over the shared front end, one enriched track table."""
    traj = cut_lineage(dt.rotation_front_end(ev, pulses, tel, fov_deg, width, height, **front)["trajectory"])
    out = None
    for name, params in trackers.items():
        t = dt.linked_targets(dt.run_tracker(name, traj, True, **params).select(
            "rec_id", "target_id", "step", "t", "azimuth_deg", "elev_deg"), traj).withColumn("tracker", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def dual_fusion(a: DataFrame, b: DataFrame, keys: list[str], gate_deg: float = 15.0, offset_deg: float = 0.0) -> DataFrame:
    """Two cameras' trajectories of one capture fused by bearing."""
    return tk.dual_sensor_gate(a, b, keys, gate_deg, offset_deg)


def av_fusion(ev: DataFrame, boxes: DataFrame, audio: DataFrame, rate: int, pairs: DataFrame, band=(300.0, 1400.0),
              f0_range=(380.0, 780.0)) -> dict[str, DataFrame]:
    """Align, detect in both domains, converge, fuse and measure coherence."""
    plan = cut_lineage(sg.plan_alignment(ev, audio, rate, pairs))
    ac = fu.acoustic_track(audio, rate, band, f0_range).withColumnRenamed("rec_id", "audio_id").join(plan, "audio_id")
    ac = cut_lineage(ac.select("rec_id", (F.col("t") + F.rint(F.col("offset_s") * US)).cast("long").alias("t"), "f0", "snr", "conf"))
    eb = cut_lineage(fu.ebs_rotor_track(ev, boxes, band))
    j = cut_lineage(fu.with_acoustic(eb, ac, ["rec_id"]))
    conv = fu.convergence(j, ["rec_id"])
    return {"alignment": plan, "timeline": fu.fuse_frames(j), "convergence": conv,
            "fused": fu.fuse_confidence(j, ac, eb, conv, ["rec_id"]),
            "coherence": fu.cross_coherence(ev, boxes, audio, rate, plan.select("rec_id", "audio_id", "offset_s"), band)}


def box_experiment(ev: DataFrame, tel: DataFrame, pulses: DataFrame, fov_deg: float, width: int, height: int,
                   az: tuple[float, float], ywin: tuple[float, float], target_m: float = 0.225, az_sign: float = 1.0,
                   n_list=(0, 1, 2, 3, 4), min_pass: int = 60, min_spectrum: int = 200, fs: float = 2000.0,
                   fft=(200.0, 800.0)) -> dict[str, DataFrame]:
    """Masking metrics, per-revolution track and spectra, and the column comparison of one box."""
    e = cut_lineage(rot.revolution_asof(rot.world_azimuth(ev, tel, fov_deg, width, az_sign), pulses))
    boxes = pulses.select("rec_id", F.col("k").alias("rev"), F.lit(float(az[0])).alias("az0"), F.lit(float(az[1])).alias("az1"),
                          F.lit(float(ywin[0])).alias("y0"), F.lit(float(ywin[1])).alias("y1"))
    cols = None
    for mode, half in (("all", None), ("few", 4.0), ("single", 0.5)):
        sub = e if half is None else e.where(F.abs(F.col("x") - width / 2.0) <= half)
        s = mv.solve_box(sub, ["rec_id"], az, ywin, fov_deg, width, target_m, min_pass=min_pass).withColumn("columns", F.lit(mode))
        cols = s if cols is None else cols.unionByName(s)
    return {"masking": mv.masking_metrics(ev, tel, pulses, width, height, (*az, *ywin), fov_deg, az_sign, n_list),
            "track": mv.track_over_revs(e.drop("rev"), pulses, az, ywin, fov_deg, width, target_m, min_pass),
            "spectra": sp.per_rev_spectra(e, boxes, *fft, fs, min_events=min_spectrum), "columns": cols}

