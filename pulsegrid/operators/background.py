"""Static background models for staring and rotating sensors, as joins on pixels and voxels."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import US
from .asof import small
from .denoise import PIXEL, hot_pixels, pixel_counts
from .rotation import azimuth_interp, phase_asof, revolution_asof, rotation_period
from .select import us


# ------------------------------------------------------------------ staring
def staring_background(ev: DataFrame, bg_window_s: float = 1.0, baseline_pct: float = 99.5,
                       absolute: bool = False) -> DataFrame:
    """Pixels at or above the percentile of learning-window counts.

    The window starts at the recording's first event, or at time zero when ``absolute``.
    """
    if absolute:
        learn = ev.where(F.col("t") < us(bg_window_s))
    else:
        first = ev.groupBy("rec_id").agg(F.min("t").alias("_t0"))
        learn = ev.join(small(first), "rec_id").where(F.col("t") < F.col("_t0") + us(bg_window_s))
    pc = pixel_counts(learn)
    thr = pc.groupBy("rec_id").agg(
        F.greatest(F.percentile("n", baseline_pct / 100.0), F.lit(1.0)).alias("_thr"))
    return pc.join(thr, "rec_id").where(F.col("n") >= F.col("_thr")).select(*PIXEL)


def staring_foreground(ev: DataFrame, bg_window_s: float = 1.0,
                       baseline_pct: float = 99.5) -> DataFrame:
    bg = staring_background(ev, bg_window_s, baseline_pct)
    return ev.join(bg, PIXEL, "left_anti").select(*ev.columns)


def staring_drop(ev: DataFrame, bg_window_s: float = 1.0, baseline_pct: float = 99.5,
                 hot_pct: float = 99.95) -> DataFrame:
    """Foreground when hot pixels are dropped as well; learns from absolute time."""
    bad = staring_background(ev, bg_window_s, baseline_pct, absolute=True) \
        .unionByName(hot_pixels(ev, hot_pct)).distinct()
    return ev.join(bad, PIXEL, "left_anti").select(*ev.columns)


# ------------------------------------------------------------------ rotating
VOXEL = ["rec_id", "ph", "y", "x"]


def reference_end(pulses: DataFrame, n_rotations: int, offset_us: int = 0) -> DataFrame:
    """End of the first N revolutions: the N-th pulse, clamped to what is there."""
    n = max(1, n_rotations)
    w = Window.partitionBy("rec_id").orderBy("t")
    return (pulses.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
            .groupBy("rec_id").agg((F.max("t") + offset_us).alias("ref_end")))


def with_phase_bin(ev: DataFrame, pulses: DataFrame, n_phase: int = 360, offset_us: int = 0) -> DataFrame:
    ph = F.floor(F.col("phase") * n_phase) % n_phase
    return phase_asof(ev, pulses, offset_us).withColumn("ph", ph.cast("int")).drop("phase")


def rotation_reference(ev: DataFrame, pulses: DataFrame, width: int, height: int,
                       n_rotations: int = 1, n_phase: int = 360, dil_phase: int = 1,
                       dil_xy: int = 1, offset_us: int = 0) -> DataFrame:
    """Frozen (phase, y, x) occupancy of the first N revolutions, dilated by a full box.

    Dilation is clipped at every border and does not wrap in phase.  Event time is telemetry time plus ``offset_us``.
    """
    end = small(reference_end(pulses, n_rotations, offset_us))
    early = ev.join(end, "rec_id").where(F.col("t") < F.col("ref_end")).select(*ev.columns)
    vox = with_phase_bin(early, pulses, n_phase, offset_us).select(*VOXEL).distinct()
    grown = vox
    for c, r, hi in (("ph", dil_phase, n_phase), ("y", dil_xy, height), ("x", dil_xy, width)):
        grown = grown.withColumn(c, F.explode(F.sequence(
            F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(hi - 1)))))
    return grown.distinct()


def rotation_foreground(ev: DataFrame, pulses: DataFrame, width: int, height: int,
                        n_rotations: int = 1, n_phase: int = 360,
                        hot: DataFrame | None = None, offset_us: int = 0) -> DataFrame:
    """Events outside the frozen reference (and off hot pixels); N <= 0 only drops hot pixels."""
    out = ev
    if n_rotations > 0:
        ref = rotation_reference(ev, pulses, width, height, n_rotations, n_phase, offset_us=offset_us)
        out = with_phase_bin(ev, pulses, n_phase, offset_us).join(ref, VOXEL, "left_anti")
    if hot is not None:
        out = out.join(hot, PIXEL, "left_anti")
    return out.select(*ev.columns)


def cumulative_voxel_mask(ev: DataFrame, pulses: DataFrame, n_phase: int = 360,
                          hot_pct: float = 99.95, skip_first_rev: bool = True, offset_us: int = 0) -> DataFrame:
    """Events of the revolution in which their (phase, x, y) voxel first lit."""
    v = phase_asof(revolution_asof(ev, pulses, offset_us), pulses, offset_us).withColumn(
        "ph", F.least(F.floor(F.col("phase") * n_phase), F.lit(n_phase - 1)).cast("int"))
    first = v.groupBy(*VOXEL).agg(F.min("rev").alias("_first"))
    seed = first.groupBy("rec_id").agg(F.min("_first").alias("_seed"))
    out = v.join(first, VOXEL).where(F.col("rev") <= F.col("_first"))
    if skip_first_rev:
        out = out.join(small(seed), "rec_id").where(F.col("rev") > F.col("_seed"))
    return out.join(hot_pixels(ev, hot_pct), PIXEL, "left_anti").select(*ev.columns, "rev")


def with_coarse_voxel(ev: DataFrame, tel: DataFrame, width: int, height: int, offset_us: int = 0) -> DataFrame:
    """Add ``voxel``: a 180 x 160 x 160 (azimuth, x, y) cell number."""
    pan = azimuth_interp(ev, tel, offset_us)
    def part(v, scale, n):
        return F.greatest(F.least(F.floor(v * scale), F.lit(n - 1)), F.lit(0))
    key = (part(F.col("pan"), 180 / 360.0, 180) * 160 + part(F.col("x"), 160 / width, 160)) * 160 \
        + part(F.col("y"), 160 / height, 160)
    return pan.withColumn("voxel", key.cast("long")).drop("pan")


def coarse_depth(ev: DataFrame, tel: DataFrame, pulses: DataFrame, width: int,
                 height: int, offset_us: int = 0) -> DataFrame:
    """Add ``depth``: the smallest N for which the event's coarse voxel is static.

    A voxel first seen at t is static for every N with t < t_min + N T, so one minimum per voxel
    answers all mask depths at once.
    """
    v = with_coarse_voxel(ev, tel, width, height, offset_us)
    first = v.groupBy("rec_id", "voxel").agg(F.min("t").alias("_seen"))
    start = first.groupBy("rec_id").agg(F.min("_seen").alias("_t0"))
    dims = start.join(rotation_period(pulses), "rec_id")
    n = F.floor((F.col("_seen") - F.col("_t0")) / (F.col("period_s") * US)) + 1
    return (v.join(first.join(dims, "rec_id").select("rec_id", "voxel", n.alias("depth")),
                   ["rec_id", "voxel"]))


def coarse_voxel_mask(ev: DataFrame, tel: DataFrame, pulses: DataFrame, width: int, height: int,
                      n_rev: int, offset_us: int = 0) -> DataFrame:
    if n_rev <= 0:
        return ev
    d = coarse_depth(ev, tel, pulses, width, height, offset_us)
    return d.where(F.col("depth") > n_rev).select(*ev.columns)


def rotation_phase_filter(ev: DataFrame, pulses: DataFrame, r_min: float = 0.5,
                          recur_frac: float = 0.34, min_events: int = 4,
                          phase_tol: float = 0.12, offset_us: int = 0) -> DataFrame:
    """Drop events locked to their pixel's rotation phase.

    A first aggregation per (pixel, revolution) makes the distinct-revolution count a plain count
    and keeps a hot pixel's events from meeting in one task.
    """
    v = phase_asof(revolution_asof(ev, pulses, offset_us), pulses, offset_us).withColumn(
        "_th", F.col("phase") * (2 * math.pi))
    per_rev = v.groupBy(*PIXEL, "rev").agg(F.sum(F.cos("_th")).alias("c"),
                                           F.sum(F.sin("_th")).alias("s"), F.count("*").alias("n"))
    n_rev = (per_rev.groupBy("rec_id").agg((F.max("rev") + 1).alias("a"))
             .join(pulses.groupBy("rec_id").agg(F.max("k").alias("b")), "rec_id")
             .select("rec_id", F.greatest("a", "b").alias("n_rev")))
    pix = (per_rev.groupBy(*PIXEL).agg(F.sum("c").alias("c"), F.sum("s").alias("s"),
                                       F.sum("n").alias("n"), F.count("*").alias("revs"))
           .join(n_rev, "rec_id")
           .where((F.col("n_rev") >= 2) & (F.col("n") >= min_events)
                  & (F.col("revs") >= F.greatest(F.lit(2), F.floor(F.col("n_rev") * recur_frac)))
                  & (F.hypot("c", "s") / F.col("n") >= r_min))
           .select(*PIXEL, F.atan2("s", "c").alias("_mu")))
    d = F.col("_th") - F.col("_mu")
    dphi = F.abs(d - F.round(d / (2 * math.pi)) * (2 * math.pi))
    return (v.join(pix, PIXEL, "left")
            .where(F.col("_mu").isNull() | (dphi > 2 * math.pi * phase_tol)).select(*ev.columns))


def slice_starts(n: int = 20) -> list[float]:
    """Evenly scattered slice positions in (0, 1): multiples of the golden ratio, modulo 1."""
    return [(i * 0.6180339887498949) % 1.0 for i in range(1, n + 1)]


def mc_noise_mask(ev: DataFrame, n_slices: int = 20, slice_s: float = 0.05, thresh: int = 2,
                  starts: list[float] | None = None) -> DataFrame:
    """Pixels lit in at least ``thresh`` of the short slices scattered over the recording."""
    starts = starts or slice_starts(n_slices)
    end = ev.groupBy("rec_id").agg((F.max("t") - us(slice_s)).alias("_tmax"))
    hits = F.array(*[F.when((F.col("t") >= F.col("_tmax") * s)
                            & (F.col("t") < F.col("_tmax") * s + us(slice_s)), F.lit(i))
                     for i, s in enumerate(starts)])
    return (ev.join(small(end.where("_tmax > 0")), "rec_id")
            .select(*PIXEL, F.explode(F.array_compact(hits)).alias("slice")).distinct()
            .groupBy(*PIXEL).agg(F.count("*").alias("n_slices"))
            .where(F.col("n_slices") >= thresh))
