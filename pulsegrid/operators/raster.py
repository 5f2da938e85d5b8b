"""Rasters, histograms and cubes in long form: one row per lit cell."""
from __future__ import annotations

import math
from math import gcd

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tone
from ..functions.angles import elevation
from ..schema import US
from .asof import small
from .denoise import PIXEL, pixel_counts
from .quantiles import counted_quantiles
from .rotation import world_azimuth


def cell(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Histogram bin in [0, n) with the last edge closed; null outside [lo, hi]."""
    b = F.least(F.floor(F.try_divide(value - lo, hi - lo) * n), F.lit(n - 1)).cast("int")
    return F.when((value >= lo) & (value <= hi), b)


def spans(ev: DataFrame) -> DataFrame:
    """First and last event time per recording."""
    return ev.groupBy("rec_id").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def recording_summary(ev: DataFrame, pulses: DataFrame | None = None) -> DataFrame:
    s = ev.groupBy("rec_id").agg(
        F.count("*").alias("n"), F.sum("p").alias("n_on"),
        ((F.max("t") - F.min("t")) / US).alias("duration_s"),
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    s = s.withColumn("n_off", F.col("n") - F.col("n_on")).withColumn(
        "mean_rate", F.when(F.col("duration_s") > 0, F.col("n") / F.col("duration_s")).otherwise(0.0))
    if pulses is None:
        return s.withColumn("mode", F.lit("staring"))
    from .rotation import rotation_period
    rot = rotation_period(pulses).join(
        pulses.groupBy("rec_id").agg(F.max("k").alias("revolutions")), "rec_id")
    return s.join(rot, "rec_id", "left").withColumn(
        "mode", F.when(F.col("period_s").isNull(), "staring").otherwise("rotation"))


def event_rate(ev: DataFrame, bin_us: int = 10_000) -> DataFrame:
    """Rate per bin since the first event, empty bins included, the last bin closed."""
    s = spans(ev).withColumn("_nb", F.greatest(
        F.ceil((F.col("t_last") - F.col("t_first")) / bin_us), F.lit(1)))
    counts = (ev.join(small(s), "rec_id")
              .groupBy("rec_id", F.least(F.floor((F.col("t") - F.col("t_first")) / bin_us),
                                         F.col("_nb") - 1).alias("bin"))
              .agg(F.count("*").alias("n")))
    bins = s.select("rec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)).alias("bin"))
    return bins.join(counts, ["rec_id", "bin"], "left").select(
        "rec_id", "bin", ((F.col("bin") + 0.5) * (bin_us / US)).alias("t_s"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (bin_us / US)).alias("rate_hz"))


def accumulate_frames(ev: DataFrame, frame_us: int, normalize: bool = False) -> DataFrame:
    """All accumulation modes per (frame, pixel) in one aggregation."""
    key = ["rec_id", "frame", "x", "y"]
    f = (ev.withColumn("frame", F.floor(F.col("t") / frame_us)).groupBy(*key)
         .agg(F.count("*").alias("count"), F.sum("p").alias("on_count")))
    f = (f.withColumn("off_count", F.col("count") - F.col("on_count"))
         .withColumn("binary", F.lit(1))
         .withColumn("polarity", F.col("on_count") - F.col("off_count"))
         .withColumn("polarity_ratio", F.col("polarity") / F.col("count")))
    if normalize:
        top = f.groupBy("rec_id", "frame").agg(F.max("count").alias("_c"),
                                               F.max(F.abs("polarity")).alias("_p"))
        f = (f.join(top, ["rec_id", "frame"])
             .withColumn("count_norm", F.col("count") / F.col("_c"))
             .withColumn("polarity_norm", F.when(F.col("_p") > 0, F.col("polarity") / F.col("_p"))
                         .otherwise(0.0)).drop("_c", "_p"))
    return f


def time_surface(ev: DataFrame, tau_s: float = 0.02, ref_us: int | None = None) -> DataFrame:
    """Exponentially decayed time of the latest event per pixel."""
    last = ev.groupBy(*PIXEL).agg(F.max("t").alias("t_last"))
    if ref_us is None:
        last = last.join(last.groupBy("rec_id").agg(F.max("t_last").alias("_ref")), "rec_id")
    else:
        last = last.withColumn("_ref", F.lit(ref_us))
    return last.withColumn("value", F.exp((F.col("t_last") - F.col("_ref")) / US / max(tau_s, 1e-9))) \
               .drop("_ref")


def reference_white(frames: DataFrame, keys: list[str], value: str, clip_pct: float = 99.5,
                    out: str = "white") -> DataFrame:
    """Percentile of the positive values of each frame, at least 1e-9 (one value per pixel)."""
    return frames.groupBy(*keys).agg(F.coalesce(F.greatest(
        F.percentile(F.when(F.col(value) > 0, F.col(value)), clip_pct / 100.0), F.lit(1e-9)),
        F.lit(1.0)).alias(out))


def tone_map(frames: DataFrame, keys: list[str], value: str, expr: str = "sqrt", gamma: float = 0.5,
             clip_pct: float = 99.5, vmax: float | None = None, signed: bool = False,
             out: str = "disp") -> DataFrame:
    """Tone-map ``value`` per frame; ``vmax`` freezes the white point (static scale)."""
    mag = F.abs(value) if signed else F.col(value)
    if vmax is None:
        white = reference_white(frames.withColumn("_m", mag), keys, "_m", clip_pct, "vmax_used")
        frames = frames.join(white, keys)
    else:
        frames = frames.withColumn("vmax_used", F.lit(float(vmax)))
    fn = tone.compress_signed if signed else tone.compress
    return frames.withColumn(out, fn(F.col(value).cast("double"), F.col("vmax_used"), expr, gamma))


def tone_equalize(frames: DataFrame, keys: list[str], value: str, out: str = "disp") -> DataFrame:
    """Equalise values in [0, 1] with the 256-bin CDF of the non-zero pixels, read at bin centres.

    Frames with fewer than four lit pixels are left as they are.
    """
    from pyspark.sql import Window
    n = 256
    lit = frames.where(F.col(value) > 0)
    hist = lit.groupBy(*keys, cell(F.col(value), F.lit(0.0), F.lit(1.0), n).alias("b")) \
              .agg(F.count("*").alias("c"))
    dense = (hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"),
                                     F.sum("c").alias("_n"))
             .select(*keys, "_n", F.posexplode(F.transform(
                 F.sequence(F.lit(0), F.lit(n - 1)),
                 lambda b: F.coalesce(F.element_at("m", b), F.lit(0)))).alias("b", "c")))
    w = Window.partitionBy(*keys).orderBy("b")
    cdf = dense.withColumn("cdf", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_n"))
    cdf = cdf.withColumn("nxt", F.lead("cdf").over(w))
    pos = F.col(value) * n - 0.5
    px = frames.withColumn("_b", F.greatest(F.least(F.floor(pos), F.lit(n - 1)), F.lit(0)).cast("int"))
    j = px.join(cdf.withColumnRenamed("b", "_b"), [*keys, "_b"], "left")
    interp = (F.when(F.col(value) <= 0, 0.0).when(F.col("_n") < 4, F.col(value))
              .when(pos < 0, 0.0).when(pos > n - 1, 1.0)
              .otherwise(F.col("cdf") + (F.coalesce("nxt", "cdf") - F.col("cdf")) * (pos - F.col("_b"))))
    return j.withColumn(out, F.coalesce(interp, F.col(value))).select(*frames.columns, out)


def render_frames(ev: DataFrame, frame_us: int, mode: str = "count", expr: str = "sqrt",
                  gamma: float = 0.5, vmax: float | None = None) -> DataFrame:
    """Accumulate and tone-map every ``frame_us`` window of the stream."""
    f = accumulate_frames(ev, frame_us)
    col = {"count": "count", "on": "on_count", "off": "off_count"}.get(mode, mode)
    if mode in ("binary", "polarity_ratio"):
        return f.withColumn("disp", F.col(col).cast("double"))
    return tone_map(f, ["rec_id", "frame"], col, expr, gamma, vmax=vmax, signed=mode == "polarity")


def render_frame(ev: DataFrame, t_s: float, dt_s: float, back: bool = False, **kw) -> DataFrame:
    """The frame ahead of (or behind) one cursor time."""
    from .select import select_window, us
    a, b = (max(t_s - dt_s, 0.0), t_s) if back else (t_s, t_s + dt_s)
    win = select_window(ev, a, b).withColumn("t", F.col("t") - us(a))
    return render_frames(win, max(us(b) - us(a), 1), **kw)


def event_cube(ev: DataFrame, nt: int = 64, spatial_bin: int = 1, mode: str = "count") -> DataFrame:
    """Voxel counts V[y, x, slice]; slices divide the first-to-last event span."""
    w = F.when(F.col("p") == 1, 1).otherwise(-1) if mode == "polarity" else F.lit(1)
    span = F.greatest((F.col("t_last") - F.col("t_first")).cast("double"), F.lit(1e-3))
    sl = F.least(F.floor((F.col("t") - F.col("t_first")) / span * nt), F.lit(nt - 1))
    return (ev.join(small(spans(ev)), "rec_id")
            .groupBy("rec_id", F.floor(F.col("y") / spatial_bin).alias("cy"),
                     F.floor(F.col("x") / spatial_bin).alias("cx"), sl.alias("slice"))
            .agg(F.sum(w).alias("value")))


def rate_tower(ev: DataFrame, frame_us: int, cell_px: int, expr: str = "sqrt") -> DataFrame:
    """Events per second of each square cell per frame, with the display height."""
    f = (ev.groupBy("rec_id", F.floor(F.col("t") / frame_us).alias("frame"),
                    F.floor(F.col("x") / cell_px).alias("cx"), F.floor(F.col("y") / cell_px).alias("cy"))
         .agg((F.count("*") / (frame_us / US)).alias("rate_hz")))
    return tone_map(f, ["rec_id", "frame"], "rate_hz", expr)


def rate_surface(ev: DataFrame, width: int, height: int, grid: int = 8, dt_us: int = 100_000,
                 tail_us: int = 300_000) -> DataFrame:
    """Cell rate over the trailing tail at every step, and the global scale.

    Events are counted once per (cell, time unit) and only those counts are repeated for the
    steps they belong to.
    """
    tail_us = max(tail_us, dt_us)
    unit = gcd(dt_us // 2, tail_us)
    steps = spans(ev).select("rec_id", F.ceil(F.col("t_last") / dt_us).alias("_n"))
    base = (ev.groupBy("rec_id", F.least(F.floor(F.col("x") / (width / grid)), F.lit(grid - 1)).alias("gx"),
                       F.least(F.floor(F.col("y") / (height / grid)), F.lit(grid - 1)).alias("gy"),
                       (F.floor(F.col("t") / unit) * unit).alias("_u"))
            .agg(F.count("*").alias("_c")).join(steps, "rec_id"))
    lo = F.greatest(F.ceil((F.col("_u") + unit) / dt_us - 0.5), F.lit(0))
    hi = F.least(F.floor((F.col("_u") + tail_us) / dt_us - 0.5), F.col("_n") - 1)
    f = (base.where(hi >= lo).withColumn("step", F.explode(F.sequence(lo, hi)))
         .groupBy("rec_id", "step", "gx", "gy", "_n")
         .agg((F.sum("_c") / (tail_us / US)).alias("rate_hz")))
    tops = (f.groupBy("rec_id", "step").agg(F.max("rate_hz").alias("m"))
            .groupBy("rec_id").agg(F.greatest(F.percentile("m", 0.92), F.lit(1.0)).alias("zmax")))
    return f.drop("_n").join(tops, "rec_id")


def density_strip(ev: DataFrame, bins: int = 512) -> DataFrame:
    """Event histogram over the recording, divided by its peak (lit bins)."""
    s = spans(ev)
    h = (ev.join(small(s), "rec_id").where(F.col("t_last") > 0)
         .groupBy("rec_id", cell(F.col("t"), F.lit(0), F.col("t_last"), bins).alias("bin"))
         .agg(F.count("*").alias("n")))
    return h.join(h.groupBy("rec_id").agg(F.max("n").alias("_m")), "rec_id") \
            .withColumn("norm", F.col("n") / F.col("_m")).drop("_m")


# ------------------------------------------------------------------ de-rotated views
def panorama(ev: DataFrame, tel: DataFrame | None, fov_deg: float, width: int, height: int,
             az_bins: int = 720, el_bins: int = 240) -> DataFrame:
    """Azimuth x elevation histogram; the elevation range is the 0.5..99.5 percentile band."""
    el = elevation("y", fov_deg, width, height)
    rng = counted_quantiles(ev, ["rec_id"], "y", {"_ylo": 0.995, "_yhi": 0.005})
    lo, hi = elevation("_ylo", fov_deg, width, height), elevation("_yhi", fov_deg, width, height)
    a = world_azimuth(ev, tel, fov_deg, width).join(rng, "rec_id").select(
        "rec_id", cell(F.col("az"), F.lit(0.0), F.lit(360.0), az_bins).alias("az_bin"),
        cell(el, lo, hi, el_bins).alias("el_bin"))
    return (a.where("az_bin IS NOT NULL AND el_bin IS NOT NULL").groupBy("rec_id", "az_bin", "el_bin")
            .agg(F.count("*").alias("n")).withColumn("value", F.log1p("n")))


def row_panorama(ev_az: DataFrame, az_bins: int = 720) -> DataFrame:
    """Azimuth x sensor-row histogram of events that carry ``az``."""
    return (ev_az.groupBy("rec_id", "y", cell(F.col("az"), F.lit(0.0), F.lit(360.0), az_bins).alias("az_bin"))
            .agg(F.count("*").alias("n")).withColumn("value", F.log1p("n")))


def sweep_period(tel: DataFrame) -> DataFrame:
    """Rotation period from the total unwrapped azimuth of the telemetry."""
    from .rotation import unwrap
    u = unwrap(tel.select("rec_id", "t", "azimuth"), ["rec_id"], "t", "azimuth", "u")
    return u.groupBy("rec_id").agg((360.0 * (F.max("t") - F.min("t")) / US / F.abs(
        F.max_by("u", "t") - F.min_by("u", "t"))).alias("period_s"))


def trailing(ev: DataFrame, window: Column | float) -> DataFrame:
    """Events of the last ``window`` seconds of each recording, with ``_tc`` its end (s)."""
    s = spans(ev).select("rec_id", (F.col("t_last") / US).alias("_tc"))
    w = window if isinstance(window, Column) else F.lit(float(window))
    return ev.join(small(s), "rec_id").where(F.col("t") >= (F.col("_tc") - w) * US)


def phase_locked_panorama(ev: DataFrame, tel: DataFrame, fov_deg: float, width: int,
                          n_periods: int = 3, az_bins: int = 720) -> DataFrame:
    """Panorama of exactly the last N rotation periods."""
    recent = trailing(ev.join(sweep_period(tel), "rec_id"), F.col("period_s") * n_periods)
    return row_panorama(world_azimuth(recent, tel, fov_deg, width), az_bins)


def azimuth_time_waterfall(ev: DataFrame, tel: DataFrame, fov_deg: float, width: int,
                           window_s: float, rows: int = 200, cols: int = 720) -> DataFrame:
    """Density by time row (newest first) and azimuth column."""
    a = world_azimuth(trailing(ev, window_s), tel, fov_deg, width)
    r = F.floor((F.col("t") / US - (F.col("_tc") - window_s)) / window_s * rows)
    row = rows - 1 - F.greatest(F.least(r, F.lit(rows - 1)), F.lit(0))
    return (a.groupBy("rec_id", row.alias("row"),
                      F.least(F.floor(F.col("az") / 360.0 * cols), F.lit(cols - 1)).alias("col"))
            .agg(F.count("*").alias("n")).withColumn("value", F.log1p("n")))


def elevation_time_sweep(ev: DataFrame, window_s: float, cols: int = 200) -> DataFrame:
    c = F.floor((F.col("t") / US - (F.col("_tc") - window_s)) / window_s * cols)
    return (trailing(ev, window_s)
            .groupBy("rec_id", "y", F.greatest(F.least(c, F.lit(cols - 1)), F.lit(0)).alias("col"))
            .agg(F.count("*").alias("n")).withColumn("value", F.log1p("n")))


def polar_raster(ev: DataFrame, tel: DataFrame, fov_deg: float, width: int, height: int,
                 inner: float = 0.2) -> DataFrame:
    """Bearing as angle, row as radius (inner circle left blank)."""
    c, r = (height - 1) / 2.0, height * 0.46
    a = world_azimuth(ev, tel, fov_deg, width)
    rr = (inner + (1.0 - inner) * (F.col("y") / height)) * r
    th = F.radians("az")
    px = (c + rr * F.cos(th)).cast("int")
    py = (c + rr * F.sin(th)).cast("int")
    return (a.select("rec_id", px.alias("px"), py.alias("py"))
            .where((F.col("px").between(0, height - 1)) & (F.col("py").between(0, height - 1)))
            .groupBy("rec_id", "px", "py").agg(F.count("*").alias("n")))


def space_time_projection(ev: DataFrame, width: int, height: int, theta_deg: float = 30.0,
                          phi_deg: float = 20.0, depth: float = 1.0) -> DataFrame:
    """Orthographic projection of (x, y, t) onto the sensor canvas."""
    th, ph = math.radians(theta_deg), math.radians(phi_deg)
    tn = (F.col("t") - F.col("t_first")) / F.greatest(
        (F.col("t_last") - F.col("t_first")).cast("double"), F.lit(1e-3)) * (width * depth)
    p = ev.join(small(spans(ev)), "rec_id").select(
        "rec_id", (F.col("x") * math.cos(th) - tn * math.sin(th)).alias("u"),
        (F.col("y") * math.cos(ph) + (F.col("x") * math.sin(th) + tn * math.cos(th)) * math.sin(ph)).alias("v"))
    b = p.groupBy("rec_id").agg(F.min("u").alias("u0"), F.min("v").alias("v0"),
                                (F.max("u") - F.min("u")).alias("um"), (F.max("v") - F.min("v")).alias("vm"))
    sc = F.least(width / F.greatest("um", F.lit(1.0)), height / F.greatest("vm", F.lit(1.0))) * 0.92
    q = p.join(b.withColumn("sc", sc), "rec_id")
    pu = ((F.col("u") - F.col("u0")) * F.col("sc") + (width - F.col("um") * F.col("sc")) / 2).cast("int")
    pv = ((F.col("v") - F.col("v0")) * F.col("sc") + (height - F.col("vm") * F.col("sc")) / 2).cast("int")
    return (q.select("rec_id", pu.alias("pu"), pv.alias("pv"))
            .where(F.col("pu").between(0, width - 1) & F.col("pv").between(0, height - 1))
            .groupBy("rec_id", "pu", "pv").agg(F.count("*").alias("n")))


# ------------------------------------------------------------------ smoothing
def gaussian_blur(img: DataFrame, keys: list[str], axes: dict[str, int], values: list[str],
                  sigma: float) -> DataFrame:
    """Separable Gaussian smoothing of a sparse image with mirrored borders (radius 4 sigma).

    Every lit cell, and its two mirror images across the borders, is spread over its radius; one
    aggregation per axis adds the shares.
    """
    r = int(4.0 * sigma + 0.5)
    norm = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1))
    for axis, n in axes.items():
        src = F.explode(F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis)))
        lo = F.greatest(F.col("_s") - r, F.lit(0))
        hi = F.least(F.col("_s") + r, F.lit(n - 1))
        spread = (img.withColumn("_s", src).where(hi >= lo)
                  .withColumn("_d", F.explode(F.sequence(lo, hi)))
                  .withColumn("_w", F.exp(-0.5 * F.pow((F.col("_d") - F.col("_s")) / sigma, 2)) / norm))
        rest = [a for a in axes if a != axis]
        img = (spread.groupBy(*keys, *rest, F.col("_d").alias(axis))
               .agg(*[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values]))
    return img


def polarity_divergence(ev: DataFrame, width: int, height: int, sigma: float = 0.0) -> DataFrame:
    """ON minus OFF image, optionally smoothed."""
    img = ev.groupBy(*PIXEL).agg(F.sum(F.when(F.col("p") == 1, 1.0).otherwise(-1.0)).alias("div"))
    return gaussian_blur(img, ["rec_id"], {"x": width, "y": height}, ["div"], sigma) if sigma > 0 else img


def iat_surface(ev: DataFrame, min_events: int = 2, pct_lo: float = 5.0,
                pct_hi: float = 95.0) -> DataFrame:
    """Mean inter-arrival time per pixel, normalised and inverted.

    The sum of a pixel's intervals is its last minus its first time, so no ordering is needed.
    """
    p = (ev.groupBy(*PIXEL).agg((F.max("t") - F.min("t")).alias("_s"), (F.count("*") - 1).alias("n_iat"))
         .where(F.col("n_iat") >= min_events)
         .withColumn("iat_s", F.col("_s") / US / F.col("n_iat")).drop("_s"))
    b = p.groupBy("rec_id").agg(F.percentile("iat_s", pct_lo / 100).alias("_lo"),
                                F.percentile("iat_s", pct_hi / 100).alias("_hi"))
    v = (F.col("iat_s") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    return p.join(b, "rec_id").withColumn(
        "value", 1.0 - F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))).drop("_lo", "_hi")


def panorama_diff(live: DataFrame, snapshot: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Live minus snapshot raster: difference, ratio to max(b, 1) and absolute difference."""
    j = live.select(*keys, F.col(value).cast("double").alias("a")).join(
        snapshot.select(*keys, F.col(value).cast("double").alias("b")), keys, "full_outer")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return j.select(*keys, (a - b).alias("subtract"), (a / F.greatest(b, F.lit(1.0))).alias("ratio"),
                    F.abs(a - b).alias("abs_diff"))


def overlay_frames(ev: DataFrame, offsets_us: dict[str, int], frame_us: int) -> DataFrame:
    """Frames of several recordings on one clock, one count column per recording."""
    table = F.create_map(*[F.lit(v) for kv in offsets_us.items() for v in kv])
    on = ev.withColumn("frame", F.floor((F.col("t") - table[F.col("rec_id")]) / frame_us))
    cols = [F.count_if(F.col("rec_id") == r).alias(r) for r in offsets_us]
    return on.where(F.col("frame").isNotNull()).groupBy("frame", "x", "y").agg(*cols)


def mti(ev_az: DataFrame, value: str, lo: Column, hi: Column, t_bins: int = 600,
        bins: int = 720) -> DataFrame:
    """Time x value counts minus each column's time-median (empty bins count as 0), clipped at 0.

    ``lo``/``hi`` bound the value axis.  Only lit cells can stay positive, so empty cells enter
    the median as one weighted zero per column instead of a dense grid.
    """
    s = spans(ev_az)
    h = (ev_az.join(small(s), "rec_id").select(
            "rec_id", cell(F.col("t"), F.lit(0), F.col("t_last"), t_bins).alias("t_bin"),
            cell(F.col(value), lo, hi, bins).alias("bin"))
         .where(F.col("bin").isNotNull()).groupBy("rec_id", "t_bin", "bin").agg(F.count("*").alias("n")))
    zeros = h.groupBy("rec_id", "bin").agg((F.lit(t_bins) - F.count("*")).alias("w")) \
             .select("rec_id", "bin", F.lit(0).cast("long").alias("n"), "w")
    med = (h.select("rec_id", "bin", "n", F.lit(1).cast("long").alias("w")).unionByName(zeros)
           .groupBy("rec_id", "bin").agg(F.percentile("n", 0.5, F.col("w")).alias("_med")))
    return (h.join(med, ["rec_id", "bin"]).withColumn("excess", F.col("n") - F.col("_med"))
            .where(F.col("excess") > 0).drop("_med"))
