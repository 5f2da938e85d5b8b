"""Ordered series: smoothing, maxima, correlation, spin period, alignment, audio envelopes."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from ..functions.angles import wrap180
from ..functions.spectral import array_median
from ..schema import US
from ..session import cut_lineage
from .ordered import count, scan
from .raster import event_rate
from .rotation import REC, unwrap
from .spectra import region_spectrum

BLOCK = 65_536


# ------------------------------------------------------------------ neighbourhoods of long series
def halo(df: DataFrame, keys: list[str], idx: str, before: int, after: int,
         size: int) -> tuple[DataFrame, WindowSpec, Column]:
    """Cut each series into blocks that also hold the rows their edge windows need.

    Returns the enlarged frame, the window over (keys, block) in index order, and the condition
    that keeps each row's own copy once the window values are computed.
    """
    i = F.col(idx)
    blocks = F.sequence(F.floor((i - after) / size), F.floor((i + before) / size))
    out = df.withColumn("_own", F.floor(i / size)).withColumn("_block", F.explode(blocks))
    return out, Window.partitionBy(*keys, "_block").orderBy(idx), F.col("_own") == F.col("_block")


def neighbourhood(df: DataFrame, keys: list[str], idx: str, before: int, after: int,
                  make) -> DataFrame:
    """Add the columns ``make(window)`` returns, computed over a halo of rows around each row.

    Blocks are cut by row number, so gaps in the index don't shorten a halo.
    """
    numbered = scan(df, keys, [idx], F.floor(F.col(idx) / BLOCK), _row=count(False))
    big, w, own = halo(numbered, keys, "_row", before, after, BLOCK)
    cols = make(w)
    return big.withColumns(cols).where(own).select(*df.columns, *cols)


def moving_average(df: DataFrame, keys: list[str], idx: str, value: str, k: int,
                   out: str = "smooth") -> DataFrame:
    """Zero-padded moving average of length ``k`` (divides by k at the edges too)."""
    if k <= 1:
        return df.withColumn(out, F.col(value).cast("double"))
    back, fwd = k // 2, (k - 1) // 2
    return neighbourhood(df, keys, idx, back, fwd, lambda w: {
        out: F.sum(F.col(value).cast("double")).over(w.rowsBetween(-back, fwd)) / k})


def derotate_highpass(df: DataFrame, keys: list[str], idx: str, value: str, fs: float,
                      derotate_hz: float, out: str = "highpass") -> DataFrame:
    """Remove the slow rotation envelope: subtract a moving average of fs / derotate_hz samples."""
    k = max(3, int(round(fs / derotate_hz)))
    return moving_average(df, keys, idx, value, k, "_lp").withColumn(out, F.col(value) - F.col("_lp")).drop("_lp")


def detrend_norm(df: DataFrame, keys: list[str], idx: str, value: str, k: int,
                 out: str = "norm") -> DataFrame:
    """Subtract the moving average, then divide by the population standard deviation."""
    d = moving_average(df, keys, idx, value, k, "_m").withColumn("_d", F.col(value) - F.col("_m"))
    s = d.groupBy(*keys).agg(F.stddev_pop("_d").alias("_s"))
    return d.join(s, keys).withColumn(out, F.when(F.col("_s") > 1e-12, F.col("_d") / F.col("_s"))
                                      .otherwise(F.col("_d"))).drop("_m", "_d", "_s")


def rolling_median(df: DataFrame, keys: list[str], idx: str, value: str, weight: str, win: int = 5,
                   out: str = "ridge") -> DataFrame:
    """Centred median of the finite values whose weight is positive; the value itself if none."""
    h = win // 2
    ok = F.when((F.col(weight) > 0) & ~F.isnan(F.col(value).cast("double")), F.col(value))
    return neighbourhood(df, keys, idx, h, h, lambda w: {
        out: F.coalesce(array_median(F.collect_list(ok).over(w.rowsBetween(-h, h))), F.col(value))})


def local_maxima(df: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """Rows with a positive value that is at least both neighbours' (series ends excluded)."""
    p = neighbourhood(df, keys, idx, 1, 1, lambda w: {
        "_p": F.lag(value).over(w), "_n": F.lead(value).over(w)})
    return p.where((F.col(value) > 0) & (F.col(value) >= F.col("_p")) & (F.col(value) >= F.col("_n"))) \
            .drop("_p", "_n")


def angle_unwrap(df: DataFrame, keys: list[str], order: str, angle: str) -> DataFrame:
    """Signed wrapped step and cumulative unwrapped angle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return unwrap(df, keys, order, angle, "unwrapped").withColumn(
        "step_deg", wrap180(F.col(angle) - F.lag(angle).over(w)))


def radial_velocity(track: DataFrame, keys: list[str], t: str = "t_s", rel: str = "rel_distance",
                    out: str = "radial_velocity") -> DataFrame:
    """Central differences of distance over time, one-sided at the ends, zero for single points."""
    w = Window.partitionBy(*keys).orderBy(t)
    n = F.count("*").over(Window.partitionBy(*keys))
    def grad(c):
        a, b, here = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        return F.when(a.isNull(), b - here).when(b.isNull(), here - a).otherwise((b - a) / 2)
    dt = grad(t)
    v = grad(rel) / F.when(F.abs(dt) < 1e-9, 1e-9).otherwise(dt)
    return track.withColumn(out, F.when(n < 2, 0.0).otherwise(v))


def ema(df: DataFrame, keys: list[str], idx: str, values: list[str], alpha: float = 0.5) -> DataFrame:
    """Exponential averages seeded with the first row.

    Older rows weigh (1 - alpha)^k, so a history that reaches 1e-18 is exact in double precision
    and the fold needs only that many rows per output.
    """
    depth = math.ceil(math.log(1e-18) / math.log(1.0 - alpha))

    def fold(c, w):
        hist = F.collect_list(F.col(c).cast("double")).over(w.rowsBetween(-depth, 0))
        return F.aggregate(F.slice(hist, 2, depth + 1), F.element_at(hist, 1),
                           lambda acc, v: acc * (1 - alpha) + v * alpha)
    return neighbourhood(df, keys, idx, depth, 0, lambda w: {f"{c}_ema": fold(c, w) for c in values})


def measure_points(points: DataFrame, keys: list[str], cycles: float = 1.0) -> DataFrame:
    """Readout of picked (x, y, t_s) points per group: two points, or three and more."""
    w = Window.partitionBy(*keys).orderBy("t_s", "seq")
    p = points.withColumns({"_dx": F.col("x") - F.lag("x").over(w), "_dy": F.col("y") - F.lag("y").over(w),
                            "_dt": F.col("t_s") - F.lag("t_s").over(w)})
    g = p.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.hypot("_dx", "_dy")).alias("path_px"),
                             (F.max("t_s") - F.min("t_s")).alias("span_s"), F.sum("_dx").alias("_sx"),
                             F.sum("_dy").alias("_sy"), F.avg("_dt").alias("interval_mean_s"),
                             F.stddev_pop("_dt").alias("_sd"))
    two = F.col("n") == 2
    dt = F.greatest("span_s", F.lit(1e-12))
    return g.where("n >= 2").select(
        *keys, "n", "path_px", "span_s", F.when(two, F.col("_sx")).alias("dx_px"),
        F.when(two, F.col("_sy")).alias("dy_px"),
        F.when(two, cycles / dt).when(F.col("span_s") > 0, (F.col("n") - 1) / F.col("span_s")).alias("freq_hz"),
        F.when(two, F.col("path_px") / dt).alias("speed_px_s"),
        F.when(~two, F.col("interval_mean_s")).alias("interval_mean_s"),
        F.when(~two, F.col("_sd")).alias("jitter_s"))


# ------------------------------------------------------------------ correlation of long series
def _lag_sums(min_lag: int, max_lag: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(a: pd.Series, b: pd.Series, off: pd.Series) -> pd.Series:
        out = []
        for x, y, o in zip(a, b, off):
            x, y = np.asarray(x, float), np.asarray(y, float)
            # y starts at index o relative to x[0]; want sum_i y[i + lag] x[i] for each lag
            full = np.correlate(y, x, "full")           # index m <-> lag m - (len(x) - 1) + o
            lags = np.arange(min_lag, max_lag + 1)
            m = lags + len(x) - 1 - int(o)
            v = np.zeros(len(lags))
            ok = (m >= 0) & (m < len(full))
            v[ok] = full[m[ok]]
            out.append(v)
        return pd.Series(out, index=a.index)
    return run


def correlate(a: DataFrame, b: DataFrame, keys: list[str], idx: str, max_lag: int, min_lag: int | None = None,
              size: int = 4096) -> DataFrame:
    """Sum over i of b[i + lag] * a[i] for every lag in [min_lag, max_lag], per group.

    ``a`` and ``b`` are dense series (keys, idx, v).  Both are gathered in blocks of ``size`` rows,
    b's blocks widened by the lags they can meet, each pair of blocks is correlated in one Arrow
    call and the partial sums are added, so no series has to fit in one task.
    """
    min_lag = -max_lag if min_lag is None else min_lag
    i = F.col(idx)

    def blocks(df, lo, hi, name):
        span = F.sequence(F.floor((i - hi) / size), F.floor((i - lo) / size))
        return (df.withColumn("_k", F.explode(span)).groupBy(*keys, "_k")
                .agg(F.sort_array(F.collect_list(F.struct(i.alias("i"), F.col("v").cast("double").alias("v")))).alias("s"))
                .select(*keys, "_k", F.transform("s", lambda s: s["v"]).alias(name),
                        F.element_at("s", 1)["i"].alias(f"{name}_0")))

    j = blocks(a, 0, 0, "_a").join(blocks(b, min_lag, max_lag, "_b"), [*keys, "_k"])
    sums = _lag_sums(min_lag, max_lag)("_a", "_b", F.col("_b_0") - F.col("_a_0"))
    return (j.select(*keys, F.posexplode(sums).alias("pos", "s"))
            .groupBy(*keys, (F.col("pos") + min_lag).alias("lag")).agg(F.sum("s").alias("corr")))


def centred(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Series minus its mean, as column ``v``."""
    m = series.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return series.join(m, keys).withColumn("v", F.col(value) - F.col("_m")).drop("_m")


def autocorrelation(series: DataFrame, keys: list[str], idx: str, value: str, max_lag: int) -> DataFrame:
    """Autocorrelation of the mean-removed series, normalised by lag 0."""
    c = centred(series, keys, value).select(*keys, idx, "v")
    s = correlate(c, c, keys, idx, max_lag, 0)
    z = s.where("lag = 0").select(*keys, F.col("corr").alias("_z")).where("_z > 0")
    return s.join(z, keys).select(*keys, "lag", (F.col("corr") / F.col("_z")).alias("acf"))


def smoothed_rate(ev: DataFrame, bin_us: int, smooth_us: int = 10_000) -> DataFrame:
    r = event_rate(ev, bin_us).select("rec_id", "bin", "n")
    return moving_average(r, REC, "bin", "n", max(int(round(smooth_us / bin_us)), 1), "rate")


def estimate_spin_period(ev: DataFrame, bin_s: float = 0.005, lo_s: float = 0.2, hi_s: float = 5.0) -> DataFrame:
    """Rotation period from the event-rate periodicity, refined on the per-revolution peaks.

    The seed is the strongest lag of the autocorrelation; the refinement fits a line through the
    strongest bin of each revolution.
    """
    bin_us = int(round(bin_s * US))
    rate = cut_lineage(smoothed_rate(ev, bin_us))
    dims = rate.groupBy("rec_id").agg(F.count("*").alias("nb"), F.percentile("rate", 0.9).alias("thr"),
                                      F.sum("n").alias("n")).where("n >= 100")
    acf = autocorrelation(rate, REC, "bin", "rate", int(round(hi_s / bin_s)))
    top = F.least(F.lit(hi_s), F.col("nb") * bin_s / 2)
    seed = (acf.join(dims, "rec_id").where((F.col("lag") * bin_s >= lo_s - 1e-9) & (F.col("lag") * bin_s <= top + 1e-9))
            .groupBy("rec_id").agg(F.max_by("lag", F.struct("acf", -F.col("lag"))).alias("lag0"),
                                   F.max("acf").alias("confidence")))
    fit = _cycle_fit(rate.join(seed.select("rec_id", "lag0"), "rec_id").join(dims.select("rec_id", "thr"), "rec_id"), bin_s)
    period = F.when((F.col("n_peaks") >= 3) & F.col("slope").between(lo_s, hi_s), F.col("slope")).otherwise(F.col("lag0") * bin_s)
    return seed.select("rec_id", "lag0", (F.col("lag0") * bin_s).alias("seed_s"), "confidence").join(fit, "rec_id") \
               .select("rec_id", "seed_s", "confidence", F.round(period, 5).alias("period_s"), "n_peaks")


def _cycle_fit(rate: DataFrame, bin_s: float, reach: tuple[int, ...] = (8, 64, 512, 1 << 40)) -> DataFrame:
    """rec_id, slope, n_peaks: the line through the strongest bin of every cycle.

    Cycles are counted from the strongest bin of the recording with the period known so far.  The first line uses the cycles
    near it; each line is precise enough to count the cycles of a wider reach, up to the whole recording.
    """
    line = rate.groupBy("rec_id").agg(F.max_by("bin", F.struct("rate", -F.col("bin"))).alias("at"), F.first("lag0").cast("double").alias("step"))
    for cycles in reach:
        near = rate.where(F.col("rate") >= F.col("thr")).join(line, "rec_id")
        c = F.round((F.col("bin") - F.col("at")) / F.col("step"))
        near = near.withColumn("cycle", c).where((F.abs("cycle") <= cycles) & (F.abs(F.col("bin") - F.col("at") - F.col("cycle") * F.col("step")) <= 0.4 * F.col("step")))
        peaks = near.groupBy("rec_id", "cycle").agg(F.max_by("bin", F.struct("rate", -F.col("bin"))).alias("peak"), F.first("at").alias("at"), F.first("step").alias("step"))
        line = peaks.groupBy("rec_id").agg(F.regr_slope("peak", "cycle").alias("slope"), F.regr_intercept("peak", "cycle").alias("start"), F.first("at").alias("at"),
                                           F.first("step").alias("step"), F.count("*").alias("n_peaks"))
        good = (F.col("n_peaks") >= 3) & F.col("slope").isNotNull()
        line = line.select("rec_id", "n_peaks", F.when(good, F.col("start")).otherwise(F.col("at")).alias("at"), F.when(good, F.col("slope")).otherwise(F.col("step")).alias("step"))
    return line.select("rec_id", (F.col("step") * bin_s).alias("slope"), "n_peaks")


def refine_telemetry_offset(ev: DataFrame, pulses: DataFrame, bin_s: float = 0.005,
                            search_s: float = 0.4) -> DataFrame:
    """Lag that maximises the mean-removed event rate summed at the pulse times."""
    bin_us = int(round(bin_s * US))
    nb = F.greatest(F.ceil(F.col("_end") / bin_us), F.lit(1))
    dims = ev.groupBy("rec_id").agg(F.max("t").alias("_end")).select("rec_id", nb.alias("nb"))
    counts = (ev.join(dims, "rec_id")
              .groupBy("rec_id", F.least(F.floor(F.col("t") / bin_us), F.col("nb") - 1).alias("bin"))
              .agg(F.count("*").alias("c")))
    grid = dims.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    r = grid.join(counts, ["rec_id", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    r = centred(r, REC, "c").select("rec_id", "bin", "nb", "v")
    steps = int(math.ceil(2 * search_s / bin_s - 1e-9))
    lags = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    g = (pulses.select("rec_id", "t", lags.alias("step"))
         .withColumn("g", F.col("t") / US + (F.col("step") * bin_s - search_s))
         .withColumn("_p", F.col("g") / bin_s - 0.5).withColumn("bin", F.floor("_p")))
    a = r.select("rec_id", "bin", "nb", F.col("v").alias("va"))
    b = r.select("rec_id", (F.col("bin") - 1).alias("bin"), F.col("v").alias("vb"))
    j = g.join(a, ["rec_id", "bin"]).join(b, ["rec_id", "bin"]).where((F.col("_p") > 0) & (F.col("_p") < F.col("nb") - 1))
    s = j.groupBy("rec_id", "step").agg(F.count("*").alias("n"), F.sum(
        F.col("va") + (F.col("vb") - F.col("va")) * (F.col("_p") - F.col("bin"))).alias("score")).where("n >= 2")
    return s.groupBy("rec_id").agg(
        (F.max_by("step", F.struct(F.round("score", 9), -F.col("step"))) * bin_s - search_s).alias("offset_s"),
        F.max("score").alias("score"))


def cross_correlate(a: DataFrame, b: DataFrame, bin_s: float, max_lag_s: float,
                    parabolic: bool = False) -> DataFrame:
    """Best lag to add to series ``b`` so that it lines up with ``a`` (both (key, i, v), normalised).

    The correlation is divided by the longer length; the first best lag wins; ``parabolic`` adds
    the sub-bin refinement.
    """
    cap = int(round(max_lag_s / bin_s))
    n = (a.groupBy("key").agg(F.count("*").alias("na")).join(b.groupBy("key").agg(F.count("*").alias("nb")), "key")
         .select("key", F.greatest("na", "nb").alias("n"), "na", "nb"))
    c = correlate(b, a, ["key"], "i", cap).join(n, "key").where(
        (F.col("lag") > -F.col("nb")) & (F.col("lag") < F.col("na"))).withColumn("corr", F.col("corr") / F.col("n"))
    g = c.groupBy("key").agg(F.max_by("lag", F.struct(F.round("corr", 9), -F.col("lag"))).alias("lag"))
    best = g.join(c.select("key", "lag", F.col("corr").alias("peak_corr")), ["key", "lag"])
    if parabolic:
        l = c.select("key", (F.col("lag") + 1).alias("lag"), F.col("corr").alias("y0"))
        r = c.select("key", (F.col("lag") - 1).alias("lag"), F.col("corr").alias("y2"))
        best = best.join(l, ["key", "lag"], "left").join(r, ["key", "lag"], "left")
        den = F.col("y0") - 2 * F.col("peak_corr") + F.col("y2")
        delta = F.coalesce(F.when(den != 0, 0.5 * (F.col("y0") - F.col("y2")) / den), F.lit(0.0))
    else:
        delta = F.lit(0.0)
    return best.select("key", "lag", ((F.col("lag") + delta) * bin_s).alias("offset_s"), "peak_corr")


def envelope(series: DataFrame, keys: list[str], idx: str, value: str, bin_s: float,
             smooth_s: float = 0.3, detrend_s: float = 2.0) -> DataFrame:
    """Smoothed, de-trended and normalised envelope as (keys, i, v)."""
    s = moving_average(series, keys, idx, value, max(1, int(round(smooth_s / bin_s))), "_s")
    d = detrend_norm(s.drop(value).withColumnRenamed("_s", value), keys, idx, value,
                     max(1, int(round(detrend_s / bin_s))), "v")
    return d.select(*keys, F.col(idx).alias("i"), "v")


# ------------------------------------------------------------------ audio
def audio_normalize(audio: DataFrame) -> DataFrame:
    """Scale to peak |1|; silence stays as it is."""
    peak = audio.groupBy("rec_id").agg(F.max(F.abs("amp")).alias("_p"))
    return audio.join(peak, "rec_id").withColumn(
        "amp", F.when(F.col("_p") > 0, F.col("amp") / F.col("_p")).otherwise(F.col("amp"))).drop("_p")


def audio_window(audio: DataFrame, rate: int, t0: float | None = None, t1: float | None = None) -> DataFrame:
    """Samples of [t0, t1) seconds, re-zeroed."""
    i0 = 0 if t0 is None else max(0, int(round(t0 * rate)))
    out = audio.where(F.col("i") >= i0)
    if t1 is not None:
        out = out.where(F.col("i") < max(int(round(t1 * rate)), i0))
    return out.withColumn("i", F.col("i") - i0)


def rms_envelope(audio: DataFrame, rate: int, bin_s: float = 0.01) -> DataFrame:
    """RMS per bin of the peak-normalised audio; a trailing partial bin is dropped."""
    spb = max(1, int(round(rate * bin_s)))
    g = (audio.groupBy("rec_id", F.floor(F.col("i") / spb).alias("bin"))
         .agg(F.sum(F.col("amp") * F.col("amp")).alias("_e"), F.max(F.abs("amp")).alias("_m"),
              F.count("*").alias("_n")))
    peak = g.groupBy("rec_id").agg(F.max("_m").alias("_p"))
    scale = F.when(F.col("_p") > 0, F.col("_p")).otherwise(1.0)
    return g.where(F.col("_n") == spb).join(peak, "rec_id").select(
        "rec_id", "bin", ((F.col("bin") + 0.5) * (spb / rate)).alias("t_s"),
        (F.sqrt(F.col("_e") / spb) / scale).alias("rms"))


def plan_alignment(ev: DataFrame, audio: DataFrame, rate: int, pairs: DataFrame, bin_s: float = 0.01,
                   max_lag_s: float = 12.0, smooth_s: float = 0.3, detrend_s: float = 2.0,
                   offset_s: float | None = None) -> DataFrame:
    """Offset (given or estimated) and shared seconds for each (rec_id, audio_id) pair."""
    dur = ev.groupBy("rec_id").agg(((F.max("t") - F.min("t")) / US).alias("e_s"))
    adur = audio.groupBy(F.col("rec_id").alias("audio_id")).agg((F.count("*") / rate).alias("a_s"))
    p = pairs.withColumn("key", F.concat_ws("|", "rec_id", "audio_id"))
    if offset_s is None:
        e = envelope(event_rate(ev, int(round(bin_s * US))).select("rec_id", "bin", "rate_hz"), REC, "bin", "rate_hz",
                     bin_s, smooth_s, detrend_s)
        a = envelope(rms_envelope(audio, rate, bin_s).select("rec_id", "bin", "rms"), REC, "bin", "rms", bin_s,
                     smooth_s, detrend_s)
        ek = e.join(p, "rec_id").select("key", "i", "v")
        ak = a.withColumnRenamed("rec_id", "audio_id").join(p, "audio_id").select("key", "i", "v")
        r = cross_correlate(ek, ak, bin_s, max_lag_s)
    else:
        r = p.select("key", F.lit(float(offset_s)).alias("offset_s"), F.lit(None).cast("double").alias("peak_corr"))
    j = r.join(p, "key").join(dur, "rec_id").join(adur, "audio_id")
    lo = F.greatest(F.lit(0.0), F.col("offset_s"))
    hi = F.least(F.col("e_s"), F.col("offset_s") + F.col("a_s"))
    return j.select("rec_id", "audio_id", "offset_s", "peak_corr", F.greatest(hi - lo, F.lit(0.0)).alias("overlap_s"))


def whiten_power(rows: DataFrame, keys: list[str], idx: str, value: str, method: str = "median",
                 win: int | None = None, out: str = "white") -> DataFrame:
    """Divide a spectrum by its sliding median, or express it in local sigmas (edges replicated).

    The default window is about 5 % of the spectrum, odd and at least 5; spectra under 8 bins are
    returned unchanged.
    """
    if method == "none":
        return rows.withColumn(out, F.col(value))
    s = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(idx, value))).alias("_s"))
    n = F.size("_p")
    s = s.withColumn("_p", F.transform("_s", lambda e: e[value].cast("double")))
    half_n = F.lit(win) if win else F.greatest(F.lit(5), F.expr("(size(_p) div 20) | 1"))
    s = s.withColumn("_w", half_n.cast("int")).withColumn("_h", F.expr("cast(_w div 2 as int)"))
    s = s.withColumn("_pad", F.concat(F.array_repeat(F.element_at("_p", 1), F.col("_h")), F.col("_p"),
                                      F.array_repeat(F.element_at("_p", -1), F.col("_h"))))
    win_at = lambda i: F.slice("_pad", i + 1, F.col("_w"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    if method == "median":
        white = F.transform("_p", lambda v, i: v / (F.element_at(F.sort_array(win_at(i)), F.col("_h") + 1) + 1e-20))
    else:
        def z(v, i):
            m = total(win_at(i)) / F.col("_w")
            q = total(F.transform(win_at(i), lambda x: x * x)) / F.col("_w")
            return F.greatest((v - m) / F.sqrt(F.greatest(q - m * m, F.lit(1e-20))), F.lit(0.0))
        white = F.transform("_p", z)
    white = F.when(n < 8, F.col("_p")).otherwise(white)
    return s.select(*keys, F.explode(F.arrays_zip("_s", white.alias("w"))).alias("z")) \
            .select(*keys, F.col(f"z._s.{idx}").alias(idx), F.col(f"z._s.{value}").alias(value),
                    F.col("z.w").alias(out))


def spectral_flatness(rows: DataFrame, keys: list[str], power: str) -> DataFrame:
    """Geometric over arithmetic mean of the positive powers; 1 with fewer than four."""
    p = F.when(F.col(power) > 0, F.col(power))
    g = rows.groupBy(*keys).agg(F.count(p).alias("_n"), F.avg(F.log(p)).alias("_l"), F.avg(p).alias("_a"))
    return g.select(*keys, F.when(F.col("_n") < 4, 1.0).otherwise(
        F.exp("_l") / (F.col("_a") + 1e-30)).alias("flatness"))


def global_blink(ev: DataFrame, step_s: float = 0.25, fs: float = 2000.0, fmin: float = 10.0,
                 fmax: float = 800.0, snr_gate: float = 4.0) -> DataFrame:
    """Whole-frame spectrum per time step, kept where the line clears the gate."""
    e = ev.withColumn("step", F.floor(F.col("t") / int(step_s * US)))
    return region_spectrum(e, ["rec_id", "step"], fs, fmin, fmax).where(F.col("snr") >= snr_gate)
