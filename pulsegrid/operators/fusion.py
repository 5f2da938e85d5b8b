"""Acoustic and event rotor tracks, their convergence, fusion and coherence."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.spectral import array_median, band_slice
from ..schema import US
from .detect import box_lines
from .signal import audio_normalize, rolling_median
from .spectra import spectra
from .tracks import box_asof, track_interp_join

# Logistic weights of the per-frame confidence (per dB of SNR, per harmonic, per unit
# of tonality, offset) and the floor of the convergence gate
A_SNR = 0.30
B_HARM = 0.55
C_TONAL = 1.2
D_BIAS = 2.6
GATE_FLOOR = 0.4


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def harmonic_f0(spec: DataFrame, step: Column, f0_range=(380.0, 780.0), band=(300.0, 1400.0), n_harm: int = 5,
                cand_step: float = 2.0) -> DataFrame:
    """Fundamental with the largest harmonic sum of the array ``power`` on the grid i * step.

    Adds f0, snr (mean harmonic power over the in-band median) and the count of harmonics above
    three floors.
    """
    n = int(math.floor((f0_range[1] - f0_range[0]) / cand_step + 1e-6)) + 1
    p = F.col("power")

    def at(f):
        pos = f / step
        i = F.floor(pos).cast("int")
        last = F.size(p) - 1
        inside = (pos >= 0) & (pos <= last)
        a = F.element_at(p, F.least(F.greatest(i, F.lit(0)), last) + 1)
        b = F.element_at(p, F.least(F.greatest(i + 1, F.lit(0)), last) + 1)
        return F.when(inside, a + (b - a) * (pos - i)).otherwise(0.0)

    hs = F.sequence(F.lit(1), F.lit(n_harm))
    cands = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: f0_range[0] + i * cand_step)
    total = lambda f: F.aggregate(hs, F.lit(0.0), lambda s, h: s + at(h * f))
    inb, _ = band_slice(p, step, *band)
    d = spec.withColumn("_floor", array_median(F.when(F.size(inb) > 0, inb).otherwise(p)) + 1e-30)
    d = d.withColumn("_best", F.array_max(F.transform(cands, lambda f: F.struct(F.round(total(f), 15).alias("s"), (-f).alias("f")))))
    d = d.withColumn("f0", F.when(F.size(p) >= 4, -F.col("_best.f")))
    return d.withColumns({
        "snr": F.coalesce(total(F.col("f0")) / (F.col("_floor") * n_harm), F.lit(0.0)),
        "harm": F.coalesce(F.size(F.filter(hs, lambda h: at(h * F.col("f0")) > 3.0 * F.col("_floor"))).cast("double"), F.lit(0.0))}) \
        .drop("_best", "_floor")


def acoustic_track(audio: DataFrame, rate: int, band=(300.0, 1400.0), f0_range=(380.0, 780.0), n_harm: int = 5,
                   frame_s: float = 0.1, hop_s: float = 0.05, highpass_hz: float = 200.0, cand_step: float = 2.0) -> DataFrame:
    """Per frame: rotor fundamental, SNR, harmonics and confidence of a recording's audio.

    Frames are centred on multiples of the hop and zero-padded at the ends.  The band-pass is
    applied to each frame's spectrum.
    """
    nper, hop = int(frame_s * rate), int(hop_s * rate)
    half = nper // 2
    a = audio_normalize(audio)
    n = audio.groupBy("rec_id").agg(F.count("*").alias("_len")).where(F.col("_len") >= int(2 * frame_s * rate))
    last = F.ceil(F.col("_len") / hop)
    lo = F.greatest(F.ceil((F.col("i") + half - nper + 1) / hop), F.lit(0))
    hi = F.least(F.floor((F.col("i") + half) / hop), last)
    fr = (a.join(n, "rec_id").where(hi >= lo).withColumn("frame", F.explode(F.sequence(lo, hi)))
          .select("rec_id", "frame", (F.col("i") - (F.col("frame") * hop - half)).cast("int").alias("bin"),
                  F.col("amp").alias("c"), F.lit(nper).alias("n_bins")))
    sp = spectra(fr, ["rec_id", "frame"], "stft")
    step = rate / nper
    pass_lo, pass_hi = max(highpass_hz, band[0] * 0.8), min(band[1] * 1.8, 0.499 * rate)
    sp = sp.withColumn("power", F.transform("power", lambda p, i: F.when(
        (i * step >= pass_lo) & (i * step <= pass_hi), p).otherwise(0.0)))
    d = harmonic_f0(sp, F.lit(step), f0_range, band, n_harm, cand_step)
    inb, _ = band_slice(F.col("power"), F.lit(step), band[0] * 0.5, band[1] * 1.2)
    pos = F.filter(inb, lambda p: p > 0)
    k = F.size(pos)
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    flat = F.when(k < 4, 1.0).otherwise(F.exp(add(F.transform(pos, lambda p: F.log(p))) / k) / (add(pos) / k + 1e-30))
    d = d.withColumn("flatness", flat).select("rec_id", "frame", (F.col("frame") * hop * (US / rate)).cast("long").alias("t"),
                                              "f0", "snr", "harm", "flatness")
    d = rolling_median(d, ["rec_id"], "frame", "f0", "snr").drop("f0").withColumnRenamed("ridge", "f0")
    z = A_SNR * 10 * F.log10(F.greatest("snr", F.lit(1e-3))) + B_HARM * F.col("harm") + C_TONAL * (1 - F.col("flatness")) - D_BIAS
    return d.withColumn("conf", logistic(z))


def ebs_rotor_track(ev: DataFrame, boxes: DataFrame, band=(300.0, 1400.0), window_s: float = 0.3, min_snr: float = 3.0,
                    min_events: int = 16) -> DataFrame:
    """In-box line per tracked box (rec_id, step, t, x0..y1): f0, SNR, harmonic score, confidence."""
    b = boxes.withColumn("blob", F.lit(0))
    l = box_lines(ev, b, window_s, max(2.2 * band[1], 2000.0), *band, min_events)
    d = b.select("rec_id", "step", "t").join(l.drop("blob", "n_events"), ["rec_id", "step"], "left").select(
        "rec_id", "step", "t", F.col("freq_hz").alias("f0"), F.when(F.col("freq_hz").isNotNull(), F.col("snr")).otherwise(0.0).alias("snr"),
        F.when(F.col("freq_hz").isNotNull(), F.col("harmonic")).otherwise(0.0).alias("harm"))
    d = rolling_median(d, ["rec_id"], "step", "f0", "snr").drop("f0").withColumnRenamed("ridge", "f0")
    z = A_SNR * 10 * F.log10(F.greatest("snr", F.lit(1e-3))) + B_HARM * 3.0 * F.col("harm") - D_BIAS
    return d.withColumn("conf", logistic(z) * F.when(F.col("snr") < min_snr, 0.3).otherwise(1.0))


def harmonic_ratio(fa: Column, fe: Column) -> Column:
    """fe over the nearest of fa x {1, 2, 3, 1/2, 1/3}; null when either is missing."""
    t = F.array(*[fa * m for m in (1.0, 2.0, 3.0, 0.5, 1.0 / 3.0)])
    best = F.array_min(F.transform(t, lambda v, i: F.struct(F.abs(F.log(fe / v)).alias("d"), i.alias("i"), v.alias("v"))))
    return F.when((fa > 0) & (fe > 0), fe / best["v"])


def with_acoustic(ebs: DataFrame, acoustic: DataFrame, keys: list[str], sigma: float = 0.2,
                  thresh: float = 0.5) -> DataFrame:
    """Event frames with interpolated acoustic values, frequency ratio, kappa and presence flags."""
    j = track_interp_join(ebs, acoustic, keys)
    j = j.withColumn("ratio", harmonic_ratio(F.col("a_f0"), F.col("f0")))
    return j.withColumns({
        "kappa": F.coalesce(F.exp(-F.pow(F.log("ratio") / sigma, 2)), F.lit(0.0)),
        "a_on": F.coalesce("a_conf", F.lit(0.0)) >= thresh, "e_on": F.col("conf") >= thresh})


def convergence(joined: DataFrame, keys: list[str], sigma: float = 0.2) -> DataFrame:
    """Overlap of presence, harmonic-aware band agreement, covariation and overall kappa."""
    both, either = F.col("a_on") & F.col("e_on"), F.col("a_on") | F.col("e_on")
    sel = both & F.col("a_f0").isNotNull() & F.col("f0").isNotNull()
    fa, fe = F.when(sel, F.col("a_f0")), F.when(sel, F.col("f0"))
    g = joined.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.count_if(both).alias("_b"), F.count_if(either).alias("_e"), F.count(fa).alias("n_both"),
        F.median(fa).alias("_fa"), F.median(fe).alias("_fe"), F.covar_pop(fa, fe).alias("_cv"), (F.stddev_pop(fa) * F.stddev_pop(fe)).alias("_sd"))
    ok = F.col("n_both") >= 5
    g = g.withColumn("median_freq_ratio", F.when(ok, harmonic_ratio(F.col("_fa"), F.col("_fe"))))
    g = g.withColumns({
        "temporal_overlap": F.when(F.col("_e") > 0, F.col("_b") / F.col("_e")).otherwise(0.0),
        "band_agreement": F.when(ok, F.exp(-F.pow(F.log("median_freq_ratio") / sigma, 2))).otherwise(0.0),
        "f0_covariation": F.when(ok & (F.col("_sd") > 0), F.col("_cv") / F.col("_sd"))})
    return g.withColumn("kappa_overall", F.col("temporal_overlap") * F.col("band_agreement")).drop("_b", "_e", "_fa", "_fe", "_cv", "_sd")


def bayes(pa: Column, pe: Column) -> Column:
    den = pa * pe + (1 - pa) * (1 - pe)
    return F.when(den > 0, pa * pe / den).otherwise(0.0)


def fuse_frames(joined: DataFrame) -> DataFrame:
    """Per-frame Bayes value and its soft convergence gate."""
    pb = bayes(F.coalesce("a_conf", F.lit(0.0)), F.col("conf"))
    return joined.withColumn("p_bayes", pb).withColumn("p_gated", F.col("p_bayes") * (GATE_FLOOR + (1 - GATE_FLOOR) * F.col("kappa")))


def fuse_confidence(joined: DataFrame, acoustic: DataFrame, ebs: DataFrame, conv: DataFrame, keys: list[str]) -> DataFrame:
    """Clip-level fusion: q90 confidences, Bayes, gate, and the SNR-weighted median fundamental."""
    ca = acoustic.groupBy(*keys).agg(F.percentile("conf", 0.9).alias("c_acoustic"))
    ce = ebs.groupBy(*keys).agg(F.percentile("conf", 0.9).alias("c_ebs"))
    sel = joined.where("a_on AND e_on AND a_f0 IS NOT NULL AND f0 IS NOT NULL")
    vw = sel.select(*keys, F.explode(F.array(
        F.struct(F.col("a_f0").alias("v"), F.coalesce("a_snr", F.lit(0.0)).alias("w"), F.lit(0).alias("o")),
        F.struct(F.col("f0").alias("v"), F.col("snr").alias("w"), F.lit(1).alias("o")))).alias("s")).select(*keys, "s.*")
    run = Window.partitionBy(*keys).orderBy("v", "o").rowsBetween(Window.unboundedPreceding, 0)
    tot = F.sum("w").over(Window.partitionBy(*keys))
    f0 = (vw.withColumn("_c", F.sum("w").over(run)).withColumn("_t", tot).where((F.col("_t") > 0) & (F.col("_c") >= 0.5 * F.col("_t")))
          .groupBy(*keys).agg(F.min("v").alias("fused_f0_hz")))
    g = ca.join(ce, keys).join(conv.select(*keys, "kappa_overall"), keys).join(f0, keys, "left")
    g = g.withColumn("p_dual", bayes(F.col("c_acoustic"), F.col("c_ebs")))
    return g.withColumn("p_fused", F.col("p_dual") * (GATE_FLOOR + (1 - GATE_FLOOR) * F.col("kappa_overall")))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _cross(ba: pd.Series, va: pd.Series, bb: pd.Series, vb: pd.Series, n: pd.Series) -> pd.Series:
    """Auto- and cross-spectra of one segment: [Sxx, Syy, Re Sxy, Im Sxy]."""
    out = []
    for i, v, j, w, k in zip(ba, va, bb, vb, n):
        k = int(k)
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(k) / k)
        s = np.zeros((2, k))
        s[0, np.asarray(i, np.int64)] = np.asarray(v, float)
        s[1, np.asarray(j, np.int64)] = np.asarray(w, float)
        X, Y = np.fft.rfft((s - s.mean(axis=1, keepdims=True)) * win, axis=1)
        c = np.conj(X) * Y
        out.append([np.abs(X) ** 2, np.abs(Y) ** 2, c.real, c.imag])
    return pd.Series(out, index=n.index)


def cross_coherence(ev: DataFrame, boxes: DataFrame, audio: DataFrame, rate: int, plan: DataFrame, band=(300.0, 1200.0),
                    fs: float = 2000.0, nperseg: int = 2048) -> DataFrame:
    """Magnitude-squared coherence of the in-box event rate and the audio on one clock, in-band peak.

    ``plan`` has (rec_id, audio_id, offset_s).  Audio is averaged down to ``fs``; segments overlap
    by half; a span shorter than one segment has no result.  Coherence is a ratio per frequency, so restricting it to the band replaces the
    filtering of both series.
    """
    t0 = boxes.groupBy("rec_id").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    e = box_asof(ev, boxes).join(t0, "rec_id").withColumn("bin", F.floor((F.col("t") - F.col("_t0")) / (US / fs))) \
        .groupBy("rec_id", "bin").agg(F.count("*").cast("double").alias("v"))
    a = audio_normalize(audio).withColumnRenamed("rec_id", "audio_id").join(plan, "audio_id").join(t0, "rec_id")
    ta = F.col("i") / rate + F.col("offset_s") - F.col("_t0") / US
    a = (a.where((ta >= 0) & (ta < (F.col("_t1") - F.col("_t0")) / US)).groupBy("rec_id", F.floor(ta * fs).alias("bin"))
         .agg(F.avg("amp").alias("v")))
    ends = a.groupBy("rec_id").agg((F.max("bin") + 1).alias("_na"))
    n = t0.join(ends, "rec_id").select("rec_id", F.least(F.floor((F.col("_t1") - F.col("_t0")) / (US / fs)), F.col("_na")).alias("_n")) \
          .where(F.col("_n") >= nperseg).withColumn("_len", F.lit(nperseg).cast("int"))
    hop = F.greatest(F.floor(F.col("_len") / 2), F.lit(1))
    last = F.floor((F.col("_n") - F.col("_len")) / hop)

    def segs(s, name):
        d = s.join(n, "rec_id").where(F.col("bin") < F.col("_n"))
        lo = F.greatest(F.ceil((F.col("bin") - F.col("_len") + 1) / hop), F.lit(0))
        hi = F.least(F.floor(F.col("bin") / hop), last)
        return (d.where(hi >= lo).withColumn("seg", F.explode(F.sequence(lo, hi))).groupBy("rec_id", "seg", "_len")
                .agg(F.collect_list((F.col("bin") - F.col("seg") * hop).cast("int")).alias(f"{name}_b"), F.collect_list("v").alias(f"{name}_v")))

    # Every segment counts, silent ones too: they add their audio power and no event power.
    seg = n.select("rec_id", "_len", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("seg"))
    j = seg.join(segs(e, "e"), ["rec_id", "seg", "_len"], "left").join(segs(a, "a"), ["rec_id", "seg", "_len"], "left")
    j = j.withColumns({c: F.coalesce(c, F.array().cast(j.schema[c].dataType)) for c in ("e_b", "e_v", "a_b", "a_v")})
    s = j.select("rec_id", "_len", _cross("e_b", "e_v", "a_b", "a_v", "_len").alias("s"))
    z = s.select("rec_id", "_len", F.posexplode(F.arrays_zip(*[F.element_at("s", i + 1).alias(c) for i, c in enumerate(("xx", "yy", "re", "im"))]))
                 .alias("k", "z")).groupBy("rec_id", "_len", "k").agg(*[F.sum(f"z.{c}").alias(c) for c in ("xx", "yy", "re", "im")], F.count("*").alias("n_segments"))
    coh = (F.col("re") ** 2 + F.col("im") ** 2) / F.greatest(F.col("xx") * F.col("yy"), F.lit(1e-300))
    z = z.withColumn("coh", coh).withColumn("f_hz", F.col("k") * fs / F.col("_len")).where(F.col("f_hz").between(*band))
    return z.groupBy("rec_id", "n_segments").agg(F.max_by("f_hz", F.struct("coh", -F.col("k"))).alias("peak_hz"), F.max("coh").alias("peak_coh"))
