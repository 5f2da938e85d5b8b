"""Flicker spectra: native binning, one Arrow FFT per series, JVM-side peak analysis.

A series is as long as its time span times the sampling rate, however many events it counts.  Up to ``LONG`` bins its
non-empty bins are gathered into one row and transformed there.  Longer ones stay rows and go through the transform in
blocks of :mod:`.fourier`; the same peak rules apply to both, and the longest span decides before any series is built.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.spectral import array_median, band_slice, harmonic_comb, power_udf, whiten_udf
from ..schema import US
from ..session import cut_lineage
from .asof import legs, lerp, small
from .fourier import long_lines, long_power, nufft, row_median
from .grid import grid_join
from .ordered import chunk_of, last, scan
from .raster import spans
from .select import random_subsample


#: Bins of a series that is transformed in one row (two minutes at 2 kHz).
LONG = 1 << 18


# ------------------------------------------------------------------ binning
def bin_signal(ev: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Counts per 1/fs bin from first to last event (non-empty bins), with the bin total ``n_bins``.

    Events past the last whole bin are dropped; one exactly on the last edge counts in the last bin.
    """
    return _bins_of(ev, keys, fs, _bin_spans(ev, keys, fs))


def _bin_spans(ev: DataFrame, keys: list[str], fs: float, min_events: int = 0) -> DataFrame:
    """First event, event count and bin total of every group, computed once."""
    s = ev.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.count("*").alias("n_events"))
    return small(s.where(F.col("n_events") >= min_events).select(*keys, "_lo", "n_events", F.floor((F.col("_hi") - F.col("_lo")) / (US / fs)).cast("int").alias("n_bins")).where("n_bins >= 2"))


def _bins_of(ev: DataFrame, keys: list[str], fs: float, s: DataFrame) -> DataFrame:
    pos = (F.col("t") - F.col("_lo")) / (US / fs)
    b = F.when(pos == F.col("n_bins"), F.col("n_bins") - 1).otherwise(F.floor(pos))
    return (ev.select(*keys, "t").join(s, keys).withColumn("bin", b.cast("int"))
            .where(F.col("bin") < F.col("n_bins"))
            .groupBy(*keys, "n_events", "n_bins", "bin").agg(F.count("*").alias("c")))


def _has_long(spans_: DataFrame) -> bool:
    return not spans_.where(F.col("n_bins") > LONG).isEmpty()


def dense_series(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Fill the empty bins with zeros: one row per bin."""
    s = binned.groupBy(*keys).agg(F.first("n_bins").alias("n_bins"))
    grid = s.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1))).drop("n_bins")
    return grid.join(binned.select(*keys, "bin", "c"), [*keys, "bin"], "left") \
               .withColumn("c", F.coalesce("c", F.lit(0)))


def spectra(binned: DataFrame, keys: list[str], kind: str = "power", highpass_len: int = 0, normalize: str = "none") -> DataFrame:
    """One spectrum array ``power`` per key from (keys, n_bins, bin, c [, n_events])."""
    extra = [F.first(c).alias(c) for c in ("n_events", "fs") if c in binned.columns]
    g = binned.groupBy(*keys).agg(F.first("n_bins").alias("n_bins"), F.collect_list("bin").alias("_b"),
                                  F.collect_list("c").alias("_c"), F.sum("c").alias("n_binned"), *extra)
    return g.withColumn("power", power_udf(kind, highpass_len, normalize=normalize)("_b", "_c", "n_bins")).drop("_b", "_c")


def peak_columns(df: DataFrame, fs, fmin: float, fmax: float, n_harmonics: int = 3) -> DataFrame:
    """Add peak_freq, peak_power, snr (against all non-DC bins) and harmonic score."""
    fs = fs if isinstance(fs, Column) else F.lit(float(fs))
    step = fs / F.col("n_bins")
    band, lo = band_slice(F.col("power"), step, fmin, fmax)
    has = F.col("power").isNotNull() & (F.size(band) > 0)
    peak = F.array_max(band)
    idx = lo + F.array_position(band, peak).cast("int") - 1
    noise = array_median(F.slice("power", 2, F.size("power") - 1))
    df = df.withColumn("df_hz", step)
    df = df.withColumn("peak_freq", F.when(has, idx * step)).withColumn(
        "peak_power", F.when(has, peak).otherwise(0.0))
    return (df.withColumn("snr", F.when(has, F.col("peak_power") / (noise + 1e-12)).otherwise(0.0))
            .withColumn("harmonic", F.when(has, harmonic_comb(
                F.col("power"), F.col("df_hz"), F.col("peak_freq"), fmax, n_harmonics)).otherwise(0.0)))


def lines(binned: DataFrame, keys: list[str], fs, fmin: float, fmax: float, n_harmonics: int = 3, long: bool = False,
          highpass_len: int = 0, normalize: str = "none") -> DataFrame:
    """Spectrum and dominant line of (keys, n_bins, bin, c [, n_events, fs]); ``power`` is null for series of over ``LONG`` bins.

    High-passed and whitened spectra need their neighbours, so those are always transformed in one row.
    """
    if not long or highpass_len or normalize != "none":
        return peak_columns(spectra(binned, keys, "power", highpass_len, normalize), fs, fmin, fmax, n_harmonics)
    short = peak_columns(spectra(binned.where(F.col("n_bins") <= LONG), keys), fs, fmin, fmax, n_harmonics)
    far = binned.where(F.col("n_bins") > LONG)
    own = small(far.groupBy(*keys).agg(F.sum("c").alias("n_binned"), *[F.first(c).alias(c) for c in ("n_events", "fs") if c in binned.columns]))
    rows = cut_lineage(long_power(far, keys))
    if "fs" in binned.columns:
        rows = rows.join(own.select(*keys, "fs"), keys)
    out = long_lines(rows, keys, fs if isinstance(fs, Column) else F.lit(float(fs)), fmin, fmax, n_harmonics).join(own, keys)
    return short.unionByName(out.withColumn("power", F.lit(None).cast("array<double>")).select(*short.columns))


def region_spectrum(ev: DataFrame, keys: list[str], fs: float = 2000.0, fmin: float = 10.0,
                    fmax: float = 800.0, derotate_hz: float = 0.0, n_harmonics: int = 3, normalize: str = "none", min_events: int = 0) -> DataFrame:
    """Temporal power spectrum of each group's event stream, with its dominant in-band line.

    Groups of fewer than ``min_events`` are left out by their spans, so the events need no join of their own for it.

    ``normalize`` (median or zscore) whitens the spectrum before the line is looked for.
    """
    hp = max(3, int(round(fs / derotate_hz))) if derotate_hz > 0 else 0
    s = _bin_spans(ev, keys, fs, min_events)
    return lines(_bins_of(ev, keys, fs, s), keys, fs, fmin, fmax, n_harmonics, _has_long(s), hp, normalize)


def band_snr(spec: DataFrame, fs: float, band: tuple[float, float] = (300.0, 1500.0),
             lo_exclude: float = 50.0) -> DataFrame:
    """In-band peak over the median of the out-of-band power above ``lo_exclude``."""
    step = F.lit(float(fs)) / F.col("n_bins")
    inb, _ = band_slice(F.col("power"), step, *band)
    rest = F.filter("power", lambda p, i: (i * step > lo_exclude)
                    & ((i * step < band[0]) | (i * step > band[1])))
    ok = F.col("power").isNotNull() & (F.size(inb) > 0) & (F.size(rest) > 0)
    return spec.withColumn("band_snr", F.when(ok, F.array_max(inb) / (array_median(rest) + 1e-30)))


def region_band_snr(ev: DataFrame, keys: list[str], fs: float = 2000.0, band: tuple[float, float] = (300.0, 1500.0),
                    lo_exclude: float = 50.0) -> DataFrame:
    """:func:`band_snr` of each group's event stream, of any length: keys, n_bins, band_snr."""
    s = _bin_spans(ev, keys, fs)
    binned = _bins_of(ev, keys, fs, s)
    long = _has_long(s)
    out = band_snr(spectra(binned.where(F.col("n_bins") <= LONG) if long else binned, keys), fs, band, lo_exclude).select(*keys, "n_bins", "band_snr")
    if not long:
        return out
    rows = cut_lineage(long_power(binned.where(F.col("n_bins") > LONG), keys)).withColumn("hz", F.col("k") * fs / F.col("n_bins"))
    top = rows.where(F.col("hz").between(*band)).groupBy(*keys, "n_bins").agg(F.max("power").alias("_p"))
    floor = row_median(rows.where((F.col("hz") > lo_exclude) & ~F.col("hz").between(*band)), keys, "power", "_m")
    return out.unionByName(top.join(floor, keys).select(*keys, "n_bins", (F.col("_p") / (F.col("_m") + 1e-30)).alias("band_snr")))


# ------------------------------------------------------------------ maps
def flicker_map(ev: DataFrame, fmin: float = 80.0, fmax: float = 800.0, fs: float = 2000.0,
                cell: int = 8, min_events: int = 40, snr_min: float = 0.0) -> DataFrame:
    """Per cell: dominant in-band frequency, SNR, in-band power and event count.

    Late events are clipped into the last time bin.
    """
    s = spans(ev).withColumn("_span", F.greatest((F.col("t_last") - F.col("t_first")).cast("double"), F.lit(1.0)))
    s = small(s.withColumn("fs", F.lit(float(fs))).withColumn("n_bins", F.floor(F.col("_span") / (US / F.col("fs"))).cast("int")))
    key = ["rec_id", "cy", "cx"]
    pos = F.floor((F.col("t") - F.col("t_first")) / (US / F.col("fs")))
    binned = (ev.join(s, "rec_id")
              .groupBy("rec_id", F.floor(F.col("y") / cell).cast("int").alias("cy"),
                       F.floor(F.col("x") / cell).cast("int").alias("cx"), "fs", "n_bins",
                       F.greatest(F.least(pos, F.col("n_bins") - 1), F.lit(0)).cast("int").alias("bin"))
              .agg(F.count("*").alias("c")))
    return _map_rows(binned, key, fmin, fmax, min_events, snr_min, _has_long(s))


def _map_rows(binned: DataFrame, key: list[str], fmin, fmax, min_events, snr_min=0.0, long: bool = False) -> DataFrame:
    counts = binned.groupBy(*key).agg(F.sum("c").alias("event_count"))
    active = binned.join(counts.where(F.col("event_count") >= min_events).select(*key), key, "left_semi")
    sp = lines(active, key, F.col("fs"), fmin, fmax, long=long)
    sp = sp.where(F.col("snr") >= snr_min).select(
        *key, F.col("peak_freq").alias("dominant_freq"), "snr", F.col("peak_power").alias("band_power"))
    return counts.join(sp, key, "left").withColumns({
        "snr": F.coalesce("snr", F.lit(0.0)), "band_power": F.coalesce("band_power", F.lit(0.0))})


def flicker_map_max(ev: DataFrame, fmin: float = 80.0, fmax: float = 800.0, fs: float = 2000.0,
                    cell: int = 8, window_s: float = 1.0, hop_s: float | None = None,
                    min_events: int = 30) -> DataFrame:
    """Best window per cell (strictly greater SNR, so the earliest wins) and total counts."""
    hop = int(round((hop_s or window_s) * US))
    win = int(round(window_s * US))
    s = spans(ev).withColumn("_k", F.floor(F.greatest(
        F.col("t_last") - win - F.col("t_first"), F.lit(0)) / hop))
    rel = F.col("t") - F.col("t_first")
    lo = F.greatest(F.floor((rel - win) / hop) + 1, F.lit(0))
    hi = F.least(F.floor(rel / hop), F.col("_k"))
    w = (ev.join(small(s), "rec_id").where((F.col("t") < F.col("t_last")) & (hi >= lo))
         .withColumn("k", F.explode(F.sequence(lo, hi))))
    start = F.col("t_first") + F.col("k") * hop
    span = F.least(start + win, F.col("t_last")) - start
    w = w.withColumn("fs", F.lit(float(fs))).withColumn("n_bins", F.floor(span / (US / fs)).cast("int"))
    key = ["rec_id", "cy", "cx", "k"]
    b = F.least(F.floor((F.col("t") - start) / (US / fs)), F.col("n_bins") - 1)
    binned = (w.groupBy("rec_id", F.floor(F.col("y") / cell).cast("int").alias("cy"),
                        F.floor(F.col("x") / cell).cast("int").alias("cx"), "k", "fs", "n_bins",
                        F.greatest(b, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("c")))
    m = _map_rows(binned, key, fmin, fmax, min_events)
    best = F.max_by(F.struct("dominant_freq", "snr", "band_power", "k"), F.struct("snr", -F.col("k")))
    g = m.groupBy("rec_id", "cy", "cx").agg(
        F.sum("event_count").alias("event_count"), F.max(F.col("snr")).alias("_s"),
        best.alias("b"))
    lit = F.col("_s") > 0
    return g.select("rec_id", "cy", "cx", "event_count", F.when(lit, F.col("b.dominant_freq")).alias("dominant_freq"),
                    F.when(lit, F.col("b.snr")).otherwise(0.0).alias("snr"),
                    F.when(lit, F.col("b.band_power")).otherwise(0.0).alias("band_power"))


def freq_map(ev: DataFrame, width: int, height: int, grid: int, window_s: float, fs: float,
             f_lo: float, f_hi: float) -> DataFrame:
    """Grid variant over the trailing window: magnitude peaks, weak cells marked not significant."""
    n = max(int(window_s * fs), 16)
    start = F.col("t_last") / US - window_s
    e = ev.join(small(spans(ev)), "rec_id").where(F.col("t") >= start * US)
    b = F.greatest(F.least(F.floor((F.col("t") / US - start) * fs), F.lit(n - 1)), F.lit(0)).cast("int")
    key = ["rec_id", "gy", "gx"]
    binned = (e.groupBy("rec_id", F.least(F.floor(F.col("y") * grid / height), F.lit(grid - 1)).cast("int").alias("gy"),
                        F.least(F.floor(F.col("x") * grid / width), F.lit(grid - 1)).cast("int").alias("gx"),
                        b.alias("bin")).agg(F.count("*").alias("c")).withColumn("n_bins", F.lit(n)))
    sp = spectra(binned, key, "magnitude")
    step = F.lit(fs / n)
    band, lo = band_slice(F.col("power"), step, max(f_lo, fs / n), f_hi)
    peak = F.array_max(band)
    sp = sp.select(*key, peak.alias("peak"), ((lo + F.array_position(band, peak) - 1) * step).alias("freq_hz"))
    # cells without events have a zero peak and take part in the percentile
    full = sp.groupBy("rec_id").agg(F.collect_list("peak").alias("p"), F.max("peak").alias("_max"))
    thr = full.select("rec_id", "_max", F.explode(F.concat("p", F.array_repeat(
        F.lit(0.0), F.greatest(F.lit(grid * grid) - F.size("p"), F.lit(0))))).alias("v")) \
        .groupBy("rec_id").agg(F.greatest(F.percentile("v", 0.3), F.max("_max") * 0.05).alias("_thr"))
    return sp.join(thr, "rec_id").withColumn("significant", F.col("peak") > F.col("_thr")).drop("_thr")


def spectrogram(ev: DataFrame, keys: list[str], fs: float = 2000.0, nperseg: int = 256,
                overlap: float = 0.75, fmax: float | None = None) -> DataFrame:
    """STFT power of the binned series: one row per (segment, frequency)."""
    b = bin_signal(ev, keys, fs).where("n_bins >= 8")
    seg = F.when(F.col("n_bins") < nperseg, F.greatest(F.lit(16), F.floor(F.col("n_bins") / 4))) \
           .otherwise(F.lit(nperseg)).cast("int")
    b = b.withColumn("_n", seg).withColumn("_hop", F.col("_n") - F.floor(F.col("_n") * overlap).cast("int"))
    segs = F.floor((F.col("n_bins") - F.col("_n")) / F.col("_hop"))
    lo = F.greatest(F.ceil((F.col("bin") - F.col("_n") + 1) / F.col("_hop")), F.lit(0))
    hi = F.least(F.floor(F.col("bin") / F.col("_hop")), segs)
    parts = (b.where(hi >= lo).withColumn("seg", F.explode(F.sequence(lo, hi)))
             .select(*keys, "seg", "_hop", F.col("_n").alias("n_bins"),
                     (F.col("bin") - F.col("seg") * F.col("_hop")).cast("int").alias("bin"), "c"))
    # Every segment of the span has a row; one without events has no power.
    dims = b.groupBy(*keys).agg(F.max("_n").alias("_len"), F.max("_hop").alias("_hop"), F.max(segs).alias("_segs"))
    every = dims.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_segs").cast("long"))))
    own = spectra(parts, [*keys, "seg"], "segment").select(*keys, "seg", "power")
    silent = F.array_repeat(F.lit(0.0), (F.floor(F.col("_len") / 2) + 1).cast("int"))
    sp = every.join(own, [*keys, "seg"], "left").withColumns({"power": F.coalesce("power", silent), "n_bins": F.col("_len")})
    t = (F.col("seg") * F.col("_hop") + F.col("n_bins") / 2) / fs
    out = sp.select(*keys, "seg", t.alias("t_s"), "n_bins", F.posexplode("power").alias("k", "power")) \
            .withColumn("f_hz", F.col("k") * fs / F.col("n_bins"))
    return (out if fmax is None else out.where(F.col("f_hz") <= fmax)).drop("n_bins")


# ------------------------------------------------------------------ moving boxes
def moving_box_gate(ev: DataFrame, track: DataFrame, pad: float = 6.0) -> DataFrame:
    """Events inside the box (cx, cy, dx, dy) interpolated to their own time, padded by ``pad``.

    Tracks are keyed by (rec_id, target_id); only events within a track's time range count.
    """
    ids = track.groupBy("rec_id", "target_id").agg(F.min("t").alias("track_t0"), F.max("t").alias("track_t1"),
                                                   F.count("*").alias("_n")).where("_n >= 3").drop("_n")
    marks = track.select("rec_id", "target_id", "t", "cx", "cy",
                         F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy"))
    parts = legs(marks, ["rec_id", "target_id"]).join(ids, ["rec_id", "target_id"])

    def reach(centre, size):
        """The box of a whole leg along one axis, a pixel wider than the box at any time."""
        at = [(F.col(f"m.{centre}"), F.col(f"m.{size}")), (F.coalesce(f"nx.{centre}", f"m.{centre}"), F.coalesce(f"nx.{size}", f"m.{size}"))]
        half = F.greatest(at[0][1], at[1][1]) / 2 + pad
        return F.least(at[0][0], at[1][0]) - half - 1, F.greatest(at[0][0], at[1][0]) + half + 1

    (x0, x1), (y0, y1) = reach("cx", "dx"), reach("cy", "dy")
    boxes = parts.select("rec_id", "target_id", "track_t0", "track_t1", "m", "nx", "a", "b", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    te = F.col("t")
    j = grid_join(ev, boxes)
    return j.where((F.abs(F.col("x") - lerp(te, "cx")) <= lerp(te, "dx") / 2 + pad)
                   & (F.abs(F.col("y") - lerp(te, "cy")) <= lerp(te, "dy") / 2 + pad)).select(*ev.columns, "target_id", "track_t0", "track_t1")


def blade_fft(ev: DataFrame, track: DataFrame, fmin: float = 20.0, fmax: float = 600.0,
              bin_dt: float = 0.0005, pad: float = 6.0, min_events: int = 32) -> DataFrame:
    """Rotor line inside the moving box: peak, and SNR against the in-band median."""
    key = ["rec_id", "target_id"]
    e = moving_box_gate(ev, track, pad)
    span = (F.col("track_t1") - F.col("track_t0")) / US
    nb = F.greatest(F.lit(64), F.floor(span / bin_dt)).cast("int")
    e = e.withColumn("n_bins", nb).withColumn("fs", F.col("n_bins") / span)
    b = F.least(F.floor((F.col("t") - F.col("track_t0")) / US / span * F.col("n_bins")), F.col("n_bins") - 1)
    binned = e.groupBy(*key, "n_bins", "fs", b.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    n = binned.groupBy(*key).agg(F.sum("c").alias("n_events"))
    busy = binned.join(n.where(F.col("n_events") >= min_events), key, "left_semi")
    spans_ = small(track.groupBy(*key).agg(F.greatest(F.lit(64), F.floor((F.max("t") - F.min("t")) / US / bin_dt)).cast("int").alias("n_bins")))
    long = _has_long(spans_)
    sp = spectra(busy.where(F.col("n_bins") <= LONG) if long else busy, key, "raw")
    band, lo = band_slice(F.col("power"), F.col("fs") / F.col("n_bins"), fmin, fmax)
    peak = F.array_max(band)
    sp = sp.select(*key, ((lo + F.array_position(band, peak) - 1) * F.col("fs") / F.col("n_bins")).alias("peak_hz"),
                   (peak / (array_median(band) + 1e-12)).alias("snr"))
    if long:
        far = busy.where(F.col("n_bins") > LONG)
        rows = cut_lineage(long_power(far, key, "raw").join(small(far.groupBy(*key).agg(F.first("fs").alias("fs"))), key))
        rows = rows.withColumn("hz", F.col("k") * F.col("fs") / F.col("n_bins")).where(F.col("hz").between(fmin, fmax))
        top = rows.groupBy(*key).agg(F.max_by("hz", F.struct("power", -F.col("k"))).alias("peak_hz"), F.max("power").alias("_p"))
        sp = sp.unionByName(top.join(row_median(rows, key, "power", "_m"), key).select(*key, "peak_hz", (F.col("_p") / (F.col("_m") + 1e-12)).alias("snr")))
    return n.join(sp, key, "left").withColumn("snr", F.coalesce("snr", F.lit(0.0)))


def per_rev_spectra(ev_rev: DataFrame, boxes: DataFrame, fmin: float = 200.0, fmax: float = 800.0,
                    fs: float = 2000.0, spin_hz: float | None = None, min_events: int = 200) -> DataFrame:
    """Spectrum of each boxed instance in its own revolution.

    ``ev_rev`` carries ``az`` and ``rev``; ``boxes`` has (rec_id, rev, az0, az1, y0, y1).
    """
    from ..functions.angles import wrap180
    c = (F.col("az0") + F.col("az1")) / 2.0
    azu = wrap180(F.col("az") - c) + c
    e = ev_rev.join(boxes, ["rec_id", "rev"]).where(
        azu.between(F.col("az0"), F.col("az1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    key = ["rec_id", "rev"]
    return region_spectrum(e, key, fs, fmin, fmax, 8.0 * spin_hz if spin_hz else 0.0, min_events=min_events)


# ------------------------------------------------------------------ spectra without binning
def freq_grid(fmin: float, fmax: float, n: int) -> list[float]:
    lo = max(fmin, 1e-3)
    return [lo + (fmax - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]


def _even(freqs: list[float]) -> bool:
    """Whether the frequencies are evenly spaced."""
    step = freqs[1] - freqs[0] if len(freqs) > 1 else 0.0
    return step > 0 and all(abs(f - freqs[0] - k * step) <= 1e-9 * abs(freqs[-1]) for k, f in enumerate(freqs))


def nudft(ev: DataFrame, keys: list[str], freqs: list[float], weight: str | None = None) -> DataFrame:
    """|sum w exp(-2 pi i f t)|^2 / N^2 on a frequency grid, straight from event times.

    An evenly spaced grid takes the fast transform (a cost of events plus frequencies, right to about 1e-13); a list without
    even spacing takes the sums themselves.  Weights are centred only when given.
    """
    if not _even(freqs):
        return nudft_direct(ev, keys, freqs, weight)
    z = nufft(ev, keys, freqs[0], freqs[1] - freqs[0], len(freqs), None if weight is None else F.col(weight), weight is not None).where("n_events >= 4")
    f = F.element_at(F.array(*[F.lit(float(x)) for x in freqs]), F.col("k") + 1)
    return (z.select(*keys, "n_events", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
            .select(*keys, "k", f.alias("f_hz"), "n_events", ((F.col("z.re") ** 2 + F.col("z.im") ** 2) / F.pow("n_events", F.lit(2))).alias("power")))


def nudft_direct(ev: DataFrame, keys: list[str], freqs: list[float], weight: str | None = None) -> DataFrame:
    """The sums of :func:`nudft` one frequency at a time, for few frequencies without even spacing.

    Equal times are merged first and the sums are combined map-side, so the shuffle carries one
    row per (task, group, frequency).
    """
    s = ev.groupBy(*keys).agg(F.min("t").alias("_t0"), F.count("*").alias("n_events"),
                              (F.avg(weight) if weight else F.lit(0.0)).alias("_w0")).where("n_events >= 4")
    w = F.sum(F.col(weight)) if weight else F.count("*").cast("double")
    pts = ev.groupBy(*keys, "t").agg(w.alias("_w"), F.count("*").alias("_m")).join(s, keys)
    wt = F.col("_w") - F.col("_m") * F.col("_w0") if weight else F.col("_w")
    grid = F.posexplode(F.array(*[F.lit(float(f)) for f in freqs]))
    ph = -2 * math.pi * F.col("f_hz") * ((F.col("t") - F.col("_t0")) / US)
    return (pts.withColumn("_wt", wt).select("*", grid.alias("k", "f_hz"))
            .groupBy(*keys, "k", "f_hz", "n_events")
            .agg(F.sum(F.col("_wt") * F.cos(ph)).alias("_c"), F.sum(F.col("_wt") * F.sin(ph)).alias("_s"))
            .select(*keys, "k", "f_hz", "n_events",
                    ((F.col("_c") ** 2 + F.col("_s") ** 2) / F.pow("n_events", F.lit(2))).alias("power")))


def nufft_spectrum(ev: DataFrame, fmin: float = 10.0, fmax: float = 800.0, n_freq: int = 600,
                   max_events: int | None = None, normalize: str = "none") -> DataFrame:
    """Dominant line per recording by a non-uniform FFT of all events (or a sample of ``max_events``)."""
    freqs = freq_grid(fmin, fmax, n_freq)
    sub = ev if max_events is None else random_subsample(ev, max_events)
    start, step = freqs[0], freqs[1] - freqs[0]
    z = nufft(sub, ["rec_id"], start, step, n_freq).where("n_events >= 4")
    g = z.select("rec_id", "n_events", F.zip_with("re", "im", lambda a, b: (a * a + b * b) / F.pow("n_events", F.lit(2))).alias("power"))
    if normalize != "none":
        g = g.withColumn("power", whiten_udf(normalize)("power"))
    peak = F.array_max("power")
    g = g.withColumn("peak_freq", start + (F.array_position("power", peak) - 1) * step)
    return g.select("rec_id", "n_events", "peak_freq", peak.alias("peak_power"), (peak / (array_median(F.col("power")) + 1e-12)).alias("snr"),
                    harmonic_comb(F.col("power"), F.lit(step), F.col("peak_freq"), fmax, 3, start).alias("harmonic"))


def lomb_scargle(ev: DataFrame, fmin: float = 10.0, fmax: float = 800.0, n_freq: int = 512,
                 max_events: int | None = None, literal: bool = False) -> DataFrame:
    """Normalised periodogram of the event times, one row per (recording, frequency).

    The delay and both squared norms follow from the sums at the doubled frequencies and the projections from those at the
    frequencies themselves, so two fast transforms give every term.

    With unit impulses the centred signal vanishes, so the default is the point-process form (the
    share of events in phase at each frequency); ``literal`` analyses sin(2 pi t) at the event
    times, which is what centring the impulses amounts to in the original tool.
    """
    freqs = freq_grid(fmin, fmax, n_freq)
    start, step = freqs[0], freqs[1] - freqs[0]
    sub = ev if max_events is None else random_subsample(ev, max_events)
    weight = None
    if literal:
        sub = sub.join(small(sub.groupBy("rec_id").agg(F.min("t").alias("_t0"))), "rec_id").withColumn("t", F.col("t") - F.col("_t0"))
        weight = F.sin(2 * math.pi * F.col("t") / US)
    twice = nufft(sub, ["rec_id"], 2 * start, 2 * step, n_freq).where("n_events >= 8")
    once = nufft(sub, ["rec_id"], start, step, n_freq, weight)
    norm = sub.groupBy("rec_id").agg(F.sum(weight * weight).alias("_yy")) if literal else twice.select("rec_id", F.col("n_events").cast("double").alias("_yy"))
    j = (twice.select("rec_id", F.col("n_events").alias("_n"), F.col("re").alias("_c2"), F.col("im").alias("_s2"))
         .join(once.select("rec_id", "re", "im"), "rec_id").join(norm, "rec_id"))
    rows = j.select("rec_id", "_n", "_yy", F.posexplode(F.arrays_zip("_c2", "_s2", "re", "im")).alias("k", "z"))
    c2, s2, a, b = F.col("z._c2"), -F.col("z._s2"), F.col("z.re"), -F.col("z.im")
    turn, size = F.atan2(s2, c2) / 2, F.sqrt(c2 * c2 + s2 * s2)
    yc, ys = a * F.cos(turn) + b * F.sin(turn), b * F.cos(turn) - a * F.sin(turn)
    p = 0.5 * (yc ** 2 / F.greatest((F.col("_n") + size) / 2, F.lit(1e-300)) + ys ** 2 / F.greatest((F.col("_n") - size) / 2, F.lit(1e-300)))
    return rows.select("rec_id", "k", (start + F.col("k") * step).alias("f_hz"), (2 * p / F.col("_yy")).alias("power"))


def isi_frequency(ev: DataFrame, keys: list[str], fmin: float = 5.0, fmax: float = 2000.0,
                  n_bins: int = 64) -> DataFrame:
    """Modal inter-event rate per group from a log-spaced histogram, and the modal share."""
    d = scan(ev, keys, ["t", "seq"], chunk_of(), _prev=last(F.col("t"), inclusive=False))
    f = (d.withColumn("_d", F.col("t") - F.col("_prev")).where("_d > 0")
         .withColumn("f", US / F.col("_d")).where(F.col("f").between(fmin, fmax)))
    ratio = math.log(fmax / fmin)
    b = F.least(F.floor(F.log(F.col("f") / fmin) / ratio * n_bins), F.lit(n_bins - 1)).cast("int")
    h = f.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    g = h.groupBy(*keys).agg(F.sum("n").alias("n_intervals"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("_b"),
                             F.max("n").alias("_m")).where("n_intervals >= 4")
    return g.select(*keys, "n_intervals", (fmin * F.exp((F.col("_b") + 0.5) / n_bins * ratio)).alias("freq_hz"),
                    (F.col("_m") / F.col("n_intervals")).alias("strength"))


def spectral_summary(fmap: DataFrame, rate: DataFrame) -> DataFrame:
    """Headline numbers per recording from a flicker map and a rate series."""
    m = fmap.groupBy("rec_id").agg(
        F.count("dominant_freq").alias("active_cells"), F.max("snr").alias("max_snr"),
        F.max_by("dominant_freq", F.struct("snr", -F.col("cy"), -F.col("cx"))).alias("peak_hz"),
        F.sum("event_count").alias("n_events"))
    r = rate.groupBy("rec_id").agg(F.avg("rate_hz").alias("mean_rate"), F.max("rate_hz").alias("peak_rate"),
                                   F.max_by("t_s", F.struct("rate_hz", -F.col("bin"))).alias("densest_t_s"))
    return m.join(r, "rec_id")
