"""Rotor ladder: comb spacing along the sweep coordinate, per (revolution, azimuth) cell."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.angles import elevation
from ..schema import US
from ..session import cut_lineage
from .asof import small
from .geometry import propeller_columns, sweep_velocity
from .movers import derived_extent_range
from .quantiles import counted_quantiles, exact_quantiles
from .rotation import revolution_asof, rotation_period, world_azimuth
from .trackers import link_tracks, pass_tracks
from .tracks import fuse_split_cells, strongest_cell, template_match


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _acf(bins: pd.Series, counts: pd.Series, nb: pd.Series) -> pd.Series:
    """Normalised autocorrelation of the mean-removed histogram; null for a flat one."""
    out = []
    for b, c, n in zip(bins, counts, nb):
        h = np.zeros(int(n))
        h[np.asarray(b, np.int64)] = np.asarray(c, float)
        h -= h.mean()
        a = np.correlate(h, h, "full")[len(h) - 1:]
        out.append(np.round(a / a[0], 10) if a[0] > 1e-12 else None)   # equal lags stay equal
    return pd.Series(out, index=bins.index)


def sweep_histogram(ev: DataFrame, keys: list[str], min_events: int, bin_px: float = 1.0) -> DataFrame:
    """Histogram of the column between its 0.5 and 99.5 percentiles, and its autocorrelation.

    The histogram is as wide as the sensor at most, whatever the event count.
    """
    s = ev.groupBy(*keys).agg(F.count("*").alias("n_events"), F.regr_slope("x", F.col("t") / US).alias("drift")) \
          .where(F.col("n_events") >= min_events)
    q = counted_quantiles(ev.join(s.select(*keys), keys, "left_semi"), keys, "x", {"lo": 0.005, "hi": 0.995})
    s = s.join(q, keys)
    wide = s.where(F.col("hi") - F.col("lo") >= 3 * bin_px).withColumn(
        "nb", F.greatest(F.floor((F.col("hi") - F.col("lo")) / bin_px + 1e-9), F.lit(8)).cast("int"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("nb") + 1e-9), F.col("nb") - 1)
    h = (ev.join(wide.select(*keys, "lo", "hi", "nb"), keys).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
         .groupBy(*keys, "nb", b.cast("int").alias("b")).agg(F.count("*").alias("c"))
         .groupBy(*keys, "nb").agg(F.collect_list("b").alias("_b"), F.collect_list("c").alias("_c"), F.sum("c").alias("_t")))
    occ = F.size(F.filter("_c", lambda c: c > 0.15 * F.col("_t") / F.col("nb")))
    h = h.select(*keys, "nb", (1.0 - occ / F.col("nb")).alias("gappiness"), _acf("_b", "_c", "nb").alias("acf"))
    return s.select(*keys, "n_events", "drift").join(h, keys, "left")


def _at(a: Column, lag: Column) -> Column:
    return F.element_at(a, lag.cast("int") + 1)


def _first_best(lags: Column, score) -> Column:
    """The first lag with the largest score."""
    pairs = F.transform(lags, lambda l: F.struct(score(l).alias("s"), (-l).alias("l")))
    return -F.array_max(pairs)["l"]


def ladder_signature(ev: DataFrame, keys: list[str], sweep: DataFrame | None = None, f_lo: float = 80.0,
                     f_hi: float = 800.0, bin_px: float = 1.0, min_events: int = 150,
                     strength: float = 0.2) -> DataFrame:
    """Comb spacing, blade rate and strength per key.

    ``sweep`` (rec_id, sweep_px_s) gives the known sweep velocity; without it the drift of the
    events is used.
    """
    h = sweep_histogram(ev, keys, min_events, bin_px)
    if sweep is not None:
        h = h.join(sweep.select("rec_id", "sweep_px_s"), "rec_id", "left")
        v = F.coalesce("sweep_px_s", "drift")
    else:
        v = F.col("drift")
    h = h.withColumn("drift_px_s", F.coalesce(v, F.lit(0.0)))
    av = F.abs("drift_px_s")
    h = h.withColumn("_lo", F.greatest(F.rint(av / f_hi / bin_px), F.lit(2.0)).cast("int")) \
         .withColumn("_hi", F.least(F.rint(av / f_lo / bin_px), F.col("nb") - 1).cast("int"))
    a, nb = F.col("acf"), F.col("nb")

    def energy(lag):
        m = F.filter(F.array(lag, 2 * lag, 3 * lag), lambda k: k < nb)
        return F.round(F.aggregate(m, F.lit(0.0), lambda s, k: s + _at(a, k)) / F.size(m), 9)

    ok = a.isNotNull() & (av >= 1e-6) & (F.col("_hi") > F.col("_lo"))
    h = h.withColumn("_peaks", F.when(ok & (F.least(F.col("_hi"), nb - 2) >= F.col("_lo")), F.filter(
        F.sequence(F.col("_lo"), F.least(F.col("_hi"), nb - 2)),
        lambda l: (_at(a, l) > 0) & (_at(a, l) >= _at(a, l - 1)) & (_at(a, l) >= _at(a, l + 1)))))
    top = F.array_max(F.transform("_peaks", lambda l: _at(a, l)))
    h = h.withColumn("_strong", F.filter("_peaks", lambda l: _at(a, l) >= 0.6 * top))
    h = h.withColumn("_cand", F.filter("_strong", lambda l: energy(l) > 0))
    best = (F.when(F.size("_cand") > 0, F.array_min("_cand"))
            .when(F.size("_strong") > 0, _first_best(F.col("_strong"), energy))
            .when(ok, _first_best(F.sequence(F.col("_lo"), F.col("_hi")), energy)))
    h = h.withColumn("_best", best)
    h = h.withColumns({"step_px": F.col("_best") * bin_px,
                       "comb_strength": F.coalesce(F.round(F.greatest(energy(F.col("_best")), F.lit(0.0)), 3), F.lit(0.0)),
                       "blade_hz": F.round(F.abs("drift_px_s") / (F.col("_best") * bin_px), 1)})
    band = F.coalesce(F.col("blade_hz").between(f_lo, f_hi), F.lit(False))
    return h.withColumns({"in_band": band, "detected": band & (F.col("comb_strength") >= strength)}) \
            .select(*keys, "n_events", "drift_px_s", "gappiness", "step_px", "blade_hz", "comb_strength", "in_band", "detected")


def accumulate_comb(ev: DataFrame, keys: list[str], pass_key: str, sweep: float | DataFrame, f_lo: float = 80.0,
                    f_hi: float = 1500.0, bin_px: float = 1.0, n_lag: int | None = None, min_events: int = 60) -> DataFrame:
    """Mean of the passes' autocorrelations (missing lags count as 0), smallest strong peak.

    ``sweep`` is the sweep velocity, or that of each recording (rec_id, sweep_px_s; ``keys`` has rec_id then).
    All lags of the band are used; ``n_lag`` limits them if given.
    """
    h = sweep_histogram(ev, [*keys, pass_key], min_events, bin_px).where("acf IS NOT NULL")
    used = h.groupBy(*keys).agg(F.count("*").alias("n_passes"))
    lags = F.col("acf") if n_lag is None else F.slice("acf", 1, n_lag)
    acc = (h.select(*keys, F.posexplode(lags).alias("lag", "v")).groupBy(*keys, "lag")
           .agg(F.sum("v").alias("v")).join(used, keys).withColumn("v", F.col("v") / F.col("n_passes")))
    g = acc.groupBy(*keys, "n_passes").agg(F.map_from_entries(F.collect_list(F.struct("lag", "v"))).alias("m"))
    if isinstance(sweep, DataFrame):
        g = g.join(sweep.select("rec_id", F.abs("sweep_px_s").alias("_v")).where("_v > 0"), "rec_id")
    else:
        g = g.withColumn("_v", F.lit(float(abs(sweep))))
    at = lambda l: F.coalesce(F.element_at("m", l), F.lit(0.0))
    v = F.col("_v")
    g = g.withColumn("_lo", F.greatest(F.rint(v / f_hi / bin_px), F.lit(2.0)).cast("int")).withColumn("_hi", F.rint(v / f_lo / bin_px).cast("int"))
    if n_lag is not None:
        g = g.withColumn("_hi", F.least("_hi", F.lit(n_lag - 2)))
    lags = F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.greatest("_lo", "_hi")))
    g = g.withColumn("_p", F.filter(lags, lambda l: (at(l) > 0) & (at(l) >= at(l - 1)) & (at(l) >= at(l + 1))))
    top = F.array_max(F.transform("_p", at))
    best = F.array_min(F.filter("_p", lambda l: at(l) >= 0.6 * top))
    g = g.withColumn("_b", best)
    return g.select(*keys, "n_passes", F.round(v / (F.col("_b") * bin_px), 1).alias("blade_hz"),
                    F.coalesce(F.round(at(F.col("_b")), 3), F.lit(0.0)).alias("comb_strength"))


def track_ladders(passes: DataFrame, keys: list[str], period: DataFrame) -> DataFrame:
    """Cross-revolution blade rate, stability, offset per revolution and confidence.

    ``passes`` has keys, rev, x_center, blade_hz, detected; ``period`` keys, period_s.
    """
    g = passes.where("detected").groupBy(*keys).agg(
        F.count("*").alias("n_passes"), F.median("blade_hz").alias("median_blade_hz"), F.stddev_pop("blade_hz").alias("_sd"),
        F.regr_slope("x_center", "rev").alias("_b")).join(period, keys, "left")
    stab = F.greatest(F.lit(0.0), 1.0 - F.when(F.col("median_blade_hz") > 0, F.col("_sd") / F.col("median_blade_hz")).otherwise(1.0))
    g = g.withColumn("stability", stab).withColumn(
        "offset_per_rev_px", F.when(F.col("n_passes") >= 2, F.coalesce("_b", F.lit(0.0))).otherwise(0.0))
    return g.select(*keys, "n_passes", "median_blade_hz", "stability", "offset_per_rev_px",
                    (F.col("offset_per_rev_px") / F.col("period_s")).alias("omega_px_s"),
                    F.least(F.least(F.col("n_passes") / 3.0, F.lit(1.0)) * F.col("stability"), F.lit(1.0)).alias("confidence"))


def scan_cells(ev: DataFrame, tel: DataFrame, pulses: DataFrame, fov_deg: float, width: int, bin_deg: float) -> DataFrame:
    """Events with world azimuth, revolution and azimuth cell."""
    nb = math.ceil(360.0 / bin_deg)
    return revolution_asof(world_azimuth(ev, tel, fov_deg, width), pulses).withColumn(
        "bin", F.least(F.floor(F.col("az") / bin_deg), F.lit(nb - 1)))


def _survey(ev: DataFrame, tel: DataFrame, pulses: DataFrame, fov_deg: float, width: int, height: int,
            f_lo: float = 80.0, f_hi: float = 800.0, bin_deg: float = 4.0, min_events: int = 150,
            blade_tol: float = 0.15, target_m: float = 0.0, template_hz: float | None = None,
            strength: float = 0.2, n_blades: int = 2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The events with their cells, the sweep velocities, the tested cells, and the merged passes with their template match."""
    key = ["rec_id", "rev", "bin"]
    e = cut_lineage(scan_cells(ev, tel, pulses, fov_deg, width, bin_deg))
    sweep = sweep_velocity(rotation_period(pulses), fov_deg, width)
    lad = ladder_signature(e, key, sweep, f_lo, f_hi, min_events=min_events, strength=strength)
    big = e.join(small(lad.select(*key)), key, "left_semi")
    q = exact_quantiles(big, key, {"bearing_deg": ("az", 0.5, 0.1), "_t": ("t", 0.5, 1000)})
    y = counted_quantiles(big, key, "y", {"_y": 0.5})
    rng = derived_extent_range(big, key, fov_deg, width, target_m).drop("n_events")
    d = (lad.join(q, key).join(y, key).join(rng, key)
         .withColumn("t_s", F.col("_t") / US).withColumn("elev_deg", elevation("_y", fov_deg, width, height)).drop("_t", "_y"))
    d = cut_lineage(propeller_columns(d, "blade_hz", n_blades))
    tmpl = strongest_cell(d, ["rec_id"]).select("rec_id", "template_hz") if template_hz is None else \
        d.select("rec_id").distinct().withColumn("template_hz", F.lit(template_hz))
    return e, sweep, d, template_match(fuse_split_cells(d, ["rec_id", "rev"], bin_deg), tmpl, ["rec_id"], blade_tol)


def scan_passes(*args, **options) -> DataFrame:
    """Every (revolution, azimuth) cell: ladder, geometry, merged passes, template match (parameters of :func:`_survey`)."""
    return _survey(*args, **options)[-1]


def scan_rotation(ev: DataFrame, tel: DataFrame, pulses: DataFrame, fov_deg: float, width: int, height: int,
                  f_lo: float = 80.0, f_hi: float = 800.0, *cells, gate_deg: float = 6.0, min_passes: int = 2, **options) -> DataFrame:
    """Survey of every (revolution, azimuth) cell: the passes of :func:`scan_passes`, the track that links each matched pass
    across revolutions, and the blade rate of all matched passes of a recording together (``accumulated_``; null under two passes).

    A merged pass takes part in the accumulation with the events of its strongest cell, if that is detected itself.
    """
    e, sweep, tested, out = _survey(ev, tel, pulses, fov_deg, width, height, f_lo, f_hi, *cells, **options)
    key = ["rec_id", "rev", "bin"]
    out = cut_lineage(out)
    hits = out.where("matches_template")
    out = out.join(pass_tracks(hits, rotation_period(pulses), gate_deg, min_passes), ["rec_id", "rev", "bearing_deg", "matches_template"], "left")
    passes = cut_lineage(hits.join(tested.where("detected").select(*key), key, "left_semi").select(*key))
    several = passes.groupBy("rec_id").agg(F.count("*").alias("_n")).where("_n >= 2")
    seen = e.join(small(passes), key, "left_semi").withColumn("pass", F.col("rev") * 100_000 + F.col("bin"))
    comb = accumulate_comb(seen, ["rec_id"], "pass", sweep, f_lo, f_hi).where("blade_hz IS NOT NULL").join(several, "rec_id", "left_semi")
    return out.join(comb.select("rec_id", F.col("blade_hz").alias("accumulated_blade_hz"), F.col("comb_strength").alias("accumulated_comb_strength")), "rec_id", "left")


def scan_tracks(dets: DataFrame, pulses: DataFrame, gate_deg: float = 6.0, min_passes: int = 2) -> DataFrame:
    """Matched detections linked across revolutions."""
    return link_tracks(dets.where("matches_template"), rotation_period(pulses), gate_deg, min_passes=min_passes)
