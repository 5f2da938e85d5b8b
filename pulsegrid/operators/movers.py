"""Masking studies and moving-object extraction on de-rotated events."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import around, bearing, elevation, focal_px, pinhole_range, wrap360
from ..schema import US
from ..session import cut_lineage
from .background import VOXEL, coarse_depth, with_phase_bin
from .denoise import PIXEL, hot_pixels
from .ordered import islands, last, scan
from .quantiles import counted_quantiles, exact_quantiles
from .raster import cell, gaussian_blur, spans
from .rotation import azimuth_interp, revolution_asof, unwrap, world_azimuth
from .asof import asof, lerp, small


# ------------------------------------------------------------------ frozen masks at every depth
def frozen_seen(ev: DataFrame, pulses: DataFrame, width: int, height: int, n_phase: int = 360,
                dil: int = 1, offset_us: int = 0) -> DataFrame:
    """Add ``seen``: the earliest event in the 3x3x3 voxel neighbourhood of the event's voxel.

    The frozen N-revolution reference holds an event's voxel exactly when ``seen`` is before the
    end of revolution N, so one pass answers every mask depth.
    """
    v = with_phase_bin(ev, pulses, n_phase, offset_us)
    first = v.groupBy(*VOXEL).agg(F.min("t").alias("seen"))
    for c, hi in (("ph", n_phase), ("y", height), ("x", width)):
        first = (first.withColumn(c, F.explode(F.sequence(
            F.greatest(F.col(c) - dil, F.lit(0)), F.least(F.col(c) + dil, F.lit(hi - 1)))))
            .groupBy(*VOXEL).agg(F.min("seen").alias("seen")))
    return v.join(first, VOXEL).select(*ev.columns, "seen")


def reference_ends(pulses: DataFrame, levels: int, offset_us: int = 0) -> DataFrame:
    """Columns end_1..end_k: the end of each reference depth per recording, in event time."""
    w = Window.partitionBy("rec_id").orderBy("t")
    return pulses.withColumn("_n", F.row_number().over(w)).groupBy("rec_id").agg(
        *[(F.max(F.when(F.col("_n") <= n, F.col("t"))) + offset_us).alias(f"end_{n}") for n in range(1, levels + 1)])


def mask_sweep(ev: DataFrame, pulses: DataFrame, tel: DataFrame, fov_deg: float, width: int,
               height: int, levels: int = 4, hot_pct: float = 99.95, n_phase: int = 360,
               hot_at_zero: bool = False, offset_us: int = 0) -> DataFrame:
    """Per mask depth N: surviving events, percentages and concentration of the survivors on a
    180 x 60 azimuth-elevation grid.  Depth 0 keeps hot pixels unless ``hot_at_zero`` drops them.
    """
    e = world_azimuth(frozen_seen(ev, pulses, width, height, n_phase, offset_us=offset_us), tel, fov_deg, width, offset_us=offset_us)
    e = (e.join(small(hot_pixels(ev, hot_pct).withColumn("_hot", F.lit(True))), PIXEL, "left")
         .join(small(reference_ends(pulses, levels, offset_us)), "rec_id"))
    ok = F.col("_hot").isNull()
    keeps = [ok if hot_at_zero else F.lit(True)]
    keeps += [ok & (F.col("seen") >= F.col(f"end_{n}")) for n in range(1, levels + 1)]
    el = elevation("y", fov_deg, width, height)
    grid = (e.groupBy("rec_id", cell(F.col("az"), F.lit(0.0), F.lit(360.0), 180).alias("a"),
                      cell(el, F.lit(-30.0), F.lit(30.0), 60).alias("b"))
            .agg(F.count("*").alias("n"), *[F.count_if(k).alias(f"k{i}") for i, k in enumerate(keeps)]))
    grid = cut_lineage(grid)             # at most 180 x 60 rows per recording, read twice below
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"k{i}").alias("k"))
                              for i in range(levels + 1)]))
    rows = grid.select("rec_id", "n", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("inside"),
                       per.alias("s")).select("rec_id", "n", "inside", "s.*")
    lit = F.when(F.col("inside") & (F.col("k") > 0), F.col("k"))
    tot = (rows.groupBy("rec_id", "level")
           .agg(F.sum("n").alias("total"), F.sum("k").alias("kept"), F.count(lit).alias("occ"),
                F.max(lit).alias("peak"), F.avg(lit).alias("mean")))
    cut = F.greatest(0.02 * F.col("kept") / F.greatest(F.col("occ"), F.lit(1)), F.lit(5.0))
    cells = (rows.where("inside AND k > 0").join(tot.select("rec_id", "level", cut.alias("cut")),
                                                 ["rec_id", "level"])
             .groupBy("rec_id", "level").agg(F.count_if(F.col("k") >= F.col("cut")).alias("mover_cells")))
    return tot.join(cells, ["rec_id", "level"], "left").select(
        "rec_id", "level", "kept", (100.0 * (1 - F.col("kept") / F.col("total"))).alias("reduction_pct"),
        F.coalesce("mover_cells", F.lit(0)).alias("mover_cells"),
        F.coalesce(F.col("peak") / F.col("mean"), F.lit(0.0)).alias("concentration"))


def mask_sweep_rate(ev: DataFrame, pulses: DataFrame, width: int, height: int, levels: int = 4,
                    hot_pct: float = 99.95, bin_us: int = 50_000, offset_us: int = 0) -> DataFrame:
    """Surviving event rate per time bin and frozen mask depth."""
    e = (frozen_seen(ev, pulses, width, height, offset_us=offset_us)
         .join(small(hot_pixels(ev, hot_pct).withColumn("_hot", F.lit(True))), PIXEL, "left")
         .join(small(reference_ends(pulses, levels, offset_us)), "rec_id"))
    ks = [F.count("*").alias("k0")] + [
        F.count_if(F.col("_hot").isNull() & (F.col("seen") >= F.col(f"end_{n}"))).alias(f"k{n}")
        for n in range(1, levels + 1)]
    g = e.groupBy("rec_id", F.floor(F.col("t") / bin_us).alias("bin")).agg(*ks)
    return g.select("rec_id", "bin", F.explode(F.array(*[
        F.struct(F.lit(n).alias("level"), (F.col(f"k{n}") / (bin_us / US)).alias("rate_hz"))
        for n in range(levels + 1)])).alias("s")).select("rec_id", "bin", "s.*")


# ------------------------------------------------------------------ coarse masks at every depth
def in_box(az: tuple[float, float], ywin: tuple[float, float], az_col: str = "az") -> Column:
    azu = around(az_col, (az[0] + az[1]) / 2.0)
    return azu.between(*az) & F.col("y").between(*ywin)


def masking_metrics(ev: DataFrame, tel: DataFrame, pulses: DataFrame, width: int, height: int,
                    box: tuple[float, float, float, float], fov_deg: float, az_sign: float = 1.0,
                    n_list: tuple[int, ...] = (0, 1, 2, 3, 4, 5), offset_us: int = 0) -> DataFrame:
    """Reduction, rate and target/background retention per coarse mask depth."""
    e = world_azimuth(coarse_depth(ev, tel, pulses, width, height, offset_us), tel, fov_deg, width, az_sign, offset_us=offset_us)
    e = e.withColumn("_in", in_box(box[:2], box[2:]))
    g = (e.groupBy("rec_id", "depth").agg(F.count("*").alias("n"), F.count_if("_in").alias("d"),
                                          F.min("t").alias("a"), F.max("t").alias("b")))
    tot = g.groupBy("rec_id").agg(F.sum("n").alias("tot"), F.sum("d").alias("n_d"),
                                  ((F.max("b") - F.min("a")) / US).alias("dur"))
    lev = g.select("rec_id", "depth", "n", "d", F.explode(F.array(*[F.lit(n) for n in n_list])).alias("level"))
    keep = F.col("depth") > F.col("level")
    k = (lev.groupBy("rec_id", "level").agg(
            F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(keep, F.col("d"))), F.lit(0)).alias("target_kept"))
         .join(tot, "rec_id"))
    dret = F.col("target_kept") / F.greatest("n_d", F.lit(1))
    bret = (F.col("kept") - F.col("target_kept")) / F.greatest(F.col("tot") - F.col("n_d"), F.lit(1))
    return k.select("rec_id", "level", "kept", (100.0 * (1 - F.col("kept") / F.col("tot"))).alias("reduction_pct"),
                    F.try_divide("kept", "dur").alias("rate_hz"), "target_kept",
                    (100 * dret).alias("target_retained_pct"), (100 * bret).alias("background_retained_pct"),
                    (dret / F.greatest(bret, F.lit(1e-6))).alias("contrast"))


def mask_reduction_over_time(ev: DataFrame, tel: DataFrame, pulses: DataFrame, width: int, height: int,
                             n_list: tuple[int, ...] = (0, 1, 2, 3, 4), bin_us: int = 50_000) -> DataFrame:
    """Kept rate per time bin (from the first event) for each coarse mask depth, lit bins only."""
    e = coarse_depth(ev, tel, pulses, width, height).join(small(spans(ev)), "rec_id")
    ks = [F.count_if(F.col("depth") > n).alias(f"k{n}") for n in n_list]
    g = e.groupBy("rec_id", F.floor((F.col("t") - F.col("t_first")) / bin_us).alias("bin")).agg(*ks)
    return g.select("rec_id", "bin", F.explode(F.array(*[
        F.struct(F.lit(n).alias("level"), (F.col(f"k{n}") / (bin_us / US)).alias("rate_hz"))
        for n in n_list])).alias("s")).select("rec_id", "bin", "s.*")


def densest_box(ev_az: DataFrame, height: int, az_pad: float = 4.0, y_pad: float = 28.0,
                az_bins: int = 360, y_bins: int = 80, min_events: int = 60) -> DataFrame:
    """Padded box around the peak of the smoothed (azimuth, row) histogram per recording."""
    h = (ev_az.groupBy("rec_id", cell(F.col("az"), F.lit(0.0), F.lit(360.0), az_bins).alias("a"),
                       cell(F.col("y").cast("double"), F.lit(0.0), F.lit(float(height)), y_bins).alias("b"))
         .agg(F.count("*").cast("double").alias("v")))
    big = h.groupBy("rec_id").agg(F.sum("v").alias("_n")).where(F.col("_n") >= min_events)
    s = gaussian_blur(h.join(big, "rec_id", "left_semi"), ["rec_id"], {"a": az_bins, "b": y_bins}, ["v"], 1.0)
    peak = s.groupBy("rec_id").agg(F.max_by(F.struct("a", "b"), F.struct(
        F.round("v", 9), -F.col("a"), -F.col("b"))).alias("p"))
    azc, yc = (F.col("p.a") + 0.5) / az_bins * 360.0, (F.col("p.b") + 0.5) / y_bins * height
    return peak.select("rec_id", F.greatest(azc - az_pad, F.lit(0.0)).alias("az0"),
                       F.least(azc + az_pad, F.lit(360.0)).alias("az1"),
                       F.greatest(yc - y_pad, F.lit(0.0)).alias("y0"),
                       F.least(yc + y_pad, F.lit(float(height))).alias("y1"))


# ------------------------------------------------------------------ movers and passes
def extract_movers(ev: DataFrame, tel: DataFrame, pulses: DataFrame, fov_deg: float, width: int,
                   height: int, target_m: float = 0.0, bin_deg: float = 2.0,
                   min_events: int = 150) -> DataFrame:
    """One row per (revolution, azimuth cell) with enough surviving events.

    Median bearing and time come from the bucketed exact quantiles, row statistics from counted
    ones, so a crowded cell is never held in one task.
    """
    nb = math.ceil(360.0 / bin_deg)
    e = revolution_asof(world_azimuth(ev, tel, fov_deg, width), pulses).withColumn(
        "bin", F.least(F.floor(F.col("az") / bin_deg), F.lit(nb - 1)))
    key = ["rec_id", "rev", "bin"]
    n = e.groupBy(*key).agg(F.count("*").alias("n_events")).where(F.col("n_events") >= min_events)
    big = cut_lineage(e.join(n.select(*key), key, "left_semi").select(*key, "az", "t", "y"))
    q = (big.groupBy(*key).agg(F.count("*").alias("n_events"))
         .join(exact_quantiles(big, key, {"bearing_deg": ("az", 0.5, 0.1), "_t": ("t", 0.5, 1000)}), key)
         .join(counted_quantiles(big, key, "y", {"_y": 0.5, "_y1": 0.1, "_y9": 0.9}), key))
    size = F.col("_y9") - F.col("_y1")
    return q.select("rec_id", "rev", "bin", (F.col("_t") / US).alias("t_s"), "bearing_deg",
                    elevation("_y", fov_deg, width, height).alias("elev_deg"),
                    pinhole_range(size, fov_deg, width, target_m).alias("range_m"), "n_events",
                    size.alias("size_px"), (F.col("_y") < height / 2.0).alias("above_horizon"))


def movers_table(movers: DataFrame) -> DataFrame:
    """Headline aggregates of the movers per recording."""
    up = F.col("above_horizon")
    return movers.groupBy("rec_id").agg(
        F.count("*").alias("n_movers"), F.count_if(up).alias("n_above_horizon"),
        F.min(F.when(up, F.col("bearing_deg"))).alias("bearing_min_deg"),
        F.max(F.when(up, F.col("bearing_deg"))).alias("bearing_max_deg"),
        F.median(F.when(up, F.col("range_m"))).alias("range_median_m"))


def with_pass_bearing(ev: DataFrame, tel: DataFrame, pulses: DataFrame, fov_deg: float, width: int,
                      az_sign: float = -1.0, offset_us: int = 0) -> DataFrame:
    """Add ``rev`` and ``b``: bearing on the continuous (unwrapped) pan, so a pass that crosses
    north has a meaningful mean without an ordered unwrap of its events."""
    marks = unwrap(tel.select("rec_id", "t", "azimuth"), ["rec_id"], "t", "azimuth", "az_u") \
        .select("rec_id", "t", "az_u")
    te = F.col("t") - offset_us
    j = asof(ev, marks, ["rec_id"], te)
    b = lerp(te, "az_u") + bearing("x", fov_deg, width, az_sign)
    return revolution_asof(j.select(*ev.columns, b.alias("b")), pulses, offset_us)


def with_gap_bearing(ev: DataFrame, fov_deg: float, width: int, gap_us: int = 200_000, az_sign: float = -1.0) -> DataFrame:
    """The same for a staring sensor: passes are runs of events whose gaps stay within ``gap_us``, bearings relative to its axis."""
    return gap_segments(ev, ["rec_id"], gap_us, "rev").withColumn("b", bearing("x", fov_deg, width, az_sign))


def robust_centre(df: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    """Per value column (with its bucket width): trimmed mean ``_c``, spread ``_s`` and kept count
    ``_n`` within 3 * 1.4826 * MAD of the median.  The small per-group tables are materialised."""
    med = exact_quantiles(df, keys, {f"{v}_med": (v, 0.5, w) for v, w in values.items()})
    d = df.join(cut_lineage(med), keys).withColumns(
        {f"{v}_dev": F.abs(F.col(v) - F.col(f"{v}_med")) for v in values})
    mad = exact_quantiles(d, keys, {f"{v}_mad": (f"{v}_dev", 0.5, w) for v, w in values.items()})
    d = d.join(cut_lineage(mad), keys)
    aggs, out = [], []
    for v in values:
        m = F.col(f"{v}_mad") + 1e-9
        kept = F.when(F.col(f"{v}_dev") < 3 * 1.4826 * m, F.col(v))
        aggs += [F.avg(kept).alias(f"{v}_a"), F.stddev_pop(kept).alias(f"{v}_d"), F.count(kept).alias(f"{v}_n"),
                 F.first(f"{v}_med").alias(f"{v}_m"), F.first(m).alias(f"{v}_w")]
        out += [F.coalesce(f"{v}_a", f"{v}_m").alias(f"{v}_c"),
                F.when(F.col(f"{v}_n") > 1, F.col(f"{v}_d")).otherwise(1.4826 * F.col(f"{v}_w")).alias(f"{v}_s"),
                f"{v}_n"]
    return d.groupBy(*keys).agg(*aggs).select(*keys, *out)


def per_pass_centroids(ev: DataFrame, tel: DataFrame | None, pulses: DataFrame | None, fov_deg: float, width: int,
                       height: int, target_m: float = 0.0, min_events: int = 50, offset_us: int = 0, gap_us: int = 200_000) -> DataFrame:
    """Accumulation-independent bearing per revolution with its standard error and range.

    Without telemetry the sensor stares, and a pass is a run of events between gaps.
    """
    key = ["rec_id", "rev"]
    if tel is None:
        e = with_gap_bearing(ev, fov_deg, width, gap_us)
    else:
        e = with_pass_bearing(ev, tel, pulses, fov_deg, width, offset_us=offset_us)
    n = e.groupBy(*key).agg(F.count("*").alias("n_events")).where(F.col("n_events") >= min_events)
    e = cut_lineage(e.join(n.select(*key), key, "left_semi").select(
        *key, "t", "b", elevation("y", fov_deg, width, height).alias("e")))
    c = robust_centre(e, key, {"b": 0.1, "e": 0.1})
    t = exact_quantiles(e, key, {"_t": ("t", 0.5, 1000)})
    ang = math.sqrt(12.0) * F.col("b_s")
    rng = F.when((F.lit(target_m) > 0) & (ang > 1e-6), target_m / F.radians(ang))
    n = e.groupBy(*key).agg(F.count("*").alias("n_events"))
    return (n.join(c, key).join(t, key).select(
        *key, (F.col("_t") / US).alias("t_s"), wrap360("b_c").alias("bearing_deg"),
        (F.col("b_s") / F.sqrt("b_n")).alias("bearing_se_deg"), F.col("e_c").alias("elev_deg"),
        ang.alias("ang_size_deg"), rng.alias("range_m"), "n_events"))


def image_centroid_per_pass(ev: DataFrame, tel: DataFrame, pulses: DataFrame, fov_deg: float, width: int,
                            accum_us: int, min_events: int = 50, az_sign: float = -1.0) -> DataFrame:
    """Bearing of the densest ``accum_us`` frame of each pass (for comparison only)."""
    key = ["rec_id", "rev"]
    e = revolution_asof(ev, pulses)
    p = (e.groupBy(*key).agg(F.count("*").alias("n"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
         .where(F.col("n") >= min_events)
         .withColumn("_nf", F.ceil((F.col("_t1") - F.col("_t0")) / accum_us)).where("_nf >= 1"))
    # frame k holds (edge k, edge k+1]; the first event falls into frame 0
    idx = F.greatest(F.least(F.ceil((F.col("t") - F.col("_t0")) / accum_us) - 1, F.col("_nf") - 1), F.lit(0))
    f = (e.join(p.drop("n"), key).groupBy(*key, idx.alias("f"), "_t0")
         .agg(F.count("*").alias("c"), F.avg("x").alias("cx")))
    top = f.groupBy(*key).agg(F.max_by(F.struct("f", "cx", "_t0"), F.struct("c", -F.col("f"))).alias("m"))
    c = top.select(*key, (F.col("m._t0") + (F.col("m.f") + 0.5) * accum_us).alias("t"),
                   F.col("m.cx").alias("cx"))
    j = azimuth_interp(c, tel)
    return j.select(*key, (F.col("t") / US).alias("t_s"),
                    wrap360(F.col("pan") + bearing("cx", fov_deg, width, az_sign)).alias("bearing_deg"))


def gap_segments(ev: DataFrame, keys: list[str], gap_us: int, out: str = "seg") -> DataFrame:
    """Number the runs of events whose gaps stay within ``gap_us`` (two chunked scans)."""
    w = scan(ev, keys, ["t", "seq"], _prev=last(F.col("t"), inclusive=False))
    return islands(w, keys, ["t", "seq"], F.coalesce(F.col("t") - F.col("_prev") > gap_us, F.lit(False)),
                   out).drop("_prev")


def box_passes(ev_az: DataFrame, keys: list[str], az: tuple[float, float], ywin: tuple[float, float],
               fov_deg: float, width: int, target_m: float = 0.225, gap_s: float = 0.3,
               min_pass: int = 120) -> DataFrame:
    """Passes of the events inside a box: median bearing, its SE, row extent and range."""
    azu = around("az", (az[0] + az[1]) / 2.0)
    e = gap_segments(ev_az.where(in_box(az, ywin)).withColumn("azu", azu), keys, int(gap_s * US))
    key = [*keys, "seg"]
    e = cut_lineage(e.select(*key, "azu", "t", "y"))
    g = (e.groupBy(*key).agg(F.count("*").alias("n_events"), F.stddev_pop("azu").alias("_sd"))
         .where(F.col("n_events") >= min_pass))
    e = e.join(g.select(*key), key, "left_semi")
    q = (g.join(exact_quantiles(e, key, {"bearing_deg": ("azu", 0.5, 0.1), "_t": ("t", 0.5, 1000)}), key)
         .join(counted_quantiles(e, key, "y", {"_y1": 0.1, "_y9": 0.9}), key))
    ye = F.col("_y9") - F.col("_y1")
    return q.select(*key, (F.col("_t") / US).alias("t_s"), "bearing_deg",
                    (F.col("_sd") / F.sqrt("n_events")).alias("bearing_se_deg"), ye.alias("y_extent_px"),
                    (target_m * focal_px(fov_deg, width) / F.greatest(ye, F.lit(1.0))).alias("range_m"),
                    "n_events")


def solve_box(ev_az: DataFrame, keys: list[str], az, ywin, fov_deg, width, target_m=0.225, gap_s=0.3,
              min_pass=120) -> DataFrame:
    """Medians and spans over the passes of a box (bearings and ranges rounded to 0.01 first)."""
    p = box_passes(ev_az, keys, az, ywin, fov_deg, width, target_m, gap_s, min_pass)
    p = p.withColumn("_b", F.round("bearing_deg", 2)).withColumn("_r", F.round("range_m", 2))
    return p.groupBy(*keys).agg(
        F.count("*").alias("n_passes"), F.sum("n_events").alias("n_events"),
        F.median("_b").alias("bearing_deg"), (F.max("_b") - F.min("_b")).alias("bearing_span_deg"),
        F.median("_r").alias("range_m"), F.min("_r").alias("range_min_m"), F.max("_r").alias("range_max_m"))


def track_over_revs(ev_az: DataFrame, pulses: DataFrame, az, ywin, fov_deg, width, target_m=0.225,
                    min_pass=60) -> DataFrame:
    """The same box solved in every full revolution."""
    full = pulses.withColumn("t2", F.lead("t").over(Window.partitionBy("rec_id").orderBy("t"))) \
        .where("t2 IS NOT NULL").select("rec_id", F.col("k").alias("rev"),
                                        ((F.col("t") + F.col("t2")) / 2 / US).alias("t_s"))
    e = revolution_asof(ev_az, pulses)
    s = solve_box(e, ["rec_id", "rev"], az, ywin, fov_deg, width, target_m, min_pass=min_pass)
    return s.join(full, ["rec_id", "rev"]).select("rec_id", "rev", "t_s", "bearing_deg", "range_m", "n_events")


def derived_extent_range(ev: DataFrame, keys: list[str], fov_deg: float, width: int,
                         target_m: float) -> DataFrame:
    """Range from the row spread of each group's dense core (within 3 MAD of the median row)."""
    med = counted_quantiles(ev, keys, "y", {"_med": 0.5})
    d = ev.join(med, keys).withColumn("_dev", F.abs(F.col("y") - F.col("_med")))
    mad = counted_quantiles(d, keys, "_dev", {"_mad": 0.5})
    near = F.col("_dev") <= F.greatest(3.0 * 1.4826 * F.col("_mad"), F.lit(1.0))
    c = d.join(mad, keys).withColumn("_core", near)
    n = c.groupBy(*keys).agg(F.count("*").alias("n_events"), F.count_if("_core").alias("_nc"))
    core = c.join(n, keys).where((F.col("n_events") >= 8) & (F.col("_core") | (F.col("_nc") < 8)))
    q = counted_quantiles(core, keys, "y", {"_lo": 0.025, "_hi": 0.975})
    size = F.col("_hi") - F.col("_lo") + 1.0
    out = n.drop("_nc").join(q, keys, "left")
    return out.select(*keys, "n_events", F.coalesce(size, F.lit(0.0)).alias("size_px"),
                      pinhole_range(size, fov_deg, width, target_m).alias("range_m"))
