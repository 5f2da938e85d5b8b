"""Joins and rankings over detections, passes and movers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import wrap180, wrap360
from ..schema import US
from .asof import asof, legs, lerp, nearest
from .grid import grid_join
from .rotation import unwrap


# ------------------------------------------------------------------ interval joins
def in_box_events(ev: DataFrame, dets: DataFrame, window_us: int, det_cols: list[str] = ["step"]) -> DataFrame:
    """Events inside each detection's half-open box over its trailing window [t - window, t)."""
    boxes = dets.select("rec_id", *det_cols, F.col("t").alias("dt"), (F.col("t") - window_us).alias("a"), F.col("t").alias("b"), "x0", "y0", "x1", "y1")
    return grid_join(ev, boxes, window_us).select(*ev.columns, *det_cols, "dt")


def nearest_in_time(track: DataFrame, traj: DataFrame, keys: list[str], cols: list[str],
                    tol_us: int = 50_000) -> DataFrame:
    """Attach the columns of the nearest detection within the tolerance (null otherwise)."""
    j = nearest(track, traj.select(*keys, "t", *cols), keys, F.col("t"), tol_us=tol_us)
    return j.select(*track.columns, *[F.col(f"near.{c}").alias(c) for c in cols])


def box_asof(ev: DataFrame, boxes: DataFrame, strict: bool = True) -> DataFrame:
    """Events inside the box active at their time: the last box before it, from the first box to the last.

    ``strict`` takes the last box with a time before the event, as a left-sided search does.
    """
    iv = legs(boxes.select("rec_id", "t", "x0", "y0", "x1", "y1"), ["rec_id"]).where("nx IS NOT NULL")
    ends = boxes.groupBy("rec_id").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    later = F.lit(1 if strict else 0)
    a = F.when(F.col("a") == F.col("_first"), F.col("a")).otherwise(F.col("a") + later)
    spans = iv.join(ends, "rec_id").select("rec_id", F.col("a").alias("box_t"), a.alias("a"), F.least(F.col("b") + later, F.col("_last")).alias("b"),
                                           *[F.col(f"m.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return grid_join(ev, spans).select(*ev.columns, "box_t")


def dual_sensor_gate(a: DataFrame, b: DataFrame, keys: list[str], gate_deg: float = 15.0,
                     offset_deg: float = 0.0) -> DataFrame:
    """Camera-b bearings, less the offset, against camera a's bearing at the same time.

    Returns kept and total counts, median signed residual and median ranges per key.
    """
    marks = unwrap(a.select(*keys, "t", "azimuth_deg"), keys, "t", "azimuth_deg", "u").select(*keys, "t", "u")
    j = asof(b, marks, keys, F.col("t"))
    d = wrap180(wrap360(F.col("azimuth_deg") - offset_deg) - lerp(F.col("t"), "u"))
    j = j.select(*b.columns, d.alias("_d")).withColumn("_ok", F.abs("_d") < gate_deg)
    g = j.groupBy(*keys).agg(F.count_if("_ok").alias("kept"), F.count("*").alias("total"),
                             F.median(F.when(F.col("_ok"), F.col("_d"))).alias("residual_deg"),
                             F.median(F.when(F.col("_ok"), F.col("range_m"))).alias("range_b_m"))
    return g.join(a.groupBy(*keys).agg(F.median("range_m").alias("range_a_m")), keys)


def shared_revolution_join(a: DataFrame, b: DataFrame, pulses: DataFrame) -> DataFrame:
    """Per shared full revolution: time and bearing difference of two cameras' passes, and omega.

    ``a``/``b`` have (rev, t_s, bearing_deg); ``pulses`` (k, t) of the common rotation.
    """
    after = pulses.select((F.col("k") - 1).alias("rev"), F.col("t").alias("_next"))         # a full turn ends with the next pulse
    spin = pulses.select(F.col("k").alias("rev"), "t").join(after, "rev").select("rev", (360.0 / ((F.col("_next") - F.col("t")) / US)).alias("omega"))
    j = a.select("rev", F.col("t_s").alias("ta"), F.col("bearing_deg").alias("ba")).join(
        b.select("rev", F.col("t_s").alias("tb"), F.col("bearing_deg").alias("bb")), "rev")
    return j.join(spin, "rev").select("rev", (F.col("ta") - F.col("tb")).alias("dt"),
                                      wrap180(F.col("ba") - F.col("bb")).alias("dbearing"), "omega")


def track_interp_join(ebs: DataFrame, acoustic: DataFrame, keys: list[str],
                      cols: tuple[str, ...] = ("f0", "conf", "snr")) -> DataFrame:
    """Acoustic values at the event-track times; outside its span f0 is null and the rest are 0."""
    j = asof(ebs, acoustic.select(*keys, "t", *cols), keys, F.col("t"))
    inside = (F.col("t") >= F.col("_first")) & (F.col("t") <= F.col("_last"))
    out = [F.when(inside, lerp(F.col("t"), c)).otherwise(None if c == "f0" else 0.0).alias(f"a_{c}") for c in cols]
    return j.select(*ebs.columns, *out)


def template_match(dets: DataFrame, template: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Flag detections within ``tol`` of their key's template frequency (column template_hz)."""
    j = dets.join(template.select(*keys, "template_hz"), keys, "left")
    ok = F.abs(F.col("blade_hz") - F.col("template_hz")) <= tol * F.col("template_hz")
    return j.withColumn("matches_template", F.coalesce(F.col("detected") & ok, F.lit(False)))


def fuse_split_cells(dets: DataFrame, keys: list[str], bin_deg: float) -> DataFrame:
    """Merge same-revolution detections whose consecutive bearings lie within 1.5 bins.

    The strongest comb wins, the bearing is event-weighted, events add up.  At most a few hundred
    azimuth cells exist per revolution, so the ordering window is small.
    """
    w = Window.partitionBy(*keys).orderBy("bearing_deg", "bin")
    d = dets.withColumn("_new", (F.abs(wrap180(F.col("bearing_deg") - F.lag("bearing_deg").over(w)))
                                 > bin_deg * 1.5).cast("int"))
    d = d.withColumn("cluster", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in dets.columns if c not in {*keys, "bearing_deg", "n_events", "detected"}]
    best = F.max_by(F.struct(*rest), F.struct("comb_strength", -F.col("bearing_deg")))
    wt = F.greatest("n_events", F.lit(1))
    g = d.groupBy(*keys, "cluster").agg(best.alias("m"), (F.sum(F.col("bearing_deg") * wt) / F.sum(wt)).alias("bearing_deg"),
                                        F.sum("n_events").alias("n_events"), F.max("detected").alias("detected"))
    return g.select(*keys, "cluster", "m.*", "bearing_deg", "n_events", "detected")


# ------------------------------------------------------------------ rankings
def top_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the largest ordering (ties are broken by the later entries)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*keys, "m.*")


def top_blob_per_frame(blobs: DataFrame) -> DataFrame:
    """Largest component per frame; the first in raster order on ties."""
    return top_by(blobs, ["rec_id", "step"], [F.col("area"), -F.col("y0"), -F.col("x0")])


def densest_track(movers: DataFrame) -> DataFrame:
    """Per revolution the mover with the most events."""
    return top_by(movers, ["rec_id", "rev"], [F.col("n_events"), -F.col("bearing_deg")])


def strongest_cell(dets: DataFrame, keys: list[str]) -> DataFrame:
    """The detected cell with the strongest comb: its blade rate becomes the template."""
    d = top_by(dets.where("detected"), keys, [F.col("comb_strength"), -F.col("rev"), -F.col("bin")])
    return d.withColumn("template_hz", F.col("blade_hz"))


def mover_clusters(movers: DataFrame, gate_deg: float = 6.0) -> DataFrame:
    """Number the runs of above-horizon movers whose sorted bearings follow within the gate."""
    up = movers.where("above_horizon")
    w = Window.partitionBy("rec_id").orderBy("bearing_deg", "rev", "bin")
    new = F.coalesce((F.abs(wrap180(F.col("bearing_deg") - F.lag("bearing_deg").over(w))) > gate_deg).cast("int"), F.lit(0))
    return up.withColumn("_new", new).withColumn(
        "cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def summarize_clusters(clustered: DataFrame, min_revs: int = 2) -> DataFrame:
    """Medians, range quartiles, revolutions present, drift and the translating flag per cluster."""
    k = ["rec_id", "cluster"]
    per = clustered.groupBy(*k, "rev").agg(F.median("bearing_deg").alias("b"))
    drift = per.groupBy(*k).agg(F.count("*").alias("n_revs"),
                                F.when(F.count("*") >= 2, F.max("b") - F.min("b")).otherwise(0.0).alias("drift_deg"))
    g = clustered.groupBy(*k).agg(
        F.median("bearing_deg").alias("bearing_deg"), F.median("elev_deg").alias("elev_deg"),
        F.median("range_m").alias("range_m"), F.percentile("range_m", 0.25).alias("range_p25_m"),
        F.percentile("range_m", 0.75).alias("range_p75_m"), F.count("*").alias("n_detections"))
    return g.join(drift.where(F.col("n_revs") >= min_revs), k).withColumn("translating", F.col("drift_deg") > 5.0)


def persistent_candidates(movers: DataFrame, gate_deg: float = 6.0, min_revs: int = 2, top_k: int = 4) -> DataFrame:
    """The ``top_k`` clusters per recording by revolutions present."""
    s = summarize_clusters(mover_clusters(movers, gate_deg), min_revs)
    w = Window.partitionBy("rec_id").orderBy(F.desc("n_revs"), "cluster")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def primary_mover(movers: DataFrame, az_window: tuple[float, float] | None = None, gate_deg: float = 6.0,
                  min_revs: int = 2) -> DataFrame:
    """The movers of a known arc as one target, else the most persistent cluster."""
    if az_window is not None:
        arc = movers.where(F.col("above_horizon") & F.col("bearing_deg").between(*az_window))
        return summarize_clusters(arc.withColumn("cluster", F.lit(0)), min_revs)
    best = persistent_candidates(movers, gate_deg, 1, 1).drop("rank")
    return best.where(F.col("n_revs") >= min_revs)


def multifile_consistency(primary: DataFrame, recordings: DataFrame, gate_deg: float = 10.0) -> DataFrame:
    """Consistent if every recording has a primary mover; bearings agree (null under two) when all
    lie within the gate of the first recording's."""
    j = recordings.select("rec_id").join(primary.select("rec_id", "bearing_deg"), "rec_id", "left")
    g = j.agg(F.count("*").alias("n_files"), F.count("bearing_deg").alias("n_present"),
              F.min_by("bearing_deg", F.when(F.col("bearing_deg").isNotNull(), F.col("rec_id"))).alias("first_deg"),
              F.array_compact(F.collect_list("bearing_deg")).alias("_b"))
    worst = F.array_max(F.transform("_b", lambda b: F.abs(wrap180(b - F.col("first_deg")))))
    return g.select("n_files", "n_present", (F.col("n_files") == F.col("n_present")).alias("consistent"),
                    F.when(F.col("n_present") >= 2, worst <= gate_deg).alias("bearings_agree"),
                    F.when(F.col("n_present") >= 2, worst).alias("bearing_spread_deg"))
