"""Telemetry joins: revolution, phase, boresight azimuth and de-rotated world bearing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import bearing, wrap360
from ..schema import US
from .asof import asof, lerp

REC = ["rec_id"]


def _te(offset_us: int) -> Column:
    return F.col("t") - offset_us


def revolution_asof(ev: DataFrame, pulses: DataFrame, offset_us: int = 0) -> DataFrame:
    """Add ``rev``: index of the last pulse at or before the event, clipped to the pulse range."""
    j = asof(ev, pulses.select("rec_id", "k", "t"), REC, _te(offset_us))
    return j.select(*ev.columns, F.col("m.k").alias("rev"))


def phase_asof(ev: DataFrame, pulses: DataFrame, offset_us: int = 0) -> DataFrame:
    """Add ``phase``: fraction of the current pulse interval, modulo 1 beyond the ends."""
    w = Window.partitionBy("rec_id").orderBy("t")
    spans = (pulses.select("rec_id", "t", F.lead("t").over(w).alias("t2"))
             .where(F.col("t2").isNotNull()))
    j = asof(ev, spans, REC, _te(offset_us))
    frac = (_te(offset_us) - F.col("m.t")) / F.greatest((F.col("m.t2") - F.col("m.t")).cast("double"),
                                                         F.lit(1e-3))
    return j.select(*ev.columns, (frac - F.floor(frac)).alias("phase"))


def rotation_period(pulses: DataFrame) -> DataFrame:
    """Median pulse interval per recording (seconds)."""
    w = Window.partitionBy("rec_id").orderBy("t")
    return (pulses.withColumn("_d", F.col("t") - F.lag("t").over(w)).groupBy("rec_id")
            .agg((F.median("_d") / US).alias("period_s")))


def unwrap(df: DataFrame, keys: list[str], order: str, angle: str, out: str,
           full: float = 360.0) -> DataFrame:
    """Cumulative unwrap of a short ordered angle series (telemetry, tracks)."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = F.col(angle) - F.lag(angle).over(w)
    step = F.when(F.abs(d) > full / 2, -F.signum(d) * full).otherwise(0.0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
            .withColumn(out, F.col(angle) + F.sum("_step").over(run)).drop("_step"))


def azimuth_interp(ev: DataFrame, tel: DataFrame, offset_us: int = 0,
                   out: str = "pan") -> DataFrame:
    """Add the boresight azimuth: linear in the unwrapped telemetry, constant beyond its ends."""
    marks = unwrap(tel.select("rec_id", "t", "azimuth"), REC, "t", "azimuth", "az_u") \
        .select("rec_id", "t", "az_u")
    j = asof(ev, marks, REC, _te(offset_us))
    return j.select(*ev.columns, wrap360(lerp(_te(offset_us), "az_u")).alias(out))


def world_azimuth(ev: DataFrame, tel: DataFrame | None, fov_deg: float, width: int,
                  az_sign: float = -1.0, x: str = "x", out: str = "az",
                  offset_us: int = 0) -> DataFrame:
    """Add the de-rotated bearing pan(t) + az_sign (x - W/2) FOV / W in [0, 360)."""
    rel = bearing(x, fov_deg, width, az_sign)
    if tel is None:
        return ev.withColumn(out, wrap360(rel))
    j = azimuth_interp(ev, tel, offset_us, "_pan")
    return j.withColumn(out, wrap360(F.col("_pan") + rel)).drop("_pan")
