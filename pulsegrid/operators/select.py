"""Row selection: windows, regions, polarity, columns, polygons, time ranges, subsampling."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import around
from ..schema import US
from .ordered import count, scan


def us(seconds: float) -> int:
    """Seconds to whole microseconds (half to even)."""
    return int(round(seconds * US))


def select_window(ev: DataFrame, t0: float | None = None, t1: float | None = None,
                  roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Events in [t0, t1) seconds and [x0, x1) x [y0, y1).

    Plain comparisons on the stored columns, so they reach the Parquet scan; a stored ``t_bucket``
    partition column is pruned as well when the table has one.
    """
    if t0 is not None:
        ev = ev.where(F.col("t") >= us(t0))
        if "t_bucket" in ev.columns:
            ev = ev.where(F.col("t_bucket") >= us(t0) // US)
    if t1 is not None:
        ev = ev.where(F.col("t") < us(t1))
        if "t_bucket" in ev.columns:
            ev = ev.where(F.col("t_bucket") <= us(t1) // US)
    if roi is not None:
        x0, y0, x1, y1 = roi
        ev = ev.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return ev


def polarity_filter(ev: DataFrame, polarity: str = "both") -> DataFrame:
    if polarity == "both":
        return ev
    return ev.where(F.col("p") == {"on": 1, "off": 0}[polarity])


def column_subset(ev: DataFrame, width: int, mode: str = "all", n_cols: int = 8,
                  columns: list[int] | None = None, band: tuple[int, int] | None = None) -> DataFrame:
    """Line-scanner column pick: all, few, single, an explicit list, or a closed band."""
    if columns is not None:
        return ev.where(F.col("x").isin(list(columns)))
    if band is not None:
        return ev.where(F.col("x").between(*band))
    if mode == "all":
        return ev
    half = 0.5 if mode == "single" else max(0.5, n_cols / 2.0)
    return ev.where(F.abs(F.col("x") - width / 2.0) <= half)


def polygon_keep(ev: DataFrame, verts: list[tuple[float, float]], px: str = "az",
                 py: str = "y") -> DataFrame:
    """Rows inside a polygon by the even-odd ray rule (one term per edge)."""
    if len(verts) < 3:
        return ev.where(F.lit(False))
    x, y = F.col(px), F.col(py)
    crossings = []
    for (xa, ya), (xb, yb) in zip(verts, verts[1:] + verts[:1]):
        if ya == yb:
            continue
        side = (F.lit(float(ya)) > y) != (F.lit(float(yb)) > y)
        at = (float(xb) - xa) * (y - ya) / (float(yb) - ya) + xa
        crossings.append(F.when(side & (x < at), 1).otherwise(0))
    return ev.where(reduce(lambda a, b: a + b, crossings) % 2 == 1)


def prune_time_ranges(df: DataFrame, drop: list[tuple[float, float]] = (),
                      keep: tuple[float, float] | None = None, t: str = "t") -> DataFrame:
    """Drop rows in any closed range (seconds); keep only a closed window."""
    for a, b in drop:
        df = df.where(~F.col(t).between(us(a), us(b)))
    return df if keep is None else df.where(F.col(t).between(us(keep[0]), us(keep[1])))


def stride_subsample(ev: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th event in stream order per recording."""
    return (scan(ev, ["rec_id"], ["t", "seq"], _rank=count())
            .where((F.col("_rank") - 1) % stride == 0).drop("_rank"))


def random_subsample(ev: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """Uniform sample of at most ``cap`` events per recording, repeatable across runs.

    Ranks a hash of the event number; the rank is a chunked scan over hash prefixes, so a huge
    recording is ranked in parallel.
    """
    h = F.md5(F.concat_ws(":", F.col("seq"), F.lit(seed)))
    ev_h = ev.withColumn("_h", h)
    prefix = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    return (scan(ev_h, ["rec_id"], ["_h", "seq"], prefix, _rank=count())
            .where(F.col("_rank") <= cap).drop("_h", "_rank"))


def box_gate(ev: DataFrame, az: tuple[float, float], ywin: tuple[float, float],
             rev: int | None = None, az_col: str = "az") -> DataFrame:
    """Events whose azimuth (unwrapped about the window centre) and row lie in closed windows."""
    azu = around(az_col, (az[0] + az[1]) / 2.0)
    out = ev.where(azu.between(*az) & F.col("y").between(*ywin))
    return out if rev is None else out.where(F.col("rev") == rev)


def frame_difference(ev: DataFrame, frame_us: int, rise: float = 0.5) -> DataFrame:
    """Pixels whose count rose by more than ``rise`` against the previous frame.

    Every event adds one to its own frame and takes one from the next, so one aggregation gives
    the difference without a self join.
    """
    delta = F.explode(F.array(F.struct(F.lit(0).alias("d"), F.lit(1).alias("w")),
                              F.struct(F.lit(1).alias("d"), F.lit(-1).alias("w"))))
    return (ev.select("rec_id", "x", "y", F.floor(F.col("t") / frame_us).alias("f"), delta.alias("s"))
            .groupBy("rec_id", (F.col("f") + F.col("s.d")).alias("frame"), "x", "y")
            .agg(F.sum("s.w").alias("rise")).where(F.col("rise") > rise))


def drop_rule_outliers(df: DataFrame, keys: list[str], value: str, k: float = 3.0,
                       eps: float = 1e-9) -> DataFrame:
    """MAD gate |v - median| < k * 1.4826 * (MAD + eps) per track (detections, not raw events)."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    dev = df.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = dev.groupBy(*keys).agg(F.median("_dev").alias("_mad"))
    return (dev.join(mad, keys).where(F.col("_dev") < k * 1.4826 * (F.col("_mad") + eps))
            .drop("_med", "_dev", "_mad"))


def flag_all(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)
