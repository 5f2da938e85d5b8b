"""Clip editing on event tables: cut, batch trim, stitch, composite, aligned crop."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import US
from .asof import small
from .ordered import union_all
from .raster import spans
from .select import select_window, us


def cut_clip(ev: DataFrame, t0: float | None = None, t1: float | None = None, roi=None,
             origin_us: int | None = None) -> DataFrame:
    """Window and ROI copy re-zeroed to the first event of the time slice (before the ROI), or to a
    common origin; times are clipped at 0."""
    part = select_window(ev, t0, t1)
    if origin_us is not None:
        out = part.withColumn("_o", F.lit(origin_us))
    else:
        out = part.join(small(part.groupBy("rec_id").agg(F.min("t").alias("_o"))), "rec_id")
    out = select_window(out, roi=roi)
    return out.withColumn("t", F.greatest(F.col("t") - F.col("_o"), F.lit(0))).select(*ev.columns)


def trim_batch(ev: DataFrame, t0: float = 0.0, t1: float | None = None) -> DataFrame:
    """Manifest of one common-origin trim applied to every recording."""
    d = spans(ev)
    n = cut_clip(ev, t0, t1, origin_us=us(t0)).groupBy("rec_id").agg(
        F.count("*").alias("n_events"), F.max("t").alias("last_t"))
    hi = F.col("t_last") / US if t1 is None else F.lit(float(t1))
    kept = F.greatest(hi - F.greatest(F.lit(float(t0)), F.col("t_first") / US), F.lit(0.0))
    return d.join(n, "rec_id", "left").select(
        "rec_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), "last_t", kept.alias("kept_s"),
        ((F.col("t_last") - F.col("t_first")) / US).alias("src_duration_s"))


def stitch_clips(ev: DataFrame, segments: list[tuple], gap_s: float = 0.0) -> DataFrame:
    """Concatenate (rec_id, t0, t1[, roi]) segments on one clock.

    Each segment starts at the previous one's last written time plus the gap; an empty segment
    leaves the cursor where it was.  Offsets are a running sum over one row per segment.
    """
    gap = max(us(gap_s), 0)
    parts, heads = [], []
    for i, seg in enumerate(segments):
        rec, t0, t1, *roi = seg
        x0, y0, x1, y1 = roi[0] if roi and roi[0] else (0, 0, 1 << 30, 1 << 30)
        inside = F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)
        sl = select_window(ev.where(F.col("rec_id") == rec), t0, t1).withColumn("segment", F.lit(i))
        parts.append(sl.where(inside))
        heads.append(sl.agg(F.lit(i).alias("segment"), F.min("t").alias("o"), F.count("*").alias("n"),
                            F.max(F.when(inside, F.col("t"))).alias("z")))
    h = union_all(*heads)
    # an empty slice adds nothing; a slice emptied by its ROI only adds the gap
    step = F.when(F.col("n") == 0, 0).otherwise(F.coalesce(F.col("z") - F.col("o"), F.lit(0)) + gap)
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("cursor", F.coalesce(F.sum(step).over(w), F.lit(0)))
    return union_all(*parts).join(F.broadcast(h.select("segment", "o", "cursor")), "segment").withColumn(
        "t", F.col("t") - F.col("o") + F.col("cursor")).select("segment", *ev.columns)


@dataclass(frozen=True)
class Cell:
    """One recording placed on a canvas: rect (x, y, w, h), start, speed, loop, crop."""
    rec_id: str
    rect: tuple[int, int, int, int]
    offset_s: float = 0.0
    scale: float = 1.0
    loop: bool = False
    roi: tuple[int, int, int, int] | None = None


def composite_canvas(ev: DataFrame, cells: list[Cell], width: int, height: int, sensor: tuple[int, int],
                     duration_s: float) -> DataFrame:
    """Map recordings into canvas rectangles on one clock, loop passes repeated, clipped to the canvas."""
    sw, sh = sensor
    s = small(spans(ev))
    outs = []
    for i, c in enumerate(cells):
        rx, ry, rw, rh = c.rect
        x0, y0, x1, y1 = c.roi or (0, 0, sw, sh)
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(sw, x1), min(sh, y1)
        if x1 <= x0 or y1 <= y0:
            x0, y0, x1, y1 = 0, 0, sw, sh
        e = (ev.where((F.col("rec_id") == c.rec_id) & F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
             .join(s, "rec_id").withColumn("_dur", (F.col("t_last") - F.col("t_first")) / US).where("_dur > 0"))
        span = F.col("_dur") / c.scale
        n = F.greatest(F.ceil((duration_s - c.offset_s) / span), F.lit(1)) if c.loop else F.lit(1).cast("long")
        e = e.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        off = c.offset_s + F.col("pass") * span
        lo = F.greatest(F.lit(0.0), -off * c.scale)
        hi = F.least(F.col("_dur"), (duration_s - off) * c.scale)
        rel = F.col("t") - F.col("t_first")
        inside = (hi > lo) & (rel >= F.rint(lo * US)) & ((hi >= F.col("_dur")) | (rel < F.rint(hi * US)))
        tc = F.greatest(F.rint(off * 1e6 + rel / c.scale), F.lit(0.0)).cast("long")
        px = rx + F.floor((F.col("x") - x0) * rw / (x1 - x0))
        py = ry + F.floor((F.col("y") - y0) * rh / (y1 - y0))
        outs.append(e.where(inside).select(F.lit(i).alias("cell"), "pass", "seq", px.cast("int").alias("x"),
                                           py.cast("int").alias("y"), "p", tc.alias("t")))
    return union_all(*outs).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def aligned_pair(ev: DataFrame, audio: DataFrame, rate: int, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crop events and audio to their overlap and re-zero both.

    ``plan`` has (rec_id, audio_id, offset_s): event time = audio time + offset.
    """
    s = spans(ev)
    a = audio.groupBy(F.col("rec_id").alias("audio_id")).agg((F.count("*") / rate).alias("_a"))
    w = (plan.join(s, "rec_id").join(a, "audio_id")
         .withColumn("_lo", F.greatest(F.lit(0.0), F.col("offset_s")))
         .withColumn("_hi", F.least((F.col("t_last") - F.col("t_first")) / US, F.col("offset_s") + F.col("_a")))
         .where("_hi > _lo"))
    e = ev.join(small(w.select("rec_id", "_lo", "_hi")), "rec_id")
    lo, hi = F.rint(F.col("_lo") * US), F.rint(F.col("_hi") * US)
    first = e.where((F.col("t") >= lo) & (F.col("t") < hi))
    org = first.groupBy("rec_id").agg(F.min("t").alias("_o"))
    events = first.join(org, "rec_id").withColumn("t", F.col("t") - F.col("_o")).select(*ev.columns)
    c = audio.withColumnRenamed("rec_id", "audio_id").join(w.select("audio_id", "rec_id", "_lo", "_hi", "offset_s"), "audio_id")
    i0 = F.greatest(F.rint((F.col("_lo") - F.col("offset_s")) * rate), F.lit(0.0)).cast("long")
    i1 = F.rint((F.col("_hi") - F.col("offset_s")) * rate).cast("long")
    sound = c.where((F.col("i") >= i0) & (F.col("i") < i1)).select("rec_id", "audio_id", (F.col("i") - i0).alias("i"), "amp")
    return events, sound

