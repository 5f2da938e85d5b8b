"""Noise filters on event tables. Every filter sees the original window, as the chain requires."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.neighbours import NEVER, latest_around
from ..schema import US
from ..session import cut_lineage
from .select import polarity_filter

PIXEL = ["rec_id", "x", "y"]


def pixel_counts(ev: DataFrame) -> DataFrame:
    return ev.groupBy(*PIXEL).agg(F.count("*").alias("n"))


def hot_pixels(ev: DataFrame, pct: float = 99.95) -> DataFrame:
    """Pixels whose count reaches the percentile of the non-zero pixel counts (at least 1).

    The percentile runs over one number per pixel, so its state is bounded by the sensor size.
    """
    pc = pixel_counts(ev)
    thr = pc.groupBy("rec_id").agg(
        F.greatest(F.percentile("n", pct / 100.0), F.lit(1.0)).alias("_thr"))
    return pc.join(thr, "rec_id").where(F.col("n") >= F.col("_thr")).select(*PIXEL)


def hot_pixel_mask(ev: DataFrame, pct: float = 99.95) -> DataFrame:
    return ev.join(hot_pixels(ev, pct), PIXEL, "left_anti").select(*ev.columns)


# ------------------------------------------------------------------ dead time per pixel
class Chunks:
    """The sorted time arrays of one Arrow batch laid end to end, so that a single search serves all.

    Each array is shifted into its own range, wide enough that no dead time reaches the next one.
    """

    def __init__(self, arrays, period: int):
        self.period = period
        self.t = np.concatenate([np.asarray(a, np.int64) for a in arrays])
        size = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.low = int(self.t.min())
        self.stride = int(self.t.max()) - self.low + period + 1
        self.shift = np.arange(len(arrays), dtype=np.int64) * self.stride - self.low
        self.key = self.t + np.repeat(self.shift, size)
        self.end = np.repeat(self.stop, size)
        self.nxt = np.searchsorted(self.key, self.key + period)

    def transfer(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per array: the possible first kept times of the chunk and where each chain ends."""
        end = np.where(self.nxt < self.end, self.nxt, np.arange(len(self.t)))
        while True:                      # pointer doubling to the end of every chain
            jump = end[end]
            if np.array_equal(jump, end):
                break
            end = jump
        exits = self.t[end]
        heads = np.minimum(self.nxt[self.start] + 1, self.stop)
        head = np.zeros(len(self.t) + 1, np.int64)
        np.add.at(head, self.start, 1)
        np.add.at(head, heads, -1)
        keep = np.cumsum(head[:-1]) > 0
        same = np.append(exits[1:] == exits[:-1], False)
        same[heads - 1] = False          # the last head closes its run
        keep &= ~same
        cut = np.cumsum(np.add.reduceat(keep, self.start))[:-1]
        return np.split(self.t[keep], cut), np.split(exits[keep], cut)

    def kept(self, carry: np.ndarray) -> list[np.ndarray]:
        """Per array: the kept positions, given the last kept time before it (NaN for none)."""
        has = ~np.isnan(carry)
        at = self.start.copy()
        want = carry[has].astype(np.int64) + self.period + self.shift[has]
        at[has] = np.maximum(np.searchsorted(self.key, want), self.start[has])
        mark = np.zeros(len(self.t), bool)
        at = at[at < self.stop]
        while len(at):
            mark[at] = True
            nxt = self.nxt[at]
            at = nxt[nxt < self.end[at]]
        where = np.flatnonzero(mark)
        cut = np.searchsorted(where, self.stop)[:-1]
        return [p - s for p, s in zip(np.split(where, cut), self.start)]


def refractory_filter(ev: DataFrame, period_us: int, chunk_us: int | None = None) -> DataFrame:
    """Per pixel, drop an event closer than ``period_us`` to the last kept one.

    The dead time is sequential per pixel, and one pixel may hold a third of the stream, so a
    pixel is cut into time chunks.  Each chunk is summarised as a step function from "last kept
    time on entry" to "last kept time on exit"; a streaming pass over these few summary rows per
    pixel hands every chunk its entry time, and the chunks are then filtered in parallel.  Equal
    times on a pixel are merged before collecting, so a chunk's array cannot exceed its length in
    microseconds.
    """
    if period_us <= 0:
        return ev
    period_us = int(period_us)
    width = int(chunk_us or max(64 * period_us, US // 4))
    chunk = F.floor(F.col("t") / width).alias("_chunk")
    # seq and polarity share one long so that the merge is a hash aggregation; the cells are used
    # twice (summary and filter), so they are written once instead of shuffled twice
    cells = (ev.select(*PIXEL, chunk, "t", (F.col("seq") * 2 + F.col("p")).alias("e"))
             .groupBy(*PIXEL, "_chunk", "t").agg(F.min("e").alias("e"))
             .groupBy(*PIXEL, "_chunk").agg(F.sort_array(F.collect_list(F.struct("t", "e"))).alias("es"))
             .withColumn("ts", F.transform("es", lambda s: s["t"])))
    cells = cut_lineage(cells)

    @F.pandas_udf(T.StructType([T.StructField("heads", T.ArrayType(T.LongType())),
                                T.StructField("exits", T.ArrayType(T.LongType()))]))
    def transfer(ts: pd.Series) -> pd.DataFrame:
        heads, exits = Chunks(ts, period_us).transfer() if len(ts) else ([], [])
        return pd.DataFrame({"heads": heads, "exits": exits})

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def kept(ts: pd.Series, carry: pd.Series) -> pd.Series:
        return pd.Series(Chunks(ts, period_us).kept(carry.to_numpy(float)) if len(ts) else [])

    def fold(batches):
        pixel, last = None, None
        for b in batches:
            carry = []
            for key, heads, exits in zip(zip(b.rec_id, b.x, b.y), b.heads, b.exits):
                if key != pixel:
                    pixel, last = key, None
                carry.append(last)
                i = 0 if last is None else int(np.searchsorted(heads, last + period_us))
                if i < len(heads):
                    last = int(exits[i])
            yield pd.DataFrame({"rec_id": b.rec_id, "x": b.x, "y": b.y, "_chunk": b["_chunk"],
                                "_carry": pd.array(carry, dtype="Int64")})

    heads = (cells.withColumn("s", transfer("ts"))
             .select(*PIXEL, "_chunk", "s.heads", "s.exits")
             .repartition(*PIXEL).sortWithinPartitions(*PIXEL, "_chunk")
             .mapInPandas(fold, "rec_id string, x int, y int, _chunk long, _carry long"))
    return (cells.join(heads, [*PIXEL, "_chunk"])
            .select(*PIXEL, F.explode(F.transform(
                kept("ts", "_carry"), lambda i: F.element_at("es", i + 1))).alias("e"))
            .select("rec_id", F.expr("e.e div 2").alias("seq"), "x", "y", (F.col("e.e") % 2).cast("int").alias("p"), "e.t"))


# ------------------------------------------------------------------ neighbour support
def pieces(ev: DataFrame, dt_us: int, chunk_us: int, tile: int) -> DataFrame:
    """The events under each tile and chunk that needs them: their own, and those in whose rim they lie."""
    def around(c):
        return F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile))

    until = F.sequence(F.floor(F.col("t") / chunk_us), F.floor((F.col("t") + dt_us) / chunk_us))
    return (ev.select("rec_id", "seq", "x", "y", "p", "t").withColumn("_tx", F.explode(around("x"))).withColumn("_ty", F.explode(around("y")))
            .withColumn("_chunk", F.explode(until)))


def baf_filter(ev: DataFrame, dt_us: int = 5000, chunk_us: int = US, tile: int = 64) -> DataFrame:
    """Keep an event if one of its eight neighbours fired earlier in the stream within ``dt_us``.

    The stream is cut into tiles of pixels and chunks of time.  A tile also gets the events of the rim of one pixel around it and a
    chunk those of the last ``dt_us`` before it, so that a piece needs nothing from outside and about 1.1 rows an event are
    shuffled.  Spark sorts the pieces, and a task judges them batch by batch with the last times of one piece's pixels, so its memory
    does not grow with the events of a piece.
    """
    chunk_us, side = max(int(chunk_us), int(dt_us)), tile + 2

    def judge(batches):
        last, surface = None, None
        for b in batches:
            if not b.num_rows:
                continue
            tx, ty, chunk, x, y, t = (b.column(c).to_numpy() for c in ("_tx", "_ty", "_chunk", "x", "y", "t"))
            rec = b.column("rec_id").dictionary_encode()
            starts = np.flatnonzero(np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in (rec.indices.fill_null(-1).to_numpy(), tx, ty, chunk)], axis=0))
            ends = [(rec[int(i)].as_py(), tx[i], ty[i], chunk[i]) for i in (starts[0], starts[-1])]
            if ends[0] != last:
                surface = None
            # the pieces of a batch lie below each other; only the first one may have begun in the batch before
            at = np.searchsorted(starts, np.arange(b.num_rows), "right") - 1
            gx, gy = x - tx * tile + 1, y - ty * tile + 1
            own = (gx > 0) & (gx <= tile) & (gy > 0) & (gy <= tile) & (t // chunk_us == chunk)
            seen = latest_around(gx, gy + at * side, t, side, surface)
            if len(starts) > 1 or surface is None:
                surface = np.full(side * side, NEVER, np.int64)
            end = slice(starts[-1], None)
            np.maximum.at(surface, gy[end] * side + gx[end], t[end])
            last = ends[1]
            yield b.filter(pa.array(own & (t - seen <= dt_us))).select(["rec_id", "seq", "x", "y", "p", "t"])

    key = ["rec_id", "_tx", "_ty", "_chunk"]
    schema = T.StructType([f for f in ev.select("rec_id", "seq", "x", "y", "p", "t").schema])
    return pieces(ev, dt_us, chunk_us, tile).repartition(*key).sortWithinPartitions(*key, "t", "seq").mapInArrow(judge, schema)


# ------------------------------------------------------------------ chains
def denoise_chain(ev: DataFrame, polarity: str = "both", hot_pct: float | None = None,
                  refractory_us: int | None = None, baf_dt_us: int | None = None) -> DataFrame:
    """AND of masks that are each computed on the unfiltered events."""
    out = polarity_filter(ev, polarity)
    if hot_pct is not None:
        out = out.join(hot_pixels(ev, hot_pct), PIXEL, "left_anti")
    if refractory_us:
        out = out.join(refractory_filter(ev, refractory_us).select("rec_id", "seq"),
                       ["rec_id", "seq"], "left_semi")
    if baf_dt_us is not None:
        out = out.join(baf_filter(ev, baf_dt_us).select("rec_id", "seq"),
                       ["rec_id", "seq"], "left_semi")
    return out.select(*ev.columns)


def op_chain(ev: DataFrame, polarity: str = "on", hot_pct: float = 99.9, refractory_us: int = 1000,
             background: DataFrame | None = None, stride: int = 1) -> DataFrame:
    """Events surviving each stage: select, polarity, hot-pixel, refractory, bg-suppress, subsample.

    ``background`` holds the pixels the background stage drops.
    """
    on = {"both": F.lit(True), "on": F.col("p") == 1, "off": F.col("p") == 0}[polarity]
    flags = (ev.select("rec_id", "seq", "x", "y", on.alias("a"))
             .join(hot_pixels(ev, hot_pct).withColumn("_hot", F.lit(True)), PIXEL, "left")
             .join(refractory_filter(ev, refractory_us)
                   .select("rec_id", "seq", F.lit(True).alias("_ref")), ["rec_id", "seq"], "left"))
    if background is not None:
        flags = flags.join(background.withColumn("_bg", F.lit(True)), PIXEL, "left")
    else:
        flags = flags.withColumn("_bg", F.lit(None).cast("boolean"))
    a = F.col("a")
    b = a & F.col("_hot").isNull()
    c = b & F.col("_ref").isNotNull()
    d = c & F.col("_bg").isNull()
    g = flags.groupBy("rec_id").agg(F.count("*").alias("n0"), F.count_if(a).alias("n1"),
                                    F.count_if(b).alias("n2"), F.count_if(c).alias("n3"),
                                    F.count_if(d).alias("n4"))
    g = g.withColumn("n5", F.ceil(F.col("n4") / stride))
    names = ["select", "polarity", "hot-pixel", "refractory", "bg-suppress", "subsample"]
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"),
                              F.col(f"n{i}").alias("n")) for i, n in enumerate(names)])
    return g.select("rec_id", F.explode(rows).alias("s")).select("rec_id", "s.*")
