"""Structured Streaming versions of the rate, frame, session, filter and tracking operators.

Streams carry (rec_id, seq, x, y, p, t) plus the event time ``ts``.  Windowed results are emitted
once the watermark passes; stateful operators keep bounded state per pixel, tile or recording.

A stream that ends leaves its last windows open.  :func:`run_to_end` therefore closes it: when the input is used up, a mark with a far
event time follows on a second source of the same query, so the watermark passes every window that holds data and all are emitted.
The mark's own windows never close.  Rows out of order are counted as long as they come within the
``delay`` of the watermark, which is also how long a finished window is kept; rows that come later than that are
reported by :func:`late_rows`.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.neighbours import NEVER, latest_around
from ..functions.spectral import power_udf
from ..operators.asof import BROADCAST_ROWS
from ..operators.spectra import peak_columns
from ..operators.trackers import MultiTrack
from ..schema import EVENTS, US
from ..sources.sinks import shared_folder


#: How far behind the newest row a row may come and still count.
DELAY = "60 seconds"
#: Event time of the mark that closes a stream (the end of the year 9998).
CLOSING_US = 253_370_764_800_000_000


# ------------------------------------------------------------------ plumbing
def with_event_time(stream: DataFrame, t: str = "t") -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros(F.col(t)))


def read_event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int | None = None,
                      name_filter: str | None = None) -> DataFrame:
    """A growing folder of event files as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        r = r.option("pathGlobFilter", name_filter)
    return r.parquet(path)


def _written(stream: DataFrame, out: str, mode: str) -> None:
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it to a Parquet sink and return the written table."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    _written(stream, out, mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _mark(spark: SparkSession, fields) -> DataFrame:
    """One row of the far future: zeros, empty texts, and the closing time in ``ts`` and ``t``."""
    values = {"ts": F.timestamp_micros(F.lit(CLOSING_US)), "t": F.lit(CLOSING_US)}
    return spark.range(1).select(*[values.get(f.name, F.lit("" if f.dataType.typeName() == "string" else 0)).cast(f.dataType).alias(f.name) for f in fields])


def run_to_end(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Process what is there, then close the stream: windows and sessions open at the end are written as well.

    ``stream`` has an event time ``ts``; rows are selected before it is passed, as ``operator`` must let the mark through.  The second
    run goes on from the first one's checkpoint.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    marks, fields = f"{out}/marks", stream.schema
    spark.createDataFrame([], fields).write.parquet(marks)
    whole = operator(stream.unionByName(spark.readStream.schema(fields).parquet(marks)))
    _written(whole, out, "append")
    _mark(spark, fields).write.mode("append").parquet(marks)
    _written(whole, out, "append")
    return spark.read.schema(whole.schema).parquet(f"{out}/data")


# ------------------------------------------------------------------ windowed views
def event_rate(stream: DataFrame, bin_us: int, delay: str = DELAY) -> DataFrame:
    """Tumbling event rate per recording."""
    w = (stream.withWatermark("ts", delay).groupBy("rec_id", F.window("ts", f"{bin_us} microseconds").alias("w"))
         .agg(F.count("*").alias("n")))
    return w.select("rec_id", (F.unix_micros("w.start") / bin_us).cast("long").alias("bin"), "n",
                    (F.col("n") / (bin_us / US)).alias("rate_hz"))


def frames(stream: DataFrame, dt_us: int, slide_us: int | None = None, delay: str = DELAY) -> DataFrame:
    """Accumulated frames: tumbling, or trailing frames every ``slide_us``."""
    win = F.window("ts", f"{dt_us} microseconds", f"{slide_us or dt_us} microseconds").alias("w")
    w = (stream.withWatermark("ts", delay).groupBy("rec_id", win, "x", "y")
         .agg(F.count("*").alias("count"), F.sum("p").alias("on_count")))
    return w.select("rec_id", F.unix_micros("w.start").alias("t0"), "x", "y", "count", "on_count",
                    (2 * F.col("on_count") - F.col("count")).alias("polarity"))


def trailing_map(stream: DataFrame, window_us: int, slide_us: int, cell: int, delay: str = DELAY) -> DataFrame:
    """Density of the newest ``window_us`` per cell, refreshed every ``slide_us``."""
    win = F.window("ts", f"{window_us} microseconds", f"{slide_us} microseconds").alias("w")
    w = (stream.withWatermark("ts", delay)
         .groupBy("rec_id", win, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
         .agg(F.count("*").alias("n")))
    return w.select("rec_id", F.unix_micros("w.end").alias("t1"), "cx", "cy", "n", F.log1p("n").alias("value"))


def spectra(stream: DataFrame, window_us: int, slide_us: int, fs: float, fmin: float, fmax: float, cell: int,
            min_events: int = 40, delay: str = DELAY) -> DataFrame:
    """Dominant line per cell in sliding windows: two chained window aggregations, then the FFT."""
    n_bins = int(window_us * fs / US)
    win = F.window("ts", f"{window_us} microseconds", f"{slide_us} microseconds").alias("w")
    e = stream.withWatermark("ts", delay).select(
        "rec_id", "ts", win, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), "t")
    e = e.withColumn("bin", F.floor((F.col("t") - F.unix_micros("w.start")) / (US / fs)).cast("int"))
    c = e.where(F.col("bin") < n_bins).groupBy("rec_id", "w", "cx", "cy", "bin").agg(F.count("*").alias("c"))
    g = (c.groupBy("rec_id", "w", "cx", "cy")
         .agg(F.collect_list("bin").alias("b"), F.collect_list("c").alias("cs"), F.sum("c").alias("n_events"))
         .where(F.col("n_events") >= min_events).withColumn("n_bins", F.lit(n_bins)))
    g = g.withColumn("power", power_udf("power")("b", "cs", "n_bins"))
    g = peak_columns(g, fs, fmin, fmax)
    return g.select("rec_id", F.unix_micros("w.start").alias("t0"), "cx", "cy", "n_events", "peak_freq", "snr")


def sessions(stream: DataFrame, gap_us: int, delay: str = DELAY) -> DataFrame:
    """Passes as sessions: runs of events whose gaps stay under ``gap_us``."""
    w = (stream.withWatermark("ts", delay).groupBy("rec_id", F.session_window("ts", f"{gap_us} microseconds").alias("w"))
         .agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    return w.select("rec_id", F.unix_micros("w.start").alias("t0"), F.unix_micros("w.end").alias("t1"), "n", "cx", "cy")


# ------------------------------------------------------------------ stateful filters
def refractory(stream: DataFrame, period_us: int) -> DataFrame:
    """Per-pixel dead time; the state is the last kept time."""
    def keep(key, batches, state: GroupState):
        pdf = pd.concat(list(batches)).sort_values(["t", "seq"])
        last_t = state.get[0] if state.exists else None
        t, kept = pdf["t"].to_numpy(), []
        i = 0 if last_t is None else int(np.searchsorted(t, last_t + period_us))
        while i < len(t):
            kept.append(i)
            i = int(np.searchsorted(t, t[i] + period_us))
        if kept:
            state.update((int(t[kept[-1]]),))
        yield pdf.iloc[kept][["rec_id", "seq", "x", "y", "p", "t"]]

    return stream.groupBy("rec_id", "x", "y").applyInPandasWithState(
        keep, EVENTS, "last_kept long", "append", GroupStateTimeout.NoTimeout)


def baf(stream: DataFrame, dt_us: int, tile: int = 16) -> DataFrame:
    """Neighbour support with a carried last-time surface per tile.

    Events within one pixel of a border are also sent to the adjacent tile, where they refresh the
    surface but are not emitted; the state is the surface of the tile with its one-pixel rim.
    """
    n = tile + 2
    around = lambda c: F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile))
    s = stream.withColumn("tx", F.explode(around("x"))).withColumn("ty", F.explode(around("y")))

    def keep(key, batches, state: GroupState):
        _, tx, ty = key
        pdf = pd.concat(list(batches)).sort_values(["t", "seq"])
        last = np.array(state.get[0], np.int64) if state.exists else np.full(n * n, NEVER, np.int64)
        gx, gy = (pdf["x"] - tx * tile + 1).to_numpy(np.int64), (pdf["y"] - ty * tile + 1).to_numpy(np.int64)
        t = pdf["t"].to_numpy()
        own = (gx > 0) & (gx <= tile) & (gy > 0) & (gy <= tile)
        ok = own & (t - latest_around(gx, gy, t, n, last) <= dt_us)
        last[gy * n + gx] = t                      # in stream order, so the last event of a pixel stays
        state.update((last.tolist(),))
        yield pdf[ok][["rec_id", "seq", "x", "y", "p", "t"]]

    return s.groupBy("rec_id", "tx", "ty").applyInPandasWithState(
        keep, EVENTS, "last_t array<long>", "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ stateful tracking and user code
def tracker(dets: DataFrame, **params) -> DataFrame:
    """Live multi-target tracking of a detection stream (rec_id, step, t, cx, cy, x0..y1)."""
    def run(key, batches, state: GroupState):
        tk = pickle.loads(state.get[0]) if state.exists else MultiTrack(**params)
        out = []
        for step, rows in pd.concat(list(batches)).sort_values(["step", "cx", "cy"]).groupby("step"):
            r = list(rows.itertuples(index=False))
            for k, i, c, _ in tk.update(int(step), [(a.cx, a.cy, (a.x0, a.y0, a.x1, a.y1)) for a in r]):
                out.append((key[0], i, int(step), int(r[k].t), float(c[0]), float(c[1])))
        state.update((pickle.dumps(tk),))
        yield pd.DataFrame(out, columns=["rec_id", "target_id", "step", "t", "cx", "cy"])

    return dets.groupBy("rec_id").applyInPandasWithState(
        run, "rec_id string, target_id long, step long, t long, cx double, cy double", "tracker binary", "append",
        GroupStateTimeout.NoTimeout)


def user_state(stream: DataFrame, fn: Callable, schema: str, keys: list[str]) -> DataFrame:
    """Run ``fn(frame, state_dict) -> frame`` per key; the dictionary survives between batches."""
    def run(key, batches, state: GroupState):
        mem = pickle.loads(state.get[0]) if state.exists else {}
        out = fn(pd.concat(list(batches)).sort_values(["t", "seq"]), mem)
        state.update((pickle.dumps(mem),))
        yield out

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "memory binary", "append", GroupStateTimeout.NoTimeout)


def late_rows(stream: DataFrame, folder: str, delay_us: int) -> None:
    """Count rows older than (newest row of earlier batches - delay), batch by batch, into ``folder``/late.

    A watermark drops such rows silently; this stateless side query makes them visible.  A batch writes into folders of its
    own number, which a repeated batch overwrites: its counts, and the newest time per recording up to and with it.  So a
    batch reads one small table of the batch before it, never the history.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, epoch: int):
        schema = "rec_id string, newest long"
        known = spark.read.schema(schema).parquet(f"{folder}/seen/epoch={epoch - 1}") if epoch else spark.createDataFrame([], schema)
        late = batch.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "rec_id").where(F.col("t") < F.col("newest") - delay_us)
        (late.groupBy("rec_id").agg(F.count("*").alias("n_late"), F.min("t").alias("oldest"))
         .write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}"))
        (batch.select("rec_id", F.col("t").alias("newest")).unionByName(known).groupBy("rec_id").agg(F.max("newest").alias("newest"))
         .write.mode("overwrite").parquet(f"{folder}/seen/epoch={epoch}"))

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
