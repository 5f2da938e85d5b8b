"""Reading and decoding: event tables, sensor word streams, telemetry, audio, coverage, facts."""
from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.asof import small
from ..operators.ordered import count, highest, islands, last, scan, union_all
from ..operators.raster import spans
from ..operators.select import us
from ..schema import EVENTS, US
from ..session import cut_lineage
from .raw import WORDS, read_words

WORDS_PER_CHUNK = 1_000_000


# ------------------------------------------------------------------ event tables
def pick_recordings(files: DataFrame, camera: str) -> DataFrame:
    """Per folder the first file whose name holds the camera id, else the first file (by name)."""
    path = F.regexp_replace("path", r"/[^/]*$", "")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    rank = F.struct(F.when(name.contains(camera.lower()), 0).otherwise(1).alias("a"), name.alias("b"))
    return files.groupBy(path.alias("folder")).agg(F.min_by("path", rank).alias("path"))


def number_events(raw: DataFrame, source_order: str) -> DataFrame:
    """Stable time order and zero base: add ``seq`` and shift ``t`` to the first event.

    The running number is a chunked scan, so one long recording is numbered in parallel.  The events are read three times, so
    they are materialised and the decoding behind them runs once.
    """
    raw = cut_lineage(raw)
    first = raw.groupBy("rec_id").agg(F.min("t").alias("_t0"))
    z = raw.join(small(first), "rec_id").withColumn("t", F.col("t") - F.col("_t0"))
    n = scan(z, ["rec_id"], ["t", source_order], _n=count())
    return n.select("rec_id", (F.col("_n") - 1).alias("seq"), "x", "y", "p", "t")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stored event table; filters on rec_id, t_bucket and t are pushed into the scan."""
    return spark.read.schema(EVENTS + ", t_bucket long").parquet(path)


def geometry(ev: DataFrame) -> DataFrame:
    return ev.groupBy("rec_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


# ------------------------------------------------------------------ sensor word streams
def decode_words(words: DataFrame, fmt: str) -> DataFrame:
    """Words of one encoding to events."""
    return ingest_evt3_words(words) if fmt == "evt3" else ingest_event_words(words, fmt)


def read_recordings(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events (rec_id, word_idx, bit, x, y, p, t) of all raw recordings below ``path``, whatever their encodings.

    Files are cut into word-aligned ranges (see :mod:`.raw`), and the decoders carry their state over any cut.  A file is read
    for its own encoding only.
    """
    return union_all(*[decode_words(read_words(spark, path, fmt=fmt, **options), fmt) for fmt in WORDS])


def _chunk() -> Column:
    return F.floor(F.col("word_idx") / WORDS_PER_CHUNK)


def _bits(mask: Column, n: int) -> Column:
    """One row per set bit of a mask."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)),
                              lambda b: F.call_function("getbit", mask, b) == 1))


def ingest_event_words(words: DataFrame, fmt: str = "evt21") -> DataFrame:
    """64-bit vectorised (evt21) or 32-bit (evt2) words to events.

    The high time word is a running maximum over the stream; words before the first one are junk.
    """
    w = F.col("word")
    if fmt == "evt21":
        kind = F.shiftrightunsigned(w, 60)
        high = F.shiftrightunsigned(w, 32).bitwiseAND(0x0FFFFFFF)
    else:
        kind = F.shiftrightunsigned(w, 28).bitwiseAND(0xF)
        high = w.bitwiseAND(0x0FFFFFFF)
    s = scan(words.withColumn("_k", kind), ["rec_id"], ["word_idx"], _chunk(),
             _hi=highest(F.when(F.col("_k") == 8, high)))
    cd = s.where(F.col("_k").isin(0, 1) & F.col("_hi").isNotNull())
    if fmt == "evt21":
        t = F.col("_hi") * 64 + F.shiftrightunsigned(w, 54).bitwiseAND(0x3F)
        x = F.shiftrightunsigned(w, 43).bitwiseAND(0x7FF)
        y = F.shiftrightunsigned(w, 32).bitwiseAND(0x7FF)
        cd = cd.withColumn("bit", _bits(w.bitwiseAND(F.lit(0xFFFFFFFF)), 32))
        return cd.select("rec_id", "word_idx", "bit", (x + F.col("bit")).cast("int").alias("x"),
                         y.cast("int").alias("y"), F.col("_k").cast("int").alias("p"), t.alias("t"))
    t = F.col("_hi") * 64 + F.shiftrightunsigned(w, 22).bitwiseAND(0x3F)
    return cd.select("rec_id", "word_idx", F.lit(0).alias("bit"),
                     F.shiftrightunsigned(w, 11).bitwiseAND(0x7FF).cast("int").alias("x"),
                     w.bitwiseAND(0x7FF).cast("int").alias("y"), F.col("_k").cast("int").alias("p"), t.alias("t"))


def ingest_evt3_words(words: DataFrame) -> DataFrame:
    """16-bit stateful words: every field is carried forward, within a chunk by windows and over chunks by one row for each.

    The 12-bit high time wraps (one epoch each time it falls); a vector word's column is the last
    base plus the widths of the vector words since.
    """
    k, d = F.col("_k"), F.col("_d")
    part = ["rec_id", "_chunk"]
    w = Window.partitionBy(*part).orderBy("word_idx")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    high, base = F.when(k == 8, d), F.when(k == 3, d)
    width = F.when(k == 4, 12).when(k == 5, 8).otherwise(0)
    s = words.select("rec_id", "word_idx", _chunk().alias("_chunk"), F.shiftrightunsigned("word", 12).cast("int").alias("_k"),
                     F.col("word").bitwiseAND(0xFFF).cast("int").alias("_d"))
    s = s.withColumns({
        "_prev": F.last(high, True).over(before), "_raw": F.last(high, True).over(upto), "_first": F.first(high, True).over(upto),
        "_low": F.last(F.when(k == 6, d), True).over(upto), "_y": F.last(F.when(k == 0, d.bitwiseAND(0x7FF)), True).over(upto),
        "_base": F.last(base, True).over(upto), "_cw": F.sum(width).over(upto)})
    s = s.withColumns({"_wraps": F.sum(F.when(high < F.col("_prev"), 1).otherwise(0)).over(upto),
                       "_c0": F.last(F.when(k == 3, F.col("_cw")), True).over(upto)})

    # what each chunk hands on is its last row
    state = ["_raw", "_first", "_low", "_y", "_base", "_cw", "_wraps", "_c0"]
    heads = s.groupBy(*part).agg(F.max_by(F.struct(*state), "word_idx").alias("e")).select(*part, "e.*")
    past = Window.partitionBy("rec_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def carried(c):
        return F.last(c, True).over(past)

    heads = heads.withColumns({f"_p{c}": carried(c) for c in ("_raw", "_low", "_y", "_base")})
    heads = heads.withColumns({"_turn": F.when(F.col("_first") < F.col("_p_raw"), 1).otherwise(0), "_widths": F.coalesce(F.sum("_cw").over(past), F.lit(0))})
    heads = heads.withColumns({"_epoch": F.coalesce(F.sum(F.col("_wraps") + F.col("_turn")).over(past), F.lit(0)),
                               "_since": F.col("_widths") - F.coalesce(carried(F.col("_widths") + F.col("_c0")), F.lit(0))})
    ev = s.where("_k IN (2, 4, 5)").join(heads.select(*part, "_p_raw", "_p_low", "_p_y", "_p_base", "_turn", "_epoch", "_since"), part)

    def now(c):
        return F.coalesce(c, f"_p{c}", F.lit(0)).cast("long")

    epoch = F.col("_epoch") + F.col("_wraps") + F.when(F.col("_raw").isNotNull(), F.col("_turn")).otherwise(0)
    t = (epoch * 4096 + now("_raw")) * 4096 + now("_low")
    cw = F.col("_cw") - width                      # of the vector words before this one
    column = now("_base").bitwiseAND(0x7FF) + F.when(F.col("_c0").isNotNull(), cw - F.col("_c0")).otherwise(cw + F.col("_since"))
    one = k == 2
    mask = F.when(one, 1).when(k == 4, d).otherwise(d.bitwiseAND(0xFF))
    pol = F.shiftrightunsigned(F.when(one, d.cast("long")).otherwise(now("_base")), 11)
    return ev.withColumn("bit", _bits(mask, 12)).select(
        "rec_id", "word_idx", "bit", F.when(one, d.bitwiseAND(0x7FF)).otherwise(column + F.col("bit")).cast("int").alias("x"),
        now("_y").cast("int").alias("y"), pol.cast("int").alias("p"), t.alias("t"))


def strip_preroll(ev: DataFrame) -> DataFrame:
    """Drop a leading cluster split off by a gap of at least 3 s and half the span.

    Only the first max(10, n / 500) gaps are looked at; recordings under 200 events are kept.
    """
    d = ev.groupBy("rec_id").agg(F.count("*").alias("_n"), (F.max("t") - F.min("t")).alias("_span")).where("_n >= 200")
    s = scan(ev, ["rec_id"], ["t", "seq"], _r=count(), _prev=last(F.col("t"), inclusive=False)).join(d, "rec_id", "left")
    look = F.greatest(F.lit(10), F.floor(F.col("_n") / 500))
    gap = F.col("t") - F.col("_prev")
    cut = (s.where((F.col("_r") >= 2) & (F.col("_r") <= look + 1))
           .groupBy("rec_id").agg(F.max_by("_r", F.struct(gap, -F.col("_r"))).alias("_cut"), F.max(gap).alias("_g"),
                                  F.first("_span").alias("_sp"))
           .where((F.col("_g") >= 3_000_000) & (F.col("_g") >= F.floor(F.col("_sp") / 2))).select("rec_id", "_cut"))
    return s.join(cut, "rec_id", "left").where(F.col("_cut").isNull() | (F.col("_r") >= F.col("_cut"))).select(*ev.columns)


# ------------------------------------------------------------------ telemetry
def parse_telemetry(rows: DataFrame) -> DataFrame:
    """Columns System_Time, Azimuth, Revolution, Flag (strings) to (rec_id, t, azimuth, rev, flag, hall).

    ``date_HHMMSS_millis`` becomes seconds of the day, zero-based per recording; there is no
    midnight wrap handling.
    """
    hms, ms = F.split(F.trim("System_Time"), "_")[1], F.split(F.trim("System_Time"), "_")[2]
    t = ((F.substring(hms, 1, 2).cast("long") * 3600 + F.substring(hms, 3, 2).cast("long") * 60
          + F.substring(hms, 5, 2).cast("long")) * 1000 + ms.cast("long")) * 1000
    r = rows.select("rec_id", t.alias("_t"), F.col("Azimuth").cast("double").alias("azimuth"),
                    F.col("Revolution").cast("int").alias("rev"), F.coalesce("Flag", F.lit("")).alias("flag"))
    first = r.groupBy("rec_id").agg(F.min("_t").alias("_t0"))
    return r.join(first, "rec_id").select("rec_id", (F.col("_t") - F.col("_t0")).alias("t"), "azimuth", "rev", "flag",
                                          F.col("flag").contains("HALL_SYNC").alias("hall"))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry CSV files; lines starting with ``#`` are ignored, the file name is the recording."""
    raw = (spark.read.schema("System_Time string, Azimuth string, Revolution string, Flag string")
           .option("comment", "#").csv(path)
           .withColumn("rec_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)))
    return parse_telemetry(raw.where(~F.lower(F.trim("System_Time")).startswith("system_time")))


def synth_telemetry(durations: DataFrame, period_s: float, az0_deg: float = 0.0, dt_s: float = 0.01) -> DataFrame:
    """Constant-spin telemetry samples for (rec_id, duration_s)."""
    n = F.ceil((F.col("duration_s") + dt_s) / dt_s - 1e-9)
    s = durations.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    t = F.col("i") * dt_s
    turn = t / period_s * 360.0 + az0_deg
    return s.select("rec_id", "i", F.round(t * US).cast("long").alias("t"), (turn - F.floor(turn / 360.0) * 360.0).alias("azimuth"),
                    F.floor(t / period_s).cast("int").alias("rev"))


def synth_pulses(durations: DataFrame, period_s: float) -> DataFrame:
    """Revolution pulses at k T for k = 0 .. floor(duration / T) + 1."""
    return durations.select("rec_id", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.col("duration_s") / period_s) + 1)).alias("k")).withColumn(
        "t", F.round(F.col("k") * (period_s * US)).cast("long"))


# ------------------------------------------------------------------ audio
def _samples(blob: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(blob), "rb") as w:
        rate, ch, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128.0
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] + (b[:, 1] << 8) + (b[:, 2] << 16)
        x = np.where(x >= 1 << 23, x - (1 << 24), x).astype(float)
    else:
        x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(float)
    return (x.reshape(-1, ch).mean(axis=1) if ch > 1 else x), rate


def decode_wav(files: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Rows (path, content) to samples (rec_id, i, amp, rate); channels are averaged, PCM is not rescaled."""
    def run(batches):
        for b in batches:
            for path, blob in zip(b["path"], b["content"]):
                x, rate = _samples(blob)
                for s in range(0, len(x), block):
                    part = x[s:s + block]
                    yield pd.DataFrame({"rec_id": path.rsplit("/", 1)[-1], "i": np.arange(s, s + len(part)),
                                        "amp": part, "rate": rate})
    return files.select("path", "content").mapInPandas(run, "rec_id string, i long, amp double, rate int")


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    return decode_wav(spark.read.format("binaryFile").load(path))


# ------------------------------------------------------------------ previews and coverage
def preview_spans(ev: DataFrame, slice_s: float = 2.0, n_slices: int = 3) -> DataFrame:
    """Beginning, middle and end windows per recording; short recordings give one whole window."""
    d = spans(ev)
    s, dur = us(slice_s), F.col("t_last") - F.col("t_first")
    end = F.col("t_last") + 1
    mid = F.floor(F.col("t_first") + (dur - s) / 2)
    rows = F.when(dur <= n_slices * s, F.array(F.struct(F.lit(0).alias("slice"), F.col("t_first").alias("a"), end.alias("b")))) \
        .otherwise(F.array(F.struct(F.lit(0).alias("slice"), F.col("t_first").alias("a"), (F.col("t_first") + s).alias("b")),
                           F.struct(F.lit(1).alias("slice"), mid.alias("a"), (mid + s).alias("b")),
                           F.struct(F.lit(2).alias("slice"), (F.col("t_last") - s).alias("a"), end.alias("b"))))
    return d.select("rec_id", F.explode(rows).alias("w")).select("rec_id", "w.*")


def preview_slices(ev: DataFrame, slice_s: float = 2.0, n_slices: int = 3) -> DataFrame:
    """Events of the preview windows (three rows per recording join against the events)."""
    w = preview_spans(ev, slice_s, n_slices)
    return ev.join(w, "rec_id").where((F.col("t") >= F.col("a")) & (F.col("t") < F.col("b"))).select(*ev.columns, "slice")


def coverage_spans(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Union of touching intervals (a, b) per key, with the gap to the next covered span."""
    iv = intervals.where("b > a").select(*keys, "a", "b")
    chunk = F.floor(F.col("a") / US)
    s = scan(iv, keys, ["a", "b"], chunk, _end=highest(F.col("b"), inclusive=False))
    g = islands(s, keys, ["a", "b"], F.col("_end").isNull() | (F.col("a") > F.col("_end")), "island", chunk)
    m = g.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))
    nxt = scan(m, keys, ["island"], F.floor(F.col("a") / US), _next=_follow("a"))
    return nxt.withColumnRenamed("_next", "next_a")


def _follow(c: str):
    from ..operators.ordered import following
    return following(F.col(c))


def first_gap(covered: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """First uncovered stretch inside [lo, hi) per key (none where it is all covered)."""
    c = covered.where((F.col("b") > lo) & (F.col("a") < hi))
    g = c.groupBy(*keys).agg(F.min("a").alias("_a0"), F.min_by("b", "a").alias("_b0"), F.min_by("next_a", "a").alias("_n0"))
    head = F.col("_a0") > lo
    a, b = F.when(head, F.lit(lo)).otherwise(F.col("_b0")), F.when(head, F.col("_a0")).otherwise(F.least(F.coalesce("_n0", F.lit(hi)), F.lit(hi)))
    return g.select(*keys, a.alias("gap_a"), b.alias("gap_b")).where("gap_b > gap_a")


# ------------------------------------------------------------------ facts
def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of each input file."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "modificationTime")


def source_facts(ev: DataFrame, config: dict[str, object], manifest: DataFrame | None = None) -> DataFrame:
    """Geometry, counts, duration and the run configuration (as JSON) per recording.

    With the manifest of an ingested table also what was read: path, size, time of change, encoding, digest and SHA-256 of the source.
    """
    conf = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in config.items()]))
    facts = ev.groupBy("rec_id").agg(
        F.count("*").alias("events"), F.sum("p").alias("n_on"), (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"), ((F.max("t") - F.min("t")) / US).alias("duration_s")) \
        .withColumn("config", conf)
    if manifest is None:
        return facts
    return facts.join(manifest.select("rec_id", "path", "bytes", "modified_us", "fmt", "n_words", "digest", "sha256"), "rec_id", "left")
