"""Queries for decoding, telemetry, previews, coverage and sinks, over data derived from the tables."""
from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..sources import events as src, raw, sinks
from .raster_catalog import SPAN
from .registry import query

SPE = SPAN.format(src="px_events")


#: Header of the files that queries write, before the closing line.
HEADER = {"evt21": "% evt 2.1\n% format EVT21;height=32;width=32\n", "evt2": "% format EVT2\n% geometry 32x32\n", "evt3": "% evt 3.0\n% format EVT3;height=32;width=32\n"}


def raw_files(v, words, fmt: str) -> str:
    """Write words (name, seq, k, word) as raw files; returns the folder."""
    folder = sinks.shared_folder(v.spark, "raw")
    raw.write_raw(words.withColumn("fmt", F.lit(fmt)), folder, [c for c in ("t", "seq", "k") if c in words.columns], F.lit(HEADER[fmt]))
    return folder


def words21(e, spare=1):
    """A TIME_HIGH and a column-mask word per event (bits 0 and ``spare`` of the mask are set for ON events)."""
    low = F.shiftleft((F.col("t") % 64).cast("long"), 54)
    cd = (F.shiftleft(F.col("p").cast("long"), 60).bitwiseOR(low).bitwiseOR(F.shiftleft(F.col("x").cast("long"), 43))
          .bitwiseOR(F.shiftleft(F.col("y").cast("long"), 32)).bitwiseOR(F.when(F.col("p") == 1, spare).otherwise(1).cast("long")))
    th = F.shiftleft(F.lit(8).cast("long"), 60).bitwiseOR(F.shiftleft(F.floor(F.col("t") / 64), 32))
    return e.select("*", F.posexplode(F.array(th, cd)).alias("k", "word"))


def by_thousands(e):
    """Files of some thousand events of a recording."""
    return e.withColumn("name", F.format_string("%s-%d.raw", "rec_id", F.floor(F.col("seq") / 4096)))


#: Ranges of the queries' files, so small that each file is read by several tasks.
SPLIT = 1 << 14
NAME = "rec_id || '-' || CAST(seq // 4096 AS VARCHAR) || '.raw'"
ROW = "(row_number() OVER (PARTITION BY rec_id, seq // 4096 ORDER BY seq) - 1)"


@query("rec_id seq:l x:i y:i p:i t:l", f"""SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t, seq) - 1 AS seq, x, y, p, t - t0 AS t
  FROM px_events JOIN {SPE} USING (rec_id)""")
def read_events(v):
    """From raw files of ten seconds each to numbered events."""
    e = v.px_events.withColumn("name", F.format_string("%s-%d.raw", "rec_id", F.floor(F.col("t") / 10_000_000)))
    got = src.read_recordings(v.spark, raw_files(v, words21(e), "evt21"), split_bytes=SPLIT)
    return src.number_events(got.withColumn("rec_id", F.regexp_extract("rec_id", "^(.*)-", 1)), "word_idx")


@query("rec_id path bytes:l fmt width:i height:i evt", f"""SELECT rec_id || '-' || CAST(t // 10000000 AS VARCHAR) || '.raw' AS rec_id, rec_id || '-' || CAST(t // 10000000 AS VARCHAR) || '.raw' AS path,
  {len(HEADER["evt21"]) + 6} + 16*count(*) AS bytes, 'evt21' AS fmt, 32 AS width, 32 AS height, '2.1' AS evt FROM px_events GROUP BY ALL""")
def read_headers(v):
    e = v.px_events.withColumn("name", F.format_string("%s-%d.raw", "rec_id", F.floor(F.col("t") / 10_000_000)))
    heads = raw.read_headers(v.spark, raw_files(v, words21(e), "evt21"))
    return heads.select("rec_id", F.element_at(F.split("path", "/"), -1).alias("path"), "bytes", "fmt", "width", "height", F.col("header")["evt"].alias("evt"))


@query("rec_id word_idx:l bit:i x:i y:i p:i t:l", f"""SELECT {NAME} AS rec_id, r*2+1 AS word_idx, b AS bit, x+b AS x, y, p, hi*64 + t%64 AS t
  FROM (SELECT *, unnest(CASE WHEN p=1 THEN [0,3] ELSE [0] END) AS b FROM (SELECT *, {ROW} AS r, max(t//64) OVER (PARTITION BY rec_id, seq//4096 ORDER BY seq) AS hi FROM px_events))""")
def ingest_event_words(v):
    folder = raw_files(v, words21(by_thousands(v.px_events), 9).drop("t"), "evt21")
    return src.ingest_event_words(raw.read_words(v.spark, folder, split_bytes=SPLIT), "evt21")


@query("rec_id word_idx:l x:i y:i p:i t:l", f"""SELECT {NAME} AS rec_id, {ROW}*2+1 AS word_idx, x, y, p, (max(t//64) OVER (PARTITION BY rec_id, seq//4096 ORDER BY seq))*64 + t%64 AS t FROM px_events""")
def ingest_evt2_words(v):
    cd = (F.shiftleft(F.col("p").cast("long"), 28).bitwiseOR(F.shiftleft((F.col("t") % 64).cast("long"), 22))
          .bitwiseOR(F.shiftleft(F.col("x").cast("long"), 11)).bitwiseOR(F.col("y").cast("long")))
    th = F.shiftleft(F.lit(8).cast("long"), 28).bitwiseOR(F.floor(F.col("t") / 64))
    w = by_thousands(v.px_events).select("name", "seq", F.posexplode(F.array(th, cd)).alias("k", "word"))
    return src.ingest_event_words(raw.read_words(v.spark, raw_files(v, w, "evt2"), split_bytes=SPLIT), "evt2")


@query("rec_id word_idx:l bit:i x:i y:i p:i t:l", f"""WITH f AS (SELECT {NAME} AS name, {ROW}*6 AS r, *, t - (first_value(t) OVER (PARTITION BY rec_id, seq//4096 ORDER BY seq)) // 16777216 * 16777216 AS u FROM px_events)
  SELECT name AS rec_id, r+3 AS word_idx, 0 AS bit, x, y, p, u AS t FROM f UNION ALL
  SELECT name, r+5, b, x+b, y, p, u FROM (SELECT *, unnest([1, 4]) AS b FROM f)""")
def ingest_evt3_words(v):
    """The high time word wraps every 16.8 s, so a file counts from the wrap before its first event."""
    hi, lo = F.floor(F.col("t") / 4096) % 4096, F.col("t") % 4096
    pol = F.shiftleft(F.col("p").cast("long"), 11)
    ws = [0x8000 + hi, 0x6000 + lo, F.col("y").cast("long"), 0x2000 + pol + F.col("x"), 0x3000 + pol + F.col("x"),
          F.lit(0x4000 + 0b10010)]
    w = by_thousands(v.px_events).select("name", "seq", F.posexplode(F.array(*[c.cast("long") for c in ws])).alias("k", "word"))
    return src.ingest_evt3_words(raw.read_words(v.spark, raw_files(v, w, "evt3"), split_bytes=SPLIT))


@query("rec_id seq:l t:l", """WITH z AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t, seq) AS r, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t, seq) AS g, count(*) OVER (PARTITION BY rec_id) AS n,
     max(t) OVER (PARTITION BY rec_id) - min(t) OVER (PARTITION BY rec_id) AS sp FROM (SELECT rec_id, seq, CASE WHEN t < 20000 THEN t ELSE t + 40000000 END AS t FROM px_events)),
  c AS (SELECT rec_id, r AS cut FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY g DESC, r) AS k FROM z WHERE r >= 2 AND r <= greatest(10, n//500)+1 AND n >= 200) WHERE k=1 AND g >= 3000000 AND g >= sp//2)
  SELECT z.* FROM z LEFT JOIN c USING (rec_id) WHERE cut IS NULL OR r >= cut""")
def strip_preroll(v):
    return src.strip_preroll(v.px_events.withColumn("t", F.when(F.col("t") < 20_000, F.col("t")).otherwise(F.col("t") + 40_000_000)))


@query("rec_id t:l azimuth:d5 rev:i flag hall:b", """SELECT rec_id, t, azimuth, rev, flag, flag='HALL_SYNC' AS hall FROM telemetry""")
def read_telemetry(v):
    s = F.col("t") / 1000 + 36_000_000
    sec = F.floor(s / 1000)
    stamp = F.format_string("20240101_%02d%02d%02d_%03d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, F.floor(s) % 1000)
    rows = v.telemetry.select("rec_id", stamp.alias("System_Time"), F.col("azimuth").cast("string").alias("Azimuth"),
                              F.col("rev").cast("string").alias("Revolution"), F.col("flag").alias("Flag"))
    return src.parse_telemetry(rows)


@query("kind rec_id i:l t:l azimuth:d5", f"""SELECT 'sample' AS kind, rec_id, i, CAST(round(i*0.05*1000000) AS BIGINT) AS t, (i*0.05::DOUBLE/1.3*360+15) - floor((i*0.05::DOUBLE/1.3*360+15)/360.0)*360.0 AS azimuth FROM
   (SELECT rec_id, unnest(range(0, CAST(ceil(((t1-t0)/1000000.0+0.05)/0.05-1e-9) AS BIGINT))) AS i FROM {SPE}) UNION ALL
  SELECT 'pulse', rec_id, k, CAST(round(k*1300000.0) AS BIGINT), NULL FROM (SELECT rec_id, unnest(range(0, CAST(floor((t1-t0)/1000000.0/1.3) AS BIGINT)+2)) AS k FROM {SPE})""")
def synth_telemetry(v):
    d = v.px_events.groupBy("rec_id").agg(((F.max("t") - F.min("t")) / 1e6).alias("duration_s"))
    s = src.synth_telemetry(d, 1.3, 15.0, 0.05).select(F.lit("sample").alias("kind"), "rec_id", "i", "t", "azimuth")
    p = src.synth_pulses(d, 1.3).select(F.lit("pulse").alias("kind"), "rec_id", F.col("k").alias("i"), "t", F.lit(None).cast("double").alias("azimuth"))
    return s.unionByName(p)


@query("rec_id i:l amp:d rate:i", """SELECT 'vec' || CAST(vec_id AS VARCHAR) || '.wav' AS rec_id, n AS i, CAST(trunc(v*1000) AS DOUBLE) AS amp, 8000 AS rate FROM series64""")
def read_audio(v):
    """Each vector becomes a small 16-bit stereo clip, which the decoder then reads."""
    def pack(batches):
        for b in batches:
            blobs = []
            for e in b["embedding"]:
                x = np.trunc(np.asarray(e, np.float64) * 1000).astype("<i2")
                f = io.BytesIO()
                with wave.open(f, "wb") as w:
                    w.setnchannels(2)
                    w.setsampwidth(2)
                    w.setframerate(8000)
                    w.writeframes(np.repeat(x, 2).tobytes())
                blobs.append(f.getvalue())
            yield pd.DataFrame({"path": "in/vec" + b["vec_id"].astype(str) + ".wav", "content": blobs})
    return src.decode_wav(v.table("embeddings").select("vec_id", "embedding").mapInPandas(pack, "path string, content binary"))


@query("rec_id seq:l slice:i", f"""SELECT e.rec_id, seq, slice FROM px_events e JOIN (SELECT rec_id, t0 AS a, t0+2000000 AS b, 0 AS slice FROM {SPE} UNION ALL
   SELECT rec_id, CAST(floor(t0+(t1-t0-2000000)/2.0) AS BIGINT), CAST(floor(t0+(t1-t0-2000000)/2.0) AS BIGINT)+2000000, 1 FROM {SPE} UNION ALL SELECT rec_id, t1-2000000, t1+1, 2 FROM {SPE}) w
   ON e.rec_id=w.rec_id AND t >= a AND t < b""")
def preview_slices(v):
    return src.preview_slices(v.px_events)


@query("rec_id a:l b:l n:l next_a:l", """SELECT *, lead(a) OVER (PARTITION BY rec_id ORDER BY a) AS next_a FROM (SELECT rec_id, isl, min(a) AS a, max(b) AS b, count(*) AS n FROM (SELECT *, sum(CASE WHEN pe IS NULL OR a > pe THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM
   (SELECT rec_id, t AS a, t+4000 AS b, max(t+4000) OVER (PARTITION BY rec_id ORDER BY t, t+4000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM px_events)) GROUP BY rec_id, isl)""")
def coverage_spans(v):
    iv = v.px_events.select("rec_id", F.col("t").alias("a"), (F.col("t") + 4000).alias("b"))
    return src.coverage_spans(iv, ["rec_id"])


@query("rec_id seq:l x:i y:i p:i t:l t_bucket:l", "SELECT *, t // 1000000 AS t_bucket FROM px_events")
def write_event_table(v):
    path = sinks.shared_folder(v.spark, "events")
    sinks.write_event_table(v.px_events, path)
    return src.read_events(v.spark, path)


@query("rec_id step:l cx:d area:l", "SELECT * FROM steps")
def write_result_table(v):
    path = sinks.shared_folder(v.spark, "result")
    sinks.write_result_table(v.steps, path)
    return v.spark.read.parquet(f"{path}/parquet")


FILE = "rec_id || '-' || CAST(t // 10000000 AS VARCHAR) || '.raw'"


def ingested(v):
    """Raw files of ten seconds, ingested; then the first file of each recording is replaced by its ON events and ingested again."""
    e = v.px_events.withColumn("name", F.format_string("%s-%d.raw", "rec_id", F.floor(F.col("t") / 10_000_000)))
    source, path = raw_files(v, words21(e), "evt21"), sinks.shared_folder(v.spark, "table")
    sinks.ingest_folder(v.spark, source, path, split_bytes=SPLIT)
    again = words21(e.where("t < 10000000 AND p = 1")).withColumn("fmt", F.lit("evt21"))
    raw.write_raw(again, source, ["t", "seq", "k"], F.lit(HEADER["evt21"] + "% note replaced\n"))
    sinks.ingest_folder(v.spark, source, path, split_bytes=SPLIT)
    return path


@query("rec_id n:l n_on:l first:l last:l buckets:l generation:i", f"""SELECT {FILE} AS rec_id, count(*) AS n, sum(p) AS n_on, 0 AS first, max(t) - min(t) AS last, max((t - t0)//1000000) + 1 AS buckets, any_value(g) AS generation FROM
  (SELECT *, CASE WHEN t < 10000000 THEN 2 ELSE 1 END AS g, min(t) OVER (PARTITION BY rec_id, t//10000000) AS t0 FROM px_events WHERE t >= 10000000 OR p = 1) GROUP BY ALL""")
def ingest_folder(v):
    ev = sinks.read_ingested(v.spark, ingested(v))
    return ev.groupBy("rec_id", "generation").agg(F.count("*").alias("n"), F.sum("p").alias("n_on"), F.min("t").alias("first"), F.max("t").alias("last"),
                                                  (F.max("t_bucket") + 1).alias("buckets"))


@query("rec_id events:l n_on:l width:i height:i duration_s:d config bytes:l fmt n_words:l", f"""SELECT {FILE} AS rec_id, count(*) AS events, sum(p) AS n_on, max(x)+1 AS width, max(y)+1 AS height, (max(t)-min(t))/1000000.0 AS duration_s,
  '{{"mode":"rotation","fov_deg":50.0,"az_sign":-1}}' AS config, any_value({len(HEADER["evt21"]) + 6} + CASE WHEN t < 10000000 THEN 16 ELSE 0 END) + 16*count(*) AS bytes, 'evt21' AS fmt, 2*count(*) AS n_words
  FROM px_events WHERE t >= 10000000 OR p = 1 GROUP BY ALL""")
def source_facts(v):
    path = ingested(v)
    return src.source_facts(sinks.read_ingested(v.spark, path), {"mode": "rotation", "fov_deg": 50.0, "az_sign": -1}, sinks.read_manifest(v.spark, path))
