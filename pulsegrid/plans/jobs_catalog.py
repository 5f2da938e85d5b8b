"""Queries for streaming operators, user functions and end-to-end jobs."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import user as us
from ..operators.ordered import union_all
from ..sources.sinks import shared_folder
from ..streaming import stream as st
from . import jobs
from .filters_catalog import BAF, REFR
from .movers_catalog import MV, _MET, boxsolve
from .raster_catalog import SPAN
from .registry import query
from .spectra_catalog import line_views
from .tracks_catalog import DETS, dets

SPE = SPAN.format(src="px_events")


def events_stream(v):
    """The events table itself as a file stream, shaped like the batch view."""
    e = v.table("events")
    us_ = F.unix_micros(F.col("ts").cast("timestamp"))
    s = st.read_event_stream(v.spark, v.folder, e.schema, name_filter="events.parquet")
    base = e.agg(F.min(us_)).first()[0]
    return st.with_event_time(s.select(
        F.concat(F.lit("cam"), F.expr("(user_id div 32) % 2").cast("string")).alias("rec_id"), F.col("event_id").alias("seq"),
        (F.col("user_id") % 32).cast("int").alias("x"), ((F.col("event_id") * 7 + F.col("user_id")) % 32).cast("int").alias("y"),
        F.when(F.col("value") >= 35, 1).otherwise(0).alias("p"), F.floor((us_ - base) / 86400).alias("t")))


def disordered_stream(v):
    """The same events as files that each reach over the whole time, one to a micro-batch."""
    folder = shared_folder(v.spark, "feed")
    v.px_events.repartition(3, "seq").write.parquet(folder)
    return st.with_event_time(st.read_event_stream(v.spark, folder, v.px_events.schema, files_per_trigger=1))


@query("rec_id bin:l n:l rate_hz:d", "SELECT rec_id, t//500000 AS bin, count(*) AS n, count(*)/0.5 AS rate_hz FROM px_events GROUP BY ALL")
def stream_event_rate(v):
    return st.run_to_end(disordered_stream(v), lambda s: st.event_rate(s, 500_000), "rate")


@query("rec_id t0:l x:i y:i count:l on_count:l polarity:l", """SELECT rec_id, s*500000 AS t0, x, y, count(*) AS count, sum(p) AS on_count, 2*sum(p)-count(*) AS polarity FROM (SELECT *, unnest([t//500000, t//500000-1]) AS s FROM px_events) GROUP BY ALL""")
def stream_frames(v):
    return st.run_to_end(disordered_stream(v), lambda s: st.frames(s, 1_000_000, 500_000), "frames")


@query("rec_id t1:l cx:l cy:l n:l value:d", """SELECT rec_id, s*1000000+3000000 AS t1, x//8 AS cx, y//8 AS cy, count(*) AS n, ln(1+count(*)) AS value FROM (SELECT *, unnest([t//1000000, t//1000000-1, t//1000000-2]) AS s FROM px_events) GROUP BY ALL""")
def stream_trailing_map(v):
    return st.run_to_end(disordered_stream(v), lambda s: st.trailing_map(s, 3_000_000, 1_000_000, 8), "trailing")


@query("rec_id t0:l t1:l n:l cx:d cy:d", """SELECT rec_id, min(t) AS t0, max(t)+20000 AS t1, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM (SELECT *, sum(CASE WHEN pt IS NULL OR t-pt >= 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY t, seq) AS s FROM
   (SELECT *, lag(t) OVER (PARTITION BY rec_id ORDER BY t, seq) AS pt FROM px_events)) GROUP BY rec_id, s""")
def stream_sessions(v):
    return st.run_to_end(disordered_stream(v), lambda s: st.sessions(s, 20_000), "sessions")


_SW = line_views("sw", None, "rec_id, w0, cx, cy", 40, 2, 18, """SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY rec_id, w0, cx, cy) AS n_events FROM
  (SELECT rec_id, w0, x//16 AS cx, y//16 AS cy, CAST(160 AS BIGINT) AS nb, (t - w0*2000000)//25000 AS b, count(*) AS c FROM
   (SELECT *, unnest([t//2000000, t//2000000-1]) AS w0 FROM px_events) GROUP BY ALL)) WHERE n_events >= 60""")


@query("rec_id t0:l cx:l cy:l n_events:l peak_freq:d snr:d3", """SELECT rec_id, w0*2000000 AS t0, cx, cy, n_events, peak_freq, snr FROM sw_line JOIN (SELECT DISTINCT rec_id, w0, cx, cy, n_events FROM sw_bins) USING (rec_id, w0, cx, cy)""", views=_SW)
def stream_spectra(v):
    return st.run_to_end(disordered_stream(v), lambda s: st.spectra(s, 4_000_000, 2_000_000, 40.0, 2.0, 18.0, 16, 60), "spectra")


_EV = "rec_id seq:l x:i y:i p:i t:l"


@query(_EV, f"SELECT e.* FROM px_events e SEMI JOIN ({REFR.format(src='px_events', p=500000)}) k USING (rec_id, seq)")
def stream_refractory(v):
    return st.run_available(st.refractory(events_stream(v).drop("ts"), 500_000), "refractory")


@query(_EV, BAF.format(src="px_events", dt=20000))
def stream_baf(v):
    return st.run_available(st.baf(events_stream(v).drop("ts"), 20_000), "baf")


@query("rec_id target_id:l step:l cx:d cy:d")
def stream_tracker(v):
    folder = shared_folder(v.spark, "dets")
    d = v.quads.select("rec_id", "step", "t", "cx", "cy", *[(F.col(c) + s * F.col(w) / 2).alias(n) for n, c, s, w in (
        ("x0", "cx", -1, "dx"), ("y0", "cy", -1, "dy"), ("x1", "cx", 1, "dx"), ("y1", "cy", 1, "dy"))])
    d.write.parquet(folder)
    return st.run_available(st.tracker(st.read_event_stream(v.spark, folder, d.schema), gate=6.0, max_missed=2), "tracker")


def running_total(pdf, mem):
    """User state example: events and mean column seen so far, per batch."""
    mem["n"] = mem.get("n", 0) + len(pdf)
    mem["sx"] = mem.get("sx", 0) + int(pdf["x"].sum())
    return pd.DataFrame({"rec_id": [pdf["rec_id"].iloc[0]], "n": [mem["n"]], "mean_x": [mem["sx"] / mem["n"]]})


@query("rec_id n:l mean_x:d", "SELECT rec_id, count(*) AS n, avg(x) AS mean_x FROM px_events GROUP BY rec_id")
def stream_user_state(v):
    return st.run_available(st.user_state(events_stream(v).drop("ts"), running_total, "rec_id string, n long, mean_x double", ["rec_id"]), "user")


@query("rec_id n_late:l oldest:l", """SELECT rec_id, count(*) AS n_late, min(t) AS oldest FROM px_events JOIN (SELECT rec_id, max(t) AS m FROM px_events WHERE (t//1000000)%2=0 GROUP BY rec_id) USING (rec_id)
  WHERE (t//1000000)%2=1 AND t < m - 3000000 GROUP BY rec_id""")
def stream_late_data(v):
    base = shared_folder(v.spark, "late")
    e = v.px_events
    for parity in (0, 1):                       # odd seconds arrive after the even ones
        e.where(F.floor(F.col("t") / 1_000_000) % 2 == parity).write.mode("append").parquet(f"{base}/in")
        st.late_rows(st.read_event_stream(v.spark, f"{base}/in", e.schema), f"{base}/out", 3_000_000)
    return v.spark.read.schema("rec_id string, n_late long, oldest long, epoch int").parquet(f"{base}/out/late")


# ------------------------------------------------------------------ user functions
def centroid(pdf, ctx):
    return pd.DataFrame({"rec_id": [ctx["rec_id"]], "window": [ctx["window"]], "n": [len(pdf)], "cx": [pdf["x"].mean()], "t0": [ctx["t0"]]})


@query("rec_id window:l n:l cx:d t0:d", "SELECT rec_id, t//1000000 AS \"window\", count(*) AS n, avg(x) AS cx, t//1000000*1.0 AS t0 FROM px_events GROUP BY ALL")
def user_script(v):
    return us.user_script(v.px_events, centroid, "rec_id string, window long, n long, cx double, t0 double", 1_000_000)


def blob_with_score(pdf):
    return {"cx": pdf["x"].mean(), "cy": pdf["y"].mean(), "w": 8.0, "conf": len(pdf) / 1000.0}, {"n": len(pdf), "on": int(pdf["p"].sum())}


@query("kind rec_id window:l name value:d", """WITH w AS (SELECT rec_id, t//1000000 AS w, count(*) AS n, sum(p) AS o, avg(x) AS cx, avg(y) AS cy FROM px_events GROUP BY ALL)
  SELECT 'metric' AS kind, rec_id, w AS "window", 'n' AS name, CAST(n AS DOUBLE) AS value FROM w UNION ALL SELECT 'metric', rec_id, w, 'on', o FROM w UNION ALL SELECT 'det', rec_id, w, 'x0', cx-4 FROM w UNION ALL SELECT 'det', rec_id, w, 'score', n/1000.0 FROM w""")
def user_metrics(v):
    m = us.user_metrics(v.px_events, blob_with_score, 1_000_000).select(F.lit("metric").alias("kind"), "rec_id", "window", "name", "value")
    d = us.user_detections(v.px_events, blob_with_score, 1_000_000)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("x0", "score")])).alias("s")
    return m.unionByName(d.select(F.lit("det").alias("kind"), "rec_id", "window", rows).select("kind", "rec_id", "window", "s.*"))


# ------------------------------------------------------------------ jobs
def stacked(tables: dict, ids: dict[str, list[str]]):
    """All tables of a job under each other: part, rec_id, id (the other keys), name and value of every figure."""
    out = []
    for part, df in tables.items():
        keys = ids[part]
        figures = [c for c, kind in df.dtypes if c not in keys and c != "rec_id" and kind in ("int", "bigint", "double", "float", "boolean")]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in figures]))
        name = F.concat_ws("/", *[F.col(c).cast("string") for c in keys]) if keys else F.lit("")
        out.append(df.select(F.lit(part).alias("part"), "rec_id", name.alias("id"), cells.alias("c")).select("part", "rec_id", "id", "c.*"))
    return union_all(*out)


STACK = "part rec_id id name value:d4"


@query(STACK, f"""WITH s AS (SELECT rec_id, n, n/((t1-t0)/1000000.0) AS mean_rate FROM {SPE} JOIN (SELECT rec_id, count(*) AS n FROM px_events GROUP BY rec_id) USING (rec_id)),
  b AS (SELECT rec_id, (t-t0)//100000 AS bin, count(*) AS c FROM px_events JOIN {SPE} USING (rec_id) GROUP BY ALL),
  r AS (SELECT g.rec_id, g.bin, coalesce(c, 0) AS n FROM (SELECT rec_id, unnest(range(0, CAST(ceil((t1-t0)/100000.0) AS BIGINT))) AS bin FROM {SPE}) g LEFT JOIN
        (SELECT rec_id, least(bin, CAST(ceil((t1-t0)/100000.0) AS BIGINT) - 1) AS bin, sum(c) AS c FROM b JOIN {SPE} USING (rec_id) GROUP BY ALL) b USING (rec_id, bin)),
  d AS (SELECT rec_id, arg_max(bin, n*100000-bin) AS bin FROM r GROUP BY rec_id),
  f AS (SELECT e.rec_id, x, y, count(*) AS c FROM px_events e JOIN {SPE} USING (rec_id) JOIN d USING (rec_id) WHERE (t-t0)//100000 = bin GROUP BY ALL)
  SELECT 'summary' AS part, rec_id, '' AS id, unnest(['n', 'mean_rate']) AS name, unnest([n::DOUBLE, mean_rate::DOUBLE]) AS value FROM s
  UNION ALL SELECT 'rate', rec_id, CAST(bin AS VARCHAR), 'n', n FROM r UNION ALL SELECT 'densest_frame', rec_id, CAST(x AS VARCHAR) || '/' || CAST(y AS VARCHAR), 'count', c FROM f""")
def job_overview(v):
    o = jobs.overview(v.px_events, v.pulses, 100_000)
    return stacked({"summary": o["summary"].select("rec_id", "n", "mean_rate"), "rate": o["rate"].select("rec_id", "bin", "n"), "densest_frame": o["densest_frame"]},
                   {"summary": [], "rate": ["bin"], "densest_frame": ["x", "y"]})


@query(STACK)
def job_detect(v):
    o = jobs.detect(v.px_tone, 32, 32, 50.0, min_pixels=4, erode=0, suppress=False, fft_min_events=40)
    return stacked(o, {"detections": ["target_id", "step"], "targets": ["target_id"]})


@query(STACK)
def job_track_study(v):
    o = jobs.track_study(v.px_tone, 32, 32, 50.0, 0.04, min_pixels=4, erode=0)
    return stacked(o, {"range": ["step"], "lock": ["step"], "lost": []})


@query("tracker rec_id target_id:l step:l azimuth_deg:d3 rel_distance:d")
def job_tracking(v):
    return jobs.tracking(v.px_events, v.pulses, v.telemetry, 50.0, 32, 32, {"nearest": {"gate_deg": 30.0}, "single": {}},
                         dt_us=250_000, min_pixels=3, dilate=1, erode=1, n_rotations=3, n_phase=36, hot_pct=99.9, target_m=0.2)


@query("target_id:l kept:l total:l residual_deg:d", """SELECT b.target_id, count(*) FILTER (WHERE abs(d) < 2.0) AS kept, count(*) AS total, median(d) FILTER (WHERE abs(d) < 2.0) AS residual_deg FROM
  (SELECT b.target_id, (b.azimuth_deg - 0.5 - a.azimuth_deg + 180) - floor((b.azimuth_deg - 0.5 - a.azimuth_deg + 180)/360.0)*360.0 - 180 AS d FROM (SELECT * FROM dets WHERE rec_id='cam1') b JOIN (SELECT * FROM dets WHERE rec_id='cam0') a USING (target_id, t)) b GROUP BY b.target_id""", views=DETS)
def job_dual_fusion(v):
    d = dets(v)
    return jobs.dual_fusion(d.where("rec_id = 'cam0'"), d.where("rec_id = 'cam1'"), ["target_id"], 2.0, 0.5)


@query(STACK)
def job_av_fusion(v):
    pairs = v.px_events.select("rec_id").distinct().withColumn("audio_id", F.concat(F.lit("mic"), F.substring("rec_id", 4, 1)))
    o = jobs.av_fusion(v.px_events, v.steps, v.audio, 8000, pairs)
    return stacked(o, {"alignment": [], "timeline": ["step"], "convergence": [], "fused": [], "coherence": []})


@query("part rec_id key:l value:d3", f"""SELECT 'masking' AS part, rec_id, level AS key, reduction_pct AS value FROM ({_MET}) UNION ALL SELECT 'columns', rec_id, n_passes, bearing_deg FROM ({boxsolve('rec_id', 30)})""",
       views={**MV, "wrev": "SELECT w.*, p.rev, w.pan + (w.x-16.0)*(50.0/32) - floor((w.pan + (w.x-16.0)*(50.0/32))/360.0)*360.0 AS az FROM (SELECT * EXCLUDE (az) FROM world) w JOIN with_phase p USING (rec_id, seq)"})
def job_box_experiment(v):
    o = jobs.box_experiment(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, (120.0, 240.0), (4.0, 28.0), n_list=(0, 2, 4, 8, 16), min_pass=30, min_spectrum=20, fs=200.0, fft=(20.0, 80.0))
    m = o["masking"].select(F.lit("masking").alias("part"), "rec_id", F.col("level").cast("long").alias("key"), F.col("reduction_pct").alias("value"))
    c = o["columns"].where("columns = 'all'").select(F.lit("columns").alias("part"), "rec_id", F.col("n_passes").alias("key"), F.col("bearing_deg").alias("value"))
    return m.unionByName(c)


@query(STACK)
def job_box_tables(v):
    """All tables of the box experiment: masking, track, spectra and the three column choices."""
    o = jobs.box_experiment(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, (120.0, 240.0), (4.0, 28.0), n_list=(0, 2, 4, 8, 16), min_pass=30, min_spectrum=20, fs=200.0, fft=(20.0, 80.0))
    return stacked(o, {"masking": ["level"], "track": ["rev"], "spectra": ["rev"], "columns": ["columns"]})
