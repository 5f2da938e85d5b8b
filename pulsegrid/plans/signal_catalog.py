"""Queries for ordered series, correlation, alignment and audio."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as ra, signal as sg
from .raster_catalog import SPAN
from .registry import query

SR = 8000
RATE = """SELECT g.rec_id, g.bin, g.nb, coalesce(n,0) AS n FROM (SELECT rec_id, nb, unnest(range(0, nb)) AS bin FROM
   (SELECT rec_id, CAST(greatest(ceil((t1-t0)/{b}.0),1) AS BIGINT) AS nb FROM {span})) g LEFT JOIN
  (SELECT rec_id, least((t-t0)//{b}, CAST(greatest(ceil((t1-t0)/{b}.0),1) AS BIGINT)-1) AS bin, count(*) AS n FROM {src} JOIN {span} USING (rec_id) GROUP BY ALL) c
  ON g.rec_id=c.rec_id AND g.bin=c.bin"""


def rate(src, b):
    return RATE.format(b=b, src=src, span=SPAN.format(src=src))


SG = {"rate50": rate("px_events", 50000), "rate5": rate("px_events", 5000)}


@query("rec_id bin:l n:l smooth:d norm:d5", """SELECT *, (n-m)/stddev_pop(n-m) OVER (PARTITION BY rec_id) AS norm FROM (SELECT *,
  sum(n) OVER (PARTITION BY rec_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)/6.0 AS smooth,
  sum(n) OVER (PARTITION BY rec_id ORDER BY bin ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)/41.0 AS m FROM rate50)""", views=SG)
def moving_average(v):
    r = ra.event_rate(v.px_events, 50_000).select("rec_id", "bin", "n")
    s = sg.moving_average(r, ["rec_id"], "bin", "n", 6)
    return sg.detrend_norm(s, ["rec_id"], "bin", "n", 41)


@query("rec_id bin:l highpass:d", """SELECT rec_id, bin, n - sum(n) OVER (PARTITION BY rec_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)/10.0 AS highpass
  FROM rate50""", views=SG)
def derotate_highpass(v):
    r = ra.event_rate(v.px_events, 50_000).select("rec_id", "bin", "n")
    return sg.derotate_highpass(r, ["rec_id"], "bin", "n", 20.0, 2.0)


@query("vec_id:l n:l ridge:d7", """SELECT vec_id, n, coalesce(median(CASE WHEN v > -0.1 THEN v END) OVER (PARTITION BY vec_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), v) AS ridge
  FROM series64""")
def rolling_median(v):
    s = v.series64.withColumn("w", F.col("v") + 0.1)
    return sg.rolling_median(s, ["vec_id"], "n", "v", "w")


@query("vec_id:l n:l v:d", """SELECT vec_id, n, v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM series64 WINDOW w AS (PARTITION BY vec_id ORDER BY n))
  WHERE v > 0 AND v >= a AND v >= b""")
def local_maxima(v):
    return sg.local_maxima(v.series64, ["vec_id"], "n", "v")


@query("rec_id t:l unwrapped:d5 step_deg:d5", """SELECT *, azimuth + sum(CASE WHEN abs(d) > 180 THEN -sign(d)*360.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY rec_id ORDER BY t) AS unwrapped,
  (d+180) - floor((d+180)/360.0)*360.0 - 180 AS step_deg FROM (SELECT *, azimuth - lag(azimuth) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM telemetry)""")
def angle_unwrap(v):
    return sg.angle_unwrap(v.telemetry, ["rec_id"], "t", "azimuth")


_REL = "1000.0/sqrt(dx*dx+dy*dy)"


@query("rec_id target_id:l t:l radial_velocity:d", f"""SELECT rec_id, target_id, t, CASE WHEN pr IS NULL THEN nr-r WHEN nr IS NULL THEN r-pr ELSE (nr-pr)/2 END /
  CASE WHEN pr IS NULL THEN nt-t_s WHEN nr IS NULL THEN t_s-pt ELSE (nt-pt)/2 END AS radial_velocity FROM
  (SELECT *, lag(r) OVER w AS pr, lead(r) OVER w AS nr, lag(t_s) OVER w AS pt, lead(t_s) OVER w AS nt FROM
    (SELECT *, {_REL} AS r, t/1000000.0 AS t_s FROM quads) WINDOW w AS (PARTITION BY rec_id, target_id ORDER BY t))""")
def radial_velocity(v):
    q = v.quads.withColumn("t_s", F.col("t") / 1e6).withColumn("rel_distance", 1000.0 / F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    return sg.radial_velocity(q, ["rec_id", "target_id"])


@query("rec_id step:l cx_ema:d cy_ema:d", """SELECT a.rec_id, a.step, sum(b.cx*(CASE WHEN b.rn=1 THEN 1 ELSE 0.5::DOUBLE END)*pow(0.5::DOUBLE, a.rn-b.rn)) AS cx_ema,
  sum(b.cy*(CASE WHEN b.rn=1 THEN 1 ELSE 0.5::DOUBLE END)*pow(0.5::DOUBLE, a.rn-b.rn)) AS cy_ema FROM s a JOIN s b ON a.rec_id=b.rec_id AND b.rn<=a.rn GROUP BY ALL""",
       views={"s": "SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY step) AS rn FROM steps"})
def ema_centroid(v):
    return sg.ema(v.steps, ["rec_id"], "step", ["cx", "cy"])


@query("rec_id lag:l acf:d", """SELECT a.rec_id, b.bin-a.bin AS lag, sum(a.v*b.v)/any_value(z) AS acf FROM acfc a JOIN acfc b ON a.rec_id=b.rec_id AND b.bin BETWEEN a.bin AND a.bin+60
  JOIN (SELECT rec_id, sum(v*v) AS z FROM acfc GROUP BY rec_id) q ON q.rec_id=a.rec_id GROUP BY ALL""",
       views={**SG, "acfc": "SELECT rec_id, bin, n - avg(n) OVER (PARTITION BY rec_id) AS v FROM rate50"})
def autocorrelation(v):
    r = ra.event_rate(v.px_events, 50_000).select("rec_id", "bin", "n")
    return sg.autocorrelation(r, ["rec_id"], "bin", "n", 60)


_SPIN = {
    **SG,
    "sp_r": "SELECT rec_id, bin, n, sum(n) OVER (PARTITION BY rec_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)/2.0::DOUBLE AS rate FROM rate5",
    "sp_d": "SELECT rec_id, count(*) AS nb, quantile_cont(rate, 0.9) AS thr FROM sp_r GROUP BY rec_id HAVING sum(n) >= 100",
    "sp_c": "SELECT rec_id, bin, rate - avg(rate) OVER (PARTITION BY rec_id) AS v FROM sp_r",
    "sp_a": """SELECT a.rec_id, b.bin - a.bin AS lag, sum(a.v*b.v)/any_value(z) AS acf FROM sp_c a JOIN sp_c b ON a.rec_id = b.rec_id AND b.bin BETWEEN a.bin + 40 AND a.bin + 1000
        JOIN (SELECT rec_id, sum(v*v) AS z FROM sp_c GROUP BY rec_id) q ON q.rec_id = a.rec_id GROUP BY ALL""",
    "sp_s": """SELECT rec_id, lag AS lag0, acf AS confidence, thr FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY acf DESC, lag) AS rn FROM sp_a JOIN sp_d USING (rec_id)
        WHERE lag*0.005 >= 0.2 - 1e-9 AND lag*0.005 <= least(5.0, nb*0.005/2) + 1e-9) WHERE rn = 1""",
    "sp_l0": """SELECT rec_id, 0 AS n_peaks, bin::DOUBLE AS a0, lag0::DOUBLE AS step FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY rate DESC, bin) AS rn FROM sp_r) JOIN sp_s USING (rec_id) WHERE rn = 1""",
}
for _k, _reach in enumerate((8, 64, 512, 1 << 40)):
    _SPIN[f"sp_p{_k}"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, cycle ORDER BY rate DESC, bin) AS rn FROM
        (SELECT r.rec_id, bin, rate, a0, step, round((bin - a0)/step) AS cycle FROM sp_r r JOIN sp_s USING (rec_id) JOIN sp_l{_k} USING (rec_id) WHERE rate >= thr)
        WHERE abs(cycle) <= {_reach} AND abs(bin - a0 - cycle*step) <= 0.4*step) WHERE rn = 1"""
    _SPIN[f"sp_l{_k + 1}"] = f"""SELECT rec_id, n_peaks, CASE WHEN n_peaks >= 3 AND slope IS NOT NULL THEN start ELSE a0 END AS a0, CASE WHEN n_peaks >= 3 AND slope IS NOT NULL THEN slope ELSE step END AS step FROM
        (SELECT rec_id, count(*) AS n_peaks, regr_slope(bin, cycle) AS slope, regr_intercept(bin, cycle) AS start, any_value(a0) AS a0, any_value(step) AS step FROM sp_p{_k} GROUP BY rec_id)"""


@query("rec_id seed_s:d confidence:d5 period_s:d5 n_peaks:l", """SELECT rec_id, lag0*0.005 AS seed_s, confidence, n_peaks,
  round(CASE WHEN n_peaks >= 3 AND step*0.005 BETWEEN 0.2 AND 5 THEN step*0.005 ELSE lag0*0.005 END, 5) AS period_s FROM sp_s JOIN sp_l4 USING (rec_id)""", views=_SPIN)
def estimate_spin_period(v):
    return sg.estimate_spin_period(v.px_events)


@query("rec_id offset_s:d score:d4", """SELECT rec_id, arg_max(step, round(score,9)*1000000 - step/1000.0)*0.05 - 0.4 AS offset_s, max(score) AS score FROM
  (SELECT g.rec_id, step, sum(a.v + (b.v-a.v)*(p-floor(p))) AS score, count(*) AS n FROM
    (SELECT rec_id, step, (t/1000000.0 + (step*0.05-0.4))/0.05 - 0.5 AS p FROM pulses, range(0,16) q(step)) g
    JOIN r a ON a.rec_id=g.rec_id AND a.bin=floor(p) JOIN r b ON b.rec_id=g.rec_id AND b.bin=floor(p)+1 WHERE p > 0 AND p < a.nb-1 GROUP BY ALL) WHERE n >= 2 GROUP BY rec_id""",
       views={"r": """SELECT rec_id, bin, nb, n - avg(n) OVER (PARTITION BY rec_id) AS v FROM (SELECT g.rec_id, g.bin, g.nb, coalesce(c,0) AS n FROM
           (SELECT rec_id, nb, unnest(range(0,nb)) AS bin FROM (SELECT rec_id, CAST(ceil(max(t)/50000.0) AS BIGINT) AS nb FROM px_events GROUP BY rec_id)) g
           LEFT JOIN (SELECT rec_id, least(t//50000, CAST(ceil(mt/50000.0) AS BIGINT)-1) AS bin, count(*) AS c FROM px_events JOIN (SELECT rec_id, max(t) AS mt FROM px_events GROUP BY rec_id) USING (rec_id) GROUP BY ALL) q
           ON g.rec_id=q.rec_id AND g.bin=q.bin)"""})
def refine_telemetry_offset(v):
    return sg.refine_telemetry_offset(v.px_events, v.pulses, 0.05, 0.4)


_NORM = "SELECT bin AS i, (n-avg(n) OVER ())/stddev_pop(n) OVER () AS v, count(*) OVER () AS m FROM rate50 WHERE rec_id='{r}'"


@query("key lag:l offset_s:d peak_corr:d", """WITH c AS (SELECT a.i-b.i AS lag, sum(a.v*b.v)/greatest(any_value(a.m), any_value(b.m)) AS c FROM sa a JOIN sb b ON abs(a.i-b.i) <= 40 GROUP BY 1),
  p AS (SELECT lag AS l0 FROM c ORDER BY round(c,9) DESC, lag LIMIT 1)
  SELECT 'cam0|cam1' AS key, l0 AS lag, (l0 + coalesce(0.5*(y0.c-y2.c)/nullif(y0.c-2*y1.c+y2.c,0),0))*0.05 AS offset_s, y1.c AS peak_corr
  FROM p JOIN c y1 ON y1.lag=l0 LEFT JOIN c y0 ON y0.lag=l0-1 LEFT JOIN c y2 ON y2.lag=l0+1""",
       views={**SG, "sa": _NORM.format(r="cam0"), "sb": _NORM.format(r="cam1")})
def cross_correlate(v):
    r = ra.event_rate(v.px_events, 50_000).select("rec_id", F.col("bin").alias("i"), "n")
    m = r.groupBy("rec_id").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    r = r.join(m, "rec_id").select("rec_id", F.lit("cam0|cam1").alias("key"), "i", ((F.col("n") - F.col("m")) / F.col("s")).alias("v"))
    return sg.cross_correlate(r.where("rec_id = 'cam0'").drop("rec_id"), r.where("rec_id = 'cam1'").drop("rec_id"), 0.05, 2.0, True)


def env(src, val, idx, k1, k2):
    return f"""SELECT rec_id, i, (s-m)/stddev_pop(s-m) OVER (PARTITION BY rec_id) AS v, count(*) OVER (PARTITION BY rec_id) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY rec_id ORDER BY i
      ROWS BETWEEN {k2 // 2} PRECEDING AND {(k2 - 1) // 2} FOLLOWING)/{k2}.0 AS m FROM (SELECT rec_id, {idx} AS i, sum({val}) OVER (PARTITION BY rec_id ORDER BY {idx}
      ROWS BETWEEN {k1 // 2} PRECEDING AND {(k1 - 1) // 2} FOLLOWING)/{k1}.0 AS s FROM {src}))"""


RMS = f"""SELECT rec_id, bin, (bin+0.5)*(80/{SR}.0) AS t_s, sqrt(e/80)/p AS rms FROM (SELECT rec_id, i//80 AS bin, sum(amp*amp) AS e, count(*) AS n
   FROM audio GROUP BY rec_id, i//80) JOIN (SELECT rec_id, max(abs(amp)) AS p FROM audio GROUP BY rec_id) USING (rec_id) WHERE n = 80"""
AL = {"rate10": rate("px_events", 10000), "rmsv": RMS, "ee": env("rate10", "n/0.01", "bin", 30, 200), "ea": env("rmsv", "rms", "bin", 30, 200)}


@query("rec_id audio_id offset_s:d peak_corr:d overlap_s:d", f"""WITH c AS (SELECT a.rec_id, b.rec_id AS audio_id, a.i-b.i AS lag, sum(a.v*b.v)/greatest(any_value(a.n), any_value(b.n)) AS c
   FROM ee a JOIN ea b ON right(a.rec_id,1)=right(b.rec_id,1) AND abs(a.i-b.i) <= 1200 GROUP BY ALL),
  r AS (SELECT *, lag*0.01 AS offset_s, c AS peak_corr, row_number() OVER (PARTITION BY rec_id ORDER BY round(c,9) DESC, lag) AS rn FROM c)
  SELECT r.*, greatest(least(e_s, offset_s+a_s) - greatest(0, offset_s), 0) AS overlap_s FROM r JOIN (SELECT rec_id, (max(t)-min(t))/1000000.0 AS e_s FROM px_events GROUP BY rec_id) USING (rec_id)
  JOIN (SELECT rec_id AS audio_id, count(*)/{SR}.0 AS a_s FROM audio GROUP BY rec_id) USING (audio_id) WHERE rn = 1""", views=AL)
def plan_alignment(v):
    pairs = v.px_events.select("rec_id").distinct().withColumn("audio_id", F.concat(F.lit("mic"), F.substring("rec_id", 4, 1)))
    return sg.plan_alignment(v.px_events, v.audio, SR, pairs)


@query("rec_id bin:l t_s:d rms:d", RMS)
def rms_envelope(v):
    return sg.rms_envelope(v.audio, SR, 0.01)


@query("rec_id i:l amp:d", "SELECT rec_id, i, amp/max(abs(amp)) OVER (PARTITION BY rec_id) AS amp FROM audio")
def audio_normalize(v):
    return sg.audio_normalize(v.audio)


@query("rec_id x:i p:i n:l path_px:d span_s:d dx_px:d dy_px:d freq_hz:d3 speed_px_s:d3 interval_mean_s:d7 jitter_s:d7", """SELECT rec_id, q.x, q.p, count(*) AS n, sum(sqrt(dx*dx+dy*dy)) AS path_px, (max(t)-min(t))/1000000.0 AS span_s,
   CASE WHEN count(*)=2 THEN sum(dx) END AS dx_px, CASE WHEN count(*)=2 THEN sum(dy) END AS dy_px,
   CASE WHEN count(*)=2 THEN 1/greatest((max(t)-min(t))/1000000.0, 1e-12) WHEN max(t)>min(t) THEN (count(*)-1)/((max(t)-min(t))/1000000.0) END AS freq_hz,
   CASE WHEN count(*)=2 THEN sum(sqrt(dx*dx+dy*dy))/greatest((max(t)-min(t))/1000000.0, 1e-12) END AS speed_px_s,
   CASE WHEN count(*)>2 THEN avg(dt)/1000000.0 END AS interval_mean_s, CASE WHEN count(*)>2 THEN stddev_pop(dt/1000000.0) END AS jitter_s FROM
  (SELECT rec_id, x, p, t, 0*x AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM px_events WINDOW w AS (PARTITION BY rec_id, x, p ORDER BY t, seq)) q
  GROUP BY rec_id, q.x, q.p HAVING count(*) >= 2""")
def measure_points(v):
    e = v.px_events.withColumns({"t_s": F.col("t") / 1e6, "g": F.col("x")})
    return sg.measure_points(e, ["rec_id", "g", "p"]).withColumnRenamed("g", "x")


@query("vec_id:l n:l white:d5 z:d5", """SELECT vec_id, n, p/(median(q) + 1e-20) AS white, any_value(zz) AS z FROM (SELECT a.vec_id, a.n, a.p, b.p AS q,
   greatest((a.p - avg(b.p) OVER w)/sqrt(greatest(avg(b.p*b.p) OVER w - (avg(b.p) OVER w)*(avg(b.p) OVER w), 1e-20)), 0) AS zz
   FROM s a, range(-2,3) o(d), s b WHERE b.vec_id=a.vec_id AND b.n = greatest(least(a.n+d, 63), 0) WINDOW w AS (PARTITION BY a.vec_id, a.n)) GROUP BY vec_id, n, p""",
       views={"s": "SELECT vec_id, n, v*v + 0.001 AS p FROM series64"})
def whiten_power(v):
    s = v.series64.withColumn("p", F.col("v") * F.col("v") + 0.001)
    m = sg.whiten_power(s, ["vec_id"], "n", "p", "median")
    z = sg.whiten_power(s, ["vec_id"], "n", "p", "zscore", out="z").drop("p")
    return m.join(z, ["vec_id", "n"])


@query("vec_id:l flatness:d", """SELECT vec_id, CASE WHEN count(*) FILTER (WHERE v>0) < 4 THEN 1 ELSE exp(avg(ln(v)) FILTER (WHERE v>0))/(avg(v) FILTER (WHERE v>0) + 1e-30) END AS flatness
  FROM (SELECT vec_id, CASE WHEN v > 0 THEN v END AS v FROM series64) GROUP BY vec_id""")
def spectral_flatness(v):
    return sg.spectral_flatness(v.series64, ["vec_id"], "v")
