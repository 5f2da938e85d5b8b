"""Queries for rasters, histograms, cubes and tone mapping."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.angles import elevation
from ..operators import raster as ra, rotation as rot
from .filters_catalog import BASE
from .registry import query

SPAN = """(SELECT rec_id, min(t) AS t0, max(t) AS t1 FROM {src} GROUP BY rec_id)"""
SPE = SPAN.format(src="px_events")


@query("rec_id n:l n_on:l n_off:l duration_s:d width:i height:i mean_rate:d4 period_s:d revolutions:l mode",
       """SELECT *, n - n_on AS n_off, n/duration_s AS mean_rate, 'rotation' AS mode FROM
  (SELECT rec_id, count(*) AS n, sum(p) AS n_on, (max(t)-min(t))/1000000.0 AS duration_s,
    max(x)+1 AS width, max(y)+1 AS height FROM px_events GROUP BY rec_id)
  JOIN (SELECT rec_id, median(d)/1000000.0 AS period_s, max(k) AS revolutions FROM
    (SELECT rec_id, k, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM pulses) GROUP BY rec_id)
  USING (rec_id)""")
def recording_summary(v):
    return ra.recording_summary(v.px_events, v.pulses)


@query("rec_id bin:l t_s:d n:l rate_hz:d", f"""SELECT b.rec_id, b.bin, (b.bin+0.5)*0.05 AS t_s, coalesce(n,0) AS n,
  coalesce(n,0)/0.05 AS rate_hz FROM
  (SELECT rec_id, unnest(range(0, CAST(greatest(ceil((t1-t0)/50000.0),1) AS BIGINT))) AS bin FROM {SPE}) b
  LEFT JOIN (SELECT rec_id, least((t-t0)//50000, CAST(ceil((t1-t0)/50000.0) AS BIGINT)-1) AS bin, count(*) AS n
    FROM px_events JOIN {SPE} USING (rec_id) GROUP BY ALL) USING (rec_id, bin)""")
def event_rate(v):
    return ra.event_rate(v.px_events, 50_000)


FR = """SELECT rec_id, t // {f} AS frame, x, y, count(*) AS count, sum(p) AS on_count,
  count(*)-sum(p) AS off_count, 1 AS "binary", 2*sum(p)-count(*) AS polarity,
  (2*sum(p)-count(*))/CAST(count(*) AS DOUBLE) AS polarity_ratio FROM {src} GROUP BY ALL"""


@query("rec_id frame:l x:i y:i count:l on_count:l off_count:l binary:i polarity:l polarity_ratio:d count_norm:d polarity_norm:d",
       f"""SELECT *, count/CAST(max(count) OVER w AS DOUBLE) AS count_norm,
  CASE WHEN max(abs(polarity)) OVER w > 0 THEN polarity/CAST(max(abs(polarity)) OVER w AS DOUBLE) ELSE 0 END AS polarity_norm
  FROM ({FR.format(f=500000, src='px_lineitem')}) WINDOW w AS (PARTITION BY rec_id, frame)""")
def accumulate_frames(v):
    return ra.accumulate_frames(v.px_lineitem, 500_000, normalize=True)


@query("rec_id x:i y:i t_last:l value:d", f"""SELECT rec_id, x, y, max(t) AS t_last,
  exp((max(t) - any_value(t1))/1000000.0/2.0) AS value FROM px_events JOIN {SPE} USING (rec_id) GROUP BY rec_id, x, y""")
def time_surface(v):
    return ra.time_surface(v.px_events, 2.0)


@query("rec_id frame:l x:i y:i count:l vmax_used:d disp:d", f"""SELECT *, sqrt(least(count/vmax_used, 1.0)) AS disp FROM
  (SELECT rec_id, frame, x, y, count, greatest(quantile_cont(count, 0.995) OVER (PARTITION BY rec_id, frame), 1e-9) AS vmax_used
   FROM ({FR.format(f=1000000, src='px_lineitem')}))""")
def render_frame_table(v):
    return ra.render_frames(v.px_lineitem, 1_000_000)


@query("rec_id frame:l white:d", f"""SELECT rec_id, frame, greatest(quantile_cont(count, 0.95), 1e-9) AS white
  FROM ({FR.format(f=1000000, src='px_lineitem')}) GROUP BY rec_id, frame""")
def reference_white(v):
    return ra.reference_white(ra.accumulate_frames(v.px_lineitem, 1_000_000), ["rec_id", "frame"], "count", 95.0)


_CURVES = {"linear": "v", "sqrt": "sqrt(v)", "gamma": "pow(v, 0.7)", "log": "ln(1+99*v)/ln(100)",
           "asinh": "asinh(10*v)/asinh(10)"}


@query("rec_id x:i y:i curve disp:d", "SELECT rec_id, x, y, curve, disp FROM (" + " UNION ALL ".join(
    f"SELECT rec_id, x, y, '{c}' AS curve, {e} AS disp FROM tv" for c, e in _CURVES.items())
    + " UNION ALL SELECT rec_id, x, y, 'signed' AS curve, sign(pol)*sqrt(least(abs(pol)/w2, 1.0)) FROM tv)",
    views={"tv": """SELECT rec_id, x, y, pol, least(c/greatest(quantile_cont(c, 0.995) OVER w, 1e-9), 1.0) AS v,
      greatest(quantile_cont(abs(pol), 0.9) FILTER (WHERE pol <> 0) OVER w, 1e-9) AS w2
      FROM (SELECT rec_id, x, y, count(*) AS c, 2*sum(p)-count(*) AS pol FROM px_events GROUP BY rec_id, x, y)
      WINDOW w AS (PARTITION BY rec_id)"""})
def tone_map(v):
    img = (v.px_events.groupBy("rec_id", "x", "y").agg(F.count("*").alias("c"), F.sum("p").alias("on"))
           .withColumn("pol", 2 * F.col("on") - F.col("c")))
    outs = [ra.tone_map(img, ["rec_id"], "c", e, 0.7).withColumn("curve", F.lit(e)) for e in _CURVES]
    outs.append(ra.tone_map(img, ["rec_id"], "pol", "sqrt", clip_pct=90.0, signed=True)
                .withColumn("curve", F.lit("signed")))
    from ..operators.ordered import union_all
    return union_all(*[o.select("rec_id", "x", "y", "curve", "disp") for o in outs])


@query("rec_id x:i y:i v:d disp:d", """SELECT rec_id, x, y, v, CASE WHEN v*256-0.5 < 0 THEN 0 WHEN v*256-0.5 > 255 THEN 1
    ELSE c0.cdf + (coalesce(c1.cdf, c0.cdf) - c0.cdf)*(v*256-0.5 - floor(v*256-0.5)) END AS disp
  FROM img LEFT JOIN cdf c0 ON img.rec_id=c0.r AND c0.b = floor(v*256-0.5)
  LEFT JOIN cdf c1 ON img.rec_id=c1.r AND c1.b = floor(v*256-0.5)+1""",
       views={"img": """SELECT rec_id, x, y, count(*)/CAST(max(count(*)) OVER (PARTITION BY rec_id) AS DOUBLE) AS v
          FROM px_lineitem GROUP BY rec_id, x, y""",
              "cdf": """SELECT r, b, sum(c) OVER (PARTITION BY r ORDER BY b)/CAST(sum(c) OVER (PARTITION BY r) AS DOUBLE) AS cdf FROM
          (SELECT r, b, count(img.v) AS c FROM (SELECT DISTINCT rec_id AS r FROM img), range(0,256) q(b)
           LEFT JOIN img ON img.rec_id=r AND least(floor(v*256), 255) = b GROUP BY r, b)"""})
def tone_equalize(v):
    c = v.px_lineitem.groupBy("rec_id", "x", "y").agg(F.count("*").alias("c"))
    top = c.groupBy("rec_id").agg(F.max("c").alias("m"))
    img = c.join(top, "rec_id").select("rec_id", "x", "y", (F.col("c") / F.col("m")).alias("v"))
    return ra.tone_equalize(img, ["rec_id"], "v")


@query("rec_id cy:l cx:l slice:l value:l", f"""SELECT rec_id, y//4 AS cy, x//4 AS cx,
  least(CAST(floor((t-t0)/CAST(t1-t0 AS DOUBLE)*16) AS BIGINT), 15) AS slice, sum(CASE WHEN p=1 THEN 1 ELSE -1 END) AS value
  FROM px_lineitem JOIN {SPAN.format(src='px_lineitem')} USING (rec_id) GROUP BY ALL""")
def event_cube(v):
    return ra.event_cube(v.px_lineitem, 16, 4, "polarity")


@query("rec_id frame:l cx:l cy:l rate_hz:d disp:d", """SELECT *, sqrt(least(rate_hz/greatest(quantile_cont(rate_hz, 0.995)
  OVER (PARTITION BY rec_id, frame), 1e-9), 1.0)) AS disp FROM
  (SELECT rec_id, t//500000 AS frame, x//8 AS cx, y//8 AS cy, count(*)/0.5 AS rate_hz FROM px_lineitem GROUP BY ALL)""")
def rate_tower(v):
    return ra.rate_tower(v.px_lineitem, 500_000, 8)


@query("rec_id step:l gx:l gy:l rate_hz:d zmax:d", """WITH f AS (SELECT s.rec_id, s.step, x//8 AS gx, y//8 AS gy,
    any_value(s.n) AS n, count(*)/0.3 AS rate_hz
   FROM (SELECT rec_id, n, unnest(range(0, n)) AS step FROM (SELECT rec_id, CAST(ceil(max(t)/100000.0) AS BIGINT) AS n
      FROM px_lineitem GROUP BY rec_id)) s JOIN px_lineitem e ON e.rec_id = s.rec_id
      AND e.t < s.step*100000 + 50000 AND e.t >= s.step*100000 + 50000 - 300000 GROUP BY ALL)
  SELECT f.rec_id, step, gx, gy, rate_hz, zmax FROM f JOIN (SELECT rec_id, greatest(quantile_cont(m, 0.92), 1) AS zmax FROM
    (SELECT rec_id, step, max(rate_hz) AS m FROM f GROUP BY ALL) GROUP BY rec_id)
  USING (rec_id)""")
def rate_surface(v):
    return ra.rate_surface(v.px_lineitem, 64, 64, 8)


@query("rec_id bin:i n:l norm:d", f"""SELECT *, n/CAST(max(n) OVER (PARTITION BY rec_id) AS DOUBLE) AS norm FROM
  (SELECT rec_id, least(CAST(floor(t/CAST(t1 AS DOUBLE)*512) AS INT), 511) AS bin, count(*) AS n FROM px_events
   JOIN {SPE} USING (rec_id) GROUP BY ALL)""")
def density_strip(v):
    return ra.density_strip(v.px_events)


_EL = "(16.0-{y})*(50.0/32)"


@query("rec_id az_bin:i el_bin:i n:l value:d", f"""SELECT *, ln(1+n) AS value FROM (SELECT rec_id, least(floor(az/360.0*90),89) AS az_bin,
   least(floor(({_EL.format(y='y')}-lo)/(hi-lo)*24),23) AS el_bin, count(*) AS n FROM world JOIN
   (SELECT rec_id, quantile_cont({_EL.format(y='y')}, 0.005) AS lo, quantile_cont({_EL.format(y='y')}, 0.995) AS hi
    FROM px_events GROUP BY rec_id) USING (rec_id)
   WHERE {_EL.format(y='y')} BETWEEN lo AND hi GROUP BY ALL)""", views=BASE)
def panorama(v):
    return ra.panorama(v.px_events, v.telemetry, 50.0, 32, 32, 90, 24)


PERIOD = """(SELECT rec_id, 360.0*(max(t)-min(t))/1000000.0/abs(arg_max(u,t)-arg_min(u,t)) AS period FROM az_u GROUP BY rec_id)"""


@query("rec_id y:i az_bin:i n:l value:d", f"""SELECT *, ln(1+n) AS value FROM (SELECT rec_id, y,
  least(floor(az/360.0*180),179) AS az_bin, count(*) AS n FROM world JOIN {PERIOD} USING (rec_id) JOIN {SPE} USING (rec_id)
  WHERE t >= (t1/1000000.0 - 5*period)*1000000 GROUP BY ALL)""", views=BASE)
def phase_locked_panorama(v):
    return ra.phase_locked_panorama(v.px_events, v.telemetry, 50.0, 32, 5, 180)


@query("rec_id row:l col:l n:l value:d", f"""SELECT *, ln(1+n) AS value FROM (SELECT rec_id,
  49 - greatest(least(floor((t/1000000.0 - (t1/1000000.0 - 20.0))/20.0*50), 49), 0) AS row,
  least(floor(az/360.0*72), 71) AS col, count(*) AS n FROM world JOIN {SPE} USING (rec_id)
  WHERE t >= (t1/1000000.0 - 20.0)*1000000 GROUP BY ALL)""", views=BASE)
def azimuth_time_waterfall(v):
    return ra.azimuth_time_waterfall(v.px_events, v.telemetry, 50.0, 32, 20.0, 50, 72)


@query("rec_id y:i col:l n:l value:d", f"""SELECT *, ln(1+n) AS value FROM (SELECT rec_id, y,
  greatest(least(floor((t/1000000.0 - (t1/1000000.0 - 20.0))/20.0*40), 39), 0) AS col, count(*) AS n
  FROM px_events JOIN {SPE} USING (rec_id) WHERE t >= (t1/1000000.0 - 20.0)*1000000 GROUP BY ALL)""")
def elevation_time_sweep(v):
    return ra.elevation_time_sweep(v.px_events, 20.0, 40)


@query("rec_id px:i py:i n:l", """SELECT rec_id, px, py, count(*) AS n FROM (SELECT rec_id,
  CAST(trunc(15.5 + (0.2+0.8*(y/32.0))*32*0.46*cos(radians(az))) AS INT) AS px,
  CAST(trunc(15.5 + (0.2+0.8*(y/32.0))*32*0.46*sin(radians(az))) AS INT) AS py FROM world)
  WHERE px BETWEEN 0 AND 31 AND py BETWEEN 0 AND 31 GROUP BY ALL""", views=BASE)
def polar_raster(v):
    return ra.polar_raster(v.px_events, v.telemetry, 50.0, 32, 32)


@query("rec_id pu:i pv:i n:l", f"""WITH p AS (SELECT rec_id, x*cos(radians(30)) - tn*sin(radians(30)) AS u,
   y*cos(radians(20)) + (x*sin(radians(30)) + tn*cos(radians(30)))*sin(radians(20)) AS v FROM
   (SELECT *, (t-t0)/CAST(t1-t0 AS DOUBLE)*32.0 AS tn FROM px_events JOIN {SPE} USING (rec_id))),
  b AS (SELECT rec_id, min(u) AS u0, min(v) AS v0, max(u)-min(u) AS um, max(v)-min(v) AS vm FROM p GROUP BY rec_id),
  c AS (SELECT *, least(32/greatest(um,1), 32/greatest(vm,1))*0.92 AS sc FROM b)
  SELECT rec_id, CAST(trunc((u-u0)*sc+(32-um*sc)/2) AS INT) AS pu, CAST(trunc((v-v0)*sc+(32-vm*sc)/2) AS INT) AS pv, count(*) AS n
  FROM p JOIN c USING (rec_id) GROUP BY ALL""")
def space_time_projection(v):
    return ra.space_time_projection(v.px_events, 32, 32)


_GX = """SELECT rec_id, {o}, d AS {a}, sum(div*exp(-0.5*(d-s)*(d-s)))/any_value(nrm) AS div FROM
  (SELECT rec_id, {o}, div, unnest([{a}, -1-{a}, 63-{a}]) AS s FROM {src}), range(0, 32) q(d),
  (SELECT sum(exp(-0.5*k*k)) AS nrm FROM range(-4, 5) z(k)) WHERE abs(d-s) <= 4 GROUP BY rec_id, {o}, d"""


@query("rec_id x:i y:i div:d", "SELECT * FROM g2", views={
    "g0": "SELECT rec_id, x, y, sum(CASE WHEN p=1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS div FROM px_events GROUP BY rec_id, x, y",
    "g1": _GX.format(o="y", a="x", src="g0"), "g2": _GX.format(o="x", a="y", src="g1")})
def polarity_divergence(v):
    return ra.polarity_divergence(v.px_events, 32, 32, 1.0)


@query("rec_id x:i y:i n_iat:l iat_s:d9 value:d", """SELECT *, 1 - greatest(least((iat_s-lo)/greatest(hi-lo,1e-9),1),0) AS value FROM
  (SELECT *, quantile_cont(iat_s, 0.05) OVER (PARTITION BY rec_id) AS lo, quantile_cont(iat_s, 0.95) OVER (PARTITION BY rec_id) AS hi
   FROM (SELECT rec_id, x, y, count(d) AS n_iat, avg(d)/1000000.0 AS iat_s FROM
    (SELECT *, t - lag(t) OVER (PARTITION BY rec_id, x, y ORDER BY t, seq) AS d FROM px_events) GROUP BY rec_id, x, y) WHERE n_iat >= 2)""")
def iat_surface(v):
    return ra.iat_surface(v.px_events)


PANO = "SELECT rec_id, y, CAST(least(floor(az/360.0*60),59) AS INT) AS az_bin, count(*) AS n FROM world WHERE {w} GROUP BY ALL"


@query("rec_id y:i az_bin:i subtract:d ratio:d abs_diff:d", f"""SELECT rec_id, y, az_bin, coalesce(a.n,0)-coalesce(b.n,0) AS subtract,
  coalesce(a.n,0)/greatest(coalesce(b.n,0),1.0) AS ratio, abs(coalesce(a.n,0)-coalesce(b.n,0)) AS abs_diff FROM
  ({PANO.format(w='t >= 15000000')}) a FULL JOIN ({PANO.format(w='t < 15000000')}) b USING (rec_id, y, az_bin)""", views=BASE)
def panorama_diff(v):
    w = rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32)
    live = ra.row_panorama(w.where("t >= 15000000"), 60)
    snap = ra.row_panorama(w.where("t < 15000000"), 60)
    return ra.panorama_diff(live, snap, ["rec_id", "y", "az_bin"])


@query("frame:l x:i y:i cam0:l cam1:l", """SELECT frame, x, y, count(*) FILTER (WHERE rec_id='cam0') AS cam0,
  count(*) FILTER (WHERE rec_id='cam1') AS cam1 FROM (SELECT *, CAST(floor((t - CASE rec_id WHEN 'cam0' THEN 0 ELSE 350000 END)/2000000.0) AS BIGINT) AS frame
  FROM px_events) GROUP BY frame, x, y""")
def overlay_frames(v):
    return ra.overlay_frames(v.px_events, {"cam0": 0, "cam1": 350_000}, 2_000_000)


_MTI = """SELECT '{k}' AS plane, rec_id, t_bin, bin, n, n - med AS excess FROM (
 WITH h AS (SELECT rec_id, least(CAST(floor(t/CAST(t1 AS DOUBLE)*30) AS INT),29) AS t_bin, {b} AS bin, count(*) AS n
    FROM world JOIN """ + SPE + """ USING (rec_id) {j} WHERE {c} GROUP BY ALL),
  g AS (SELECT rec_id, bin, tb FROM (SELECT DISTINCT rec_id, bin FROM h), range(0,30) q(tb))
 SELECT h.*, med FROM h JOIN (SELECT g.rec_id, g.bin, median(coalesce(n,0)) AS med FROM g LEFT JOIN h ON g.rec_id=h.rec_id AND g.bin=h.bin
   AND g.tb=h.t_bin GROUP BY g.rec_id, g.bin) USING (rec_id, bin)) WHERE n - med > 0"""


@query("plane rec_id t_bin:i bin:i n:l excess:d",
       _MTI.format(k="azimuth", b="CAST(least(floor(az/360.0*36),35) AS INT)", c="true", j="") + " UNION ALL "
       + _MTI.format(k="elevation", b=f"CAST(least(floor(({_EL.format(y='y')}-lo)/(hi-lo)*10),9) AS INT)",
                     c=f"{_EL.format(y='y')} BETWEEN lo AND hi",
                     j=f"JOIN (SELECT rec_id, quantile_cont({_EL.format(y='y')}, 0.01) AS lo, quantile_cont({_EL.format(y='y')}, 0.99) AS hi FROM px_events GROUP BY rec_id) USING (rec_id)"),
       views=BASE)
def mti(v):
    w = rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32)
    az = ra.mti(w, "az", F.lit(0.0), F.lit(360.0), 30, 36).withColumn("plane", F.lit("azimuth"))
    from ..operators.quantiles import counted_quantiles
    y = counted_quantiles(v.px_events, ["rec_id"], "y", {"_a": 0.99, "_b": 0.01})
    e = v.px_events.join(y, "rec_id").withColumn("el", elevation("y", 50.0, 32, 32))
    el = ra.mti(e, "el", elevation("_a", 50.0, 32, 32), elevation("_b", 50.0, 32, 32), 30, 10) \
        .withColumn("plane", F.lit("elevation"))
    return az.unionByName(el)
