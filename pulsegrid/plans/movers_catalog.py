"""Queries for masking studies, movers and passes."""
from __future__ import annotations

from ..operators import movers as mv, rotation as rot
from .filters_catalog import BASE, HOT, LATE, OFFSET
from .registry import query

FOC = "(16.0/tan(radians(50.0)/2.0))"
MV = {
    **BASE,
    "hotp": HOT.format(src="px_events", q=0.999),
    "vox": "SELECT *, CAST(floor(phase*36) AS BIGINT) % 36 AS ph FROM with_phase",
    "rends": """SELECT h.rec_id, lev, max(h.t) AS ref_end FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n
        FROM pulses) h, range(1, 5) q(lev) WHERE n <= lev GROUP BY ALL""",
    "seen": """SELECT e.rec_id, e.seq, min(n.t) AS seen FROM vox e JOIN vox n ON e.rec_id=n.rec_id AND abs(e.ph-n.ph)<=1
        AND abs(e.x-n.x)<=1 AND abs(e.y-n.y)<=1 GROUP BY ALL""",
    "lev_keep": """SELECT w.*, q.lev AS level, CASE WHEN q.lev = 0 THEN true ELSE hotp.x IS NULL AND seen >= ref_end END AS keep
        FROM world w JOIN seen USING (rec_id, seq) CROSS JOIN range(0,5) q(lev)
        LEFT JOIN rends ON rends.rec_id = w.rec_id AND rends.lev = q.lev
        LEFT JOIN hotp ON hotp.rec_id=w.rec_id AND hotp.x=w.x AND hotp.y=w.y""",
    "wrev": """SELECT w.*, p.rev, (16.0-w.y)*(50.0/32) AS elev, w.a AS b FROM world w JOIN with_phase p USING (rec_id, seq)""",
}


SWEEP = """WITH g AS (
   SELECT rec_id, level, CASE WHEN az BETWEEN 0 AND 360 THEN least(floor(az/2),179) END AS a,
     CASE WHEN (16.0-y)*(50.0/32) BETWEEN -30 AND 30 THEN least(floor((16.0-y)*(50.0/32)+30),59) END AS b,
     count(*) FILTER (WHERE keep) AS k, count(*) AS n FROM lev_keep GROUP BY ALL),
  s AS (SELECT rec_id, level, sum(k) AS kept, sum(n) AS total, max(k) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND k>0) AS peak,
     avg(k) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND k>0) AS mean, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND k>0) AS occ
     FROM g GROUP BY ALL)
  SELECT s.rec_id, s.level, kept, 100.0*(1-kept/CAST(total AS DOUBLE)) AS reduction_pct, coalesce(peak/mean,0) AS concentration,
   (SELECT count(*) FROM g WHERE g.rec_id=s.rec_id AND g.level=s.level AND a IS NOT NULL AND b IS NOT NULL AND k>0
      AND k >= greatest(0.02*s.kept/greatest(s.occ,1), 5)) AS mover_cells FROM s"""


@query("rec_id level:i kept:l reduction_pct:d mover_cells:l concentration:d", SWEEP, views={**MV, **{k: LATE[k] for k in ("pulses", "telemetry")}})
def mask_sweep_offset(v):
    return mv.mask_sweep(v.px_events, v.pulses, v.telemetry, 50.0, 32, 32, 4, 99.9, 36, offset_us=OFFSET)


@query("rec_id level:i kept:l reduction_pct:d mover_cells:l concentration:d", SWEEP, views=MV)
def mask_sweep(v):
    return mv.mask_sweep(v.px_events, v.pulses, v.telemetry, 50.0, 32, 32, 4, 99.9, 36)


@query("rec_id bin:l level:i rate_hz:d", """SELECT rec_id, t//1000000 AS bin, level, count(*) FILTER (WHERE keep)/1.0 AS rate_hz
  FROM lev_keep GROUP BY ALL""", views={**MV, "vox": "SELECT *, CAST(floor(phase*360) AS BIGINT) % 360 AS ph FROM with_phase"})
def mask_sweep_rate(v):
    return mv.mask_sweep_rate(v.px_events, v.pulses, 32, 32, 4, 99.9, 1_000_000)


_MET = """SELECT rec_id, level, kept, 100.0*(1-kept/CAST(tot AS DOUBLE)) AS reduction_pct, kept/dur AS rate_hz, tk AS target_kept,
   100.0*tk/greatest(nd,1) AS target_retained_pct, 100.0*(kept-tk)/greatest(tot-nd,1) AS background_retained_pct,
   (CAST(tk AS DOUBLE)/greatest(nd,1))/greatest(CAST(kept-tk AS DOUBLE)/greatest(tot-nd,1), 1e-6) AS contrast FROM
  (SELECT rec_id, level, count(*) FILTER (WHERE depth > level) AS kept, count(*) FILTER (WHERE depth > level AND inb) AS tk,
    count(*) AS tot, count(*) FILTER (WHERE inb) AS nd, (max(t)-min(t))/1000000.0 AS dur FROM
   (SELECT *, (az1-180+180) - floor((az1-180+180)/360.0)*360.0 - 180 + 180 BETWEEN 100 AND 260 AND y BETWEEN 4 AND 20 AS inb FROM
     (SELECT *, pan + (x-16.0)*(50.0/32) AS az1 FROM coarse_d)), unnest([0,2,4,8,16]) q(level) GROUP BY rec_id, level)"""


@query("rec_id level:i kept:l reduction_pct:d rate_hz:d target_kept:l target_retained_pct:d background_retained_pct:d contrast:d",
       _MET, views=MV)
def masking_metrics(v):
    return mv.masking_metrics(v.px_events, v.telemetry, v.pulses, 32, 32, (100.0, 260.0, 4.0, 20.0), 50.0, 1.0,
                              (0, 2, 4, 8, 16))


@query("rec_id bin:l level:i rate_hz:d", """SELECT rec_id, (t-t0)//500000 AS bin, level, count(*) FILTER (WHERE depth > level)/0.5 AS rate_hz
  FROM coarse_d JOIN (SELECT rec_id, min(t) AS t0 FROM px_events GROUP BY rec_id) USING (rec_id), unnest([0,1,4,12]) q(level)
  GROUP BY ALL""", views=MV)
def mask_reduction_over_time(v):
    return mv.mask_reduction_over_time(v.px_events, v.telemetry, v.pulses, 32, 32, (0, 1, 4, 12), 500_000)


_BLUR = """SELECT rec_id, {o}, d AS {a}, sum(v*exp(-0.5*(d-s)*(d-s)))/any_value(nrm) AS v FROM
  (SELECT rec_id, {o}, v, unnest([{a}, -1-{a}, 2*{n}-1-{a}]) AS s FROM {src}), range(0, {n}) q(d),
  (SELECT sum(exp(-0.5*k*k)) AS nrm FROM range(-4, 5) z(k)) WHERE abs(d-s) <= 4 GROUP BY rec_id, {o}, d"""


@query("rec_id az0:d az1:d y0:d y1:d", """SELECT rec_id, greatest((a+0.5)/360*360.0-4,0) AS az0, least((a+0.5)/360*360.0+4,360) AS az1,
  greatest((b+0.5)/80*32.0-6,0) AS y0, least((b+0.5)/80*32.0+6,32) AS y1 FROM
  (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(v,9) DESC, a, b) AS rn FROM h2) WHERE rn = 1""",
       views={**MV, "h0": """SELECT rec_id, least(CAST(floor(az) AS INT),359) AS a, least(CAST(floor(y/32.0*80) AS INT),79) AS b,
                CAST(count(*) AS DOUBLE) AS v FROM world GROUP BY ALL""",
              "h1": _BLUR.format(o="b", a="a", n=360, src="h0"), "h2": _BLUR.format(o="a", a="b", n=80, src="h1")})
def densest_box(v):
    return mv.densest_box(rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32), 32, y_pad=6.0)


_MOV = f"""SELECT rec_id, rev, least(CAST(floor(az/30) AS INT),11) AS bin, median(t)/1000000.0 AS t_s, median(az) AS bearing_deg,
  median(elev) AS elev_deg, 0.2*{FOC}/greatest(quantile_cont(y,0.9)-quantile_cont(y,0.1),1.0) AS range_m, count(*) AS n_events,
  quantile_cont(y,0.9)-quantile_cont(y,0.1) AS size_px, median(elev) > 0 AS above_horizon
  FROM wrev GROUP BY ALL HAVING count(*) >= 12"""


@query("rec_id rev:l bin:i t_s:d7 bearing_deg:d elev_deg:d range_m:d n_events:l size_px:d above_horizon:b", _MOV, views=MV)
def extract_movers(v):
    return mv.extract_movers(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 0.2, 30.0, 12)


@query("rec_id n_movers:l n_above_horizon:l bearing_min_deg:d bearing_max_deg:d range_median_m:d", f"""SELECT rec_id, count(*) AS n_movers,
  count(*) FILTER (WHERE above_horizon) AS n_above_horizon, min(bearing_deg) FILTER (WHERE above_horizon) AS bearing_min_deg,
  max(bearing_deg) FILTER (WHERE above_horizon) AS bearing_max_deg, median(range_m) FILTER (WHERE above_horizon) AS range_median_m
  FROM ({_MOV}) GROUP BY rec_id""", views=MV)
def movers_table(v):
    return mv.movers_table(mv.extract_movers(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 0.2, 30.0, 12))


def robust(col, p):
    return f"""(WITH d AS (SELECT rec_id, rev, {col} AS val, abs({col}-med) AS dev, med FROM wrev JOIN
      (SELECT rec_id, rev, median({col}) AS med FROM wrev GROUP BY ALL) USING (rec_id, rev)),
     m AS (SELECT rec_id, rev, median(dev)+1e-9 AS mad FROM d GROUP BY ALL)
    SELECT rec_id, rev, coalesce(avg(val) FILTER (WHERE dev < 3*1.4826*mad), any_value(med)) AS {p}_c,
      CASE WHEN count(*) FILTER (WHERE dev < 3*1.4826*mad) > 1 THEN stddev_pop(val) FILTER (WHERE dev < 3*1.4826*mad)
        ELSE 1.4826*any_value(mad) END AS {p}_s, count(*) FILTER (WHERE dev < 3*1.4826*mad) AS {p}_n
    FROM d JOIN m USING (rec_id, rev) GROUP BY ALL)"""


PASSES = f"""SELECT rec_id, rev, t_s, b_c - floor(b_c/360.0)*360.0 AS bearing_deg, b_s/sqrt(b_n) AS bearing_se_deg, e_c AS elev_deg,
  sqrt(12)*b_s AS ang_size_deg, 0.2/radians(sqrt(12)*b_s) AS range_m, n_events
  FROM (SELECT rec_id, rev, median(t)/1000000.0 AS t_s, count(*) AS n_events FROM wrev GROUP BY ALL HAVING count(*) >= 50)
  JOIN {robust('b', 'b')} USING (rec_id, rev) JOIN {robust('elev', 'e')} USING (rec_id, rev)"""


@query("rec_id rev:l t_s:d7 bearing_deg:d4 bearing_se_deg:d elev_deg:d ang_size_deg:d5 range_m:d5 n_events:l", PASSES, views=MV)
def per_pass_centroids(v):
    return mv.per_pass_centroids(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 0.2)


@query("rec_id rev:l t_s:d7 bearing_deg:d4 bearing_se_deg:d elev_deg:d ang_size_deg:d5 range_m:d5 n_events:l", PASSES, views={
    "wrev": """SELECT *, seg AS rev, (16.0-y)*(50.0/32) AS elev, -(x-16.0)*(50.0/32) AS b FROM (SELECT *, sum(CASE WHEN t - prev > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY t, seq) AS seg
      FROM (SELECT *, lag(t) OVER (PARTITION BY rec_id ORDER BY t, seq) AS prev FROM px_events))"""})
def per_pass_centroids_staring(v):
    return mv.per_pass_centroids(v.px_events, None, None, 50.0, 32, 32, 0.2, gap_us=30_000)


@query("rec_id rev:l t_s:d7 bearing_deg:d4", """SELECT rec_id, rev, tc/1000000.0 AS t_s, a - floor(a/360.0)*360.0 AS bearing_deg FROM (
  SELECT c.*, (m.u + coalesce((m.u2-m.u)*((tc-m.t)/CAST(m.t2-m.t AS DOUBLE)),0)) - (cx-16.0)*(50.0/32) AS a FROM
  (SELECT rec_id, rev, f, cx, t0 + (f+0.5)*50000 AS tc FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, rev ORDER BY c DESC, f) AS rn FROM
   (SELECT rec_id, rev, greatest(least(CAST(ceil((t-t0)/50000.0) AS BIGINT)-1, nf-1),0) AS f, any_value(t0) AS t0, count(*) AS c, avg(x) AS cx
    FROM wrev JOIN (SELECT rec_id, rev, min(t) AS t0, CAST(ceil((max(t)-min(t))/50000.0) AS BIGINT) AS nf FROM wrev GROUP BY ALL HAVING count(*)>=50)
    USING (rec_id, rev) GROUP BY ALL)) WHERE rn = 1) c
  ASOF JOIN (SELECT *, lead(u) OVER (PARTITION BY rec_id ORDER BY t) AS u2, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS t2 FROM az_u) m
   ON c.rec_id = m.rec_id AND c.tc >= m.t)""", views=MV)
def image_centroid_per_pass(v):
    return mv.image_centroid_per_pass(v.px_events, v.telemetry, v.pulses, 50.0, 32, 50_000)


_SEG = """SELECT *, sum(CASE WHEN t - prev > {g} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY t, seq) AS seg FROM
  (SELECT *, lag(t) OVER (PARTITION BY {k} ORDER BY t, seq) AS prev FROM ({src}))"""


@query("rec_id seq:l seg:l", _SEG.format(g=15000, k="rec_id", src="SELECT * FROM px_events"))
def gap_segments(v):
    return mv.gap_segments(v.px_events, ["rec_id"], 15_000)


_BOXSRC = """SELECT *, (az-180+180) - floor((az-180+180)/360.0)*360.0 - 180 + 180 AS azu FROM wrev
  WHERE (az-180+180) - floor((az-180+180)/360.0)*360.0 BETWEEN 120 AND 240 AND y BETWEEN 4 AND 28"""


def boxpass(keys, n):
    return f"""SELECT {keys}, seg, median(t)/1000000.0 AS t_s, median(azu) AS bearing_deg, stddev_pop(azu)/sqrt(count(*)) AS se,
    quantile_cont(y,0.9)-quantile_cont(y,0.1) AS ye, 0.225*{FOC}/greatest(quantile_cont(y,0.9)-quantile_cont(y,0.1),1.0) AS range_m,
    count(*) AS n_events FROM ({_SEG.format(g=300000, k=keys, src=_BOXSRC)}) GROUP BY {keys}, seg HAVING count(*) >= {n}"""


def boxsolve(keys, n):
    return f"""SELECT {keys}, count(*) AS n_passes, sum(n_events) AS n_events, median(round(bearing_deg,2)) AS bearing_deg,
    max(round(bearing_deg,2))-min(round(bearing_deg,2)) AS bearing_span_deg, median(round(range_m,2)) AS range_m,
    min(round(range_m,2)) AS range_min_m, max(round(range_m,2)) AS range_max_m FROM ({boxpass(keys, n)}) GROUP BY {keys}"""


@query("rec_id n_passes:l n_events:l bearing_deg:d4 bearing_span_deg:d4 range_m:d4 range_min_m:d4 range_max_m:d4", boxsolve("rec_id", 30), views=MV)
def solve_box(v):
    return mv.solve_box(rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32), ["rec_id"], (120.0, 240.0), (4.0, 28.0), 50.0, 32, min_pass=30)


@query("rec_id rev:l t_s:d7 bearing_deg:d4 range_m:d4 n_events:l", f"""SELECT s.*, f.t_s FROM ({boxsolve('rec_id, rev', 20)}) s JOIN
  (SELECT rec_id, k AS rev, (t + lead(t) OVER (PARTITION BY rec_id ORDER BY t))/2/1000000.0 AS t_s FROM pulses) f USING (rec_id, rev)
  WHERE f.t_s IS NOT NULL""", views=MV)
def track_over_revs(v):
    return mv.track_over_revs(rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32), v.pulses, (120.0, 240.0), (4.0, 28.0), 50.0, 32, min_pass=20)


@query("rec_id rev:l n_events:l size_px:d range_m:d", f"""WITH d AS (SELECT w.*, abs(y-med) AS dev FROM wrev w JOIN
    (SELECT rec_id, rev, median(y) AS med FROM wrev GROUP BY ALL) USING (rec_id, rev)),
  m AS (SELECT rec_id, rev, median(dev)*1.4826 AS mad, count(*) AS n FROM d GROUP BY ALL),
  c AS (SELECT d.*, n, dev <= greatest(3.0*mad, 1.0) AS core FROM d JOIN m USING (rec_id, rev)),
  k AS (SELECT rec_id, rev, any_value(n) AS n_events, CASE WHEN count(*) FILTER (WHERE core) >= 8
      THEN quantile_cont(y,0.975) FILTER (WHERE core) - quantile_cont(y,0.025) FILTER (WHERE core) + 1.0
      ELSE quantile_cont(y,0.975) - quantile_cont(y,0.025) + 1.0 END AS s FROM c GROUP BY ALL)
  SELECT rec_id, rev, n_events, CASE WHEN n_events >= 8 THEN s ELSE 0 END AS size_px,
    CASE WHEN n_events >= 8 THEN 0.2*{FOC}/greatest(s, 1.0) END AS range_m FROM k""", views=MV)
def derived_extent_range(v):
    return mv.derived_extent_range(rot.revolution_asof(v.px_events, v.pulses), ["rec_id", "rev"], 50.0, 32, 0.2)
