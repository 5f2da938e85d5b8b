"""Queries for selection, denoise, background and telemetry operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background as bg, denoise as dn, rotation as rot, select as sel
from .registry import query
from .views import SQL_VIEWS

EV = "rec_id seq:l x:i y:i p:i t:l"

# ------------------------------------------------------------------ SQL building blocks
HOT = """SELECT rec_id, x, y FROM
  (SELECT rec_id, x, y, count(*) AS n FROM {src} GROUP BY ALL) JOIN
  (SELECT rec_id, greatest(quantile_cont(n, {q}), 1) AS thr FROM
     (SELECT rec_id, x, y, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY rec_id) USING (rec_id)
  WHERE n >= thr"""
PHASE = """SELECT e.*, h.k AS rev, (e.t - s.t)/CAST(s.t2 - s.t AS DOUBLE)
    - floor((e.t - s.t)/CAST(s.t2 - s.t AS DOUBLE)) AS phase
  FROM px_events e ASOF JOIN pulses h ON e.rec_id = h.rec_id AND e.t >= h.t
  ASOF JOIN (SELECT * FROM (SELECT rec_id, t, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS t2
             FROM pulses) WHERE t2 IS NOT NULL) s ON e.rec_id = s.rec_id AND e.t >= s.t"""
AZU = """SELECT rec_id, t, azimuth + sum(st) OVER (PARTITION BY rec_id ORDER BY t) AS u FROM
  (SELECT rec_id, t, azimuth, CASE WHEN abs(d) > 180 THEN -sign(d)*360.0::DOUBLE ELSE 0.0::DOUBLE END AS st FROM
   (SELECT *, azimuth - lag(azimuth) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM telemetry))"""
PAN = """SELECT e.*, (m.u + coalesce((m.u2 - m.u)*((e.t - m.t)/CAST(m.t2 - m.t AS DOUBLE)), 0)) AS pan_u
  FROM px_events e ASOF JOIN (SELECT *, lead(u) OVER (PARTITION BY rec_id ORDER BY t) AS u2,
    lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS t2 FROM az_u) m ON e.rec_id = m.rec_id AND e.t >= m.t"""
WORLD = """SELECT * EXCLUDE (pan_u), pan_u - floor(pan_u/360.0)*360.0 AS pan,
  a - floor(a/360.0)*360.0 AS az FROM (SELECT *, pan_u - (x - 16.0)*(50.0/32) AS a FROM pan)"""
REFR = """SELECT * FROM (WITH RECURSIVE dd AS (SELECT rec_id, x, y, t, min(seq) AS seq FROM {src} GROUP BY ALL),
  kept AS (
    SELECT rec_id, x, y, min(t) AS t FROM dd GROUP BY ALL
    UNION ALL
    SELECT k.rec_id, k.x, k.y, (SELECT min(d.t) FROM dd d WHERE d.rec_id=k.rec_id AND d.x=k.x AND d.y=k.y
       AND d.t >= k.t + {p}) AS t FROM kept k WHERE k.t IS NOT NULL)
  SELECT dd.* FROM dd JOIN kept USING (rec_id, x, y, t))"""
BAF = """SELECT e.* FROM {src} e WHERE EXISTS (SELECT 1 FROM {src} n WHERE n.rec_id = e.rec_id
  AND abs(n.x - e.x) <= 1 AND abs(n.y - e.y) <= 1 AND (n.x <> e.x OR n.y <> e.y)
  AND n.t >= e.t - {dt} AND (n.t < e.t OR (n.t = e.t AND n.seq < e.seq)))"""
STARING = """SELECT rec_id, x, y FROM (SELECT rec_id, x, y, count(*) AS n FROM learn GROUP BY ALL) JOIN
  (SELECT rec_id, greatest(quantile_cont(n, {q}), 1) AS thr FROM
    (SELECT rec_id, x, y, count(*) AS n FROM learn GROUP BY ALL) GROUP BY rec_id) USING (rec_id)
  WHERE n >= thr"""
ROTREF = """SELECT DISTINCT rec_id, ph + dp AS ph, y + dy AS y, x + dx AS x FROM
  (SELECT DISTINCT rec_id, CAST(floor(phase*360) AS BIGINT) % 360 AS ph, y, x FROM with_phase
    JOIN (SELECT rec_id, max(t) AS ref_end FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n
      FROM pulses) WHERE n <= 4 GROUP BY rec_id) USING (rec_id) WHERE t < ref_end),
  unnest([-1,0,1]) a(dp), unnest([-1,0,1]) b(dy), unnest([-1,0,1]) c(dx)
  WHERE ph+dp BETWEEN 0 AND 359 AND y+dy BETWEEN 0 AND 31 AND x+dx BETWEEN 0 AND 31"""
BASE = {
    "with_phase": PHASE, "az_u": AZU, "pan": PAN, "world": WORLD, "rotref": ROTREF,
    "hot99": HOT.format(src="px_events", q=0.99), "hot999": HOT.format(src="px_events", q=0.999),
    "coarse": """SELECT *, (least(CAST(floor(pan*(180/360.0)) AS BIGINT),179)*160
        + least(CAST(floor(x*5.0) AS BIGINT),159))*160 + least(CAST(floor(y*5.0) AS BIGINT),159) AS voxel
        FROM world""",
    "coarse_d": """SELECT c.*, CAST(floor((seen - t0)/(period_s*1000000.0)) AS BIGINT) + 1 AS depth FROM coarse c
        JOIN (SELECT rec_id, voxel, min(t) AS seen FROM coarse GROUP BY ALL) USING (rec_id, voxel)
        JOIN (SELECT rec_id, min(t) AS t0 FROM px_events GROUP BY rec_id) USING (rec_id)
        JOIN (SELECT rec_id, median(d)/1000000.0 AS period_s FROM
           (SELECT rec_id, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM pulses) GROUP BY rec_id)
           USING (rec_id)""",
}


# ------------------------------------------------------------------ selection
@query(EV, "SELECT * FROM px_events WHERE t >= 2000000 AND t < 17500000 AND x >= 4 AND x < 28 AND y >= 2 AND y < 30")
def select_window(v):
    return sel.select_window(v.px_events, 2.0, 17.5, (4, 2, 28, 30))


@query(EV, "SELECT * FROM px_lineitem WHERE p = 1")
def polarity_filter(v):
    return sel.polarity_filter(v.px_lineitem, "on")


@query(EV + " mode", """SELECT *, 'few' AS mode FROM px_lineitem WHERE abs(x - 32.0) <= 4.0 UNION ALL
  SELECT *, 'single' AS mode FROM px_lineitem WHERE abs(x - 32.0) <= 0.5 UNION ALL
  SELECT *, 'stack' AS mode FROM px_lineitem WHERE x IN (3, 31, 60)""")
def column_subset(v):
    e = v.px_lineitem
    return (sel.column_subset(e, 64, "few", 8).withColumn("mode", F.lit("few"))
            .unionByName(sel.column_subset(e, 64, "single").withColumn("mode", F.lit("single")))
            .unionByName(sel.column_subset(e, 64, columns=[3, 31, 60]).withColumn("mode", F.lit("stack"))))


POLY = [(20.0, 3.5), (200.0, 1.5), (330.5, 16.5), (250.0, 30.5), (60.0, 25.5)]
_edges = " + ".join(
    f"CASE WHEN ({ya} > y) <> ({yb} > y) AND az < ({xb}-{xa})::DOUBLE*(y-{ya})/({yb}-{ya})+{xa} THEN 1 ELSE 0 END"
    for (xa, ya), (xb, yb) in zip(POLY, POLY[1:] + POLY[:1]))


@query("rec_id seq:l y:i az:d4", f"SELECT * FROM world WHERE ({_edges}) % 2 = 1", views=BASE)
def polygon_keep(v):
    return sel.polygon_keep(rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32), POLY)


@query("rec_id step:l t:l cx:d", """SELECT * FROM steps WHERE NOT (t BETWEEN 3000000 AND 5000000)
  AND NOT (t BETWEEN 11000000 AND 11250000) AND t BETWEEN 1000000 AND 25000000""")
def prune_time_ranges(v):
    return sel.prune_time_ranges(v.steps, [(3.0, 5.0), (11.0, 11.25)], (1.0, 25.0))


@query(EV, """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t, seq) AS rn
  FROM px_events) WHERE (rn - 1) % 7 = 0""")
def stride_subsample(v):
    return sel.stride_subsample(v.px_events, 7)


@query(EV, """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id
  ORDER BY md5(CAST(seq AS VARCHAR) || ':0'), seq) AS rn FROM px_events) WHERE rn <= 500""")
def random_subsample(v):
    return sel.random_subsample(v.px_events, 500)


@query(EV, """SELECT * FROM (SELECT *, (az-180+180) - floor((az-180+180)/360.0)*360.0 - 180 + 180 AS azu FROM world
  JOIN (SELECT seq, rev FROM with_phase) USING (seq))
  WHERE azu BETWEEN 90 AND 270 AND y BETWEEN 4 AND 26 AND rev = 6""", views=BASE)
def box_gate(v):
    e = rot.revolution_asof(rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32), v.pulses)
    return sel.box_gate(e, (90.0, 270.0), (4.0, 26.0), 6)


@query("rec_id frame:l x:i y:i rise:l", """SELECT a.rec_id, a.frame, a.x, a.y, a.n - coalesce(b.n, 0) AS rise FROM
  (SELECT rec_id, t // 100000 AS frame, x, y, count(*) AS n FROM px_lineitem GROUP BY ALL) a LEFT JOIN
  (SELECT rec_id, t // 100000 AS frame, x, y, count(*) AS n FROM px_lineitem GROUP BY ALL) b
  ON a.rec_id=b.rec_id AND a.x=b.x AND a.y=b.y AND b.frame = a.frame - 1 WHERE a.n - coalesce(b.n, 0) > 0.5""")
def frame_difference(v):
    return sel.frame_difference(v.px_lineitem, 100_000)


@query("rec_id target_id:l step:l cy:d", """SELECT q.* FROM quads q JOIN
  (SELECT rec_id, target_id, median(cy) AS med FROM quads GROUP BY ALL) m USING (rec_id, target_id) JOIN
  (SELECT rec_id, target_id, median(abs(cy - med)) AS mad FROM quads JOIN
    (SELECT rec_id, target_id, median(cy) AS med FROM quads GROUP BY ALL) USING (rec_id, target_id) GROUP BY ALL) d
  USING (rec_id, target_id) WHERE abs(cy - med) < 1.5*1.4826*(mad + 1e-9)""")
def drop_rule_outliers(v):
    return sel.drop_rule_outliers(v.quads, ["rec_id", "target_id"], "cy", k=1.5)


# ------------------------------------------------------------------ denoise
@query("rec_id x:i y:i n:l", "SELECT rec_id, x, y, count(*) AS n FROM px_lineitem GROUP BY ALL")
def pixel_counts(v):
    return dn.pixel_counts(v.px_lineitem)


@query(EV, "SELECT e.* FROM px_events e ANTI JOIN hot99 USING (rec_id, x, y)", views=BASE)
def hot_pixel_mask(v):
    return dn.hot_pixel_mask(v.px_events, 99.0)


@query(EV, f"SELECT e.* FROM px_lineitem e SEMI JOIN ({REFR.format(src='px_lineitem', p=900000)}) k USING (rec_id, seq)")
def refractory_filter(v):
    return dn.refractory_filter(v.px_lineitem, 900_000, chunk_us=2_000_000)


@query(EV, BAF.format(src="px_lineitem", dt=200000))
def baf_filter(v):
    return dn.baf_filter(v.px_lineitem, 200_000)


@query(EV, """SELECT e.* FROM px_events e ANTI JOIN hot99 USING (rec_id, x, y) SEMI JOIN refr USING (rec_id, seq)
  SEMI JOIN baf USING (rec_id, seq) WHERE p = 0""",
       views={**BASE, "refr": REFR.format(src="px_events", p=500000), "baf": BAF.format(src="px_events", dt=20000)})
def denoise_chain(v):
    return dn.denoise_chain(v.px_events, "off", 99.0, 500_000, 20_000)


_CHAIN = """SELECT rec_id, unnest([0,1,2,3,4,5]) AS stage_no, unnest(['select','polarity','hot-pixel',
  'refractory','bg-suppress','subsample']) AS stage,
  unnest([n0, n1, n2, n3, n4, CAST(ceil(n4/3.0) AS BIGINT)]) AS n FROM (
 SELECT rec_id, count(*) AS n0, count(*) FILTER (WHERE p=1) AS n1,
  count(*) FILTER (WHERE p=1 AND NOT h) AS n2, count(*) FILTER (WHERE p=1 AND NOT h AND r) AS n3,
  count(*) FILTER (WHERE p=1 AND NOT h AND r AND NOT b) AS n4 FROM (
  SELECT e.*, hot99.x IS NOT NULL AS h, refr.seq IS NOT NULL AS r, stbg.x IS NOT NULL AS b FROM px_events e
  LEFT JOIN hot99 ON e.rec_id=hot99.rec_id AND e.x=hot99.x AND e.y=hot99.y
  LEFT JOIN refr ON e.rec_id=refr.rec_id AND e.seq=refr.seq
  LEFT JOIN stbg ON e.rec_id=stbg.rec_id AND e.x=stbg.x AND e.y=stbg.y) GROUP BY rec_id)"""
STVIEWS = {**BASE, "learn": """SELECT e.* FROM px_events e JOIN (SELECT rec_id, min(t) AS t0 FROM px_events GROUP BY rec_id)
    USING (rec_id) WHERE t < t0 + 8000000""", "stbg": STARING.format(q=0.9)}


@query("rec_id stage_no:i stage n:l", _CHAIN,
       views={**STVIEWS, "refr": REFR.format(src="px_events", p=500000)})
def op_chain(v):
    return dn.op_chain(v.px_events, "on", 99.0, 500_000,
                       bg.staring_background(v.px_events, 8.0, 90.0), 3)


# ------------------------------------------------------------------ background
@query(EV, "SELECT e.* FROM px_events e ANTI JOIN stbg USING (rec_id, x, y)", views=STVIEWS)
def staring_foreground(v):
    return bg.staring_foreground(v.px_events, 8.0, 90.0)


@query(EV, "SELECT e.* FROM px_events e ANTI JOIN stbg USING (rec_id, x, y) ANTI JOIN hot999 USING (rec_id, x, y)",
       views={**STVIEWS, "learn": "SELECT * FROM px_events WHERE t < 8000000"})
def staring_drop(v):
    return bg.staring_drop(v.px_events, 8.0, 90.0, 99.9)


#: The same views with telemetry that runs 137 ms behind the events.
OFFSET = -137_000
LATE = {**BASE, "pulses": f"SELECT rec_id, k, t - 137000 AS t FROM ({SQL_VIEWS['pulses']})",
        "telemetry": f"SELECT * EXCLUDE (t), t - 137000 AS t FROM ({SQL_VIEWS['telemetry']})"}


@query("rec_id ph:i y:i x:i", "SELECT * FROM rotref", views=LATE)
def rotation_reference_offset(v):
    return bg.rotation_reference(v.px_events, v.pulses, 32, 32, n_rotations=4, offset_us=OFFSET)


@query("rec_id ph:i y:i x:i", "SELECT * FROM rotref", views=BASE)
def rotation_reference(v):
    return bg.rotation_reference(v.px_events, v.pulses, 32, 32, n_rotations=4)


ROTATION_FOREGROUND_SQL = """SELECT w.* FROM (SELECT *, CAST(floor(phase*360) AS BIGINT) % 360 AS ph FROM with_phase) w
  ANTI JOIN rotref USING (rec_id, ph, y, x) ANTI JOIN hot999 USING (rec_id, x, y)"""


@query(EV, ROTATION_FOREGROUND_SQL, views=LATE)
def rotation_foreground_offset(v):
    return bg.rotation_foreground(v.px_events, v.pulses, 32, 32, 4, hot=dn.hot_pixels(v.px_events, 99.9), offset_us=OFFSET)


@query(EV, ROTATION_FOREGROUND_SQL, views=BASE)
def rotation_foreground(v):
    return bg.rotation_foreground(v.px_events, v.pulses, 32, 32, 4, hot=dn.hot_pixels(v.px_events, 99.9))


CUMULATIVE_VOXEL_MASK_SQL = """SELECT w.* FROM (SELECT *, min(rev) OVER (PARTITION BY rec_id, ph, x, y) AS first_rev,
    min(rev) OVER (PARTITION BY rec_id) AS seed FROM
    (SELECT *, least(CAST(floor(phase*12) AS BIGINT), 11) AS ph FROM with_phase)) w
  ANTI JOIN hot999 USING (rec_id, x, y) WHERE rev <= first_rev AND rev > seed"""


@query(EV, CUMULATIVE_VOXEL_MASK_SQL, views=LATE)
def cumulative_voxel_mask_offset(v):
    return bg.cumulative_voxel_mask(v.px_events, v.pulses, 12, 99.9, offset_us=OFFSET)


@query(EV, CUMULATIVE_VOXEL_MASK_SQL, views=BASE)
def cumulative_voxel_mask(v):
    return bg.cumulative_voxel_mask(v.px_events, v.pulses, 12, 99.9)


COARSE_VOXEL_MASK_SQL = """SELECT c.* FROM coarse c ANTI JOIN (SELECT DISTINCT rec_id, voxel FROM coarse
    JOIN (SELECT rec_id, min(t) AS t0 FROM px_events GROUP BY rec_id) USING (rec_id)
    JOIN (SELECT rec_id, median(d) AS per FROM (SELECT rec_id, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS d
      FROM pulses) GROUP BY rec_id) USING (rec_id) WHERE t < t0 + 10*per) USING (rec_id, voxel)"""


@query(EV, COARSE_VOXEL_MASK_SQL, views=LATE)
def coarse_voxel_mask_offset(v):
    return bg.coarse_voxel_mask(v.px_events, v.telemetry, v.pulses, 32, 32, 10, offset_us=OFFSET)


@query(EV, COARSE_VOXEL_MASK_SQL, views=BASE)
def coarse_voxel_mask(v):
    return bg.coarse_voxel_mask(v.px_events, v.telemetry, v.pulses, 32, 32, 10)


ROTATION_PHASE_FILTER_SQL = """SELECT w.* FROM with_phase w LEFT JOIN (SELECT rec_id, x, y, atan2(s, c) AS mu FROM
    (SELECT rec_id, x, y, sum(cos(2*pi()*phase)) AS c, sum(sin(2*pi()*phase)) AS s, count(*) AS n,
       count(DISTINCT rev) AS revs FROM with_phase GROUP BY ALL)
    JOIN (SELECT rec_id, greatest(max(rev)+1, (SELECT max(k) FROM pulses q WHERE q.rec_id = z.rec_id)) AS n_rev
      FROM with_phase z GROUP BY rec_id) USING (rec_id)
    WHERE n >= 4 AND revs >= greatest(2, floor(0.1*n_rev)) AND sqrt(c*c+s*s)/n >= 0.5) p USING (rec_id, x, y)
  WHERE mu IS NULL OR abs(2*pi()*phase - mu - round((2*pi()*phase - mu)/(2*pi()))*2*pi()) > 2*pi()*0.12"""


@query(EV, ROTATION_PHASE_FILTER_SQL, views=LATE)
def rotation_phase_filter_offset(v):
    return bg.rotation_phase_filter(v.px_events, v.pulses, recur_frac=0.1, offset_us=OFFSET)


@query(EV, ROTATION_PHASE_FILTER_SQL, views=BASE)
def rotation_phase_filter(v):
    return bg.rotation_phase_filter(v.px_events, v.pulses, recur_frac=0.1)


@query("rec_id x:i y:i n_slices:l", """SELECT rec_id, x, y, count(DISTINCT i) AS n_slices FROM px_lineitem
  JOIN (SELECT rec_id, max(t) - 50000 AS tmax FROM px_lineitem GROUP BY rec_id) USING (rec_id),
  (SELECT i, (i*0.6180339887498949::DOUBLE) - floor(i*0.6180339887498949::DOUBLE) AS s FROM range(1, 21) r(i))
  WHERE t >= tmax*s AND t < tmax*s + 50000 GROUP BY rec_id, x, y HAVING count(DISTINCT i) >= 2""")
def mc_noise_mask(v):
    return bg.mc_noise_mask(v.px_lineitem)


# ------------------------------------------------------------------ telemetry joins
@query("rec_id seq:l rev:l", """SELECT rec_id, seq, (SELECT count(*) - 1 FROM pulses h WHERE h.rec_id = e.rec_id
  AND h.t <= e.t) AS rev FROM px_events e""")
def revolution_asof(v):
    return rot.revolution_asof(v.px_events, v.pulses)


@query("rec_id seq:l phase:d", "SELECT * FROM with_phase", views=BASE)
def phase_asof(v):
    return rot.phase_asof(v.px_events, v.pulses)


@query("rec_id seq:l pan:d5", "SELECT * FROM world", views=BASE)
def azimuth_interp(v):
    return rot.azimuth_interp(v.px_events, v.telemetry)


@query("rec_id seq:l az:d5", "SELECT * FROM world", views=BASE)
def world_azimuth(v):
    return rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32)
