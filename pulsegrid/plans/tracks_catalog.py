"""Queries for detections: joins, rankings, geometry, metrics and editing."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import edit as ed, geometry as geo, kpi, movers as mv, ordered, rotation as rot, tracks as tk
from ..session import cut_lineage
from .filters_catalog import BASE
from .movers_catalog import FOC, MV, PASSES, _MOV
from .raster_catalog import SPAN
from .registry import query

# ------------------------------------------------------------------ shared views
DETS = {
    **MV,
    "dets": f"""SELECT *, t/1000000.0 AS t_s, 100.0 + cx*3 AS freq_hz, n_events/2.0 AS snr, area/CAST(n_events AS DOUBLE) AS harmonic,
       -(cx-16.0)*(50.0/32) AS azimuth_deg, (16.0-cy)*(50.0/32) AS elev_deg, sqrt(dx*dx+dy*dy) AS apparent_px,
       0.2*{FOC}/greatest(sqrt(dx*dx+dy*dy),1.0) AS range_m, 1/greatest(sqrt(dx*dx+dy*dy),1.0) AS rel_distance FROM quads""",
    "movs": _MOV, "passes": PASSES,
}


def dets(v):
    """Localised detections with stand-in frequency, SNR and harmonic columns."""
    q = geo.localize_detections(v.quads, 50.0, 32, 32, 0.2).withColumnRenamed("bearing_deg", "azimuth_deg")
    return q.withColumns({"t_s": F.col("t") / 1e6, "freq_hz": 100.0 + F.col("cx") * 3, "snr": F.col("n_events") / 2.0,
                          "harmonic": F.col("area") / F.col("n_events")})


def movs(v):
    return mv.extract_movers(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 0.2, 30.0, 12)


# ------------------------------------------------------------------ joins
@query("rec_id step:l seq:l", """SELECT e.rec_id, s.step, e.seq FROM px_events e JOIN steps s ON e.rec_id=s.rec_id AND e.t >= s.t - 300000 AND e.t < s.t
  AND e.x >= s.x0+3 AND e.x < s.x1-3 AND e.y >= s.y0+3 AND e.y < s.y1-3""")
def in_box_events(v):
    d = v.steps.withColumns({"x0": F.col("x0") + 3, "y0": F.col("y0") + 3, "x1": F.col("x1") - 3, "y1": F.col("y1") - 3})
    return tk.in_box_events(v.px_events, d, 300_000)


@query("rec_id target_id:l step:l near_area:l near_n:l", """SELECT q.rec_id, q.target_id, q.step, CASE WHEN d <= 200000 THEN area END AS near_area, CASE WHEN d <= 200000 THEN n END AS near_n FROM
  (SELECT q.rec_id, q.target_id, q.step, s.area, s.n_events AS n, abs(s.t - q.t - 100000) AS d, row_number() OVER (PARTITION BY q.rec_id, q.target_id, q.step ORDER BY abs(s.t - q.t - 100000), s.t) AS rn
   FROM quads q JOIN steps s ON q.rec_id=s.rec_id AND abs(s.t-q.t-100000) <= 2000000) q WHERE rn = 1""")
def nearest_in_time(v):
    q = v.quads.withColumn("t", F.col("t") + 100_000).select("rec_id", "target_id", "step", "t")
    s = v.steps.select("rec_id", "t", F.col("area").alias("near_area"), F.col("n_events").alias("near_n"))
    return tk.nearest_in_time(q, s, ["rec_id"], ["near_area", "near_n"], 200_000)


@query("rec_id seq:l box_t:l", """SELECT e.rec_id, e.seq, s.t AS box_t FROM px_events e ASOF JOIN steps s ON e.rec_id=s.rec_id AND e.t > s.t
  WHERE e.t < (SELECT max(t) FROM steps z WHERE z.rec_id=e.rec_id) AND e.x >= s.x0 AND e.x < s.x1 AND e.y >= s.y0 AND e.y < s.y1
  UNION ALL SELECT e.rec_id, e.seq, s.t FROM px_events e JOIN (SELECT rec_id, min(t) AS t, arg_min(x0,t) AS x0, arg_min(x1,t) AS x1, arg_min(y0,t) AS y0, arg_min(y1,t) AS y1 FROM steps GROUP BY rec_id) s
  ON e.rec_id=s.rec_id AND e.t = s.t WHERE e.x >= s.x0 AND e.x < s.x1 AND e.y >= s.y0 AND e.y < s.y1""")
def box_asof(v):
    return tk.box_asof(v.px_events, v.steps)


_TA = """SELECT target_id, t, azimuth_deg, range_m FROM dets WHERE rec_id='{r}'"""


@query("target_id:l kept:l total:l residual_deg:d range_a_m:d range_b_m:d", """SELECT target_id, count(*) FILTER (WHERE abs(d) < 1.5) AS kept, count(*) AS total,
   median(d) FILTER (WHERE abs(d) < 1.5) AS residual_deg, median(range_m) FILTER (WHERE abs(d) < 1.5) AS range_b_m,
   any_value((SELECT median(range_m) FROM ta z WHERE z.target_id = q.target_id)) AS range_a_m FROM
  (SELECT b.*, (b.azimuth_deg - 0.7 - a.az + 180) - floor((b.azimuth_deg - 0.7 - a.az + 180)/360.0)*360.0 - 180 AS d FROM tb b JOIN ai a ON a.target_id=b.target_id AND a.t=b.t) q GROUP BY target_id""",
       views={**DETS, "ta": _TA.format(r="cam0"), "tb": _TA.format(r="cam1"),
              "ai": """SELECT b.target_id, b.t, CASE WHEN lo.t IS NULL THEN hi.azimuth_deg WHEN hi.t IS NULL OR hi.t = lo.t THEN lo.azimuth_deg
                 ELSE lo.azimuth_deg + (hi.azimuth_deg-lo.azimuth_deg)*(b.t-lo.t)/CAST(hi.t-lo.t AS DOUBLE) END AS az
                FROM tb b ASOF LEFT JOIN ta lo ON lo.target_id=b.target_id AND lo.t <= b.t ASOF LEFT JOIN ta hi ON hi.target_id=b.target_id AND hi.t >= b.t"""})
def dual_sensor_gate(v):
    d = dets(v)
    return tk.dual_sensor_gate(d.where("rec_id = 'cam0'"), d.where("rec_id = 'cam1'"), ["target_id"], 1.5, 0.7)


SHARED = """SELECT a.rev, a.t_s - b.t_s AS dt, (a.bearing_deg-b.bearing_deg+180) - floor((a.bearing_deg-b.bearing_deg+180)/360.0)*360.0 - 180 AS dbearing, omega
  FROM (SELECT * FROM passes WHERE rec_id='cam0') a JOIN (SELECT * FROM passes WHERE rec_id='cam1') b USING (rev) JOIN
  (SELECT k AS rev, 360.0/((lead(t) OVER (ORDER BY t) - t)/1000000.0) AS omega FROM pulses WHERE rec_id='cam0') USING (rev) WHERE omega IS NOT NULL"""


def shared(v):
    p = cut_lineage(mv.per_pass_centroids(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 0.2))
    return tk.shared_revolution_join(p.where("rec_id = 'cam0'"), p.where("rec_id = 'cam1'"), v.pulses.where("rec_id = 'cam0'"))


@query("rev:l dt:d dbearing:d4 omega:d", SHARED, views=DETS)
def shared_revolution_join(v):
    return shared(v)


@query("n:l dt_s:d4 dphi_deg:d2 dt_se_s:d4 dphi_se_deg:d2 omega_rel_spread:d omega_mean:d separable:b", f"""SELECT n, b AS dt_s, a AS dphi_deg, sqrt(s2/sxx) AS dt_se_s, sqrt(s2*xx/(n*sxx)) AS dphi_se_deg,
   ptp/om AS omega_rel_spread, om AS omega_mean, ptp/om > 0.05 AND abs(b) > 2*sqrt(s2/sxx) AS separable FROM (SELECT *, greatest(syy-b*b*sxx,0)/(n-2) AS s2 FROM
   (SELECT count(*) AS n, regr_slope(dbearing, omega) AS b, regr_intercept(dbearing, omega) AS a, regr_sxx(dbearing, omega) AS sxx, regr_syy(dbearing, omega) AS syy,
      max(omega)-min(omega) AS ptp, avg(omega) AS om, sum(omega*omega) AS xx FROM ({SHARED}) HAVING count(*) >= 3))""", views=DETS)
def fit_timing_boresight(v):
    return kpi.fit_timing_boresight(shared(v), [])


@query("rec_id target_id:l step:l a_f0:d a_conf:d", """SELECT q.rec_id, q.target_id, q.step, CASE WHEN s.t IS NOT NULL AND hi.t IS NOT NULL THEN s.cx + (hi.cx-s.cx)*coalesce((q.t+60000-s.t)/CAST(nullif(hi.t-s.t,0) AS DOUBLE),0) END AS a_f0,
   CASE WHEN s.t IS NOT NULL AND hi.t IS NOT NULL THEN s.cy + (hi.cy-s.cy)*coalesce((q.t+60000-s.t)/CAST(nullif(hi.t-s.t,0) AS DOUBLE),0) ELSE 0 END AS a_conf
  FROM quads q ASOF LEFT JOIN steps s ON s.rec_id=q.rec_id AND s.t <= q.t+60000 ASOF LEFT JOIN steps hi ON hi.rec_id=q.rec_id AND hi.t >= q.t+60000""")
def track_interp_join(v):
    q = v.quads.withColumn("t", F.col("t") + 60_000).select("rec_id", "target_id", "step", "t")
    return tk.track_interp_join(q, v.steps.select("rec_id", "t", F.col("cx").alias("f0"), F.col("cy").alias("conf")), ["rec_id"], ("f0", "conf"))


LAD = """SELECT *, bearing_deg AS bd, 100.0 + bin*10.0 + rev AS blade_hz, n_events/100.0 AS comb_strength, n_events >= 13 AS detected FROM movs"""


def lad(v):
    return movs(v).withColumns({"blade_hz": 100.0 + F.col("bin") * 10.0 + F.col("rev"), "comb_strength": F.col("n_events") / 100.0,
                                "detected": F.col("n_events") >= 13})


@query("rec_id rev:l bin:i matches_template:b", """SELECT l.*, detected AND abs(blade_hz - template_hz) <= 0.15*template_hz AS matches_template FROM lad l JOIN
  (SELECT rec_id, blade_hz AS template_hz FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY comb_strength DESC, rev, bin) AS rn FROM lad WHERE detected) WHERE rn=1) USING (rec_id)""",
       views={**DETS, "lad": LAD})
def template_match(v):
    d = cut_lineage(lad(v))
    return tk.template_match(d, tk.strongest_cell(d, ["rec_id"]), ["rec_id"], 0.15)


@query("rec_id rev:l bin:i template_hz:d comb_strength:d", """SELECT *, blade_hz AS template_hz FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY comb_strength DESC, rev, bin) AS rn FROM lad WHERE detected) WHERE rn=1""",
       views={**DETS, "lad": LAD})
def strongest_cell(v):
    return tk.strongest_cell(lad(v), ["rec_id"])


@query("rec_id rev:l cluster:l bin:i bearing_deg:d4 n_events:l detected:b", """SELECT rec_id, rev, cluster, arg_max(bin, comb_strength*100000 - bearing_deg/1000) AS bin, sum(bearing_deg*n_events)/sum(n_events) AS bearing_deg,
   sum(n_events) AS n_events, bool_or(detected) AS detected FROM (SELECT *, sum(CASE WHEN bearing_deg - pb > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, rev ORDER BY bearing_deg) AS cluster FROM
   (SELECT *, lag(bearing_deg) OVER (PARTITION BY rec_id, rev ORDER BY bearing_deg) AS pb FROM lad)) GROUP BY ALL""", views={**DETS, "lad": LAD})
def fuse_split_cells(v):
    return tk.fuse_split_cells(lad(v), ["rec_id", "rev"], 30.0)


@query("rec_id rev:l bin:i n_events:l", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, rev ORDER BY n_events DESC, bearing_deg) AS rn FROM movs) WHERE rn = 1", views=DETS)
def densest_track(v):
    return tk.densest_track(movs(v))


CLU = """SELECT *, sum(CASE WHEN bearing_deg - pb > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY bearing_deg, rev, bin) AS cluster FROM
   (SELECT *, lag(bearing_deg) OVER (PARTITION BY rec_id ORDER BY bearing_deg, rev, bin) AS pb FROM movs WHERE above_horizon)"""
SUMM = """SELECT * FROM (SELECT rec_id, cluster, median(bearing_deg) AS bearing_deg, median(elev_deg) AS elev_deg, median(range_m) AS range_m, quantile_cont(range_m,0.25) AS range_p25_m,
   quantile_cont(range_m,0.75) AS range_p75_m, count(*) AS n_detections FROM clu GROUP BY ALL) JOIN (SELECT rec_id, cluster, count(*) AS n_revs, max(b)-min(b) AS drift_deg FROM
   (SELECT rec_id, cluster, rev, median(bearing_deg) AS b FROM clu GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 2) USING (rec_id, cluster)"""
_SC = "rec_id cluster:l bearing_deg:d elev_deg:d range_m:d range_p25_m:d range_p75_m:d n_detections:l n_revs:l drift_deg:d"


@query(_SC + " rank:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n_revs DESC, cluster) AS rank FROM summ) WHERE rank <= 4",
       views={**DETS, "clu": CLU, "summ": SUMM})
def persistent_candidates(v):
    return tk.persistent_candidates(movs(v), 2.5, 2, 4)


@query(_SC + " translating:b", "SELECT *, drift_deg > 5 AS translating FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n_revs DESC, cluster) AS rank FROM summ) WHERE rank = 1",
       views={**DETS, "clu": CLU, "summ": SUMM})
def primary_mover(v):
    return tk.primary_mover(movs(v), gate_deg=2.5)


@query("n_files:l n_present:l consistent:b bearings_agree:b bearing_spread_deg:d", """SELECT count(*) AS n_files, count(bearing_deg) AS n_present, count(*)=count(bearing_deg) AS consistent, max(d) <= 10 AS bearings_agree, max(d) AS bearing_spread_deg FROM
  (SELECT *, abs(bearing_deg - (SELECT arg_min(bearing_deg, rec_id) FROM summ)) AS d FROM (SELECT DISTINCT rec_id FROM px_events) LEFT JOIN summ USING (rec_id))""",
       views={**DETS, "clu": "SELECT *, 0 AS cluster FROM movs WHERE above_horizon AND bearing_deg BETWEEN 100 AND 200", "summ": SUMM})
def multifile_consistency(v):
    recs = v.px_events.select("rec_id").distinct()
    return tk.multifile_consistency(tk.primary_mover(movs(v), (100.0, 200.0)), recs, 10.0)


# ------------------------------------------------------------------ geometry
def _optics_recs(v):
    r = v.px_events.groupBy("rec_id").agg(F.count("*").alias("n"))
    wide = r.select("rec_id", F.lit("genx320").alias("sensor"), F.col("rec_id").alias("camera"))
    hd = r.select(F.concat("rec_id", F.lit("hd")).alias("rec_id"), F.lit("imx636").alias("sensor"), F.lit("wide").alias("camera"))
    return wide.unionByName(hd).withColumns({"fov_deg": F.lit(None).cast("double"), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})


@query("rec_id sensor width_px:i height_px:i fov_h_deg:d fov_v_deg:d focal_px:d focal_px_optics:d deg_per_px:d", """SELECT rec_id, sensor, w AS width_px, h AS height_px, f AS fov_h_deg, degrees(2*atan(tan(radians(f)/2)*h/w)) AS fov_v_deg,
   w/2.0/tan(radians(f)/2) AS focal_px, mm/(pitch*1e-3) AS focal_px_optics, f/w AS deg_per_px FROM
  (SELECT DISTINCT rec_id, 'genx320' AS sensor, 320 AS w, 320 AS h, CASE WHEN rec_id='cam1' THEN 50.0::DOUBLE ELSE 58.0::DOUBLE END AS f, 1.8::DOUBLE AS mm, 6.3::DOUBLE AS pitch FROM px_events UNION ALL
   SELECT DISTINCT rec_id || 'hd', 'imx636', 1280, 720, degrees(2*atan2(1280*4.86*1e-3/2, 8.0)), 8.0, 4.86 FROM px_events)""")
def optics_dimension(v):
    return geo.optics_dimension(_optics_recs(v))


@query("rec_id target_id:l step:l azimuth_deg:d elev_deg:d apparent_px:d range_m:d rel_distance:d", "SELECT * FROM dets", views=DETS)
def localize_detections(v):
    return dets(v)


@query("rec_id size_m:d distance_m:d n_px:d inverse_range_m:d implied_size_m:d angular_deg:d angular_exact_deg:d ifov_mrad:d ifov_exact_mrad:d gsd_m:d gsd_exact_m:d",
       """SELECT *, n_px*D/f AS implied_size_m, L*f/n_px AS inverse_range_m, n_px*dpp AS angular_deg, degrees(2*atan(n_px/(2*f))) AS angular_exact_deg, radians(dpp)*1e3 AS ifov_mrad,
   2*atan(1/(2*f))*1e3 AS ifov_exact_mrad, D*radians(dpp) AS gsd_m, D/f AS gsd_exact_m FROM (SELECT r.rec_id, L AS size_m, D AS distance_m, L, D, w/2.0/tan(radians(fov)/2) AS f, fov/w AS dpp, L*(w/2.0/tan(radians(fov)/2))/D AS n_px FROM
   (SELECT DISTINCT rec_id, 320 AS w, CASE WHEN rec_id='cam1' THEN 50.0::DOUBLE ELSE 58.0::DOUBLE END AS fov FROM px_events) r, unnest([0.2::DOUBLE,0.35::DOUBLE,1.0::DOUBLE]) a(L), unnest([5.0::DOUBLE,20.0::DOUBLE,80.0::DOUBLE]) b(D))""")
def pixels_on_target(v):
    o = geo.optics_dimension(_optics_recs(v)).where("sensor = 'genx320'")
    return geo.pixels_on_target(o, [0.2, 0.35, 1.0], [5.0, 20.0, 80.0])


@query("rec_id target_id:l step:l task n_px:d max_range_m:d", f"""SELECT rec_id, target_id, step, task, n_px, apparent_px/100.0*{FOC}/n_px AS max_range_m FROM dets,
   (VALUES ('detection', 2.0::DOUBLE), ('orientation', 2.8::DOUBLE), ('recognition', 8.0::DOUBLE), ('identification', 12.8::DOUBLE)) z(task, n_px)""", views=DETS)
def perception_ranges(v):
    return geo.perception_ranges(dets(v).withColumn("size_m", F.col("apparent_px") / 100.0), 50.0, 32)


_FV = "degrees(2*atan(tan(radians({f})/2)*{h}/{w}))"


@query("rec_id step:l mode mx0:d my0:d mx1:d my1:d", f"""WITH s AS (SELECT *, 10.0 + area/10.0 AS rng FROM steps),
   d AS (SELECT *, 160 + (x0-16.0)*(50.0/32)/(58.0/320) AS ax0, 160 + (x1-16.0)*(50.0/32)/(58.0/320) AS ax1, 120 + (y0-16.0)*(({_FV.format(f='50.0',h='32',w='32')})/32)/(({_FV.format(f='58.0',h='240',w='320')})/240) AS ay0,
     120 + (y1-16.0)*(({_FV.format(f='50.0',h='32',w='32')})/32)/(({_FV.format(f='58.0',h='240',w='320')})/240) AS ay1, 0.025*(160/tan(radians(58.0)/2))/rng AS sh FROM s)
  SELECT rec_id, step, 'fov_scale' AS mode, ax0 AS mx0, ay0 AS my0, ax1 AS mx1, ay1 AS my1 FROM d UNION ALL SELECT rec_id, step, 'parallax', ax0+sh, ay0, ax1+sh, ay1 FROM d
  UNION ALL SELECT rec_id, step, 'manual', 160+(x0-16.0)*4+2, 120+(y0-16.0)*4-1, 160+(x1-16.0)*4+2, 120+(y1-16.0)*4-1 FROM d""")
def map_views(v):
    a, b = geo.View(50.0, 32, 32), geo.View(58.0, 320, 240)
    s = v.steps.withColumn("range_m", 10.0 + F.col("area") / 10.0)
    outs = [geo.map_views(s, a, b, m, manual_dx=2.0, manual_dy=-1.0, manual_scale=4.0).withColumn("mode", F.lit(m))
            for m in ("fov_scale", "parallax", "manual")]
    return ordered.union_all(*[o.select("rec_id", "step", "mode", "mx0", "my0", "mx1", "my1") for o in outs])


@query("rec_id target_id:l step:l rotor_hz:d rpm:d4 tip_speed_mps:d tip_mach:d sweep_px_s:d3", """SELECT d.*, freq_hz/3 AS rotor_hz, freq_hz/3*60 AS rpm, pi()*0.127*freq_hz/3 AS tip_speed_mps, pi()*0.127*freq_hz/3/343.0 AS tip_mach, 360.0/per*32/50.0 AS sweep_px_s FROM dets d
  JOIN (SELECT rec_id, median(d)/1000000.0 AS per FROM (SELECT rec_id, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM pulses) GROUP BY rec_id) USING (rec_id)""", views=DETS)
def propeller_columns(v):
    d = geo.propeller_columns(dets(v), "freq_hz", 3)
    return d.join(geo.sweep_velocity(rot.rotation_period(v.pulses), 50.0, 32), "rec_id")


KF = "SELECT rec_id, step, t, x0, y0, x1, y1, CASE WHEN step % 3 = 0 THEN NULL ELSE 2.0 + step/10.0 END AS distance_m FROM steps"


def keyframes(v):
    return v.steps.withColumn("distance_m", F.when(F.col("step") % 3 != 0, 2.0 + F.col("step") / 10.0))


@query("rec_id step:l measured_px:d diag_px:d angular_size_deg:d expected_px:d implied_size_m:d gsd_m:d px_residual:d", f"""SELECT *, m AS measured_px, m*(50.0/32) AS angular_size_deg, 0.2*{FOC}/distance_m AS expected_px, m*distance_m/{FOC} AS implied_size_m,
   distance_m*radians(50.0/32) AS gsd_m, m - 0.2*{FOC}/distance_m AS px_residual FROM (SELECT *, greatest(x1-x0, y1-y0) AS m, sqrt((x1-x0)**2+(y1-y0)**2) AS diag_px FROM ({KF}))""")
def solve_keyframe(v):
    return geo.solve_keyframe(keyframes(v), 0.2, 50.0, 32)


@query("rec_id n:l size_m:d implied_mean_m:d implied_std_m:d r2:d4", f"""SELECT rec_id, n, L AS size_m, im AS implied_mean_m, isd AS implied_std_m, 1-(nn-2*L*nx+L*L*xx)/(nn-sn*sn/n) AS r2 FROM (SELECT *, nx/xx AS L FROM (SELECT rec_id, count(*) AS n, sum(N*x) AS nx, sum(x*x) AS xx, sum(N*N) AS nn,
   sum(N) AS sn, avg(N/x) AS im, stddev_pop(N/x) AS isd FROM (SELECT rec_id, CAST(greatest(x1-x0,y1-y0) AS DOUBLE) AS N, {FOC}/distance_m AS x FROM ({KF}) WHERE distance_m > 0) GROUP BY rec_id))""")
def fit_target_size(v):
    from ..functions.angles import focal_px
    p = keyframes(v).select("rec_id", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double").alias("n_px"),
                            "distance_m", F.lit(focal_px(50.0, 32)).alias("focal_px"))
    return geo.fit_target_size(p, ["rec_id"])


@query("rec_id target_id:l step:l x0:d x1:d", """SELECT q.rec_id, q.target_id, q.step, CASE WHEN s.t IS NULL THEN hi.x0 WHEN hi.t IS NULL THEN s.x0 ELSE s.x0 + (hi.x0-s.x0)*coalesce((q.t+60000-s.t)/CAST(nullif(hi.t-s.t,0) AS DOUBLE),0) END AS x0,
   CASE WHEN s.t IS NULL THEN hi.x1 WHEN hi.t IS NULL THEN s.x1 ELSE s.x1 + (hi.x1-s.x1)*coalesce((q.t+60000-s.t)/CAST(nullif(hi.t-s.t,0) AS DOUBLE),0) END AS x1
  FROM quads q ASOF LEFT JOIN steps s ON s.rec_id=q.rec_id AND s.t <= q.t+60000 ASOF LEFT JOIN steps hi ON hi.rec_id=q.rec_id AND hi.t >= q.t+60000""")
def interpolate_box(v):
    q = v.quads.withColumn("t", F.col("t") + 60_000).select("rec_id", "target_id", "step", "t")
    return geo.interpolate_box(q, v.steps, ["rec_id"])


@query("rec_id target_id:l signature n:l", """SELECT rec_id, target_id, s AS signature, count(*) AS n FROM dets JOIN (VALUES ('drone',80,800,4.0,true),('insect',30,250,3.0,false),('mosquito',300,800,3.0,true),('hummingbird',15,120,3.0,false),('bird',3,30,2.5,false),('custom',10,1000,4.0,false)) z(s,lo,hi,g,h)
  ON freq_hz BETWEEN lo AND hi AND snr >= g AND harmonic >= CASE WHEN h THEN 0.34 ELSE 0 END GROUP BY ALL""", views=DETS)
def signature_library(v):
    j = tables.match_signatures(dets(v))
    return j.groupBy("rec_id", "target_id", "signature").agg(F.count("*").alias("n"))


@query("rec_id target_id:l step:l azimuth_deg:d4 elev_deg:d range_m:d altitude_z_m:d", f"""SELECT q.*, a - floor(a/360.0)*360.0 AS azimuth_deg, (16.0-cy)*(50.0/32) AS elev_deg, 0.2*{FOC}/greatest(dy,1) AS range_m, 0.2*{FOC}/greatest(dy,1)*tan(radians((16.0-cy)*(50.0/32))) AS altitude_z_m FROM
   (SELECT q.*, (m.u + coalesce((m.u2-m.u)*((q.t-m.t)/CAST(m.t2-m.t AS DOUBLE)),0)) - (cx-16.0)*(50.0/32) AS a FROM quads q ASOF JOIN (SELECT *, lead(u) OVER (PARTITION BY rec_id ORDER BY t) AS u2, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS t2 FROM az_u) m
    ON q.rec_id=m.rec_id AND q.t >= m.t) q""", views=BASE)
def build_trajectory(v):
    return geo.build_trajectory(v.quads, v.telemetry, 50.0, 32, 32, 0.2)


# ------------------------------------------------------------------ metrics
COV = """SELECT rec_id, 360.0 AS azimuth_deg, hi-lo AS elev_band_deg, om AS solid_angle_sr, 100*om/(4*pi()) AS sphere_pct, om/(radians(50.0)*2*sin(radians(25.0))) AS gain_vs_static, period_s, n_revolutions, 1/period_s AS update_rate_hz FROM
  (SELECT *, radians(360.0)*(sin(radians(hi))-sin(radians(lo))) AS om FROM (SELECT rec_id, quantile_cont((16.0-y)*(50.0/32), 0.01) AS lo, quantile_cont((16.0-y)*(50.0/32), 0.99) AS hi FROM px_events GROUP BY rec_id))
  JOIN (SELECT rec_id, median(d)/1000000.0 AS period_s, max(k) AS n_revolutions FROM (SELECT rec_id, k, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM pulses) GROUP BY rec_id) USING (rec_id)"""
_CC = "rec_id azimuth_deg:d elev_band_deg:d solid_angle_sr:d sphere_pct:d gain_vs_static:d period_s:d n_revolutions:l update_rate_hz:d"


@query(_CC, COV)
def coverage_metrics(v):
    return kpi.coverage_metrics(v.px_events, 50.0, 32, 32, v.pulses)


@query("rec_id n_points:l bearing_std_deg:d elev_median_deg:d elev_std_deg:d range_median_m:d range_p25_m:d range_p75_m:d", """SELECT rec_id, count(*) AS n_points, stddev_pop(azimuth_deg) AS bearing_std_deg, median(elev_deg) AS elev_median_deg,
   stddev_pop(elev_deg) AS elev_std_deg, median(range_m) AS range_median_m, quantile_cont(range_m,0.25) AS range_p25_m, quantile_cont(range_m,0.75) AS range_p75_m FROM dets GROUP BY rec_id""", views=DETS)
def localization_metrics(v):
    return kpi.localization_metrics(dets(v), ["rec_id"])


@query(_CC + " n_passes:l bearing_se_deg:d5 elev_median_deg:d5 elev_std_deg:d5 range_median_m:d5 range_p25_m:d5 range_p75_m:d5 passes_per_rev:d", f"""SELECT *, n_passes/CAST(greatest(n_revolutions,1) AS DOUBLE) AS passes_per_rev FROM ({COV}) JOIN (SELECT rec_id, count(*) AS n_passes, median(bearing_se_deg) AS bearing_se_deg, median(elev_deg) AS elev_median_deg,
   stddev_pop(elev_deg) AS elev_std_deg, median(range_m) AS range_median_m, quantile_cont(range_m,0.25) AS range_p25_m, quantile_cont(range_m,0.75) AS range_p75_m FROM passes GROUP BY rec_id) USING (rec_id)""", views=DETS)
def rotation_metrics(v):
    p = mv.per_pass_centroids(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 0.2)
    return kpi.rotation_metrics(v.px_events, p, v.pulses, 50.0, 32, 32)


@query("rec_id n_tracks:l n_sustained:l longest_s:d mean_s:d total_points:l n_blade:l median_blade_hz:d rel_min:d rel_max:d", """SELECT g.*, rel_min, rel_max FROM (SELECT rec_id, count(*) AS n_tracks, count(*) FILTER (WHERE dur >= 0.5) AS n_sustained, max(dur) AS longest_s, avg(dur) AS mean_s, sum(n) AS total_points, count(b) AS n_blade, median(b) AS median_blade_hz
   FROM (SELECT rec_id, target_id, max(t_s)-min(t_s) AS dur, count(*) AS n, max(freq_hz) AS b FROM dets GROUP BY ALL) GROUP BY rec_id) g JOIN
  (SELECT rec_id, quantile_cont(rel_distance,0.05) AS rel_min, quantile_cont(rel_distance,0.95) AS rel_max FROM dets GROUP BY rec_id) USING (rec_id)""", views=DETS)
def effectiveness_summary(v):
    return kpi.effectiveness_summary(dets(v).withColumn("blade_hz", F.col("freq_hz")))


ROLL = """SELECT *, greatest(least(0.35*least(n/8.0,1.0)+0.35*tanh(mean_snr/8.0)+0.15*freq_stability+0.15*mean_harmonic,1),0) AS confidence FROM (SELECT rec_id, target_id, count(*) AS n, max(t_s)-min(t_s) AS duration_s, median(freq_hz) AS median_freq_hz,
   CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, 1-stddev_pop(freq_hz)/median(freq_hz)) END AS freq_stability, avg(snr) AS mean_snr, avg(harmonic) AS mean_harmonic FROM dets GROUP BY ALL)"""
_RC = "rec_id target_id:l n:l duration_s:d median_freq_hz:d freq_stability:d mean_snr:d mean_harmonic:d confidence:d"


@query(_RC, ROLL, views=DETS)
def target_rollup(v):
    return kpi.target_rollup(dets(v), ["rec_id", "target_id"])


@query("rec_id target_id:l step:l apparent_px:d freq_hz:d confidence:d", "SELECT d.*, confidence FROM dets d JOIN roll USING (rec_id, target_id)", views={**DETS, "roll": ROLL})
def detections_table(v):
    d = dets(v).withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("dx"), "y1": F.col("dy")})
    return kpi.detections_table(d, ["rec_id", "target_id"])


TRNG = f"""SELECT rec_id, count(range_m) AS n_detections, max(range_m) AS measured_max_range_m, min(apparent_px) AS measured_min_px, 0.2*{FOC}/sqrt(60.0) AS capability_range_m, 0.2*{FOC}/max(range_m) AS effective_track_px,
   0.2*{FOC}/2.0 AS detection_m, 0.2*{FOC}/2.8 AS orientation_m, 0.2*{FOC}/8.0 AS recognition_m, 0.2*{FOC}/12.8 AS identification_m, 'ok' AS status FROM dets GROUP BY rec_id"""


@query("rec_id n_detections:l measured_max_range_m:d measured_min_px:d capability_range_m:d effective_track_px:d detection_m:d orientation_m:d recognition_m:d identification_m:d status", TRNG, views=DETS)
def tracking_range(v):
    return kpi.tracking_range(dets(v), ["rec_id"], 0.2, 50.0, 32)


PFR = f"""SELECT rec_id, target_id, n, CASE WHEN n>=2 AND r1>r0 AND b < -1e-3 THEN 'snr_fit' WHEN n=1 THEN 'snr_inverse_square' ELSE 'pixels_on_target' END AS model,
   CASE WHEN n>=2 AND r1>r0 AND b < -1e-3 THEN exp((ln(4.0)-a)/b) WHEN n=1 THEN dm*sqrt(sm/4.0) ELSE 0.2*{FOC}/8 END AS capability_range_m, CASE WHEN n>=2 AND r1>r0 AND b < -1e-3 THEN b WHEN n=1 THEN -2.0 END AS slope,
   CASE WHEN n>=2 AND r1>r0 THEN q END AS r2, n_resolved, mx AS measured_max_range_m FROM (SELECT {{k}}, count(*) AS n, min(range_m) AS r0, max(range_m) AS r1, regr_slope(ln(snr), ln(range_m)) AS b, regr_intercept(ln(snr), ln(range_m)) AS a,
   regr_r2(ln(snr), ln(range_m)) AS q, median(range_m) AS dm, median(snr) AS sm, count(*) FILTER (WHERE snr >= 4.0) AS n_resolved, max(range_m) FILTER (WHERE snr >= 4.0) AS mx FROM dets GROUP BY {{k}})"""


@query("rec_id target_id:l n:l model capability_range_m:d4 slope:d4 r2:d n_resolved:l measured_max_range_m:d", PFR.format(k="rec_id, target_id"), views=DETS)
def prop_frequency_range(v):
    return kpi.prop_frequency_range(dets(v), ["rec_id", "target_id"], 4.0, 0.2, 50.0, 32)


TTC = """SELECT {k}, count(*) AS n, max(range_m) AS detect_range_m, max(range_m)/15.0 AS nominal_ttc_s, max(range_m)/5.0 AS ttc_5mps_s, max(range_m)/20.0 AS ttc_20mps_s, CASE WHEN -regr_slope(range_m, t_s) > 1e-6 THEN -regr_slope(range_m, t_s) END AS closing_speed_mps,
   CASE WHEN -regr_slope(range_m, t_s) > 1e-6 THEN arg_min(range_m, t_s)/-regr_slope(range_m, t_s) END AS ttc_first_s, CASE WHEN -regr_slope(range_m, t_s) > 1e-6 THEN min(range_m)/-regr_slope(range_m, t_s) END AS ttc_min_s FROM {src} GROUP BY {k}"""


@query("rec_id target_id:l n:l detect_range_m:d nominal_ttc_s:d ttc_5mps_s:d ttc_20mps_s:d closing_speed_mps:d ttc_first_s:d2 ttc_min_s:d2", TTC.format(k="rec_id, target_id", src="dets"), views=DETS)
def time_to_contact(v):
    d = dets(v).withColumn("_d", F.col("range_m"))
    return kpi.time_to_contact(d, ["rec_id", "target_id"], "_d")


@query("rec_id n_detections:l capability_range_m:d measured_max_range_m:d freq_model freq_range_m:d4 primary_id:l nominal_ttc_s:d closing_speed_mps:d ttc_first_s:d2", """SELECT t.rec_id, n_detections, t.capability_range_m, t.measured_max_range_m, p.model AS freq_model, p.capability_range_m AS freq_range_m, pid AS primary_id, nominal_ttc_s, closing_speed_mps, ttc_first_s
  FROM trng t JOIN pfr p USING (rec_id) JOIN prim USING (rec_id) JOIN ttc USING (rec_id)""",
       views={**DETS, "roll": ROLL, "trng": TRNG, "pfr": PFR.format(k="rec_id").replace("rec_id, target_id, n, CASE", "rec_id, n, CASE"),
              "prim": "SELECT rec_id, target_id AS pid FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(confidence,9) DESC, n DESC, target_id) AS rn FROM roll) WHERE rn=1",
              "pdet": "SELECT d.* FROM dets d JOIN prim ON d.rec_id=prim.rec_id AND d.target_id=prim.pid", "ttc": TTC.format(k="rec_id", src="pdet")})
def kpi_report(v):
    return kpi.kpi_report(dets(v), 0.2, 50.0, 32)


@query("rec_id target_id:l step:l true_range_m:d range_error_m:d", """SELECT d.*, tr AS true_range_m, range_m - tr AS range_error_m FROM (SELECT d.*, CASE WHEN lo.t IS NULL THEN hi.cx WHEN hi.t IS NULL THEN lo.cx ELSE lo.cx+(hi.cx-lo.cx)*coalesce((d.t+60000-lo.t)/CAST(nullif(hi.t-lo.t,0) AS DOUBLE),0) END AS tr
  FROM dets d ASOF LEFT JOIN steps lo ON lo.rec_id=d.rec_id AND lo.t <= d.t+60000 ASOF LEFT JOIN steps hi ON hi.rec_id=d.rec_id AND hi.t >= d.t+60000) d""", views=DETS)
def ground_truth_join(v):
    return kpi.ground_truth_join(dets(v).withColumn("t", F.col("t") + 60_000), v.steps.select("rec_id", "t", F.col("cx").alias("true_range_m")), ["rec_id"])


@query("rec_id target_id:l step:l distance_m:d", """SELECT d.*, 5.0 + (greatest(least(rel_distance,b),a)-a)/(b-a)*35.0 AS distance_m FROM dets d JOIN (SELECT rec_id, quantile_cont(rel_distance,0.01) AS a, quantile_cont(rel_distance,0.99) AS b FROM dets GROUP BY rec_id) USING (rec_id)""", views=DETS)
def calibrate_range(v):
    return kpi.calibrate_range(dets(v), ["rec_id"], 5.0, 40.0)


@query("rec_id target_id:l step:l coverage:d jitter:d snr_term:d lock:d", """SELECT a.*, 0.5*snr_term + 0.3/(1+jitter/5) + 0.2*coverage AS lock FROM (SELECT rec_id, target_id, step, least(n/4.0, 1.0) AS coverage, CASE WHEN n >= 3 THEN sqrt(vx+vy) ELSE 0 END AS jitter, least(snr/8.0,1.0) AS snr_term FROM
   (SELECT a.rec_id, a.target_id, a.step, any_value(a.snr) AS snr, count(*) AS n, var_pop(b.ddx) FILTER (WHERE b.pt >= a.t - 1000000) AS vx, var_pop(b.ddy) FILTER (WHERE b.pt >= a.t - 1000000) AS vy FROM dets a JOIN
    (SELECT *, cx - lag(cx) OVER w AS ddx, cy - lag(cy) OVER w AS ddy, lag(t) OVER w AS pt FROM dets WINDOW w AS (PARTITION BY rec_id, target_id ORDER BY t)) b ON a.rec_id=b.rec_id AND a.target_id=b.target_id AND b.t BETWEEN a.t-1000000 AND a.t GROUP BY ALL)) a""", views=DETS)
def lock_score(v):
    return kpi.lock_score(dets(v), ["rec_id", "target_id"], 4.0)


# ------------------------------------------------------------------ editing
EV = "rec_id seq:l x:i y:i p:i t:l"


@query(EV, """SELECT rec_id, seq, x, y, p, greatest(t-o,0) AS t FROM px_events JOIN (SELECT rec_id, min(t) AS o FROM px_events WHERE t >= 5000000 AND t < 20000000 GROUP BY rec_id) USING (rec_id)
  WHERE t >= 5000000 AND t < 20000000 AND x >= 4 AND x < 20 AND y >= 4 AND y < 28""")
def cut_clip(v):
    return ed.cut_clip(v.px_events, 5.0, 20.0, (4, 4, 20, 28))


@query("rec_id n_events:l last_t:l kept_s:d src_duration_s:d", f"""SELECT rec_id, count(*) FILTER (WHERE t >= 3000000 AND t < 21000000) AS n_events, max(t-3000000) FILTER (WHERE t >= 3000000 AND t < 21000000) AS last_t, greatest(21.0 - greatest(3.0, min(t)/1000000.0),0) AS kept_s, (max(t)-min(t))/1000000.0 AS src_duration_s FROM px_events GROUP BY rec_id""")
def trim_batch(v):
    return ed.trim_batch(v.px_events, 3.0, 21.0)


_ST = "SELECT {i} AS segment, * FROM px_events WHERE rec_id='{r}' AND t >= {a} AND t < {b}"


@query("segment:i seq:l x:i y:i p:i t:l", """WITH s AS (SELECT *, true AS k FROM s0 UNION ALL SELECT *, x >= 8 AND x < 24 AND y >= 8 AND y < 24 FROM s1 UNION ALL SELECT *, true FROM s2),
  h AS (SELECT segment, min(t) AS o, max(t) FILTER (WHERE k) - min(t) + 250000 AS st FROM s GROUP BY segment),
  c AS (SELECT segment, o, coalesce(sum(st) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS cur FROM h)
  SELECT segment, seq, x, y, p, t - o + cur AS t FROM s JOIN c USING (segment) WHERE k""",
       views={"s0": _ST.format(i=0, r="cam0", a=0, b=9000000), "s1": _ST.format(i=1, r="cam1", a=4000000, b=30000000), "s2": _ST.format(i=2, r="cam0", a=9000000, b=40000000)})
def stitch_clips(v):
    return ed.stitch_clips(v.px_events, [("cam0", 0.0, 9.0), ("cam1", 4.0, 30.0, (8, 8, 24, 24)), ("cam0", 9.0, 40.0)], 0.25)


@query("cell:i pass:l seq:l x:i y:i p:i t:l", f"""SELECT cell, pass, seq, rx + (x*48)//32 AS x, (y*48)//32 AS y, p, CAST(greatest(round_even(off*1000000 + (t-t0)/sc, 0), 0) AS BIGINT) AS t FROM
  (SELECT *, t0 AS tz, off0 + pass*dur/sc AS off FROM (SELECT c.*, e.seq, e.x, e.y, e.p, e.t, s.t0, (s.t1-s.t0)/1000000.0 AS dur, unnest(range(0, CASE WHEN lp THEN CAST(greatest(ceil((70.0-off0)/((s.t1-s.t0)/1000000.0/sc)),1) AS BIGINT) ELSE 1 END)) AS pass
   FROM px_events e JOIN {SPAN.format(src='px_events')} s USING (rec_id) JOIN (VALUES (0,'cam0',0,1.5::DOUBLE,1.0::DOUBLE,false),(1,'cam1',48,0.0::DOUBLE,2.0::DOUBLE,true)) c(cell,rec_id,rx,off0,sc,lp) USING (rec_id)))
  WHERE least(dur, (70.0-off)*sc) > greatest(0, -off*sc) AND (t-t0) >= round_even(greatest(0,-off*sc)*1000000,0) AND ((70.0-off)*sc >= dur OR (t-t0) < round_even((70.0-off)*sc*1000000,0))""")
def composite_canvas(v):
    cells = [ed.Cell("cam0", (0, 0, 48, 48), 1.5), ed.Cell("cam1", (48, 0, 48, 48), 0.0, 2.0, True)]
    return ed.composite_canvas(v.px_events, cells, 96, 48, (32, 32), 70.0)


@query("kind rec_id i:l t:l amp:d", """WITH pl AS (SELECT s.rec_id, 'mic' || right(s.rec_id,1) AS mic, 1.25 AS lo, least((t1-t0)/1000000.0, 1.25 + a) AS hi FROM (SELECT rec_id, min(t) AS t0, max(t) AS t1 FROM px_events GROUP BY rec_id) s
    JOIN (SELECT rec_id AS mic, count(*)/8000.0 AS a FROM audio GROUP BY rec_id) q ON q.mic = 'mic' || right(s.rec_id,1)),
  ev AS (SELECT e.* FROM px_events e JOIN pl USING (rec_id) WHERE t >= round_even(lo*1000000,0) AND t < round_even(hi*1000000,0))
  SELECT 'events' AS kind, rec_id, seq AS i, t - min(t) OVER (PARTITION BY rec_id) AS t, NULL AS amp FROM ev UNION ALL
  SELECT 'audio', pl.rec_id, i, NULL, amp FROM audio a JOIN pl ON pl.mic=a.rec_id WHERE i < round_even((hi-1.25)*8000,0)""")
def aligned_pair(v):
    plan = v.px_events.select("rec_id").distinct().select("rec_id", F.concat(F.lit("mic"), F.substring("rec_id", 4, 1)).alias("audio_id"),
                                                          F.lit(1.25).alias("offset_s"))
    e, a = ed.aligned_pair(v.px_events, v.audio, 8000, plan)
    e = e.select(F.lit("events").alias("kind"), "rec_id", F.col("seq").alias("i"), "t", F.lit(None).cast("double").alias("amp"))
    return e.unionByName(a.select(F.lit("audio").alias("kind"), "rec_id", "i", F.lit(None).cast("long").alias("t"), "amp"))

