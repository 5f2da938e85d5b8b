"""Queries for the rotor ladder, contrast maximisation and audio fusion."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spectral import harmonic_comb as comb
from ..operators import contrast as cm, detect as dt, fusion as fu, ladder as ld, rotation as rot
from ..session import cut_lineage
from .movers_catalog import MV
from .registry import query
from .tracks_catalog import DETS, dets

# ------------------------------------------------------------------ overtones
SPEC = {"spow": "SELECT vec_id, n AS k, v*v + 0.001 AS p, 20.0*n AS hz FROM series64"}


def spec(v):
    """Each vector squared, read as a 64-bin spectrum with 20 Hz spacing."""
    return v.series64.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("n", (F.col("v") * F.col("v") + 0.001).alias("p")))).alias("a")) \
        .select("vec_id", F.transform("a", lambda s: s["p"]).alias("power"))


@query("vec_id:l f0:d harmonic:d", """SELECT vec_id, f0, CASE WHEN count(*) FILTER (WHERE m >= 2 AND ok) = 0 THEN 0 ELSE count(*) FILTER (WHERE m >= 2 AND ok AND v > 0.25*base)/CAST(count(*) FILTER (WHERE m >= 2 AND ok) AS DOUBLE) END AS harmonic FROM
  (SELECT *, max(v) FILTER (WHERE m=1) OVER (PARTITION BY vec_id) AS base FROM (SELECT s.vec_id, f0, m, m*f0 <= 1000 AS ok, max(p) FILTER (WHERE hz > m*f0 - 31 AND hz < m*f0 + 51) AS v FROM spow s JOIN
    (SELECT vec_id, hz AS f0 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS rn FROM spow WHERE k BETWEEN 4 AND 20) WHERE rn=1) USING (vec_id), range(1,5) q(m) GROUP BY ALL)) GROUP BY vec_id, f0""", views=SPEC)
def harmonic_comb(v):
    s = spec(v)
    band = F.slice("power", 5, 17)
    s = s.withColumn("f0", (F.array_position(band, F.array_max(band)) + 3) * 20.0)
    return s.withColumn("harmonic", comb(F.col("power"), F.lit(20.0), F.col("f0"), 1000.0))


@query("vec_id:l f0:d snr:d5 harm:d", """WITH c AS (SELECT vec_id, i, h, 200+i*5.0 AS f, coalesce(CASE WHEN pos <= 63 THEN a.p + (coalesce(b.p,a.p)-a.p)*(pos-floor(pos)) END, 0) AS val FROM
    (SELECT vec_id, i, h, h*(200+i*5.0)/20.0 AS pos FROM (SELECT DISTINCT vec_id FROM spow), range(0,41) q(i), range(1,6) z(h)) g LEFT JOIN spow a USING (vec_id) LEFT JOIN spow b ON b.vec_id=a.vec_id AND b.k=a.k+1 WHERE a.k = least(floor(pos), 63)),
  s AS (SELECT vec_id, i, f, round(sum(val),15) AS sc FROM c GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, i) AS rn FROM s),
  fl AS (SELECT vec_id, median(p)+1e-30 AS fl FROM spow WHERE hz BETWEEN 160 AND 1100 GROUP BY vec_id)
  SELECT c.vec_id, c.f AS f0, sum(val)/(any_value(fl)*5) AS snr, count(*) FILTER (WHERE val > 3*fl) AS harm FROM c JOIN b ON b.vec_id=c.vec_id AND b.i=c.i AND rn=1 JOIN fl ON fl.vec_id=c.vec_id GROUP BY c.vec_id, c.f""", views=SPEC)
def harmonic_f0(v):
    return fu.harmonic_f0(spec(v), F.lit(20.0), (200.0, 400.0), (160.0, 1100.0), 5, 5.0)


# ------------------------------------------------------------------ ladder
LADV = {
    **MV, "lc": """SELECT w.*, least(CAST(floor(az/30) AS BIGINT),11) AS bin FROM wrev w""",
    "ls": """SELECT rec_id, rev, bin, count(*) AS n, quantile_cont(x,0.005) AS lo, quantile_cont(x,0.995) AS hi, greatest(CAST(floor(quantile_cont(x,0.995)-quantile_cont(x,0.005)+1e-9) AS BIGINT),8) AS nb FROM lc GROUP BY ALL HAVING count(*) >= 12""",
    "lh": """SELECT g.rec_id, g.rev, g.bin, g.nb, g.b, coalesce(c,0) AS h FROM (SELECT rec_id, rev, bin, nb, unnest(range(0,nb)) AS b FROM ls WHERE hi-lo >= 3) g LEFT JOIN
        (SELECT rec_id, rev, bin, least(CAST(floor((x-lo)/(hi-lo)*nb+1e-9) AS BIGINT), nb-1) AS b, count(*) AS c FROM lc JOIN ls USING (rec_id, rev, bin) WHERE x BETWEEN lo AND hi GROUP BY ALL) q USING (rec_id, rev, bin, b)""",
    "lz": "SELECT *, h - avg(h) OVER w AS v, avg(h) OVER w AS mu FROM lh WINDOW w AS (PARTITION BY rec_id, rev, bin)",
    "la": """SELECT a.rec_id, a.rev, a.bin, any_value(a.nb) AS nb, b.b-a.b AS lag, sum(a.v*b.v) AS s FROM lz a JOIN lz b ON a.rec_id=b.rec_id AND a.rev=b.rev AND a.bin=b.bin AND b.b >= a.b GROUP BY ALL""",
    "lac": "SELECT a.*, round(a.s/z.s, 10) AS acf FROM la a JOIN la z ON a.rec_id=z.rec_id AND a.rev=z.rev AND a.bin=z.bin AND z.lag=0 WHERE z.s > 1e-12",
    "lsw": """SELECT rec_id, 360.0/per*32/50.0 AS v, greatest(round_even(360.0/per*32/50.0/80.0,0),2) AS l0, round_even(360.0/per*32/50.0/10.0,0) AS l1 FROM (SELECT rec_id, median(d)/1000000.0 AS per FROM
        (SELECT rec_id, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM pulses) GROUP BY rec_id)""",
    "le": """SELECT a.*, v, least(l1, a.nb-1) AS hi, l0, (SELECT round(avg(m.acf),9) FROM lac m WHERE m.rec_id=a.rec_id AND m.rev=a.rev AND m.bin=a.bin AND m.lag IN (a.lag, 2*a.lag, 3*a.lag)) AS en,
        lag(acf) OVER w AS pa, lead(acf) OVER w AS na FROM lac a JOIN lsw USING (rec_id) WINDOW w AS (PARTITION BY rec_id, rev, bin ORDER BY lag)""",
    "lp": "SELECT *, max(acf) OVER (PARTITION BY rec_id, rev, bin) AS mx FROM le WHERE lag >= l0 AND lag <= least(hi, nb-2) AND hi > l0 AND acf > 0 AND acf >= pa AND acf >= na",
    "lb": """SELECT rec_id, rev, bin, lag, en, v FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, rev, bin ORDER BY pri, o1, lag) AS rn FROM
        (SELECT rec_id, rev, bin, lag, en, v, CASE WHEN en > 0 THEN 0 ELSE 1 END AS pri, CASE WHEN en > 0 THEN lag ELSE -en END AS o1 FROM lp WHERE acf >= 0.6*mx UNION ALL
         SELECT rec_id, rev, bin, lag, en, v, 2, -en FROM le WHERE lag >= l0 AND lag <= hi AND hi > l0)) WHERE rn = 1""",
}


@query("rec_id rev:l bin:l n_events:l gappiness:d step_px:d blade_hz:d1 comb_strength:d3 detected:b", """SELECT s.rec_id, s.rev, s.bin, s.n AS n_events, gap AS gappiness, lag AS step_px, round(v/lag,1) AS blade_hz, coalesce(round(greatest(en,0),3),0) AS comb_strength,
   coalesce(round(v/lag,1) BETWEEN 10 AND 80,false) AND coalesce(round(greatest(en,0),3),0) >= 0.2 AS detected FROM ls s LEFT JOIN (SELECT rec_id, rev, bin, 1 - count(*) FILTER (WHERE h > 0.15*mu)/CAST(any_value(nb) AS DOUBLE) AS gap FROM lz GROUP BY ALL) USING (rec_id, rev, bin)
   LEFT JOIN lb USING (rec_id, rev, bin)""", views=LADV)
def ladder_signature(v):
    e = ld.scan_cells(v.px_events, v.telemetry, v.pulses, 50.0, 32, 30.0)
    from ..operators.geometry import sweep_velocity
    sw = sweep_velocity(rot.rotation_period(v.pulses), 50.0, 32)
    return ld.ladder_signature(e, ["rec_id", "rev", "bin"], sw, 10.0, 80.0, min_events=12)


@query("rec_id n_passes:l blade_hz:d1 comb_strength:d3")
def accumulate_comb(v):
    e = rot.revolution_asof(v.px_events, v.pulses)
    return ld.accumulate_comb(e, ["rec_id"], "rev", 230.4, 10.0, 80.0)


def scan(v, survey=ld.scan_passes, **options):
    return survey(v.px_events, v.telemetry, v.pulses, 50.0, 32, 32, 10.0, 80.0, 30.0, 12, 0.15, 0.2, **options)


@query("rec_id rev:l cluster:l bin:l bearing_deg:d4 blade_hz:d1 n_events:l range_m:d4 rpm:d1 matches_template:b template_hz:d1 track_id:l n_passes:l omega_deg_s:d3 accumulated_blade_hz:d1 accumulated_comb_strength:d3")
def scan_rotation(v):
    return scan(v, ld.scan_rotation, gate_deg=10.0)


@query("rec_id track_id:l n_passes:l bearing_deg:d3 median_blade_hz:d1 omega_deg_s:d3")
def link_tracks(v):
    return ld.scan_tracks(scan(v), v.pulses, 10.0)


@query("rec_id n_passes:l median_blade_hz:d stability:d offset_per_rev_px:d omega_px_s:d confidence:d", """SELECT *, o/2.0 AS omega_px_s, least(least(n_passes/3.0,1)*stability,1) AS confidence, o AS offset_per_rev_px FROM (SELECT rec_id, count(*) AS n_passes, median(freq_hz) AS median_blade_hz,
   greatest(0, 1-stddev_pop(freq_hz)/median(freq_hz)) AS stability, regr_slope(cx, step) AS o FROM dets WHERE snr >= 5 GROUP BY rec_id)""", views=DETS)
def track_ladders(v):
    p = dets(v).select("rec_id", F.col("step").alias("rev"), F.col("cx").alias("x_center"), F.col("freq_hz").alias("blade_hz"), (F.col("snr") >= 5).alias("detected"))
    per = v.px_events.select("rec_id").distinct().withColumn("period_s", F.lit(2.0))
    return ld.track_ladders(p, ["rec_id"], per)


# ------------------------------------------------------------------ contrast maximisation
@query("rec_id cand:i focus:d", """SELECT rec_id, cand, sum(c*c)/1024.0 - (sum(c)/1024.0)**2 AS focus FROM (SELECT rec_id, cand, gx, gy, count(*) AS c FROM (SELECT rec_id, cand, CASE WHEN px BETWEEN 0 AND 32 THEN least(floor(px),31) END AS gx, CASE WHEN py BETWEEN 0 AND 32 THEN least(floor(py),31) END AS gy FROM
   (SELECT e.rec_id, cand, x + (cand//3-1)*20.0*(tr-t)/1000000.0 AS px, y + (cand%3-1)*20.0*(tr-t)/1000000.0 AS py FROM px_tone e JOIN (SELECT rec_id, avg(t) AS tr FROM px_tone GROUP BY rec_id) USING (rec_id), range(0,9) q(cand)))
   WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def build_iwe(v):
    ref = v.px_tone.groupBy("rec_id").agg(F.avg("t").alias("t_ref"))
    c = F.explode(F.sequence(F.lit(0), F.lit(8)))
    e = v.px_tone.join(ref, "rec_id").withColumn("cand", c).withColumns({
        "vx": (F.floor(F.col("cand") / 3) - 1) * 20.0, "vy": (F.col("cand") % 3 - 1) * 20.0, "bx0": F.lit(0), "by0": F.lit(0)})
    return cm.focus(cm.build_iwe(e, ["rec_id"], 32, 32, 0.0), ["rec_id"], 32, 32)


def velocity_views(prefix, src, k, n, vmax, levels, grid):
    """CTEs of a velocity search: {p}0 starts at rest, {p}1.. hold the sharpest candidate of each level."""
    p, span, views = prefix, 2.0 * vmax, {f"{prefix}0": f"SELECT DISTINCT {k}, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS focus FROM {src}"}
    for level in range(levels):
        step = span / (grid - 1)
        views[f"{p}{level + 1}"] = f"""SELECT {k}, vx AS cx, vy AS cy, focus FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY round(focus, 9) DESC, cand) AS rn FROM
  (SELECT {k}, cand, vx, vy, sum(c*c)/({n}*{n}.0) - (sum(c)/({n}*{n}.0))**2 AS focus FROM
   (SELECT {k}, cand, vx, vy, least(floor(ax), {n - 1}) AS gx, least(floor(ay), {n - 1}) AS gy, count(*) AS c FROM
    (SELECT *, x + vx*(t_ref-t)/1000000.0 - bx0 AS ax, y + vy*(t_ref-t)/1000000.0 - by0 AS ay FROM
     (SELECT s.*, cand, cx - {span / 2} + (cand // {grid})*{step}::DOUBLE AS vx, cy - {span / 2} + (cand % {grid})*{step}::DOUBLE AS vy
      FROM {src} s JOIN {p}{level} USING ({k}), range(0, {grid * grid}) q(cand)))
    WHERE ax BETWEEN 0 AND {n} AND ay BETWEEN 0 AND {n} GROUP BY ALL) GROUP BY {k}, cand, vx, vy)) WHERE rn = 1"""
        span = span / (grid / 2.0)
    return views


_VE = {"vsrc": "SELECT rec_id, x, y, t, 0 AS bx0, 0 AS by0, avg(t) OVER (PARTITION BY rec_id) AS t_ref FROM px_tone", **velocity_views("ve", "vsrc", "rec_id", 32, 40.0, 2, 5)}


@query("rec_id vx:d vy:d focus:d4", "SELECT rec_id, cx AS vx, cy AS vy, focus FROM ve2", views=_VE)
def estimate_velocity(v):
    e = v.px_tone.join(v.px_tone.groupBy("rec_id").agg(F.avg("t").alias("t_ref")), "rec_id").withColumns({"bx0": F.lit(0), "by0": F.lit(0)})
    return cm.estimate_velocity(e, ["rec_id"], 32, 32, 40.0, 2, 5, 0.0)


def flow(v):
    return cm.dense_flow(v.px_tone, 32, 32, 16, 40.0, levels=2, grid=3, blur=0.0)


_DF = {"dsrc": """SELECT * FROM (SELECT rec_id, y//16 AS py, x//16 AS px, x, y, t, (x//16)*16 AS bx0, (y//16)*16 AS by0, avg(t) OVER (PARTITION BY rec_id) AS t_ref,
   count(*) OVER (PARTITION BY rec_id, y//16, x//16) AS n FROM px_tone) WHERE n >= 60 AND px < 2 AND py < 2""", **velocity_views("df", "dsrc", "rec_id, py, px", 16, 40.0, 2, 3)}


@query("rec_id py:l px:l vx:d vy:d focus:d4", "SELECT rec_id, py, px, cx AS vx, cy AS vy, focus FROM df2", views=_DF)
def dense_flow(v):
    return flow(v)


@query("rec_id n:l xc:d yc:d v0x:d v0y:d omega:d", """SELECT rec_id, count(*) AS n, avg(cx) AS xc, avg(cy) AS yc, avg(dx) AS v0x, avg(dy) AS v0y, (covar_pop(cx, dy) - covar_pop(cy, dx))/(var_pop(cx)+var_pop(cy)) AS omega FROM quads GROUP BY rec_id""")
def fit_rigid_motion(v):
    q = v.quads.select("rec_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("dx").alias("vx"), F.col("dy").alias("vy"))
    return cm.fit_rigid_motion(q, ["rec_id"])


@query("rec_id step:l cx:d4 cy:d4 vx_px_s:d4 vy_px_s:d4 contrast_gain:d4", name="cmax_tracker")
def contrast_tracker(v):
    d = cut_lineage(dt.cluster_frames(v.px_tone, 100_000, 32, 32, 4, 1, 0))
    return cm.contrast_tracker(v.px_tone, d, 100_000, 8, 60.0, 3, 2, 0.5, 60, width=32, height=32)


# ------------------------------------------------------------------ fusion
def acoustic(v):
    return fu.acoustic_track(v.audio, 8000)


def ebs(v):
    b = v.px_tone.withColumn("step", F.floor(F.col("t") / 100_000)).groupBy("rec_id", "step").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return fu.ebs_rotor_track(v.px_tone, b.withColumn("t", (F.col("step") + 1) * 100_000), (150.0, 800.0), min_events=16)


@query("rec_id frame:l t:l f0:d snr:d4 harm:d conf:d4")
def acoustic_track(v):
    return acoustic(v)


@query("rec_id step:l f0:d3 snr:d2 conf:d4")
def ebs_rotor_track(v):
    return ebs(v)


# Stand-in tracks with known values: centroids of the quarter-second detections of a recording, against the half-second ones of each of its targets
FUV = {
    "ac": """SELECT s.rec_id || '/' || CAST(target_id AS VARCHAR) AS rec_id, t, 100+cx*10 AS f0, least(cy/20.0,1.0) AS conf, n_events/10.0 AS snr
       FROM steps s JOIN (SELECT DISTINCT rec_id AS r, target_id FROM quads) ON s.rec_id = r""",
    "eb": "SELECT rec_id || '/' || CAST(target_id AS VARCHAR) AS rec_id, t + 60000 AS t, step, 200+cx*20 AS f0, least(cy/20.0,1.0) AS conf, n_events/10.0 AS snr FROM quads",
    "ji": """SELECT e.*, CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN a.f0+(b.f0-a.f0)*w END AS af, CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN a.conf+(b.conf-a.conf)*w ELSE 0 END AS ac, CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN a.snr+(b.snr-a.snr)*w ELSE 0 END AS asn
       FROM (SELECT e.*, a, b, coalesce((e.t-a.t)/CAST(nullif(b.t-a.t,0) AS DOUBLE),0) AS w FROM eb e ASOF LEFT JOIN ac a ON a.rec_id=e.rec_id AND a.t <= e.t ASOF LEFT JOIN ac b ON b.rec_id=e.rec_id AND b.t >= e.t) e""",
    "jr": """SELECT *, ratio, exp(-((ln(ratio)/0.2)**2)) AS kap, ac >= 0.3 AS aon, conf >= 0.3 AS eon FROM (SELECT *, (SELECT f0/tg FROM (VALUES (1.0::DOUBLE),(2.0::DOUBLE),(3.0::DOUBLE),(0.5::DOUBLE),(1.0::DOUBLE/3)) m(k), LATERAL (SELECT af*k AS tg) ORDER BY abs(ln(f0/tg)), k LIMIT 1) AS ratio FROM ji)""",
    "cv": """SELECT *, ov*ba AS kap FROM (SELECT *, exp(-((ln(mr)/0.2)**2)) AS ba FROM (SELECT *, (SELECT fe/tg FROM (VALUES (1.0::DOUBLE),(2.0::DOUBLE),(3.0::DOUBLE),(0.5::DOUBLE),(1.0::DOUBLE/3)) m(k), LATERAL (SELECT fa*k AS tg) ORDER BY abs(ln(fe/tg)) LIMIT 1) AS mr FROM
       (SELECT rec_id, count(*) AS n, count(*) FILTER (WHERE aon AND eon AND af IS NOT NULL) AS nb, count(*) FILTER (WHERE aon AND eon)/CAST(count(*) FILTER (WHERE aon OR eon) AS DOUBLE) AS ov, median(af) FILTER (WHERE aon AND eon AND af IS NOT NULL) AS fa, median(f0) FILTER (WHERE aon AND eon AND af IS NOT NULL) AS fe,
         corr(af, f0) FILTER (WHERE aon AND eon AND af IS NOT NULL) AS r FROM jr GROUP BY rec_id)))""",
}


def _two(v):
    name = F.concat_ws("/", "rec_id", F.col("target_id").cast("string")).alias("rec_id")
    targets = v.quads.select("rec_id", "target_id").distinct()
    a = v.steps.join(targets, "rec_id").select(name, "t", (100 + F.col("cx") * 10).alias("f0"), F.least(F.col("cy") / 20.0, F.lit(1.0)).alias("conf"), (F.col("n_events") / 10.0).alias("snr"))
    e = v.quads.select(name, (F.col("t") + 60_000).alias("t"), "step", (200 + F.col("cx") * 20).alias("f0"),
                       F.least(F.col("cy") / 20.0, F.lit(1.0)).alias("conf"), (F.col("n_events") / 10.0).alias("snr"))
    return a, e, fu.with_acoustic(e, a, ["rec_id"], thresh=0.3)


@query("rec_id n_frames:l n_both:l temporal_overlap:d median_freq_ratio:d band_agreement:d f0_covariation:d kappa_overall:d", """SELECT rec_id, n AS n_frames, nb AS n_both, ov AS temporal_overlap, mr AS median_freq_ratio, ba AS band_agreement, r AS f0_covariation, kap AS kappa_overall FROM cv""", views=FUV)
def convergence(v):
    return fu.convergence(_two(v)[2], ["rec_id"])


@query("rec_id step:l p_bayes:d p_gated:d", """SELECT rec_id, step, pb AS p_bayes, pb*(0.4+0.6*coalesce(kap,0)) AS p_gated FROM (SELECT *, CASE WHEN ac*conf+(1-ac)*(1-conf) > 0 THEN ac*conf/(ac*conf+(1-ac)*(1-conf)) ELSE 0 END AS pb FROM jr)""", views=FUV)
def fuse_frames(v):
    return fu.fuse_frames(_two(v)[2])


@query("rec_id c_acoustic:d c_ebs:d p_dual:d p_fused:d fused_f0_hz:d", """SELECT rec_id, ca AS c_acoustic, ce AS c_ebs, pd AS p_dual, pd*(0.4+0.6*kap) AS p_fused, f AS fused_f0_hz FROM (SELECT *, ca*ce/(ca*ce+(1-ca)*(1-ce)) AS pd FROM (SELECT rec_id, quantile_cont(conf,0.9) AS ca FROM ac GROUP BY rec_id) JOIN (SELECT rec_id, quantile_cont(conf,0.9) AS ce FROM eb GROUP BY rec_id) USING (rec_id)
   JOIN cv USING (rec_id) LEFT JOIN (SELECT rec_id, min(v) AS f FROM (SELECT *, sum(w) OVER (PARTITION BY rec_id ORDER BY v, o ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY rec_id) AS tt FROM
     (SELECT rec_id, af AS v, asn AS w, 0 AS o FROM jr WHERE aon AND eon AND af IS NOT NULL UNION ALL SELECT rec_id, f0, snr, 1 FROM jr WHERE aon AND eon AND af IS NOT NULL)) WHERE c >= 0.5*tt GROUP BY rec_id) USING (rec_id))""", views=FUV)
def fuse_confidence(v):
    a, e, j = _two(v)
    j = cut_lineage(j)
    return fu.fuse_confidence(j, a, e, fu.convergence(j, ["rec_id"]), ["rec_id"])


@query("rec_id n_segments:l peak_hz:d3 peak_coh:d4")
def cross_coherence(v):
    plan = v.px_events.select("rec_id").distinct().select("rec_id", F.concat(F.lit("mic"), F.substring("rec_id", 4, 1)).alias("audio_id"), F.lit(0.0).alias("offset_s"))
    return fu.cross_coherence(v.px_events, v.steps, v.audio, 8000, plan, (50.0, 400.0), 1000.0, 256)
