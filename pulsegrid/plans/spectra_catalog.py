"""Queries for spectra and flicker maps."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as ra, rotation as rot, signal as sg, spectra as sp
from .filters_catalog import BASE
from .raster_catalog import SPAN
from .registry import query

# ------------------------------------------------------------------ SQL building blocks
BINS = """SELECT {k}, n_events, nb, b, count(*) AS c FROM (SELECT {k}, n_events, nb,
   CASE WHEN (t-lo)/({dt}) = nb THEN nb-1 ELSE CAST(floor((t-lo)/({dt})) AS BIGINT) END AS b FROM {src} JOIN
   (SELECT {k}, min(t) AS lo, count(*) AS n_events, CAST(floor((max(t)-min(t))/({dt})) AS BIGINT) AS nb FROM {src} GROUP BY {k}) USING ({k})
   WHERE nb >= 2) WHERE b < nb GROUP BY ALL"""
#: dense windowed series of a binned table ``bins`` (key k)
SERIES = """SELECT {k}, nb, n, (coalesce(c,0) - tot/CAST(nb AS DOUBLE))*(0.5-0.5*cos(2*pi()*n/(nb-1))) AS s FROM
  (SELECT {k}, nb, sum(c) AS tot, unnest(range(0, nb)) AS n FROM {bins} GROUP BY {k}, nb) g LEFT JOIN
  (SELECT {k}, b AS n, c FROM {bins}) USING ({k}, n)"""
DFT = """SELECT {k}, nb, f, (sum(s*cos(2*pi()*((n*f)%nb)/nb))**2 + sum(s*sin(2*pi()*((n*f)%nb)/nb))**2) AS raw FROM
  (SELECT {k}, nb, n, s, unnest(range(0, nb//2+1)) AS f FROM {ser}) GROUP BY {k}, nb, f"""
POW = """SELECT {k}, nb, f, raw/(nb*nb)*(CASE WHEN f=0 OR f=nb//2 THEN 1 ELSE 4 END) AS p, {fs}*f/CAST(nb AS DOUBLE) AS hz FROM {dft}"""
LINE = """SELECT {k}, max(p) FILTER (WHERE hz BETWEEN {lo} AND {hi}) AS peak_power,
  arg_max(hz, p) FILTER (WHERE hz BETWEEN {lo} AND {hi}) AS peak_freq,
  max(p) FILTER (WHERE hz BETWEEN {lo} AND {hi})/(median(p) FILTER (WHERE f > 0) + 1e-12) AS snr FROM {pw} GROUP BY {k}"""
COMB = """SELECT l.{k0}{k1}, CASE WHEN count(*) FILTER (WHERE m >= 2 AND ok) = 0 THEN 0 ELSE count(*) FILTER (WHERE m >= 2 AND ok AND v > 0.25*base)
    /CAST(count(*) FILTER (WHERE m >= 2 AND ok) AS DOUBLE) END AS harmonic FROM
  (SELECT q.*, max(v) FILTER (WHERE m = 1) OVER (PARTITION BY {kk}) AS base FROM
   (SELECT {lk}, m, m*peak_freq <= least({hi}, max(hz)) AS ok, max(p) FILTER (WHERE hz >= m*peak_freq - 1.5*({fs}/nb) - 1e-6
      AND hz < m*peak_freq + 2.5*({fs}/nb) - 1e-6) AS v
    FROM {line} l JOIN {pw} w USING ({kk}), range(1, 5) z(m) GROUP BY {lk}, m, peak_freq) q) l GROUP BY {gk}"""


def line_views(prefix, src, k, fs, lo, hi, cte=None):
    """CTEs {p}_bins.. {p}_line for the region spectrum of ``src`` grouped by ``k``."""
    p = prefix
    v = {f"{p}_bins": cte or BINS.format(k=k, src=src, dt=f"1000000.0/{fs}"),
         f"{p}_ser": SERIES.format(k=k, bins=f"{p}_bins"), f"{p}_dft": DFT.format(k=k, ser=f"{p}_ser"),
         f"{p}_pw": POW.format(k=k, dft=f"{p}_dft", fs=fs), f"{p}_line": LINE.format(k=k, pw=f"{p}_pw", lo=lo, hi=hi)}
    v[f"{p}_comb"] = f"""SELECT {k}, CASE WHEN count(*) FILTER (WHERE m >= 2 AND ok) = 0 THEN 0 ELSE
      count(*) FILTER (WHERE m >= 2 AND ok AND v > 0.25*base)/CAST(count(*) FILTER (WHERE m >= 2 AND ok) AS DOUBLE) END AS harmonic FROM
      (SELECT *, max(v) FILTER (WHERE m = 1) OVER (PARTITION BY {k}) AS base FROM
        (SELECT {k}, m, m*peak_freq <= least({hi}, max(hz)) AS ok, max(p) FILTER (WHERE hz >= m*peak_freq - 1.5*({fs}/nb) - 1e-6
          AND hz < m*peak_freq + 2.5*({fs}/nb) - 1e-6) AS v
         FROM {p}_line JOIN {p}_pw USING ({k}), range(1, 5) z(m) GROUP BY {k}, m, peak_freq)) GROUP BY {k}"""
    return v


TONE = line_views("tn", "px_tone", "rec_id", 2000, 80, 800)


# ------------------------------------------------------------------ queries
@query("rec_id bin:i c:l", BINS.format(k="rec_id", src="px_tone", dt="500.0").join(
    ["SELECT g.rec_id, g.n AS bin, coalesce(c,0) AS c FROM (WITH b AS (", """) SELECT rec_id, nb, unnest(range(0, nb)) AS n FROM b GROUP BY rec_id, nb) g
     LEFT JOIN (""" + BINS.format(k="rec_id", src="px_tone", dt="500.0") + ") q ON g.rec_id = q.rec_id AND g.n = q.b"]))
def bin_signal(v):
    return sp.dense_series(sp.bin_signal(v.px_tone, ["rec_id"], 2000.0), ["rec_id"])


@query("rec_id n_events:l peak_freq:d peak_power:d snr:d1 harmonic:d",
       "SELECT * FROM tn_line JOIN tn_comb USING (rec_id) JOIN (SELECT DISTINCT rec_id, n_events FROM tn_bins) USING (rec_id)", views=TONE)
def region_spectrum(v):
    return sp.region_spectrum(v.px_tone, ["rec_id"], 2000.0, 80.0, 800.0)


_WH = {**TONE, "wh": """SELECT a.rec_id, a.nb, a.f, a.hz, any_value(a.p)/(median(b.p) + 1e-20) AS p FROM
  (SELECT *, nb//2 AS top, CAST((greatest(5, ((nb//2+1)//20)//2*2 + 1) - 1)//2 AS BIGINT) AS h FROM tn_pw) a, range(-200, 201) z(d), tn_pw b
  WHERE abs(d) <= h AND b.rec_id = a.rec_id AND b.f = greatest(0, least(top, a.f + d)) GROUP BY ALL"""}


@query("rec_id peak_freq:d peak_power:d3 snr:d3", """SELECT rec_id, max(p) FILTER (WHERE hz BETWEEN 80 AND 800) AS peak_power, arg_max(hz, p) FILTER (WHERE hz BETWEEN 80 AND 800) AS peak_freq,
  max(p) FILTER (WHERE hz BETWEEN 80 AND 800)/(median(p) FILTER (WHERE f > 0) + 1e-12) AS snr FROM wh GROUP BY rec_id""", views=_WH)
def region_spectrum_white(v):
    return sp.region_spectrum(v.px_tone, ["rec_id"], 2000.0, 80.0, 800.0, normalize="median")


@query("rec_id band_snr:d1", """SELECT rec_id, max(p) FILTER (WHERE hz BETWEEN 150 AND 450)/(median(p) FILTER (WHERE hz > 50 AND hz NOT BETWEEN 150 AND 450) + 1e-30) AS band_snr
  FROM tn_pw GROUP BY rec_id""", views=TONE)
def band_snr(v):
    return sp.region_band_snr(v.px_tone, ["rec_id"], 2000.0, (150.0, 450.0))


_CELLB = """SELECT rec_id, cy, cx, nb, least(CAST(floor((t-t0)/(1000000.0/{fs})) AS BIGINT), nb-1) AS b, count(*) AS c FROM
  (SELECT *, y//8 AS cy, x//8 AS cx, CAST(floor((t1-t0)/(1000000.0/{fs})) AS BIGINT) AS nb FROM {src} JOIN {span} USING (rec_id)) GROUP BY ALL"""
_FM = line_views("fm", None, "rec_id, cy, cx", 20, 1, 8, _CELLB.format(fs=20, src="px_lineitem", span=SPAN.format(src="px_lineitem")))
_FM["fm_ser"] = SERIES.format(k="rec_id, cy, cx", bins="fm_act")
_FM["fm_act"] = "SELECT * FROM fm_bins JOIN (SELECT rec_id, cy, cx FROM fm_bins GROUP BY ALL HAVING sum(c) >= 340) USING (rec_id, cy, cx)"
_MAP = """SELECT b.*, peak_freq AS dominant_freq, coalesce(snr,0) AS snr, coalesce(peak_power,0) AS band_power FROM
  (SELECT rec_id, cy, cx, sum(c) AS event_count FROM fm_bins GROUP BY ALL) b LEFT JOIN fm_line USING (rec_id, cy, cx)"""


@query("rec_id cy:i cx:i event_count:l dominant_freq:d snr:d3 band_power:d", _MAP, views=_FM)
def flicker_map(v):
    return sp.flicker_map(v.px_lineitem, 1.0, 8.0, 20.0, 8, 340)


_K = "rec_id, cy, cx, k"
_FX = line_views("fx", None, _K, 20, 1, 8, f"""SELECT rec_id, cy, cx, k, nb, least(CAST(floor((t-st)/50000.0) AS BIGINT), nb-1) AS b, count(*) AS c FROM
  (SELECT *, t0 + k*2000000 AS st, CAST(floor((least(t0 + k*2000000 + 3000000, t1) - (t0 + k*2000000))/50000.0) AS BIGINT) AS nb FROM
   (SELECT *, y//8 AS cy, x//8 AS cx, unnest(range(0, greatest(t1-3000000-t0,0)//2000000 + 1)) AS k FROM px_lineitem
    JOIN {SPAN.format(src='px_lineitem')} USING (rec_id)) WHERE t >= t0 + k*2000000 AND t < least(t0 + k*2000000 + 3000000, t1)) GROUP BY ALL""")
_FX["fx_ser"] = SERIES.format(k=_K, bins="fx_act")
_FX["fx_act"] = f"SELECT * FROM fx_bins JOIN (SELECT {_K} FROM fx_bins GROUP BY ALL HAVING sum(c) >= 60) USING ({_K})"


@query("rec_id cy:i cx:i event_count:l dominant_freq:d snr:d3 band_power:d", f"""SELECT m.*, coalesce(snr,0) AS snr, peak_freq AS dominant_freq,
  coalesce(peak_power,0) AS band_power FROM (SELECT rec_id, cy, cx, sum(c) AS event_count FROM fx_bins GROUP BY ALL) m LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY rec_id, cy, cx ORDER BY snr DESC, k) AS rn FROM fx_line) l
  ON m.rec_id=l.rec_id AND m.cy=l.cy AND m.cx=l.cx AND rn=1""", views=_FX)
def flicker_map_max(v):
    return sp.flicker_map_max(v.px_lineitem, 1.0, 8.0, 20.0, 8, 3.0, 2.0, 60)


_FQ = line_views("fq", None, "rec_id, gy, gx", 20, 1, 8, f"""SELECT rec_id, gy, gx, CAST(100 AS BIGINT) AS nb,
   greatest(least(CAST(floor((t/1000000.0 - (t1/1000000.0-5.0))*20) AS BIGINT), 99), 0) AS b, count(*) AS c FROM
   (SELECT *, least(y*6//64,5) AS gy, least(x*6//64,5) AS gx FROM px_lineitem JOIN {SPAN.format(src='px_lineitem')} USING (rec_id))
   WHERE t >= (t1/1000000.0-5.0)*1000000 GROUP BY ALL""")


@query("rec_id gy:i gx:i peak:d5 freq_hz:d significant:b", """SELECT *, peak > greatest(quantile_cont(peak, 0.3) OVER (PARTITION BY rec_id), max(peak) OVER (PARTITION BY rec_id)*0.05) AS significant
  FROM (SELECT rec_id, gy, gx, max(sqrt(raw)) AS peak, arg_max(20.0*f/nb, raw) AS freq_hz FROM fq_dft WHERE 20.0*f/nb BETWEEN 1 AND 8 GROUP BY ALL)""", views=_FQ)
def freq_map(v):
    return sp.freq_map(v.px_lineitem, 64, 64, 6, 5.0, 20.0, 1.0, 8.0)


_TUKEY = "CASE WHEN n < 32 THEN 0.5*(1+cos(pi()*(n/32.0-1))) WHEN n > 224 THEN 0.5*(1+cos(pi()*((n-256)/32.0+1))) ELSE 1.0 END"
_SG = {**TONE, "sg_ser": f"""SELECT rec_id, seg, n, (coalesce(c,0) - avg(coalesce(c,0)) OVER (PARTITION BY rec_id, seg))*{_TUKEY} AS s FROM
  (SELECT rec_id, seg, unnest(range(0, 256)) AS n FROM (SELECT rec_id, unnest(range(0, (nb-256)//64 + 1)) AS seg FROM (SELECT DISTINCT rec_id, nb FROM tn_bins))) g
  LEFT JOIN (SELECT rec_id, b, c FROM tn_bins) q ON q.rec_id = g.rec_id AND q.b = g.seg*64 + g.n""".replace("SELECT rec_id, seg, n, (coalesce", "SELECT g.rec_id, seg, n, (coalesce").replace("PARTITION BY rec_id, seg", "PARTITION BY g.rec_id, seg")}


@query("rec_id seg:l t_s:d f_hz:d power:d9", f"""SELECT rec_id, seg, (seg*64+128)/2000.0 AS t_s, 2000.0*f/256 AS f_hz, (sum(s*cos(2*pi()*((n*f)%256)/256))**2 + sum(s*sin(2*pi()*((n*f)%256)/256))**2)
   / (SELECT sum({_TUKEY}) FROM (SELECT unnest(range(0, 256)) AS n))**2 AS power FROM (SELECT *, unnest(range(0, 103)) AS f FROM sg_ser) GROUP BY ALL""", views=_SG)
def spectrogram(v):
    return sp.spectrogram(v.px_tone, ["rec_id"], 2000.0, 256, 0.75, 800.0)


_GATE = """SELECT e.*, q.target_id, q.a, q.b FROM px_events e JOIN
  (SELECT rec_id, target_id, min(t) AS a, max(t) AS b FROM quads GROUP BY ALL HAVING count(*) >= 3) q ON e.rec_id=q.rec_id AND e.t BETWEEN q.a AND q.b
  ASOF JOIN (SELECT *, lead(t) OVER w AS t2, lead(cx) OVER w AS cx2, lead(cy) OVER w AS cy2, lead(dx) OVER w AS dx2, lead(dy) OVER w AS dy2
    FROM quads WINDOW w AS (PARTITION BY rec_id, target_id ORDER BY t)) m ON e.rec_id=m.rec_id AND q.target_id=m.target_id AND e.t >= m.t
  WHERE abs(e.x - (m.cx + coalesce((m.cx2-m.cx)*(e.t-m.t)/(m.t2-m.t),0))) <= (m.dx + coalesce((m.dx2-m.dx)*(e.t-m.t)/(m.t2-m.t),0))/2 - 5
    AND abs(e.y - (m.cy + coalesce((m.cy2-m.cy)*(e.t-m.t)/(m.t2-m.t),0))) <= (m.dy + coalesce((m.dy2-m.dy)*(e.t-m.t)/(m.t2-m.t),0))/2 - 5"""


@query("rec_id target_id:l seq:l", _GATE)
def moving_box_gate(v):
    return sp.moving_box_gate(v.px_events, v.quads, -5.0)


_BK = "rec_id, target_id"
_BF = {"gate": _GATE, "bf_bins": """SELECT rec_id, target_id, nb, least(CAST(floor((t-a)/1000000.0/((b-a)/1000000.0)*nb) AS BIGINT), nb-1) AS b, count(*) AS c FROM
  (SELECT *, greatest(64, CAST(floor((b-a)/1000000.0/0.02) AS BIGINT)) AS nb FROM gate) GROUP BY rec_id, target_id, nb, least(CAST(floor((t-a)/1000000.0/((b-a)/1000000.0)*nb) AS BIGINT), nb-1)""",
       "bf_ser": SERIES.format(k=_BK, bins="bf_bins"), "bf_dft": DFT.format(k=_BK, ser="bf_ser")}


@query("rec_id target_id:l n_events:l peak_hz:d snr:d4", """SELECT rec_id, target_id, n_events, CASE WHEN any_value(n_events) >= 32 THEN arg_max(hz, raw) END AS peak_hz, CASE WHEN any_value(n_events) >= 32 THEN max(raw)/(median(raw)+1e-12) ELSE 0 END AS snr FROM
  (SELECT *, f/((b-a)/1000000.0) AS hz FROM bf_dft JOIN (SELECT rec_id, target_id, any_value(a) AS a, any_value(b) AS b, count(*) AS n_events FROM gate GROUP BY ALL) USING (rec_id, target_id))
  WHERE hz BETWEEN 2 AND 20 GROUP BY ALL""", views=_BF)
def blade_fft(v):
    return sp.blade_fft(v.px_events, v.quads, 2.0, 20.0, 0.02, -5.0)


_PR = line_views("pr", "prsrc", "rec_id, rev", 200, 20, 80)
_PR.update(BASE)
_PR["prsrc"] = """SELECT w.rec_id, w.t, rev FROM world w JOIN with_phase p USING (rec_id, seq)
   WHERE (az-180+180) - floor((az-180+180)/360.0)*360.0 BETWEEN 60 AND 300 AND w.y BETWEEN 2 AND 29"""
_PR["pr_bins"] = _PR["pr_bins"].replace("FROM prsrc JOIN", "FROM prbig JOIN").replace("FROM prsrc GROUP", "FROM prbig GROUP")
_PR["prbig"] = "SELECT * FROM prsrc JOIN (SELECT rec_id, rev FROM prsrc GROUP BY ALL HAVING count(*) >= 60) USING (rec_id, rev)"


@query("rec_id rev:l n_events:l peak_freq:d snr:d2", "SELECT l.*, n_events FROM pr_line l JOIN (SELECT DISTINCT rec_id, rev, n_events FROM pr_bins) USING (rec_id, rev)", views=_PR)
def per_rev_spectra(v):
    e = rot.revolution_asof(rot.world_azimuth(v.px_events, v.telemetry, 50.0, 32), v.pulses)
    boxes = v.pulses.select("rec_id", F.col("k").alias("rev"), F.lit(60.0).alias("az0"), F.lit(300.0).alias("az1"),
                            F.lit(2).alias("y0"), F.lit(29).alias("y1"))
    return sp.per_rev_spectra(e, boxes, 20.0, 80.0, 200.0, min_events=60)


_NU = """SELECT rec_id, k, hz AS f_hz, n AS n_events, (sum(w*cos(2*pi()*hz*(t-t0)/1000000.0))**2 + sum(w*sin(2*pi()*hz*(t-t0)/1000000.0))**2)/(n*CAST(n AS DOUBLE)) AS power FROM
  (SELECT s.rec_id, t, t0, n, {w} AS w, k, {f0}+k*{df} AS hz FROM {src} s JOIN (SELECT rec_id, min(t) AS t0, count(*) AS n, avg(p) AS pm FROM {src} GROUP BY rec_id) USING (rec_id), range(0, {nf}) q(k))
  GROUP BY rec_id, k, hz, n"""


@query("rec_id k:i f_hz:d power:d9", _NU.format(w="1.0", f0=150.0, df=2.0, nf=51, src="px_tone"))
def nudft(v):
    return sp.nudft(v.px_tone, ["rec_id"], [150.0 + 2.0 * i for i in range(51)])


_SUB = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY md5(CAST(seq AS VARCHAR) || ':0'), seq) AS rn FROM px_tone) WHERE rn <= {n}"""


@query("rec_id n_events:l peak_freq:d peak_power:d snr:d2", """SELECT rec_id, n_events, arg_max(f_hz, power) AS peak_freq, max(power) AS peak_power, max(power)/(median(power)+1e-12) AS snr FROM nus GROUP BY ALL""",
       views={"nus": _NU.format(w="1.0", f0=100.0, df="(700.0/199)", nf=200, src="px_tone")})
def nufft_spectrum(v):
    return sp.nufft_spectrum(v.px_tone, 100.0, 800.0, 200)


@query("rec_id k:i f_hz:d power:d7", """SELECT rec_id, k, f_hz, (sum(cos(2*pi()*f_hz*(ts-tau)))**2/greatest(sum(cos(2*pi()*f_hz*(ts-tau))**2),1e-300)
   + sum(sin(2*pi()*f_hz*(ts-tau)))**2/greatest(sum(sin(2*pi()*f_hz*(ts-tau))**2),1e-300))/count(*) AS power FROM
  (SELECT *, atan2(sum(sin(4*pi()*f_hz*ts)) OVER w, sum(cos(4*pi()*f_hz*ts)) OVER w)/(4*pi()*f_hz) AS tau FROM
   (SELECT s.rec_id, k, 100.0+k*(500.0/60) AS f_hz, (t-t0)/1000000.0 AS ts FROM sub s JOIN (SELECT rec_id, min(t) AS t0 FROM sub GROUP BY rec_id) USING (rec_id), range(0,61) q(k))
   WINDOW w AS (PARTITION BY rec_id, k)) GROUP BY ALL""", views={"sub": "SELECT * FROM px_tone"})
def lomb_scargle(v):
    return sp.lomb_scargle(v.px_tone, 100.0, 600.0, 61)


@query("rec_id n_intervals:l freq_hz:d strength:d", """SELECT rec_id, sum(c) AS n_intervals, 5.0*exp((arg_max(b, c*1000-b)+0.5)/64*ln(2000/5.0)) AS freq_hz, max(c)/CAST(sum(c) AS DOUBLE) AS strength FROM
  (SELECT rec_id, least(CAST(floor(ln(1000000.0/d/5.0)/ln(2000/5.0)*64) AS BIGINT), 63) AS b, count(*) AS c FROM
   (SELECT rec_id, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t, seq) AS d FROM px_events) WHERE d > 0 AND 1000000.0/d BETWEEN 5 AND 2000 GROUP BY ALL) GROUP BY rec_id""")
def inter_event_interval(v):
    return sp.isi_frequency(v.px_events, ["rec_id"])


@query("rec_id active_cells:l max_snr:d3 peak_hz:d n_events:l mean_rate:d4 peak_rate:d densest_t_s:d", f"""SELECT * FROM (SELECT rec_id, count(dominant_freq) AS active_cells, max(snr) AS max_snr,
   arg_max(dominant_freq, snr) AS peak_hz, sum(event_count) AS n_events FROM ({_MAP}) GROUP BY rec_id) JOIN
  (SELECT rec_id, avg(n)/0.1 AS mean_rate, max(n)/0.1 AS peak_rate, (arg_max(bin, n*100000-bin)+0.5)*0.1 AS densest_t_s FROM
   (SELECT rec_id, bin, coalesce(n,0) AS n FROM (SELECT rec_id, unnest(range(0, CAST(ceil((t1-t0)/100000.0) AS BIGINT))) AS bin FROM {SPAN.format(src='px_lineitem')})
    LEFT JOIN (SELECT rec_id, least((t-t0)//100000, CAST(ceil((t1-t0)/100000.0) AS BIGINT)-1) AS bin, count(*) AS n FROM px_lineitem JOIN {SPAN.format(src='px_lineitem')} USING (rec_id) GROUP BY ALL) USING (rec_id, bin))
   GROUP BY rec_id) USING (rec_id)""", views=_FM)
def spectral_summary(v):
    return sp.spectral_summary(sp.flicker_map(v.px_lineitem, 1.0, 8.0, 20.0, 8, 340), ra.event_rate(v.px_lineitem, 100_000))


_GB = line_views("gb", "gbsrc", "rec_id, step", 2000, 80, 800)
_GB["gbsrc"] = "SELECT *, t // 250000 AS step FROM px_tone"


@query("rec_id step:l n_events:l peak_freq:d snr:d1", "SELECT l.*, n_events FROM gb_line l JOIN (SELECT DISTINCT rec_id, step, n_events FROM gb_bins) USING (rec_id, step) WHERE snr >= 4", views=_GB)
def global_blink(v):
    return sg.global_blink(v.px_tone, 0.25, 2000.0, 80.0, 800.0, 4.0)
