"""The chunked building blocks against plain computations, with chunks small enough to matter."""
import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from pulsegrid.operators import asof, ordered as o, signal as sg
from pulsegrid.operators.quantiles import counted_quantiles, exact_quantiles


def table(spark, n=400, seed=1):
    r = np.random.default_rng(seed)
    d = pd.DataFrame({"k": np.where(r.random(n) < 0.7, "hot", "cold"), "seq": np.arange(n), "t": np.sort(r.integers(0, 5000, n)),
                      "v": r.normal(size=n)})
    d.loc[r.random(n) < 0.4, "v"] = np.nan
    return spark.createDataFrame(d).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_scan_equals_window(spark):
    df = table(spark)
    w = Window.partitionBy("k").orderBy("t", "seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("seq", F.last("v", True).over(run).alias("a"), F.sum(F.coalesce("v", F.lit(0.0))).over(run).alias("b"),
                     F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"),
                     F.row_number().over(w).cast("long").alias("d"), F.last("v", True).over(back).alias("e"))
    got = o.scan(df, ["k"], ["t", "seq"], o.chunk_of("t", 300), a=o.last(F.col("v")), b=o.total(F.coalesce("v", F.lit(0.0))),
                 c=o.highest(F.col("v"), inclusive=False), d=o.count(), e=o.following(F.col("v"))).select("seq", *"abcde")
    g, e = got.toPandas().sort_values("seq"), want.toPandas().sort_values("seq")
    for c in "abcde":
        assert np.allclose(g[c].to_numpy(float), e[c].to_numpy(float), equal_nan=True), c


def test_exact_quantiles_match_numpy(spark):
    r = np.random.default_rng(3)
    d = pd.DataFrame({"k": r.choice(["a", "b", "c"], 900, p=[0.8, 0.19, 0.01]), "v": np.round(r.normal(0, 20, 900), 2)})
    df = spark.createDataFrame(d)
    q = exact_quantiles(df, ["k"], {"lo": ("v", 0.1, 1.5), "mid": ("v", 0.5, 1.5), "hi": ("v", 0.975, 1.5)}).toPandas().set_index("k")
    c = counted_quantiles(df, ["k"], "v", {"mid": 0.5}).toPandas().set_index("k")
    for k, g in d.groupby("k"):
        assert np.allclose(q.loc[k, ["lo", "mid", "hi"]].astype(float), np.percentile(g.v, [10, 50, 97.5]))
        assert np.isclose(c.loc[k, "mid"], np.median(g.v))


def test_asof_lerp_clips_like_interp(spark):
    m = pd.DataFrame({"rec_id": "r", "t": [100, 900, 2500, 7000], "v": [1.0, 5.0, -2.0, 4.0]})
    e = pd.DataFrame({"rec_id": "r", "t": [0, 100, 500, 900, 2499, 2500, 6999, 7000, 9000]})
    j = asof.asof(spark.createDataFrame(e), spark.createDataFrame(m), ["rec_id"], F.col("t"), bucket_us=1000)
    got = j.select("t", asof.lerp(F.col("t"), "v").alias("v")).toPandas().sort_values("t")
    assert np.allclose(got.v, np.interp(e.t, m.t, m.v))


def test_halo_moving_average_across_blocks(spark, monkeypatch):
    v = np.random.default_rng(5).normal(size=150)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(150), "v": v}))
    big, w, own = sg.halo(df, ["k"], "i", 5, 4, size=16)
    got = big.withColumn("m", F.sum("v").over(w.rowsBetween(-5, 4)) / 10).where(own).toPandas().sort_values("i")
    assert len(got) == 150 and np.allclose(got.m, np.convolve(v, np.ones(10) / 10, "same"))


def test_correlate_in_blocks(spark):
    r = np.random.default_rng(6)
    a, b = r.normal(size=130), r.normal(size=90)
    mk = lambda v: spark.createDataFrame(pd.DataFrame({"k": "s", "i": np.arange(len(v)), "v": v}))
    got = sg.correlate(mk(a), mk(b), ["k"], "i", 40, size=16).toPandas().set_index("lag")["corr"]
    full = np.correlate(b, a, "full")
    for lag in range(-40, 41):
        assert np.isclose(got[lag], full[lag + len(a) - 1]), lag


def test_events_stay_in_place(spark, events):
    """With a broadcast limit below any table, per-recording tables still come to the events, not the events to them."""
    from pulsegrid.operators import raster, spectra
    ev = events(np.arange(200) % 8, np.arange(200) % 8, np.arange(200) * 1000)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for df in (raster.event_cube(ev, 4, 4), raster.density_strip(ev, 16).select("rec_id"), spectra.freq_map(ev, 8, 8, 2, 0.1, 200.0, 10.0, 90.0)):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            below = plan[plan.index("BroadcastHashJoin"):]
            assert "Exchange hashpartitioning" not in below.split("Aggregate")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
