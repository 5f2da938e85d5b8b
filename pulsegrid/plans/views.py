"""Event-camera shaped views of the given tables, in Spark and as SQL for the side-by-side check.

Every view is computed from a whole table, so its size grows with the table.
"""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

W32, W64 = 32, 64

SQL_VIEWS = {
    "px_events": """SELECT 'cam' || CAST((user_id // 32) % 2 AS VARCHAR) AS rec_id, event_id AS seq,
        CAST(user_id % 32 AS INTEGER) AS x, CAST((event_id*7+user_id) % 32 AS INTEGER) AS y,
        CASE WHEN value >= 35 THEN 1 ELSE 0 END AS p,
        (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 86400 AS t FROM events""",
    "px_lineitem": """SELECT 'lab' || CAST(l_orderkey % 2 AS VARCHAR) AS rec_id,
        CAST(l_orderkey*8+l_linenumber AS BIGINT) AS seq, CAST(min(l_partkey)%64 AS INTEGER) AS x,
        CAST(min(l_suppkey*13+l_partkey)%64 AS INTEGER) AS y,
        max(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS p,
        CAST(((l_orderkey*8+l_linenumber)*7919)%10000000 AS BIGINT) AS t
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "px_tone": """SELECT 'tone' || CAST(o_orderkey // 4000 AS VARCHAR) AS rec_id, o_orderkey AS seq,
        CAST((o_orderkey % 4000) // 160 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS INTEGER) AS x,
        CAST(12 + (CAST(floor(o_totalprice) AS BIGINT) // 5) % 5 AS INTEGER) AS y,
        CAST(o_orderkey % 2 AS INTEGER) AS p,
        ((o_orderkey % 4000) // 20) * 5000
          + ((o_orderkey % 20) * 73 + CAST(floor(o_totalprice) AS BIGINT)) % 1500 AS t FROM orders""",
    "pulses": """SELECT rec_id, k, k*1000000 + (k*7919)%1000 AS t FROM
        (SELECT rec_id, unnest(range(0, max(t)//1000000 + 2)) AS k FROM px_events GROUP BY rec_id)""",
    "telemetry": """SELECT rec_id, k, k*100000 AS t,
        fmod(k*36.0::DOUBLE + (k%10)/7.0::DOUBLE, 360.0::DOUBLE) AS azimuth,
        CAST(k // 10 AS INTEGER) AS rev,
        CASE WHEN k % 10 = 0 THEN 'HALL_SYNC' ELSE '' END AS flag FROM
        (SELECT rec_id, unnest(range(0, max(t)//100000 + 2)) AS k FROM px_events GROUP BY rec_id)""",
    "steps": """SELECT rec_id, t // 250000 AS step, CAST(((t // 250000) + 1) * 250000 AS BIGINT) AS t,
        avg(x) AS cx, avg(y) AS cy, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0,
        CAST(max(x) + 1 AS INTEGER) AS x1, CAST(max(y) + 1 AS INTEGER) AS y1,
        count(DISTINCT y*64+x) AS area, count(*) AS n_events
        FROM px_events GROUP BY rec_id, t // 250000""",
    "quads": """SELECT rec_id, CAST((x // 16) + 2*(y // 16) AS BIGINT) AS target_id, t // 500000 AS step,
        CAST(((t // 500000) + 1) * 500000 AS BIGINT) AS t, avg(x) AS cx, avg(y) AS cy,
        CAST(max(x)-min(x)+1 AS DOUBLE) AS dx, CAST(max(y)-min(y)+1 AS DOUBLE) AS dy,
        count(DISTINCT y*64+x) AS area, count(*) AS n_events
        FROM px_events GROUP BY rec_id, (x // 16) + 2*(y // 16), t // 500000""",
    "series64": """SELECT vec_id, unnest(range(0, 64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS v
        FROM embeddings""",
    "audio": """SELECT 'mic' || CAST(vec_id % 2 AS VARCHAR) AS rec_id,
        (vec_id // 2) * 64 + n AS i, v AS amp FROM series64""",
}


class Views:
    """The tables and views of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def px_events(self) -> DataFrame:
        e = self.table("events")
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        first = e.select(F.min(us)).scalar()
        return e.select(
            F.concat(F.lit("cam"), F.expr("(user_id div 32) % 2").cast("string")).alias("rec_id"),
            F.col("event_id").alias("seq"),
            (F.col("user_id") % 32).cast("int").alias("x"),
            ((F.col("event_id") * 7 + F.col("user_id")) % 32).cast("int").alias("y"),
            F.when(F.col("value") >= 35, 1).otherwise(0).alias("p"),
            F.floor((us - first) / 86400).alias("t"))

    @cached_property
    def px_lineitem(self) -> DataFrame:
        k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
        return (self.table("lineitem").groupBy("l_orderkey", "l_linenumber")
                .agg(F.min("l_partkey").alias("_p"),
                     F.min(F.col("l_suppkey") * 13 + F.col("l_partkey")).alias("_s"),
                     F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("p"))
                .select(F.concat(F.lit("lab"), (F.col("l_orderkey") % 2).cast("string")).alias("rec_id"),
                        k.alias("seq"), (F.col("_p") % 64).cast("int").alias("x"),
                        (F.col("_s") % 64).cast("int").alias("y"), "p",
                        (k * 7919 % 10_000_000).alias("t")))

    @cached_property
    def px_tone(self) -> DataFrame:
        """One-second recordings of a 5 x 5 patch that flickers at 200 Hz and drifts to the right."""
        i = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("tone"), F.expr("o_orderkey div 4000").cast("string")).alias("rec_id"),
            i.alias("seq"),
            (F.expr("(o_orderkey % 4000) div 160") + F.floor("o_totalprice") % 5).cast("int").alias("x"),
            (12 + F.floor(F.floor("o_totalprice") / 5) % 5).cast("int").alias("y"),
            (i % 2).cast("int").alias("p"),
            (F.expr("(o_orderkey % 4000) div 20") * 5000
             + (i % 20 * 73 + F.floor("o_totalprice")) % 1500).alias("t"))

    def _ticks(self, us: int) -> DataFrame:
        """Whole multiples 0..max(t)/us+1 of a period per recording."""
        return (self.px_events.groupBy("rec_id").agg(F.max("t").alias("_m"))
                .select("rec_id", F.explode(F.sequence(
                    F.lit(0).cast("long"), F.floor(F.col("_m") / us) + 1)).alias("k")))

    @cached_property
    def pulses(self) -> DataFrame:
        return self._ticks(1_000_000).withColumn(
            "t", F.col("k") * 1_000_000 + F.col("k") * 7919 % 1000)

    @cached_property
    def telemetry(self) -> DataFrame:
        k = F.col("k")
        return self._ticks(100_000).select(
            "rec_id", "k", (k * 100_000).alias("t"),
            ((k * 36.0 + (k % 10) / 7.0) % 360.0).alias("azimuth"),
            F.floor(k / 10).cast("int").alias("rev"),
            F.when(k % 10 == 0, "HALL_SYNC").otherwise("").alias("flag"))

    @cached_property
    def steps(self) -> DataFrame:
        """One detection per recording and quarter second: centroid, box, area of all events."""
        return (self.px_events.withColumn("step", F.floor(F.col("t") / 250_000))
                .groupBy("rec_id", "step")
                .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"),
                     F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
                     F.count_distinct(F.col("y") * 64 + F.col("x")).alias("area"),
                     F.count("*").alias("n_events"))
                .withColumn("t", (F.col("step") + 1) * 250_000))

    @cached_property
    def quads(self) -> DataFrame:
        """Detections of four targets per recording: the sensor quarters, per half second."""
        return (self.px_events
                .withColumn("target_id", F.expr("(x div 16) + 2 * (y div 16)"))
                .withColumn("step", F.floor(F.col("t") / 500_000))
                .groupBy("rec_id", "target_id", "step")
                .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"),
                     (F.max("x") - F.min("x") + 1).cast("double").alias("dx"),
                     (F.max("y") - F.min("y") + 1).cast("double").alias("dy"),
                     F.count_distinct(F.col("y") * 64 + F.col("x")).alias("area"),
                     F.count("*").alias("n_events"))
                .withColumn("t", (F.col("step") + 1) * 500_000))

    @cached_property
    def series64(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.posexplode("embedding").alias("n", "v")).select(
            "vec_id", F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("v"))

    @cached_property
    def audio(self) -> DataFrame:
        return self.series64.select(
            F.concat(F.lit("mic"), (F.col("vec_id") % 2).cast("string")).alias("rec_id"),
            (F.expr("vec_id div 2") * 64 + F.col("n")).alias("i"), F.col("v").alias("amp"))


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs of the views it (and they) mention."""
    pool = {**SQL_VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(sql: str):
        for name in pool:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) and pool[name] is not sql:
                visit(pool[name])
                if name not in order:
                    order.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({pool[n]})" for n in order)
    return (f"WITH RECURSIVE {ctes}\n" if ctes else "") + body
