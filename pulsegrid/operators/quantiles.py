"""Exact quantiles (linear rule) of groups of any size.

``percentile`` keeps every distinct value of a group in one task, which is right for per-pixel
counts (bounded by the sensor) and wrong for event-level values of a hot group.  Here a small
histogram per group (fixed bucket width, map-side combined) locates the buckets that hold the
wanted ranks, and only the rows of those buckets are counted and ordered.  The buckets are broadcast up to the bound of
:func:`.asof.small`, so all other rows stay where they are.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .asof import small


def exact_quantiles(df: DataFrame, keys: list[str],
                    wanted: dict[str, tuple[str, float, float]]) -> DataFrame:
    """One row per group; ``wanted`` maps an output name to (column, probability, bucket width)."""
    widths = {c: w for c, _, w in wanted.values()}
    pairs = F.explode(F.array(*[F.struct(
        F.lit(c).alias("c"), F.col(c).cast("double").alias("v"),
        F.floor(F.col(c) / w).cast("long").alias("b")) for c, w in widths.items()]))
    rows = df.select(*keys, pairs.alias("s")).select(*keys, "s.*").where("v IS NOT NULL")
    k = [*keys, "c"]
    w = Window.partitionBy(*k)
    before = w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    n0 = F.coalesce(F.sum("n").over(before), F.lit(0))
    ranks = []
    for name, (c, p, _) in wanted.items():
        h = F.lit(float(p)) * (F.col("tot") - 1)
        for side, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            ranks.append(F.struct(F.lit(name).alias("q"), F.lit(c).alias("c"), F.lit(side).alias("side"),
                                  r.cast("long").alias("r"), (h - F.floor(h)).alias("frac")))
    heads = (rows.groupBy(*k, "b").agg(F.count("*").alias("n"))
             .withColumn("n0", n0).withColumn("tot", F.sum("n").over(w))
             .withColumn("want", F.filter(F.array(*ranks), lambda s: (s["c"] == F.col("c"))
                         & (s["r"] >= F.col("n0")) & (s["r"] < F.col("n0") + F.col("n"))))
             .where(F.size("want") > 0).select(*k, "b", "n0", "want"))
    heads = small(heads)          # at most two buckets for each group and probability
    inside = Window.partitionBy(*k, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    hit = (rows.join(heads.select(*k, "b"), [*k, "b"], "left_semi")
           .groupBy(*k, "b", "v").agg(F.count("*").alias("n"))
           .withColumn("s", F.coalesce(F.sum("n").over(inside), F.lit(0)))
           .join(heads, [*k, "b"])
           .withColumn("w", F.explode("want"))
           .where((F.col("w.r") >= F.col("n0") + F.col("s"))
                  & (F.col("w.r") < F.col("n0") + F.col("s") + F.col("n"))))
    out = []
    for name in wanted:
        def of(side, name=name):
            return F.max(F.when((F.col("w.q") == name) & (F.col("w.side") == side), F.col("v")))
        frac = F.max(F.when(F.col("w.q") == name, F.col("w.frac")))
        out.append((of("lo") + (of("hi") - of("lo")) * frac).alias(name))
    return hit.groupBy(*keys).agg(*out)


def counted_quantiles(df: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    """Quantiles of a value with few distinct levels (rows, columns, counts): pre-count, merge."""
    vc = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return vc.groupBy(*keys).agg(*[F.percentile(F.col(value).cast("double"), p, F.col("_n")).alias(n)
                                   for n, p in probs.items()])
