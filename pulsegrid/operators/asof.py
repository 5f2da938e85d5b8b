"""As-of, interpolating and nearest joins of events against a time-marked table.

The marks of a group become half-open intervals ``[t_k, t_{k+1})``.  Each interval is listed under
every time bucket it touches and events look up their own bucket, so the join is an equi join:
no sort of the events, no window over them.  Catalyst broadcasts the marks when their size allows
it and otherwise shuffles by (group, bucket), which AQE can split when one bucket is hot.

Size estimates of derived marks are far too large, which would shuffle the events for nothing, so
the interval rows are counted first (a small job) and broadcast explicitly up to a fixed bound.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import US
from ..session import cut_lineage

#: most interval rows that are broadcast (some 200 bytes each)
BROADCAST_ROWS = 500_000


def legs(marks: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Turn marks into rows (keys, a, b, m, nx): from each mark to its follower, ``nx`` (null for the last).

    Marks of one group are few (pulses, telemetry samples, track points), so the window over them
    is a small one.
    """
    other = [c for c in marks.columns if c not in keys]
    return (marks.select(*keys, F.struct(*other).alias("m"))
            .withColumn("nx", F.lead("m").over(Window.partitionBy(*keys).orderBy(f"m.{t}")))
            .withColumn("a", F.col(f"m.{t}"))
            .withColumn("b", F.coalesce(F.col(f"nx.{t}"), F.col("a") + 1))
            .where(F.col("b") > F.col("a")))


def intervals(marks: DataFrame, keys: list[str], t: str = "t", bucket_us: int = US) -> DataFrame:
    """:func:`legs`, each listed once for every time bucket it touches."""
    lo, hi = F.floor(F.col("a") / bucket_us), F.floor((F.col("b") - 1) / bucket_us)
    return legs(marks, keys, t).withColumn("_bucket", F.explode(F.sequence(lo, hi)))


def small(table: DataFrame) -> DataFrame:
    """A summary table (some rows for each recording), computed once, to be joined with events where they are.

    Catalyst sizes an aggregate by its input and would shuffle the events for it; so its rows are counted and it is broadcast
    up to the bound.  A longer table is joined by shuffle.
    """
    kept = cut_lineage(table)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def asof(events: DataFrame, marks: DataFrame, keys: list[str], te: Column, mark_t: str = "t",
         bucket_us: int = US, clip: bool = True) -> DataFrame:
    """Attach to each event the interval that holds ``te``: structs ``m`` (mark) and ``nx`` (next).

    With ``clip`` times before the first mark use the first one and times after the last mark the
    last one (``nx`` is then null); without it only the backward match is kept (null before the
    first mark).  Columns ``_first``/``_last`` hold the group's mark range.
    """
    span = marks.groupBy(*keys).agg(F.min(mark_t).alias("_first"), F.max(mark_t).alias("_last"))
    iv = intervals(marks, keys, mark_t, bucket_us)
    if iv.count() <= BROADCAST_ROWS:          # every group has at least one interval
        span, iv = F.broadcast(span), F.broadcast(iv)
    ev = events.join(span, keys, "left")
    low = F.greatest(te, F.col("_first")) if clip else te
    ev = ev.withColumn("_te", F.least(low, F.col("_last"))) \
           .withColumn("_bucket", F.floor(F.col("_te") / bucket_us))
    on = [ev[k] == iv[k] for k in keys] + [
        ev["_bucket"] == iv["_bucket"], ev["_te"] >= iv["a"], ev["_te"] < iv["b"]]
    out = ev.join(iv, on, "left")
    return out.select(*[ev[c] for c in events.columns], ev["_first"], ev["_last"],
                      iv["m"], iv["nx"])


def lerp(te: Column, name: str, mark_t: str = "t") -> Column:
    """Linear value of ``name`` at ``te`` between ``m`` and ``nx``, constant beyond either end."""
    a, b = F.col(f"m.{mark_t}"), F.col(f"nx.{mark_t}")
    va, vb = F.col(f"m.{name}"), F.col(f"nx.{name}")
    frac = (F.greatest(F.least(te, b), a) - a) / (b - a).cast("double")
    return F.when(F.col("nx").isNull(), va).otherwise(va + (vb - va) * frac)


def nearest(left: DataFrame, marks: DataFrame, keys: list[str], t: Column, mark_t: str = "t",
            tol_us: int | None = None, bucket_us: int = US) -> DataFrame:
    """Attach struct ``near`` = the mark closest in time (the earlier one on ties)."""
    j = asof(left, marks, keys, t, mark_t, bucket_us)
    dm, dn = F.abs(t - F.col(f"m.{mark_t}")), F.abs(t - F.col(f"nx.{mark_t}"))
    near = F.when(dn < dm, F.col("nx")).otherwise(F.col("m"))
    j = j.withColumn("near", near)
    if tol_us is not None:
        j = j.withColumn("near", F.when(F.abs(t - F.col(f"near.{mark_t}")) <= tol_us,
                                        F.col("near")))
    return j.select(*left.columns, "near")
