"""Ordered scans (running last / sum / max / count) that never put a whole group in one task.

A plain window keyed by recording or pixel sends the whole group to one task, and one recording
may hold a third of all rows.  Here every group is cut into time chunks: a window runs inside each
(group, chunk), one summary row per chunk is carried forward by a second window over the
summaries, and the two are added.  The row data is shuffled once, on (group, chunk).
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CHUNK_US


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is last, sum, max, min or count."""
    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def last(value, inclusive=True):
    return Scan("last", value, inclusive)


def following(value):
    """First non-null value strictly after the row."""
    return Scan("last", value, False, True)


def total(value, inclusive=True):
    return Scan("sum", value, inclusive)


def highest(value, inclusive=True):
    return Scan("max", value, inclusive)


def count(inclusive=True):
    return Scan("sum", F.lit(1).cast("long"), inclusive)


def chunk_of(t: str = "t", width: int = CHUNK_US) -> Column:
    return F.floor(F.col(t) / F.lit(width)).cast("long")


def _merge(kind, carry, here):
    if kind == "last":
        return F.coalesce(here, carry)
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
    return F.greatest(carry, here) if kind == "max" else F.least(carry, here)


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None,
         **outs: Scan) -> DataFrame:
    """Add one running column per named :class:`Scan`, in ``order`` within ``keys``.

    ``chunk`` must not decrease along ``order`` within a group (the default cuts ``t``).
    """
    chunk = chunk_of() if chunk is None else chunk
    cols = {f"_v_{n}": s.value for n, s in outs.items()}
    work = df.withColumn("_chunk", chunk).withColumns(cols)
    part = [*keys, "_chunk"]
    key = F.struct(*order)
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    local, sums, carries = {}, [], {}
    for name, s in outs.items():
        v = F.col(f"_v_{name}")
        sort = [F.desc(c) if s.reverse else F.asc(c) for c in order]
        w = Window.partitionBy(*part).orderBy(*sort).rowsBetween(
            Window.unboundedPreceding, 0 if s.inclusive else -1)
        over = (Window.partitionBy(*keys)
                .orderBy(F.desc("_chunk") if s.reverse else F.asc("_chunk"))
                .rowsBetween(Window.unboundedPreceding, -1))
        c = F.col(f"_c_{name}")
        if s.kind == "last":
            local[f"_l_{name}"] = F.last(v, ignorenulls=True).over(w)
            pick = F.min_by if s.reverse else F.max_by
            sums.append(pick(v, F.when(v.isNotNull(), key)).alias(f"_c_{name}"))
            carries[f"_c_{name}"] = F.last(c, ignorenulls=True).over(over)
        else:
            local[f"_l_{name}"] = fns[s.kind](v).over(w)
            sums.append(fns[s.kind](v).alias(f"_c_{name}"))
            carries[f"_c_{name}"] = fns[s.kind](c).over(over)
    heads = work.groupBy(*part).agg(*sums).withColumns(carries)
    out = work.withColumns(local).join(heads, part)
    out = out.withColumns({n: _merge(s.kind, F.col(f"_c_{n}"), F.col(f"_l_{n}"))
                           for n, s in outs.items()})
    return out.select(*df.columns, *outs)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str,
            chunk: Column | None = None) -> DataFrame:
    """Number the islands of a group: ``out`` grows by one wherever ``starts`` holds."""
    return scan(df, keys, order, chunk, **{out: total(starts.cast("long"))})


def spine(bounds: DataFrame, first: Column, last_: Column, name: str) -> DataFrame:
    """One row per integer in [first, last] for each row of ``bounds`` (empty bins included)."""
    return bounds.withColumn(name, F.explode(F.sequence(first, last_)))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
