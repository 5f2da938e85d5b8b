"""Events in boxes by a grid over space and time.

A box that is open for some time is listed under every (time bucket, tile) it touches and an event looks up its own cell, so an
event only meets boxes that reach its neighbourhood: the candidates stay within a constant of the matches, however many boxes
a recording has.  Tiles are about as large as the boxes.  Up to a bound the listed boxes are broadcast and events stay where they
are; beyond it both sides are shuffled by cell, and cells with very many events are cut into parts, each with its own copy of the cell's boxes.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..schema import US
from ..session import cut_lineage
from .asof import BROADCAST_ROWS

#: Largest coordinate of a sensor; boxes are cut there.
EDGE = 1 << 16
#: Events of a cell that one task joins.
CELL_ROWS = 1_000_000
CELL = ["rec_id", "_b", "_tx", "_ty"]


def tile_of(boxes: DataFrame) -> int:
    """A power of two near the mean box side."""
    side = boxes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    return 1 << max(2, min(8, round(math.log2(max(1.0, side or 1.0)))))


def listed(boxes: DataFrame, bucket_us: int, tile: int) -> DataFrame:
    """Boxes (a <= t < b, x0 <= x < x1, y0 <= y < y1), once for each cell they touch."""
    def cells(lo, hi):
        return F.sequence(F.greatest(F.floor(F.col(lo) / tile), F.lit(0)), F.least(F.floor(F.col(hi) / tile), F.lit(EDGE // tile)))

    inside = boxes.where((F.col("b") > F.col("a")) & (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0")) & (F.col("x1") >= 0) & (F.col("y1") >= 0)
                         & (F.col("x0") <= EDGE) & (F.col("y0") <= EDGE))
    times = F.sequence(F.floor(F.col("a") / bucket_us), F.floor((F.col("b") - 1) / bucket_us))
    return (inside.withColumn("_b", F.explode(times)).withColumn("_tx", F.explode(cells("x0", "x1")))
            .withColumn("_ty", F.explode(cells("y0", "y1"))))


def _split(e: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the parts of crowded cells on both sides."""
    crowd = e.groupBy(*CELL).agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_ROWS)
    crowd = F.broadcast(cut_lineage(crowd.select(*CELL, F.ceil(F.col("_n") / CELL_ROWS).alias("_parts"))))
    # Crowded cells number at most the events over CELL_ROWS; their tables are that much smaller than the events.
    e = e.join(crowd, CELL, "left").withColumn("_part", F.pmod(F.xxhash64("t", "x", "y"), F.coalesce("_parts", F.lit(1).cast("long")))).drop("_parts")
    cells = cells.join(crowd, CELL, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop("_parts")
    return e, cells


def grid_join(ev: DataFrame, boxes: DataFrame, bucket_us: int = US, tile: int | None = None, exact: bool = True) -> DataFrame:
    """Events with the boxes that hold them: all columns of ``ev`` and the box columns beside rec_id.

    ``boxes`` has rec_id, a, b, x0, y0, x1, y1 and columns of its own, none named as an event's.  Without ``exact`` all
    candidates of the shared cells are returned.
    """
    tile = tile or tile_of(boxes)
    cells = cut_lineage(listed(boxes, bucket_us, tile))
    e = ev.withColumns({"_b": F.floor(F.col("t") / bucket_us), "_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    on = CELL
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    else:
        e, cells = _split(e, cells)
        on = [*CELL, "_part"]
    j = e.join(cells, on)
    if exact:
        j = j.where((F.col("t") >= F.col("a")) & (F.col("t") < F.col("b")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
                    & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    return j.select(*ev.columns, *[c for c in boxes.columns if c != "rec_id"])
