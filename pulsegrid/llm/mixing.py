"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule (how its weight changes over training time 0 to 1).  Weights give targets by water-filling:
a target stops at ``MOST`` times its source's words and the excess is shared again by weight.  Integrating a schedule gives a source's
cumulative token demand over time; a document whose words follow c words of its source is due when the demand reaches
c, so inverting the demand assigns its training position.  Documents are ordered inside a source by a hash; full passes over the
source come first, then the part of a pass that comes nearest to the target.

Cumulative words are summed in buckets of the hash order and carried from bucket to bucket, so a source of any size
is never ordered in one task.

Null texts have no words: size 0, taken 0.  A null source is a source, last in order.  Null doc_ids and repeated rows are documents like
others.  A source without words has target 0.  An empty table gives an empty table.
Texts of any length count whole.  Columns of the input, whatever their names, are not mixed up with the operator's own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulsegrid.session import cut_lineage

MOST, WEIGHTS = 3, 3
#: Schedules by weight: relative weight at evenly spaced times from 0 to 1, linear between them.
SCHEDULES = {1: (1.0, 1.0), 2: (1.5, 1.0, 0.5), 3: (0.5, 1.0, 1.5)}
#: Rows of a bucket of the hash order, about.
PER_BUCKET = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def chance(doc_id: Column, text: Column) -> Column:
    """A place in the order of a source: 60 bits of a digest."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, weight, target from source, source_size (one row for each source)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1)
    s = s.withColumn("reach", MOST * F.col("source_size") / F.col("weight"))
    everything = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    full, onward = F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0)), everything.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("all_words", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # The level if this source and all of larger reach stay below theirs; sources are capped up to the last whose reach is not above it.
    s = s.withColumn("level", (F.col("all_words") - full) / F.sum("weight").over(onward))
    s = s.withColumn("capped", F.col("reach") <= F.col("level"))
    first_free = F.min(F.when(~F.col("capped"), F.struct("reach", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("free", first_free["level"])
    target = F.when(F.col("capped") | F.col("free").isNull(), MOST * F.col("source_size")).otherwise(F.least(F.col("free") * F.col("weight"), MOST * F.col("source_size")))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def due(share: Column, knots: tuple[float, ...]) -> Column:
    """The time at which a schedule's integral reaches ``share`` of its whole."""
    n = len(knots) - 1
    parts = [(a + b) / 2 / n for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(parts), 0.0, F.lit(1.0)
    pieces = []
    for k, part in enumerate(parts):
        rest = share * whole - done
        slope, a = (knots[k + 1] - knots[k]) * n, knots[k]
        step = rest / a if slope == 0 else (F.sqrt(F.greatest(a * a + 2 * slope * rest, F.lit(0.0))) - a) / slope
        pieces.append(((done + part) / whole, F.lit(k / n) + step))
        done += part
    for end, value in reversed(pieces):
        out = F.when(share <= end, value).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def position(share: Column, weight: Column) -> Column:
    out = share
    for w, knots in SCHEDULES.items():
        out = F.when(weight == w, due(share, knots)).otherwise(out)
    return out


def planned(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position (of the first copy) of every document, and what positions of
    further copies need; ``carry`` names more columns to keep."""
    names = [c for c in carry or []]
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), chance(F.col("doc_id"), F.col("text")).alias("hash"), *[F.col(f"`{c}`").alias(f"carry_{k}") for k, c in enumerate(names)])
    rows = rows if names else cut_lineage(rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sums = cut_lineage(sums)
    count = sums.agg(F.sum("rows")).first()[0] or 0
    buckets = max(64, count // PER_BUCKET)
    goal = targets(sums.select("source", "source_size")).select(F.col("source").alias("name"), "source_size", "weight", "target")
    bucket = F.floor(F.col("hash").cast("double") / float(1 << 60) * buckets).cast("long")
    rows = rows.withColumn("bucket", bucket)
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("source").alias("name"), F.col("bucket").alias("b"), start.alias("start"))
    # One row for each source and bucket, and one for each source: small tables, which Spark broadcasts by its own size test.
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside)
    small = per.join(goal, per["name"].eqNullSafe(goal["name"])).select(per["name"].alias("name"), "b", "start", "source_size", "weight", "target")
    rows = rows.join(small, F.col("source").eqNullSafe(F.col("name")) & (F.col("bucket") == F.col("b")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    rows = rows.withColumns({"before": F.col("start") + F.col("inside"), "passes": passes.cast("long")})
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest) & (F.col("passes") < MOST)
    copies = F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(0)
    rows = rows.withColumns({"copies": copies, "taken": copies * F.col("size")})
    return rows.withColumn("position", F.when(F.col("copies") > 0, copy_position(F.lit(0))))


def copy_position(k: Column) -> Column:
    """Position of copy ``k`` (from 0) of a planned row."""
    middle = k * F.col("source_size") + F.col("before") + F.col("size") / 2
    return position(F.least(middle / F.col("target"), F.lit(1.0)), F.col("weight"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position, sorted by position over all partitions."""
    out = planned(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents in training order: each as often as the mix takes it, with the columns of ``docs``."""
    rows = planned(docs, docs.columns).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("position", copy_position(F.col("copy")))
    rows = rows.repartitionByRange("position", "hash").sortWithinPartitions("position", "hash")
    return rows.select(*[F.col(f"carry_{k}").alias(c) for k, c in enumerate(docs.columns)])
