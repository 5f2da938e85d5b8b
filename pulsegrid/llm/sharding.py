"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a hash of their text, so equal texts stand together.  Groups of equal texts that would fill a noticeable
part of a shard are set apart (their number is bounded by the threshold).  Of the other groups a size-weighted sample of keys
gives quantile boundaries; ranges that come out overfull are subdivided and measured again.  The measured ranges are then dealt to
the shards in key order, filling what the large groups have left free.  A group larger than a shard is cut into
pieces by hash of a row number, so that rows without a doc_id, or with the same one, are spread like any others.  Slots number the rows of a shard without gaps: rows are numbered inside a range, and the range's
start is the sum of those before it, so no task ever orders a whole shard.

A null text has no bytes and so size 1, checksum 0; it forms one group with the empty text.  A null doc_id is kept.  Repeated rows
all get slots of their own.  A very long text is one row like any other, only its size and checksums travel.  Other columns, whatever their
names, are not read.  An empty table gives an empty table.
"""
from __future__ import annotations

import heapq

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pulsegrid.session import cut_lineage

SHARDS = 8
#: A group is large from this share of a shard's bytes or rows on, so there are at most 2 * SHARDS / LARGE of them.
LARGE = 0.002
#: Ranges: so many for each shard at least, and none larger than about this many bytes; sampled keys for each range.
RANGES, RANGE_BYTES, SAMPLES = 512, 256 << 20, 8
#: Rows that a large group's piece may always have, and pieces of a shard's size that a group larger than a shard is cut into.
PIECE_ROWS, FINE = 2_000, 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("key"))


def splitters(groups: DataFrame, ranges: int) -> list[float]:
    """Quantile boundaries of a size-weighted sample of keys (an exponential race, with hashes for chance)."""
    chance = (F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    drawn = groups.select("key", (-F.log(chance) / F.col("bytes")).alias("time")).orderBy("time", "key").limit(ranges * SAMPLES)
    keys = sorted(float(r.key) for r in drawn.select("key").collect())
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def bucketed(rows: DataFrame, cuts: list[float]) -> DataFrame:
    edges = [float("-inf"), *cuts, float("inf")]
    if len(edges) < 3:
        return rows.withColumn("unit", F.lit(0).cast("long"))
    b = Bucketizer(splits=edges, inputCol="place", outputCol="bucket")
    return b.transform(rows.withColumn("place", F.col("key").cast("double"))).withColumn("unit", F.col("bucket").cast("long")).drop("bucket", "place")


def subdivided(groups: DataFrame, cuts: list[float], most: float, rounds: int = 4) -> list[float]:
    """Add boundaries inside every range of more than ``most`` bytes, by even steps of the (hashed) key."""
    for _ in range(rounds):
        full = {r.unit: r.bytes for r in bucketed(groups, cuts).groupBy("unit").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > most).collect()}
        edges, more = [-2.0 ** 63, *cuts, 2.0 ** 63], set(cuts)
        for unit, size in full.items():
            a, b, n = edges[unit], edges[unit + 1], int(size // most) + 1
            more |= {a + (b - a) * k / n for k in range(1, n)}
        if len(more) == len(cuts):
            break
        cuts = sorted(more)
    return cuts


def deal(pieces: list, target: float, shards: int) -> list[tuple]:
    """unit, sub, shard, first slot for the measured pieces (unit, sub, bytes, rows); negative units are large groups."""
    load, shard_of = [0] * shards, {}
    heap = [(0, s) for s in range(shards)]

    def put(cells, size):
        least, s = heapq.heappop(heap)
        load[s] = least + size
        heapq.heappush(heap, (load[s], s))
        shard_of.update(dict.fromkeys(cells, s))

    by_unit: dict[int, list] = {}
    for p in pieces:
        if p.unit < 0:
            by_unit.setdefault(p.unit, []).append(p)
    jobs = []
    for unit, own in by_unit.items():
        size = sum(p.bytes for p in own)
        jobs += [([(unit, p.sub) for p in own], size)] if size <= target else [([(unit, p.sub)], p.bytes) for p in own]
    for cells, size in sorted(jobs, key=lambda j: (-j[1], j[0])):
        put(cells, size)
    rest = sorted((p for p in pieces if p.unit >= 0), key=lambda p: (p.unit, p.sub))
    level = max(target, max(load))
    room = [max(0, level - x) for x in load]
    left, total = sum(p.bytes for p in rest), sum(room) or 1
    ends, at = [], 0.0
    for r in room:
        at += r * left / total
        ends.append(at)
    done, s = 0, 0
    for p in rest:
        while s < shards - 1 and done + p.bytes / 2 > ends[s]:
            s += 1
        shard_of[p.unit, p.sub] = s
        done += p.bytes
    first, out = [0] * shards, []
    for p in sorted(pieces, key=lambda p: (p.unit, p.sub)):
        s = shard_of[p.unit, p.sub]
        out.append((p.unit, p.sub, s, first[s]))
        first[s] += p.rows
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    rows = cut_lineage(sized(docs).withColumn("number", F.monotonically_increasing_id()))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = cut_lineage(groups)
    whole = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    total, count = whole.bytes or 0, whole.rows or 0
    target, per_window = total / shards, max(PIECE_ROWS, count // (shards * RANGES))
    is_large = (F.col("bytes") > target * LARGE) | (F.col("rows") > count / shards * LARGE)
    large = groups.where(is_large).orderBy(F.desc("bytes"), "key").collect()
    pieces_of = [max(-(-r.rows // per_window), int(r.bytes * FINE // target) + 1 if r.bytes > target else 1) for r in large]
    table = spark.createDataFrame([(r.key, -1 - k, n) for k, (r, n) in enumerate(zip(large, pieces_of))], "key long, large_unit long, subs int")
    others = groups.where(~is_large)
    ranges = max(shards * RANGES, total // RANGE_BYTES + 1)
    cuts = subdivided(others, splitters(others, ranges), 2 * max(1.0, total / ranges))
    # The large groups are bounded in number, so their table may be broadcast.
    placed = bucketed(rows, cuts).join(F.broadcast(table), "key", "left")
    placed = placed.withColumns({"unit": F.coalesce("large_unit", "unit"), "sub": F.pmod(F.xxhash64("number"), F.coalesce("subs", F.lit(1))).cast("int")})
    placed = cut_lineage(placed.select("doc_id", "size", "text_crc32", "key", "unit", "sub"))
    pieces = placed.groupBy("unit", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    plan = spark.createDataFrame(deal(pieces, target, shards), "unit long, sub int, shard int, first long")
    number = F.row_number().over(Window.partitionBy("unit", "sub").orderBy("key", "doc_id", "size"))
    numbered = placed.withColumn("number", number.cast("long"))
    # One row for each range: their number is set by the input's bytes over RANGE_BYTES, so Spark's own size test decides on a broadcast.
    return numbered.join(plan, ["unit", "sub"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                                                       (F.col("first") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
