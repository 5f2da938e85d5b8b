"""Prefix trie of conversations: what a cache of shared beginnings would save.

A turn is known by the SHA-256 of its role and text, so texts never move.  Conversations are gathered as lists of turns, rebuilt,
and equal lists become one class with a count and the smallest conv_id.  Classes are range-partitioned by their turns into
shards.  A shard numbers its turns by a dictionary in their own order, puts the median of its sorted classes into a ternary
search tree first, then the medians of both halves, and so on, which keeps every level balanced; one walk over the nodes from
the last to the first adds up members, leaves and savings, with no recursion however deep a conversation is.

A node that two shards share lies on the path to the last class of the one and to the first of the next, at a depth that both
paths have in common.  Such boundary nodes belong to the first shard that has them.  Their sums are cut so that they simply
add: each shard counts its own members, the owner takes off the one copy that must be read anyway, and a boundary node is
never a leaf, since two different classes go through it.  One aggregation by owner and depth merges them.

The conv_ids that end at a node are joined in blocks of ``LISTED`` ids first; the blocks of a class are then hashed one after
the other as a stream, so a class of any size takes little memory.  A conversation is a record: its turns are held by one task
(about 40 bytes each), as is the path to the first and last class of each shard by the driver.

Null roles and texts are empty ones.  A null turn comes first; turns with the same number follow in the order of their
hashes, repeated rows are turns of their own.  Rows with a null conv_id belong to no conversation and make no node.  Texts of any
length are read whole.  Other columns, whatever their names, are not read.  An empty table gives an empty table, without a root.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage

#: Turns of a shard: so many while there are fewer than ``SHARDS`` shards, then up to the second number.
PER_SHARD, SHARDS, MOST = 20_000, 64, 1_000_000
#: Ids that are joined to one text.
LISTED = 4096
#: Boundary nodes that may be broadcast; more are joined by shuffle.
BROADCAST_NODES = 500_000
NOTHING = hashlib.sha256(b"").hexdigest()


def gathered(conversations: DataFrame) -> DataFrame:
    """conv_id, seq: the turns (sha, words) of every conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct(
        "turn", name.alias("sha"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return lists.select("conv_id", F.transform("ts", lambda t: F.struct(t.sha.alias("sha"), t.words.alias("words"))).alias("seq"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, seq: the first h turns of conversation c - c % 20, then the own turns after the first h; h = crc32(c) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    rows = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 20})
    heads = own.select(F.col("conv_id").alias("base"), F.slice("seq", 1, 3).alias("head"))
    both = rows.join(heads, "base", "left")
    none = F.slice("seq", 1, 0)
    tail = F.when(F.size("seq") > F.col("h"), F.slice("seq", F.col("h") + 1, F.size("seq"))).otherwise(none)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    return both.select("conv_id", F.concat(head, tail).alias("seq"))


def _hashed(batches):
    """One hash for each digest from its blocks of ids, which arrive in order."""
    now, h = None, None
    for pdf in batches:
        done = []
        for digest, ids in zip(pdf.digest, pdf.ids):
            if digest != now:
                if now is not None:
                    done.append((now, h.hexdigest()))
                now, h = digest, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["digest", "ends"])
    if now is not None:
        yield pd.DataFrame([(now, h.hexdigest())], columns=["digest", "ends"])


def classes(convs: DataFrame) -> DataFrame:
    """seq, n, first, ends: every different conversation, its members, the smallest of them, and the hash of their ids."""
    digest = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda t: F.hex(t.sha)), ""), 256))
    rows = cut_lineage(convs.withColumn("digest", digest))
    blocks = rows.groupBy("digest", F.floor(F.col("conv_id") / LISTED).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("digest", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ends = blocks.repartition("digest").sortWithinPartitions("digest", "block").select("digest", "ids").mapInPandas(_hashed, "digest binary, ends string")
    groups = rows.groupBy("digest").agg(F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    return groups.join(ends, "digest").select("seq", "n", "first", "ends")


def _path(seq) -> list[bytes]:
    return [t["sha"] for t in seq]


def _edges(batches):
    """shard, first and last class of a shard."""
    shard = first = last = None
    for b in batches:
        if b.num_rows:
            shard = b.column("shard")[0].as_py()
            first = first if first is not None else _path(b.column("seq")[0].as_py())
            last = _path(b.column("seq")[b.num_rows - 1].as_py())
    if shard is not None:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.list_(pa.binary())), pa.array([last], pa.list_(pa.binary()))], ["shard", "first", "last"])


def _common(a, b) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def borders(edges: list) -> dict[int, tuple[list[int], int]]:
    """For each shard: the owners of the boundary nodes on its first path, by depth, and the depth of those on its last path.

    A shard without a neighbour on a side has none there (an empty list, -1).
    """
    out, before = {}, None
    for k, e in enumerate(edges):
        owners: list[int] = []
        if before is not None:
            up = _common(before.last, e.first)
            through = min(_common(before.first, before.last), len(out[before.shard][0]) - 1)
            owners = [out[before.shard][0][d] if d <= through else before.shard for d in range(up + 1)]
        down = _common(e.last, edges[k + 1].first) if k + 1 < len(edges) else -1
        out[e.shard] = (owners, down)
        before = e
    return out


class Tree:
    """A ternary search tree of lists of numbers; node 0 is the empty list, and a node's parent always comes before it."""

    def __init__(self):
        self.key, self.low, self.high, self.down, self.parent = [-1], [0], [0], [0], [0]

    def _node(self, key: int, parent: int) -> int:
        for column, value in ((self.key, key), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, keys) -> int:
        """The node of a list, made where it is missing."""
        at = 0
        for key in keys:
            link, k, to = self.down, at, self.down[at]
            while to and self.key[to] != key:
                link, k = (self.low, to) if key < self.key[to] else (self.high, to)
                to = link[k]
            if not to:
                to = link[k] = self._node(key, at)
            at = to
        return at


def medians(n: int):
    """0 to n - 1: the middle, then the middles of both halves, and so on."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            todo += [(middle + 1, b), (a, middle)]


_PARTS = "owner int, depth long, first long, up_owner int, up_first long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def _grown(plan):
    def run(batches):
        shard, seqs, words, n, first, ends = None, [], {}, [], [], []
        for b in batches:
            if b.num_rows:
                shard = b.column("shard")[0].as_py()
            for seq in b.column("seq"):
                turns = seq.as_py()
                seqs.append(_path(turns))
                words.update((t["sha"], t["words"]) for t in turns)
            n += b.column("n").to_pylist()
            first += b.column("first").to_pylist()
            ends += b.column("ends").to_pylist()
        if shard is not None:
            yield from _nodes(shard, seqs, words, n, first, ends, *plan.value[shard])

    return run


def _nodes(shard, seqs, words, n, first, ends, owners, down):
    """The nodes of a shard with the sums of their subtrees."""
    number = {sha: k for k, sha in enumerate(sorted(words))}
    size = [words[sha] for sha in sorted(words)]
    tree, last_of = Tree(), {}
    for k in medians(len(seqs)):
        last_of[tree.insert(map(number.__getitem__, seqs[k]))] = k
    count = len(tree.key)
    owner = [-1] * count
    for seq, depth, owned in ((seqs[0], len(owners) - 1, owners), (seqs[-1], down, None)):
        at = 0
        for d in range(depth + 1):
            at = _child(tree, at, number[seq[d - 1]]) if d else 0
            if owner[at] < 0:
                owner[at] = shard if owned is None else owned[d]
    depth = [0] * count
    for k in range(1, count):
        depth[k] = depth[tree.parent[k]] + 1
    members, least, children, leaves, saved = [0] * count, [None] * count, [0] * count, [0] * count, [0] * count
    for k, c in last_of.items():
        members[k], least[k] = n[c], first[c]
    for k in range(count - 1, -1, -1):
        border = owner[k] >= 0
        own = size[tree.key[k]] if k else 0
        saved[k] += members[k] * own - (own if not border or owner[k] == shard else 0)
        if not border and not children[k]:
            leaves[k] = 1
        if k:
            p = tree.parent[k]
            members[p] += members[k]
            least[p] = least[k] if least[p] is None else min(least[p], least[k])
            children[p] += not border or owner[k] == shard
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    above = [(None, None)] + [(owner[p], None) if owner[p] >= 0 else (None, least[p]) for p in tree.parent[1:]]
    mark = [ends[last_of[k]] if k in last_of else None for k in range(count)]
    columns = [pa.array([o if o >= 0 else None for o in owner], pa.int32()), pa.array(depth, pa.int64()), pa.array(least, pa.int64()),
               pa.array([a for a, _ in above], pa.int32()), pa.array([b for _, b in above], pa.int64()), pa.array(members, pa.int64()), pa.array(children, pa.int64()),
               pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.array(mark, pa.string())]
    whole = pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _PARTS.split(", ")])
    for a in range(0, count, 50_000):
        yield whole.slice(a, 50_000)


def _child(tree: Tree, at: int, key: int) -> int:
    to = tree.down[at]
    while tree.key[to] != key:
        to = tree.low[to] if key < tree.key[to] else tree.high[to]
    return to


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    own = cut_lineage(gathered(conversations))
    kinds = cut_lineage(classes(rebuilt(own)))
    turns = kinds.agg(F.sum(F.size("seq"))).first()[0] or 0
    shards = max(1, -(-turns // MOST), min(SHARDS, -(-turns // PER_SHARD)))
    dealt = kinds.repartitionByRange(shards, "seq").sortWithinPartitions("seq").withColumn("shard", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    edges = dealt.select("shard", "seq").mapInArrow(_edges, "shard int, first array<binary>, last array<binary>").orderBy("shard").collect()
    plan = borders(edges)
    parts = cut_lineage(dealt.mapInArrow(_grown(spark.sparkContext.broadcast(plan)), _PARTS))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("owner is not null").groupBy("owner", "depth").agg(
        F.min("first").alias("first"), F.max("up_owner").alias("up_owner"), F.lit(None).cast("long").alias("up_first"), *sums, F.max("ends").alias("ends"))
    merged = cut_lineage(merged.select(*parts.columns))
    over = merged.select(F.col("owner").alias("up_owner"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("up"))
    if sum(len(owners) + down + 1 for owners, down in plan.values()) <= BROADCAST_NODES:
        over = F.broadcast(over)
    nodes = parts.where("owner is null").unionByName(merged)
    nodes = nodes.join(over, ["up_owner", "depth"], "left")
    return nodes.select(F.col("first").alias("conv_id"), "depth", F.coalesce("up_first", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
