"""The prefix trie against a plain version: many shards, shared and deep beginnings, one hot conversation, odd rows."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x).hexdigest()


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t for _, _, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    sha(",".join(map(str, sorted(c for c in m if made[c] == p))).encode())) for p, m in members.items()), key=str)


def got(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"seq": F.lit(1), "n": F.lit("x"), "first": F.lit(None).cast("string")})
    return sorted(map(tuple, prefixtrie.trie(df).collect()), key=str)


def corpus(n=300, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        same = r.random() < 0.3
        for k in range(r.randrange(1, 7)):
            rows.append((c, k, ("user", "assistant")[k % 2], "the very same turn" if same else f"say {r.randrange(3)} of  {k}"))
    rows += [(c, k, "user", f"deep {k}" if k < 120 or c % 2 else f"other {k} {c}") for c in range(1000, 1040, 3) for k in range(130)]
    return rows


ODD = [(1, 0, None, None), (1, None, "user", "first"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "nobody"), (-7, 1, "user", "below zero"), (-7, 0, "", ""),
       (2, 5, "user", "ab"), (3, 5, "use", "rab"), (40, 0, "user", "w " * 30_000), (41, 0, "user", "only"), (44, 0, "user", None), (60, 0, "user", "é ß x")]


@pytest.mark.parametrize("per", [20_000, 40])
def test_trie_matches_plain(spark, monkeypatch, per):
    monkeypatch.setattr(prefixtrie, "PER_SHARD", per)
    monkeypatch.setattr(prefixtrie, "LISTED", 7)
    rows = corpus()
    assert got(spark, rows) == plain(rows)
    monkeypatch.setattr(prefixtrie, "BROADCAST_NODES", 0)
    rows = [(c, k, "user", f"same {k}") for c in range(400) for k in range(3)] + [(c, k, "user", f"{k} {c % 9}") for c in range(400, 480) for k in range(3)]
    assert got(spark, rows) == plain(rows)


def test_trie_odd_rows(spark):
    assert got(spark, ODD) == plain(ODD)
    assert got(spark, ODD[4:5]) == []
    assert got(spark, []) == []


def test_tree_keeps_lists_apart_and_balanced():
    tree, lists = prefixtrie.Tree(), sorted({(k % 7, k % 50, k) for k in range(500)} | {(), (1,), (1, 2)})
    ends = {}
    for k in prefixtrie.medians(len(lists)):
        ends[lists[k]] = tree.insert(lists[k])
    assert len(set(ends.values())) == len(lists) and ends[()] == 0
    assert len(tree.key) == len({p[:d] for p in lists for d in range(4)})
    assert all(p < k for k, p in enumerate(tree.parent) if k)

    def height(k):
        return 1 + max((height(x) for x in (tree.low[k], tree.high[k]) if x), default=0)

    wide = prefixtrie.Tree()
    for k in prefixtrie.medians(1000):
        wide.insert((k,))
    assert height(wide.down[0]) <= 10


def test_borders_name_the_first_owner():
    class Edge:
        def __init__(self, shard, first, last):
            self.shard, self.first, self.last = shard, first, last

    plan = prefixtrie.borders([Edge(0, "aa", "abc"), Edge(2, "abd", "abe"), Edge(3, "abef", "b"), Edge(5, "c", "d")])
    assert plan == {0: ([], 2), 2: ([0, 0, 0], 3), 3: ([0, 0, 0, 2], 0), 5: ([0], -1)}
