"""Ranked search against a plain version: large classes, ties, several blocks of items, odd rows."""
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pulsegrid.llm import bagsearch
from test_operators import ODD, empty, odd  # noqa: F401


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items, top=50):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(words(t))
    out = []
    for item, ts in terms.items():
        rows = []
        for i, b, n in bags:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def got(docs, items, **more):
    return sorted(map(tuple, bagsearch.search(docs, items, **more).collect()), key=str)


def corpus(n=500):
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(60)] + ["É", "ß9", "x"]
    text = lambda k: r.choice([" ", ", ", "-"]).join(r.choice(vocab).upper() if r.random() < 0.2 else r.choice(vocab) for _ in range(k))
    rows = [(i, text(r.randrange(1, 40))) for i in range(n)]
    rows += [(1000 + i, "w1 w2 W3 other") for i in range(200)] + [(3000 - i, "other w2, w3: w1") for i in range(100)]     # one class
    rows += [(5, "w1 w2")] * 3 + [(None, "w1 w2")] * 3 + [(6, None), (7, "")]
    r.shuffle(rows)
    return rows, [(k, text(12)) for k in range(20)] + [(3, "w1 w2 w3"), (None, "w7"), (None, "w8"), (50, None), (51, "..."), (52, "nowhere"), (53, "w1 w2 w3")]


def test_search_matches_plain(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns({"m": F.lit("x"), "bag": F.lit(1), "h": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(0))
    want = plain(docs, items)
    assert got(d, i) == want
    monkeypatch.setattr(bagsearch, "BLOCK", 60)                          # several blocks, small tables, pruning in the tasks
    monkeypatch.setattr(bagsearch, "CELLS", 400)
    monkeypatch.setattr(bagsearch, "HELD", 100)
    assert got(d, i) == want
    assert got(d, i, top=3) == plain(docs, items, 3)


def test_search_odd_rows(spark, odd, empty):  # noqa: F811
    items = [(1, "six seven w17 w19999"), (2, None), (3, "no id here")]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert got(odd, i) == plain([(r[0], r[1]) for r in ODD], items)
    assert got(empty, i) == []
    assert got(odd, i.limit(0)) == []


def test_only_the_smallest_members_of_a_class_are_shuffled(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")).unionByName(
        spark.createDataFrame([(9000 + k, f"other{k}") for k in range(9000)], "doc_id long, text string"))
    out = bagsearch.search(docs, spark.createDataFrame([(1, "two")], "item_id long, text string"))
    assert [r.doc_id for r in out.orderBy("rank").collect()] == list(range(50))
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
