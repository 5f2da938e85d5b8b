"""Line dedup against a plain version: both ways of testing the filter, odd rows, and lines that most documents share."""
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import linededup
from test_operators import ODD, empty, odd  # noqa: F401

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows):
    def key(line):
        k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))
        return k if len(k) >= 20 else None

    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held[k].append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, linededup.line_dedup(df).collect()), key=str)


def corpus(n=400):
    r = random.Random(4)
    common = [f"a line that stands in many of the documents {k}" for k in range(30)]
    rows = []
    for i in range(n):
        lines = [f"line {r.randrange(10 ** 9)} of its own, long enough" for _ in range(r.randrange(4))]
        lines += [r.choice([str.upper, str, lambda x: f" \t{x}\r"])(c) for c in r.sample(common, r.randrange(4))] + ["short", ""]
        lines += ["THE HOT line of nearly every document é"] * (r.random() < 0.8)
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(7, rows[3][1])] * 5 + [(None, rows[9][1])] * 5 + [(None, "only the rows without a number hold this line")] * 4


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_line_dedup_matches_plain(spark, odd, empty, monkeypatch, most):  # noqa: F811
    monkeypatch.setattr(linededup, "BROADCAST", most)
    assert got(odd) == plain([(r[0], r[1]) for r in ODD])
    assert got(empty) == []
    monkeypatch.setattr(linededup, "SEGMENT", 8)
    rows = corpus()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == plain(rows)


def test_key_length_and_two_holders(spark):
    short, long_ = "x" * 19, "é" * 20
    rows = [(i, f"{short}\n{long_}\n") for i in range(3)] + [(i, "a line that only two hold, so it stays") for i in (8, 9)]
    want = plain(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert [r[2] for r in want] == [1, 1, 0, 0, 0]


def test_filter_holds_every_repeat_and_little_else(spark):
    r = random.Random(1)
    lines = [f"unlike any other line {k} {r.random()}" for k in range(4000)]
    rows = [(k, line) for k, line in enumerate(lines)] + [(5000 + k, lines[k]) for k in range(200)]
    words = len(rows) // linededup.LOAD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    _, test = linededup._by_broadcast(docs, linededup.filters(docs, words), words)
    import pandas as pd
    hit = test(None, pd.util.hash_array(np.array(lines, object), categorize=False), None, np.arange(len(lines)))
    assert hit[:200].all() and hit[200:].mean() < 0.05


def test_nothing_shared_shuffles_nothing(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that stands alone, number "), "id").alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    assert linededup.dropped(rows).count() == 0
