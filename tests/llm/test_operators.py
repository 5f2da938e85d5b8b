"""The training-data operators on small tables: odd rows, planted cases, and plain Python versions of the same results."""
import hashlib
import html
import itertools
import pathlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from pulsegrid.llm import decontam, dedup, dom, golomb, html_extract, jaccard, langid, licenses, mixing, sharding, toxicity, warc
from pulsegrid.llm.catalog import ORACLES, QUERIES
from pulsegrid.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, size long, cls long"
LONG = " ".join(f"w{k}" for k in range(20_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, BASE, "en", "a"), (4, BASE, "en", "a"), (5, BASE, None, "b"),
       (6, LONG, "en", "b"), (7, LONG + " tail", "de", "b"), (None, "no id here", "en", "c"), (None, None, None, None), (8, "???", "fr", "c"),
       (9, "Licensed under the Apache License, Version 2.0.\nMIT License mit license", "en", "c"), (10, "Éa ß ñ", "es", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, repeated rows, and columns whose names operators use themselves."""
    ship(spark)
    return spark.createDataFrame([(*r, 1, 0.5, "x", 3, 9) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, BASE), (2, "no id"), (3, None), (4, ""), (None, "one two"), (5, BASE)], "item_id long, text string")


def test_words_match_plain_regex(spark):
    import pyarrow as pa
    from pulsegrid.llm.text import ALNUM_WORDS, BLANK_WORDS, Words, word_hashes
    texts = [r[1] for r in ODD] + ["a b  c", "x", " é Z z-9", "A\x00B"]
    for table, rule in ((ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (BLANK_WORDS, r"[^\x20\x09-\x0D]+")):
        want = [re.findall(rule, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        w = Words(pa.array(texts), table)
        vocab = w.vocab.to_pylist()
        assert [[vocab[c] for c in w.codes[a:b]] for a, b in zip(w.start[:-1], w.start[1:])] == want
        h, start = word_hashes(pa.array(texts), table)
        flat = list(itertools.chain(*want))
        assert start.tolist() == [0, *itertools.accumulate(map(len, want))]
        assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_golomb_round_trip():
    import numpy as np
    for n, top in ((0, 1), (1, 1 << 63), (1000, 1 << 62), (500, 600)):
        v = np.sort(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
        assert (golomb.decode(golomb.encode(v)) == v).all()


# ---- exact dedup

def plain_dedup(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None) if len(same) > 1 else i
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_odd_rows(odd, empty, monkeypatch):
    want = plain_dedup([(r[0], r[1]) for r in ODD])
    assert sorted(map(tuple, dedup.exact_dedup(odd).collect()), key=str) == want
    monkeypatch.setattr(dedup, "PER_SENDER", 3)                       # several senders and owners
    monkeypatch.setattr(dedup, "BROADCAST_SUSPECTS", 0)               # the shuffled way
    assert sorted(map(tuple, dedup.exact_dedup(odd).collect()), key=str) == want
    assert dedup.exact_dedup(empty).count() == 0


# ---- n-gram Jaccard

def plain_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            k = len(x & y)
            if k and 100 * k >= 75 * (len(x) + len(y) - k):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    name = {g: min((sets[k][0] for k in range(len(sets)) if group[k] == g and sets[k][0] is not None), default=None) for g in group}
    return sorted(((i, len(s), name[group[k]] if s else i) for k, (i, s) in enumerate(sets)), key=str)


def near_copies(n):
    """A chain of texts each near its neighbour only, a group of near copies, and unlike texts."""
    words = [f"t{k}" for k in range(60 + 4 * n)]
    chain = [" ".join(words[4 * k:4 * k + 60]) for k in range(n)]
    star = [" ".join(f"s{j}" if j != (7 * k) % 80 else f"edit{k}" for j in range(80)) for k in range(n)]
    far = [" ".join(f"f{k}-{j}" if j % 6 else f"common{j}" for j in range(40)) for k in range(n)]
    return [*enumerate([*chain, *star, *far])]


def test_jaccard_matches_all_pairs(spark, odd, empty, monkeypatch):
    rows = [(r[0], r[1]) for r in ODD]
    assert sorted(map(tuple, jaccard.jaccard_components(odd).collect()), key=str) == plain_components(rows)
    assert jaccard.jaccard_components(empty).count() == 0
    rows = near_copies(12)
    monkeypatch.setattr(jaccard, "SMALL", 4)                          # tiles of several blocks as well
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == plain_components(rows)
    monkeypatch.setattr(jaccard.links, "__defaults__", (0,))          # no rounds with centres: every pair by tiles
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == plain_components(rows)


def plain_links(rows):
    sets = plain_sets(rows)
    def near(x, y):
        return bool(x) and 100 * len(x & y) >= 75 * len(x | y)
    return sorted(((i, sum(k != j and near(s, t) for j, (_, t) in enumerate(sets))) for k, (i, s) in enumerate(sets)), key=str)


def test_link_counts_match_all_pairs(spark, odd, empty, monkeypatch):
    """Every link between different texts is counted, in a hot group of near copies and in chains, whatever the block size."""
    def got(df):
        return sorted(((r.doc_id, r.n_links) for r in jaccard.jaccard_join(df).collect()), key=str)

    assert got(odd) == plain_links([(r[0], r[1]) for r in ODD])
    assert got(empty) == []
    words = [f"h{j}" for j in range(120)]
    hot = [" ".join(w if j not in {(5 * k) % 120, (11 * k) % 120} else f"x{k}" for j, w in enumerate(words[: 120 - k % 20])) for k in range(60)]
    rows = [*near_copies(12), *[(100 + k, t) for k, t in enumerate(hot)], *[(300 + k, hot[0]) for k in range(5)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_links(rows)
    assert max(n for _, n in want) > 25 and got(docs) == want
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard.links, "__defaults__", (0,))
    assert got(docs) == want


def test_blocks_return_forests(spark, monkeypatch):
    """A tile of near copies without centres returns at most one link a member."""
    import numpy as np
    import pandas as pd
    r = np.random.default_rng(3)
    base = np.sort(r.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.sort(np.concatenate([np.delete(base, r.integers(0, 400, 20)), r.integers(0, 1 << 63, 5).astype(np.uint64)])) for _ in range(80)]
    pdf = pd.DataFrame({"side": 0, "cls": np.arange(80), "n": [len(s) for s in sets], "label": np.arange(80), "items": [s.tobytes() for s in sets]})
    assert len(jaccard._tile_forest(None, pdf)) == 79
    pdf["size"] = 1
    assert jaccard._block_counts(None, pdf).linked.tolist() == [79] * 80


def test_texts_become_sets_four_times(spark, monkeypatch):
    """For the classes, the postings and twice for kept sets, which the later steps read."""
    passes, plain = [], jaccard._mapped
    monkeypatch.setattr(jaccard, "_mapped", lambda *a: passes.append(a[-1]) or plain(*a))
    jaccard.jaccard_join(spark.createDataFrame(near_copies(8), "doc_id long, text string").repartition(3)).collect()
    assert len(passes) == 4


def test_jaccard_drops_its_shuffle_files(spark):
    import time
    rows = spark.createDataFrame(near_copies(8), "doc_id long, text string").repartition(3)

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n.split("_")[1] for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")}

    before = files()
    out = jaccard.jaccard_components(rows)
    until = time.time() + 10
    while len(left := files() - before) > 1 and time.time() < until:  # the last one, of the components, may stay
        time.sleep(0.2)
    assert len(left) <= 1, sorted(left)
    assert out.count() == len(near_copies(8))


def test_lean_batches_are_small(spark):
    from pyspark.sql import functions as F
    from pulsegrid.session import cut_lineage
    rows = spark.range(0, 48, 1, 1).select(F.expr("repeat('x', 1000000)").alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    sizes = [r.n for r in cut_lineage(rows.mapInArrow(size, "n long"), free_shuffles=True).collect()]
    assert max(sizes) < 12_000_000 and sum(sizes) > 47_000_000


def test_buckets_count_links_inside_components():
    import numpy as np
    import pandas as pd
    base = [np.arange(k * 1000, k * 1000 + 100, dtype=np.uint64) for k in range(3)]
    sets = [b[:100 - j] for b in base for j in range(4)]
    pdf = pd.DataFrame({"component": np.repeat([0, 1, 1], 4), "cls": np.arange(12), "n": [len(s) for s in sets], "size": np.tile([1, 2, 3, 4], 3), "items": [s.tobytes() for s in sets]})
    assert jaccard._bucket_counts(None, pdf).linked.tolist() == [9, 8, 7, 6] * 3
    sigs = [jaccard.signature(s) for s in (*sets, np.arange(700, dtype=np.uint64))]
    assert jaccard.distances(sigs, sigs[::-1]).tolist() == [jaccard.distance(x, y) for x, y in zip(sigs, sigs[::-1])]


def test_signature_distance_bounds_the_difference():
    import numpy as np
    r = np.random.default_rng(5)
    for n, m in ((5, 7), (300, 260), (5000, 4000)):
        x, y = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)), np.unique(r.integers(0, 1 << 63, m).astype(np.uint64))
        y = np.unique(np.concatenate([y, x[: n // 2]]))
        assert jaccard.distance(jaccard.signature(x), jaccard.signature(y)) <= len(np.setxor1d(x, y))


def test_one_of_each_keeps_single_documents(odd):
    kept = sorted((r.doc_id, r.text) for r in jaccard.one_of_each(odd).where("doc_id is not null").collect())
    assert [k for k, _ in kept] == [1, 2, 3, 4, 6, 8, 9, 10] and odd.columns == jaccard.one_of_each(odd).columns


# ---- clashing names, repeated rows

def test_recognised_keeps_clashing_columns(spark):
    rows = [(k, f"the plain words of document {k} and the rest of them", "en", 111, "x", 7) for k in range(40)] + [(90, "123 456", "en", 112, "y", 8), (91, None, None, 113, "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _a long, hash_a string, row long")
    kept = langid.recognised(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == rows[:40]


def test_shards_stay_even_with_repeated_rows(spark):
    """Thousands of equal rows, without a doc_id and with one: even bytes, gapless slots, and the sizes of the texts."""
    text = "seven b"
    rows = [(k, f"plain row {k:05d} " + "x" * (k % 17)) for k in range(4000)] + [(None, text)] * 6000 + [(77_777, text + "!")] * 3000
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    load, slots = [0] * 8, [[] for _ in range(8)]
    for r in out:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    even = sum(len(t) + 1 for _, t in rows) / 8
    assert max(load) <= 1.02 * even and min(load) >= 0.98 * even
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(i), len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)


# ---- decontamination

def plain_contamination(rows, items):
    words = (lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            b = words(text)
            for k in range(max(min(1, len(b)), len(b) - 12)) if item is not None else ():
                p = b[k:k + 13]
                for a in range(len(w) - len(p) + 1):
                    if w[a:a + len(p)] == p:
                        hit |= set(range(a, a + len(p)))
                        names.add(str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, odd, empty, bench):
    rows = [(r[0], r[1]) for r in ODD if r[0] not in (6, 7)]
    items = [tuple(r) for r in bench.collect()]
    docs = odd.where("doc_id is null or doc_id not in (6, 7)")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = plain_contamination(rows, items)
    assert sorted(map(tuple, decontam.contamination(docs, bench).select(cols).collect()), key=str) == want
    blocks = decontam.marked(docs, bench, size=2)                     # several blocks, one after the other
    assert sorted((r.row.doc_id, r.n_hit, len(r["items"])) for r in blocks.where("row.doc_id is not null").collect()) == sorted((w[0], w[2], w[3]) for w in want if w[0] is not None)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(odd, bench.where("false")).where("n_hit > 0").count() == 0
    assert {r.doc_id for r in decontam.clean(odd, bench).collect()} == {1, 2, 3, 6, 7, 8, 9, 10, None}
    near = decontam.proximity_matches(docs, spark.createDataFrame([(1, "five one three")], "item_id long, text string"), within=5).collect()
    assert {(r.doc_id, r["first"], r["last"]) for r in near} == {(4, 0, 4), (5, 0, 4)}


# ---- licenses

def test_license_scan(spark, odd, empty):
    rows = {r.doc_id: r for r in licenses.scan(odd).where("doc_id is not null").collect()}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0
    r = rows[9]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (12, 3, 3, 10, "apache,mit", "apache,apache-2.0,mit")
    assert rows[1].n_words == rows[2].n_words == 0 and rows[1].first_word is None and rows[1].labels == "" and rows[6].n_words == 20_000


# ---- sharding and mixing

def test_shards_are_even_and_whole(spark, odd, empty):
    rows = [(k, "copy" * 50 if k % 3 == 0 else f"text {k} " * (1 + k % 17)) for k in range(2000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    assert len(out) == 2000 and sorted(out.doc_id) == list(range(2000))
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() / size.mean() < 1.02
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = dict(rows)
    assert all(len(texts[i].encode()) + 1 == s and zlib.crc32(texts[i].encode()) == c for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    small = out[out.doc_id % 3 != 0].assign(text=lambda d: d.doc_id.map(texts)).groupby("text").shard.nunique()
    assert (small == 1).all()
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(empty).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        goal = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mixing_reaches_targets(spark, odd, empty):
    rows = [(k, "w " * (1 + k % 50), [None, "b", "a", "big"][min(3, k % 9)]) for k in range(3000)] + [(9000, "w w", "tiny"), (9001, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    source = {r[0]: r[2] for r in rows}
    out["source"] = [source[i] or "~" for i in out.doc_id]
    goal = plain_targets({s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})
    for s, g in out.groupby("source"):
        assert abs(g.target.iloc[0] - goal[None if s == "~" else s]) < 1e-6
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 26 and (g.taken <= 3 * g["size"]).all()
    assert out.position.dropna().between(0, 1).all() and out.position.dropna().is_monotonic_increasing
    copies = mixing.mixed(docs)
    assert copies.count() == out.copies.sum() and copies.columns == docs.columns
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0


def test_due_inverts_the_schedule(spark):
    for knots in mixing.SCHEDULES.values():
        for share, t in spark.range(11).select(F.col("id") / 10, mixing.due(F.col("id") / 10, knots)).collect():
            steps = [(j + 0.5) / 20000 for j in range(20000)]
            rate = (lambda x: knots[int(x * (len(knots) - 1))] + (x * (len(knots) - 1) - int(x * (len(knots) - 1))) * (knots[int(x * (len(knots) - 1)) + 1] - knots[int(x * (len(knots) - 1))]))
            whole = sum(map(rate, steps))
            assert abs(sum(rate(x) for x in steps if x < t) / whole - share) < 1e-3


# ---- models

def test_language(spark, odd, empty):
    en = ["the cat and the dog were here", "this is the house that they had"]
    de = ["der hund und die katze waren hier", "das ist das haus das sie hatten"]
    rows = [(k, (en if k % 2 else de)[k // 2 % 2] + f" {k}", "en" if k % 2 else "de") for k in range(80)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows + [(100, None, "en"), (101, "12 34", "en"), (102, "katzenhaus", None)], "doc_id long, text string, lang string")).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang in rows) and out[100].lang_pred == out[101].lang_pred == "und" and out[102].lang_pred == "de"
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in out) and all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(odd).count() == odd.count() and langid.identify(empty).count() == 0
    assert {r.doc_id for r in langid.recognised(odd).collect()} == {4, 5, 6, 7, 9, 10, None} and langid.recognised(odd).columns == odd.columns
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_language_model_is_whole_whatever_travels(spark, odd, monkeypatch):
    en, de, small = "the cat and the dog were here in this house", "der hund und die katze waren hier im haus", "ko te ngeru me te kuri i konei"
    rows = [(k, f"{(en, de, small)[0 if k % 20 > 2 else k % 3]} {k} rare{k % 50}x", ("en", "de", "mi")[0 if k % 20 > 2 else k % 3]) for k in range(300)]
    rows += [(1000, "kuri ngeru", None), (1001, "katzenhaus waren", None), (1002, "rare7x konei", None), (1003, "\u4e2d\u6587", None), (1004, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = sorted(map(tuple, langid.identify(docs).collect()))
    assert [r[2] for r in whole[-5:-2]] == ["mi", "de", "mi"] and whole[-1][2] == "und"
    monkeypatch.setattr(langid, "WORDS", 3)
    for most in (langid.GRAMS, 5, 0):
        monkeypatch.setattr(langid, "GRAMS", most)
        assert sorted(map(tuple, langid.identify(docs).collect())) == whole
    assert {r.doc_id for r in langid.recognised(odd).collect()} == {4, 5, 6, 7, 9, 10, None}
    monkeypatch.setattr(langid, "PENALTY", -3.0)                      # as in a corpus where rare words count for less than that
    assert all(r.lang_pred == lang for r, (_, _, lang) in zip(langid.identify(docs).where("doc_id < 300").orderBy("doc_id").collect(), rows))


def test_language_moves_open_words_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "WORDS", 50)
    monkeypatch.setattr(langid, "GRAMS", 4_000)
    r = np.random.default_rng(3)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    texts = [" ".join("".join(parts[i] for i in r.integers(0, 12, 5)) for _ in range(60)) for _ in range(4_000)]
    spark.createDataFrame([(k, t, ("en", "de")[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/docs")
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = (lambda: {f: f.stat().st_size for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")})
    earlier, whole = set(files()), sum(map(len, texts))
    new = (lambda: sum(n for f, n in files().items() if f not in earlier) / whole)
    out = langid.identify(spark.read.parquet(f"{tmp_path}/docs"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    first = new()
    assert out.write.parquet(f"{tmp_path}/out") is None and spark.read.parquet(f"{tmp_path}/out").count() == len(texts)
    assert first < 0.2 and new() < 1.5


def test_language_repeated_words_count_each_time(spark, monkeypatch):
    rows = [(k, ("the cat and the dog", "der hund und die katze")[k % 2], ("en", "de")[k % 2]) for k in range(40)]
    rows += [(100, "hunde hunde hunde catz dogg", None), (101, "hunde catz dogg catz dogg catz", None), (102, "qqq qqq catz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, langid.identify(docs).collect()))
    monkeypatch.setattr(langid, "WORDS", 1)
    for most in (langid.GRAMS, 3, 0):
        monkeypatch.setattr(langid, "GRAMS", most)
        assert sorted(map(tuple, langid.identify(docs).collect())) == whole


@pytest.mark.parametrize("flush", [1_000_000, 5_000])
def test_language_counts_take_little_memory(monkeypatch, flush):
    monkeypatch.setattr(langid, "FLUSH", flush)
    texts = [" ".join(f"w{(k * 5_000 + i) % 250_000:06d}" for i in range(6_000)) for k in range(60)]
    batches = [pa.record_batch({"lang": ["en", "de"] * 5, "text": texts[k:k + 10]}) for k in range(0, 60, 10)]
    tracemalloc.start()
    out = list(langid._count_words(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = Counter()
    for b in out:
        for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
            total[lang, word] += n
    assert total == Counter(("en" if k % 2 == 0 else "de", w) for k, t in enumerate(texts) for w in t.split())
    assert flush < 1_000_000 or sum(b.num_rows for b in out) == len(total)
    assert peak < 30_000_000


def test_toxicity_sees_through_spelling(spark, odd, empty):
    rows = [(k, f"you are an idiot number {k}" if k % 4 == 0 else f"you are an honest number {k}") for k in range(400)]
    odd_spelling = [(1000, "what an 1d10t"), (1001, "i d i o t they said"), (1002, "idiiiiot!"), (1003, "i.d.i.o.t"), (1004, "a plain 10 day word"), (1005, None), (1006, "")]
    docs = spark.createDataFrame(rows + odd_spelling, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(out[k].predicted == int(k % 4 == 0) for k in range(400))
    assert [out[k].predicted for k in range(1000, 1007)] == [1, 1, 1, 1, 0, 0, 0] and all(0 <= r.score <= 1 for r in out.values())
    assert toxicity.toxicity(odd, labels).count() == odd.count() and toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("false")).where("score > 0").count() == 0


def test_toxicity_keeps_all_n_grams_labels_and_candidates(spark, monkeypatch):
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abdeiorst"), r.integers(4, 9)))
    plain = [word() for _ in range(300)] + ["idiot", "dumbass"]
    odd = {"1d10t", "dumb@ss", "a*b*d*e", "i.d.i.o.t", "b00st", "s" * 5 + "o", "i" * 41 + "diot", "4" * 20 + "d1" * 30 + "ot"}
    docs = spark.createDataFrame([(k, " ".join(plain[k % 7::7])) for k in range(21)] + [(100 + k, w) for k, w in enumerate(sorted(odd))] + [(200, "say i d 1 o t now")], "doc_id long, text string")
    counts = Counter()
    for text in docs.toPandas().text:
        for w in filter(str.isalpha, text.split()):
            counts.update(f" {w} "[a:a + n] for n in range(1, toxicity.ORDER + 1) for a in range(len(w) + 3 - n))
    after = Counter()
    for g, n in counts.items():
        after[g[:-1]] += n
    model = toxicity.CharModel({g: (counts[g], after[g]) for g in {*counts, *after}})
    for together in (20_000, 15):
        monkeypatch.setattr(toxicity, "TOGETHER", together)
        assert {x.word: x.reading for x in toxicity.readings(docs).collect()} == {**{w: toxicity.decode(w, model) for w in {*odd, *filter(toxicity.suspicious, plain)}}, " id1ot": toxicity.decode("id1ot", model)}
    assert toxicity.decode("i" * 41 + "diot", model) == "idiot"
    # More candidates than were once kept, some of them only by their readings and beside their plain forms.
    many = [[f"{chr(97 + g)}{''.join(r.choice(list('bcdfglmnpqvwxyz'), 7))}" for _ in range(500)] for g in range(13)]
    rows = [(3 * g + c, " ".join(many[g]) + (" 1d10t idiot" if c else " idiot"), 1) for g in range(13) for c in range(3)] + [(1000 + k, "idiot" if k % 40 == 0 else "good words", 0) for k in range(300)]
    taught = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chosen = toxicity.taught_labels(taught)
    assert chosen.count() == taught.where(~toxicity.held_out(F.col("doc_id"))).count()
    kept = {x.doc_id: x.toxic for x in chosen.collect()}
    rate = sum(kept.values()) / len(kept)
    names = toxicity.possible(taught, chosen, toxicity.readings(taught), rate)
    whole = {w for g in range(13) if all(3 * g + c in kept for c in range(3)) for w in many[g] if not toxicity.suspicious(w)}
    monkeypatch.setattr(toxicity, "BROADCAST", 0)
    assert sorted(map(tuple, toxicity.labelled(taught.drop("toxic"), chosen).select("doc_id", "toxic").collect())) == sorted(kept.items())
    assert len(names) > 5_000 and {*whole, "idiot"} <= set(names) and "1d10t" not in names
    held = toxicity.found(taught, ["idiot", "good"], toxicity.readings(taught), ["doc_id", "toxic"])
    assert {x.doc_id: x.marked for x in held.collect()} == {k: ["idiot"] if "idiot" in t else ["good"] for k, t, _ in rows}


# ---- pages

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
        "<div class='ad'>Buy {0} now</div><article><h1>Title &amp; more {0}</h1><p>First   line of text, number {0}.<br>Same block.</p><p><b>Second <i>one</i></b>"
        "<div class='share'>Share this</div></article><div class='comments'><p>Reader {0} says so.</p></div><footer>&copy; site</footer></body></html>")


@pytest.fixture(scope="module")
def pages(spark):
    ship(spark)
    rows = [(k, f"http://h{k % 5}/{k}", PAGE.format(k)) for k in range(60)] + [(100, None, None), (101, "u", ""), (102, "u\r\nx", "plain text only"), (103, "v", "<p>Unclosed <b>bits"),
            (104, "w", "<script>if (a < b) { '</p>' }</script>"), (105, "http://h0/0", PAGE.format(0)), (None, "n", "<p>no id</p>"), (106, "x", "<div>" * 3000 + "deep"), (101, "u", "")]
    return spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int").repartition(4)


def test_extraction(pages):
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for k in range(60):
        assert out[k].text == f"Title & more {k}\nFirst line of text, number {k}. Same block.\nSecond one", out[k].text
    assert out[100].text == out[101].text == out[104].text == "" and all(len(r.text) == r.n_chars for r in out.values())
    assert html_extract.extract(pages).count() == pages.count() and html_extract.extract(pages.where("false")).count() == 0


def test_decoding_never_contradicts():
    import numpy as np
    parent, r = [-1, 0, 0, 1, 1, 2, 5], np.random.default_rng(3)
    for _ in range(50):
        odds = r.normal(0, 3, len(parent))
        kept = html_extract.decode(parent, odds)
        assert all(kept[p] or not kept[k] for k, p in enumerate(parent) if p >= 0)
        score = (lambda x: sum(-np.logaddexp(0, -o) if y else -np.logaddexp(0, o) for o, y in zip(odds, x)))
        best = max(score((True, *x)) for x in itertools.product([False, True], repeat=6) if all((True, *x)[p] or not (True, *x)[k] for k, p in enumerate(parent) if p >= 0))
        assert score(kept) == pytest.approx(best)


def test_dom_copes_with_broken_markup():
    for source in ("<", "<a", "<!--", "a<b>c</d>", '<p class="x>y</p>', "</p></p>", "<li>a<li>b", "&am", "<p a='>'>x"):
        dom.Page(source).features()
    assert "".join(dom.Page("<p a='>'>x &lt; y").text) == "x < y"


def test_warc_round_trip(spark, pages, tmp_path):
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(pages, folder, file_bytes=6_000, range_bytes=20_000).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)
    for m in manifest:
        data = (tmp_path / "a" / m.file).read_bytes()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256
    out = warc.read(spark, folder).collect()
    assert all(r.intact for r in out)
    (tmp_path / "a" / "part-000099-0000.warc.gz").write_bytes(b"left over from a lost task")
    assert warc.read(spark, folder).count() == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i if i is not None else -1, last.get(h or "", -1))
    want = sorted(((i, len((h or "").encode()), "revisit" if i is not None and i < last[h or ""] else "response", last[h or ""] if i is not None and i < last[h or ""] else None)
                   for i, _, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out), key=str) == want
    again = f"file://{tmp_path}/b"
    warc.write(pages.repartition(2), again, file_bytes=6_000, range_bytes=20_000)
    assert [(r.file, r.sha256) for r in sorted(manifest)] == [(r.file, r.sha256) for r in sorted(spark.read.json(f"{again}/manifest.jsonl").select("bytes", "file", "records", "sha256").collect(), key=lambda r: r.file)]
    assert warc.round_trip(pages.where("false")).count() == 0


# ---- registry

def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_pipeline(spark, odd, bench, tmp_path):
    import corpus_pipeline
    odd.drop("score", "row", "size", "cls").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {6, 9, 10, None} and 6 in ids
    assert isinstance(out[0], Row)


def test_warc_members_are_found_across_steps():
    import gzip
    import random
    r = random.Random(0)
    pages = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 10, 90_000, 5, 200_000, 40_000)]
    data = b"".join(gzip.compress(warc.record(k, f"u{k}", p, None, len(p), hashlib.sha1(p).digest()), 6, mtime=0) for k, p in enumerate(pages))
    got = [(f["WARC-Record-ID"], block.partition(b"\r\n\r\n")[2]) for f, block in warc.parse(data)]
    assert got == [(f"<urn:page:{k}>", p) for k, p in enumerate(pages)]
    with pytest.raises(EOFError):
        list(warc.parse(data[:-9]))
