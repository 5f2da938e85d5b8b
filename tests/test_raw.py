"""The splittable reader of raw recordings: ranges, headers, payloads of any first byte, all encodings."""
import os

import numpy as np
import pytest

from pulsegrid.session import ship
from pulsegrid.sources import events as src, raw


def evt21(t, x, y, p, mask=1):
    out = []
    for a, b, c, d in zip(t, x, y, p):
        out += [8 << 60 | (a // 64) << 32, d << 60 | (a % 64) << 54 | b << 43 | c << 32 | mask]
    return np.array(out, np.uint64)


def put(folder, name, head, payload):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(head.encode() + b"% end\n" + payload)


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    ship(spark)


def test_one_file_over_many_tasks_equals_one_task(spark, tmp_path):
    r = np.random.default_rng(2)
    n = 3000
    t, x, y, p = np.sort(r.integers(0, 10 ** 6, n)), r.integers(0, 600, n), r.integers(0, 400, n), r.integers(0, 2, n)
    put(tmp_path, "a.raw", "% evt 2.1\n% format EVT21;height=400;width=640\n", evt21(t.tolist(), x.tolist(), y.tolist(), p.tolist()).tobytes() + b"abc")
    put(tmp_path, "deep/b.raw", "% format EVT21\n", evt21([5, 70], [1, 2], [3, 4], [0, 1]).tobytes())
    put(tmp_path, "c.txt", "", b"")
    words = raw.read_words(spark, str(tmp_path), split_bytes=1000)
    assert words.rdd.getNumPartitions() == -(-n * 2 // 125) + 1
    got = words.where("rec_id = 'a.raw'").orderBy("word_idx").collect()
    assert [r.word_idx for r in got] == list(range(2 * n))
    ev = src.read_recordings(spark, f"file://{tmp_path}", split_bytes=1000).orderBy("rec_id", "word_idx").collect()
    assert [(e.t, e.x, e.y, e.p) for e in ev if e.rec_id == "a.raw"] == list(zip(t, x, y, p))
    assert [(e.t, e.x, e.y, e.p) for e in ev if e.rec_id == "deep/b.raw"] == [(5, 1, 3, 0), (70, 2, 4, 1)]
    assert src.read_recordings(spark, f"{tmp_path}/deep/b.raw").count() == 2
    assert raw.read_words(spark, str(tmp_path), names=["deep/b.raw"]).count() == 4
    assert raw.read_words(spark, str(tmp_path), names=[]).count() == 0


def test_payload_that_begins_with_a_percent_sign(spark, tmp_path):
    w = evt21([64], [7], [9], [1], mask=0x25)
    put(tmp_path, "x.raw", "% date today\n% evt 2.1\n", np.concatenate([w[1:], w]).tobytes())
    with open(tmp_path / "x.raw", "rb") as f:
        assert f.read().split(b"% end\n")[1][:1] == b"%"
    ev = src.read_recordings(spark, str(tmp_path)).orderBy("bit").collect()
    assert [(e.word_idx, e.bit, e.x, e.t) for e in ev] == [(2, 0, 7, 64), (2, 2, 9, 64), (2, 5, 12, 64)]


def test_headers_and_encodings(spark, tmp_path):
    put(tmp_path, "a.raw", "% format EVT3;height=720;width=1280\n% camera left\n", np.array([0x8001, 0x6002, 3, 0x2805], "<u2").tobytes())
    put(tmp_path, "b.raw", "% format EVT2\n% geometry 640x480\n", np.array([8 << 28 | 1, 1 << 28 | 2 << 22 | 5 << 11 | 3], "<u4").tobytes())
    put(tmp_path, "c.raw", "% serial 7\n", b"")
    rows = {r.rec_id: r for r in raw.read_headers(spark, str(tmp_path)).collect()}
    assert [(rows[k].fmt, rows[k].width, rows[k].height) for k in ("a.raw", "b.raw", "c.raw")] == [("evt3", 1280, 720), ("evt2", 640, 480), ("evt21", None, None)]
    assert rows["a.raw"].header["camera"] == "left" and rows["c.raw"].bytes == len("% serial 7\n% end\n")
    ev = {e.rec_id: (e.x, e.y, e.p, e.t) for e in src.read_recordings(spark, str(tmp_path)).collect()}
    assert ev == {"a.raw": (5, 3, 1, 4098), "b.raw": (5, 3, 1, 66)}


def test_a_file_without_header_is_refused():
    with pytest.raises(ValueError):
        raw.parse_header(b"\x00" * 100, "x")


def test_only_changed_recordings_are_read_again(spark, tmp_path):
    from pulsegrid.sources import sinks
    source, table = tmp_path / "in", str(tmp_path / "table")
    head = "% format EVT21\n"
    for name, n in (("a.raw", 5), ("b.raw", 7), ("c.raw", 3)):
        put(source, name, head, evt21(range(0, n * 100, 100), range(n), range(n), [1] * n).tobytes())

    def rows():
        return {r.rec_id: (r.n, r.g) for r in sinks.read_ingested(spark, table).groupBy("rec_id").agg({"seq": "count", "generation": "max"}).toDF("rec_id", "n", "g").collect()}

    assert sorted(sinks.ingest_folder(spark, str(source), table)) == ["a.raw", "b.raw", "c.raw"]
    first = {r.rec_id: r.digest for r in sinks.read_manifest(spark, table).collect()}
    assert sinks.ingest_folder(spark, str(source), table, split_bytes=16) == [] and rows() == {"a.raw": (5, 1), "b.raw": (7, 1), "c.raw": (3, 1)}
    put(source, "b.raw", head, evt21([5, 70], [1, 2], [3, 4], [0, 1]).tobytes())
    os.remove(source / "c.raw")
    put(source, "d.raw", head, evt21([1], [1], [1], [1]).tobytes())
    os.makedirs(f"{table}/manifest/v=9")                                  # an ingest that never finished
    assert sorted(sinks.ingest_folder(spark, str(source), table, split_bytes=16)) == ["b.raw", "d.raw"]
    assert rows() == {"a.raw": (5, 1), "b.raw": (2, 3), "d.raw": (1, 3)}
    now = {r.rec_id: r.digest for r in sinks.read_manifest(spark, table).collect()}
    assert now["a.raw"] == first["a.raw"] and now["b.raw"] != first["b.raw"]


def test_source_facts_have_the_hash_of_the_whole_file(spark, tmp_path, monkeypatch):
    import hashlib
    from pyspark.sql import functions as F
    from pulsegrid.sources import sinks
    source, table = tmp_path / "in", str(tmp_path / "table")
    for name, n in (("a.raw", 5), ("b.raw", 200_000)):                    # header and payload, in one block and in several
        put(source, name, "% format EVT21\n", evt21(range(0, n * 64, 64), [k % 30 for k in range(n)], [k % 20 for k in range(n)], [1] * n).tobytes())
    sinks.ingest_folder(spark, str(source), table)

    def facts():
        return {r.rec_id: r for r in src.source_facts(sinks.read_ingested(spark, table), {"mode": "x"}, sinks.read_manifest(spark, table)).collect()}

    got = facts()
    assert got["b.raw"].bytes > 1 << 20 and got["b.raw"].events == 200_000
    for name in ("a.raw", "b.raw"):
        assert got[name].sha256 == hashlib.sha256((source / name).read_bytes()).hexdigest() and got[name].path == str(source / name)
    old = sinks.read_manifest(spark, table).withColumn("sha256", F.when(F.col("rec_id") != "a.raw", F.col("sha256")))
    old.coalesce(1).write.parquet(f"{table}/manifest/v=5")                # a line without the hash, as older manifests have
    assert sinks.ingest_folder(spark, str(source), table) == ["a.raw"] and facts()["a.raw"].sha256 == got["a.raw"].sha256


def test_files_are_streamed(spark, tmp_path):
    """Files longer than a batch, and several files in one batch, are written whole and in order."""
    from pyspark.sql import functions as F
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        w = spark.range(100).selectExpr("CASE WHEN id < 90 THEN 'a.raw' ELSE concat(id, '.raw') END AS name", "'evt2' AS fmt", "99 - id AS k", "id AS word")
        got = {r.name: r.bytes for r in raw.write_raw(w, str(tmp_path / "out"), ["k"], F.lit("% format EVT2\n")).collect()}
        words = raw.read_words(spark, str(tmp_path / "out")).orderBy("rec_id", "word_idx").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 11 and got["a.raw"] == len("% format EVT2\n% end\n") + 360
    assert [r.word for r in words if r.rec_id == "a.raw"] == list(range(89, -1, -1)) and len(words) == 100


def test_short_ranges_share_tasks(spark, tmp_path):
    """Many files of few words: the tasks follow the bytes, the words and their numbers stay the same."""
    for k in range(300):
        put(tmp_path, f"{k:03}.raw", "% format EVT21\n", evt21(range(0, 64 * 5, 64), range(5), range(5), [1] * 5).tobytes())
    words = raw.read_words(spark, str(tmp_path), split_bytes=16)
    assert words.rdd.getNumPartitions() <= 65
    n = words.groupBy("rec_id").agg({"word_idx": "sum"}).toDF("rec_id", "s").where("s = 45").count()
    assert n == 300 and words.count() == 3000


def test_evt3_state_crosses_chunks(spark, monkeypatch):
    """Every cut of a stream gives what one chunk gives, and that is the plain loop."""
    r = np.random.default_rng(5)
    kinds = r.choice([0, 2, 3, 4, 5, 6, 8, 14], 400)
    words = [(int(k) << 12) | int(d) for k, d in zip(kinds, r.integers(0, 4096, 400))]
    want, high, epoch, low, y, pol, x = [], None, 0, 0, 0, 0, 0
    for i, w in enumerate(words):
        k, d = w >> 12, w & 0xFFF
        if k == 8:
            epoch, high = epoch + (high is not None and d < high), d
        elif k == 6:
            low = d
        elif k == 0:
            y = d & 0x7FF
        elif k == 3:
            pol, x = d >> 11, d & 0x7FF
        t = (epoch * 4096 + (high or 0)) * 4096 + low
        if k == 2:
            want.append((i, 0, d & 0x7FF, y, d >> 11, t))
        elif k in (4, 5):
            n = 12 if k == 4 else 8
            want += [(i, b, x + b, y, pol, t) for b in range(n) if d >> b & 1]
            x += n
    rows = spark.createDataFrame([("a", i, w) for i, w in enumerate(words)], "rec_id string, word_idx long, word long")
    for size in (7, 64, 1000):
        monkeypatch.setattr(src, "WORDS_PER_CHUNK", size)
        got = src.ingest_evt3_words(rows).orderBy("word_idx", "bit").collect()
        assert [tuple(g)[1:] for g in got] == want


def test_decoding_reads_a_stream_twice(spark, tmp_path, monkeypatch):
    """The plan of the 16-bit decoder has two scans of its words (eight before)."""
    put(tmp_path, "a.raw", "% format EVT3\n", np.array([0x8001, 0x6002, 3, 0x2805], "<u2").tobytes())
    plan = src.ingest_evt3_words(raw.read_words(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 2
