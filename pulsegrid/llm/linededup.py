"""Line dedup with two Bloom filters.

A line's key is the line without blanks at its ends, in lower case (A-Z).  Keys of ``LEAST_CHARS`` code points or more that
``LEAST_DOCS`` documents or more hold keep their lines only in the document with the largest doc_id.

Two Bloom filters tell apart the hashes seen once and those seen twice.  A key sets ``BITS`` bits of one 64-bit word; the number of
words follows the number of lines, four lines to a word.  Every task builds the words of its own lines: *once* for all keys,
*twice* for keys that two of its documents hold.  Words meet by segments of ``SEGMENT`` words: bits that two tasks have set pass
from once to twice.  A key of two documents always has all its bits in *twice*; the few others that do are false alarms.

Only lines found in *twice* go on: their keys are grouped by the text itself, which decides, and the places of the lines that
must go are sent back to their documents.  *twice* is broadcast up to ``BROADCAST`` bytes, two for each line; a larger one stays
distributed and the lines' hashes are joined with its words instead.

A document is a row; a row is known by doc_id and a hash of its text, since equal rows lose equal lines.  A null text is one
empty line, and so is an empty one.  A null doc_id is smaller than any other; if all holders have none, all keep the line.  All rows that
carry the largest doc_id keep it, too.  Lines repeated inside one document count once, and stay or go together.  Texts of any length
are read whole: a text longer than a piece is a piece of its own.  Other columns, whatever their names, are not read.  An empty table gives an
empty table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage

from .text import mix, slices

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bits a key sets in its word, lines for each word, words of a segment.
BITS, LOAD, SEGMENT = 5, 4, 1 << 14
#: Hashes that a task holds before it hands on its words.
HELD = 2_000_000
#: Largest filter that is broadcast.
BROADCAST = 64 << 20
#: Parts of a word's lines in the join with a filter that is too large for that.
SALTS = 8
BLANKS = " \t\n\x0b\x0c\r"


class Lines:
    """The lines of some texts; document d has lines ``start[d]:start[d + 1]``."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        self.lines = lists.flatten()
        self.start = np.concatenate([[0], np.asarray(pc.list_value_length(lists)).astype(np.int64).cumsum()])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def keys(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct long keys, their hashes, and of every line that has one: its number and its key's."""
        keys = pc.ascii_lower(pc.ascii_trim(self.lines, characters=BLANKS))
        at = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(keys), LEAST_CHARS)))
        coded = keys.take(pa.array(at)).dictionary_encode()
        values = coded.dictionary.to_numpy(zero_copy_only=False)
        hashes = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
        return coded.dictionary, hashes, at, np.asarray(coded.indices).astype(np.int64)


def _once_a_document(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Key numbers, once for each document that holds the key."""
    return np.unique(doc * max(n, 1) + key) % max(n, 1)


def word_of(h: np.ndarray, words: int) -> np.ndarray:
    return (h % np.uint64(words)).astype(np.int64)


def mask_of(h: np.ndarray) -> np.ndarray:
    """The bits of a hash in its word."""
    more, out = mix(h), np.zeros(len(h), np.uint64)
    for k in range(BITS):
        out |= np.uint64(1) << ((more >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _signed(words: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                lines = Lines(piece.column("text"))
                values, hashes, at, key = lines.keys()
                held.append(hashes[_once_a_document(lines.doc[at], key, len(values))])
                size += len(held[-1])
                if size >= HELD:
                    yield _words_of(np.concatenate(held), words)
                    held, size = [], 0
        if size:
            yield _words_of(np.concatenate(held), words)

    return run


def _words_of(hashes: np.ndarray, words: int) -> pa.RecordBatch:
    """A row for each segment: places of its words, their bits of all keys and of keys held twice."""
    h, n = np.unique(hashes, return_counts=True)
    word = word_of(h, words)
    order = np.argsort(word, kind="stable")
    word, mask, again = word[order], mask_of(h)[order], n[order] > 1
    place, first = np.unique(word, return_index=True)
    once = np.bitwise_or.reduceat(mask, first)
    twice = np.bitwise_or.reduceat(np.where(again, mask, np.uint64(0)), first)
    segment, cut = np.unique(place // SEGMENT, return_index=True)
    ends = np.append(cut[1:], len(place))
    rows = [[(place[a:b] - s * SEGMENT).astype(np.int32).tobytes(), once[a:b].tobytes(), twice[a:b].tobytes()] for s, a, b in zip(segment, cut, ends)]
    return pa.RecordBatch.from_arrays([pa.array(segment, pa.int64()), *[pa.array(c, pa.binary()) for c in zip(*rows)]], ["segment", "place", "once", "twice"])


def _merged(key, pdf):
    """The words of a segment with the bits that two tasks, or two documents of one, have set."""
    place = np.concatenate([np.frombuffer(b, np.int32) for b in pdf.place])
    once = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf.once])
    twice = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf.twice])
    order = np.argsort(place, kind="stable")
    place, once, twice = place[order], once[order], twice[order]
    where, first = np.unique(place, return_index=True)
    out = np.bitwise_or.reduceat(twice, first)
    bits = np.unpackbits(once.view(np.uint8).reshape(-1, 8), axis=1)
    met = np.add.reduceat(bits, first, axis=0, dtype=np.int32) > 1
    out |= np.ascontiguousarray(np.packbits(met, axis=1)).view(np.uint64).ravel()
    kept = out > 0
    return pd.DataFrame([(key[0], where[kept].astype(np.int32).tobytes(), out[kept].tobytes())], columns=["segment", "place", "twice"])


def filters(docs: DataFrame, words: int) -> DataFrame:
    """segment, place, twice: the filter of hashes seen twice, as packed words."""
    signed = docs.mapInArrow(_signed(words), "segment long, place binary, once binary, twice binary")
    return cut_lineage(signed.groupBy("segment").applyInPandas(_merged, "segment long, place binary, twice binary"))


def _suspects(test):
    """One row for each suspected key of a document: the key and the numbers of its lines."""
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                lines = Lines(piece.column("text"))
                values, hashes, at, key = lines.keys()
                doc = lines.doc[at]
                hit = test(piece, hashes, doc, key)
                at, key, doc = at[hit], key[hit], doc[hit]
                group = doc * max(len(values), 1) + key
                order = np.argsort(group, kind="stable")
                at, key, doc, group = at[order], key[order], doc[order], group[order]
                first = np.flatnonzero(np.diff(group, prepend=-1))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array((at - lines.start[doc]).astype(np.int32)))
                rows = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(rows), piece.column("th").take(rows),
                                                  values.take(pa.array(key[first])).cast(pa.string()), places], ["doc_id", "th", "key", "places"])

    return run


def _by_broadcast(docs: DataFrame, twice: DataFrame, words: int):
    table = np.zeros(words, np.uint64)
    for r in twice.toLocalIterator():
        table[r.segment * SEGMENT + np.frombuffer(r.place, np.int32)] = np.frombuffer(r.twice, np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def test(piece, hashes, doc, key):
        mask = mask_of(hashes)
        return (sent.value[word_of(hashes, words)] & mask == mask)[key]

    return docs, test


def _unpacked(batches):
    for b in batches:
        for segment, place, twice in zip(b.column("segment").to_pylist(), b.column("place").to_pylist(), b.column("twice").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(segment * SEGMENT + np.frombuffer(place, np.int32).astype(np.int64)),
                                              pa.array(np.frombuffer(twice, np.uint64).view(np.int64))], ["word", "bits"])


def _printed(words: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                lines = Lines(piece.column("text"))
                values, hashes, at, key = lines.keys()
                pair = np.unique(lines.doc[at] * max(len(values), 1) + key)
                h, rows = hashes[pair % max(len(values), 1)], pa.array(pair // max(len(values), 1))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(rows), piece.column("th").take(rows), pa.array(word_of(h, words)), pa.array(mask_of(h).view(np.int64)),
                                                  pa.array(h.view(np.int64))], ["doc_id", "th", "word", "mask", "h"])

    return run


def _by_join(docs: DataFrame, twice: DataFrame, words: int):
    """The documents with the hashes of their suspected keys, found by a join with the filter's words."""
    prints = docs.mapInArrow(_printed(words), "doc_id long, th long, word long, mask long, h long").withColumn("salt", F.pmod("th", F.lit(SALTS)).cast("int"))
    table = twice.mapInArrow(_unpacked, "word long, bits long").withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    held = prints.join(table, ["word", "salt"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    marks = held.groupBy("doc_id", "th").agg(F.collect_set("h").alias("marks"))
    both = docs.join(marks.select(F.col("doc_id").alias("other"), F.col("th").alias("other_th"), "marks"),
                     F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("th") == F.col("other_th"))).select("doc_id", "th", "text", "marks")

    def test(piece, hashes, doc, key):
        marks = piece.column("marks")
        held = mix(np.asarray(marks.flatten()).view(np.uint64)) + np.asarray(pc.list_parent_indices(marks)).astype(np.uint64)
        return np.isin(mix(hashes[key]) + doc.astype(np.uint64), held)

    return both, test


def _kept(batches):
    """The texts without the lines at ``places``."""
    for batch in batches:
        for piece in slices(batch, "text"):
            lines = Lines(piece.column("text"))
            gone = piece.column("places")
            stay = np.ones(len(lines.lines), bool)
            stay[lines.start[np.asarray(pc.list_parent_indices(gone)).astype(np.int64)] + np.asarray(gone.flatten())] = False
            before = np.concatenate([[0], stay.cumsum()])
            left = pa.ListArray.from_arrays(pa.array(before[lines.start], pa.int32()), lines.lines.filter(pa.array(stay)).cast(pa.string()))
            n = np.diff(lines.start)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), pa.array(n - np.diff(before[lines.start])), pc.binary_join(left, "\n")],
                                             ["doc_id", "n_lines", "n_dropped", "text"])


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, th, places: the numbers of the lines that each document of ``docs`` (doc_id, text, th) loses."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = docs.agg(F.sum(breaks + 1)).first()[0] or 0
    words = max(1, -(-n // LOAD))
    twice = filters(docs, words)
    source, test = (_by_broadcast if words * 8 <= BROADCAST else _by_join)(docs, twice, words)
    lines = cut_lineage(source.mapInArrow(_suspects(test), "doc_id long, th long, key string, places array<int>"))
    found = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= LEAST_DOCS)
    found = cut_lineage(found.select(F.unhex(F.sha2("key", 256)).alias("digest"), "n", "keep"))
    slim = lines.select("doc_id", "th", "places", F.unhex(F.sha2("key", 256)).alias("digest"))
    # At most a thousand keys are held by over a thousandth of the lines: they are broadcast, the others joined by shuffle.
    often = max(10_000, lines.count() // 1_000)
    hot = found.where(F.col("n") > often).select("digest", F.col("keep").alias("hot_keep"), F.lit(True).alias("hot"))
    mixed = slim.join(F.broadcast(hot), "digest", "left")
    ways = mixed.where("hot").select("doc_id", "th", "places", F.col("hot_keep").alias("keep")).unionByName(
        mixed.where("hot is null").drop("hot", "hot_keep").join(found.where(F.col("n") <= often), "digest").select("doc_id", "th", "places", "keep"))
    gone = ways.where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    # Equal rows have equal lists, which count once.
    return gone.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("places")).alias("places"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay, joined by newlines) of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    gone = dropped(rows).select(F.col("doc_id").alias("other"), F.col("th").alias("other_th"), "places")
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("th") == F.col("other_th")), "left")
    both = both.select("doc_id", "text", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    return both.mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, text string")
