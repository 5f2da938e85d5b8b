"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document, as search engines shard theirs: each piece of a partition stores, for every
benchmark term, the sorted positions of the term in its documents.  A phrase is looked up from its rarest
term (counts over all documents): that term's postings, moved back by the term's offset, are the candidates, and
the lists of the other terms, moved by their offsets, are intersected one by one, rarest first.  What is left
are the exact places of the phrase.  ``proximity_matches`` answers the looser question whether all terms of a phrase
stand within a window of some words.

The benchmark's distinct phrases travel in blocks of at most ``BLOCK`` phrases, so that a broadcast is bounded whatever
the benchmark's size; each further block is one more pass over the documents, with the marks found so far carried
along.  Documents never move.

Null and empty texts have no words, no hits and no items.  Items without words have no phrases; items of fewer words
than a window are one phrase; repeated items, and items that share a phrase, all count.  Rows with a null item_id
are no items.  Repeated documents are judged row by row.
Texts of any length are read whole.  Other columns, whatever their names, are not read.  Without documents there are no rows, without items no hits.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage

from .text import ALNUM_WORDS, Words, slices

WINDOW = 13
#: Distinct phrases in a block: about 20 MB of terms.
BLOCK = 200_000


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase (words joined by blanks), items (sorted item_ids): every distinct window of the items."""
    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                w = Words(piece.column("text"), ALNUM_WORDS)
                vocab, ids, out = w.vocab.to_pylist(), piece.column("item_id").to_pylist(), ([], [])
                for item, a, b in zip(ids, w.start[:-1], w.start[1:]):
                    words = [vocab[c] for c in w.codes[a:b]]
                    for k in range(max(min(1, len(words)), len(words) - window + 1)):
                        out[0].append(item)
                        out[1].append(" ".join(words[k:k + window]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["item_id", "phrase"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, phrase string")
    return rows.groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences of the terms in all documents."""
    def count(batches):
        total: dict[str, int] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                w = Words(piece.column("text"), ALNUM_WORDS)
                at = np.asarray(pc.index_in(w.vocab, wanted.value).fill_null(-1))
                n = np.bincount(w.codes, minlength=len(w.vocab))
                for k in np.flatnonzero(at >= 0):
                    word = w.vocab[int(k)].as_py()
                    total[word] = total.get(word, 0) + int(n[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    wanted = docs.sparkSession.sparkContext.broadcast(pa.array([r.term for r in terms.collect()], pa.large_string()))
    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Block:
    """One block of phrases: term numbers padded with -1, with the order in which each phrase looks its terms up."""

    def __init__(self, rows, counts: dict[str, int]):
        self.items = [list(r.items_) for r in rows]
        words = [r.phrase.split(" ") for r in rows]
        terms = sorted({t for p in words for t in p})
        number = {t: k for k, t in enumerate(terms)}
        self.terms = pa.array(terms, pa.large_string())
        self.length = np.array([len(p) for p in words], np.int64)
        self.term = np.full((len(words), max(self.length, default=1)), -1, np.int64)
        self.order = np.zeros_like(self.term)
        rarity = np.array([counts.get(t, 0) for t in terms], np.int64)
        for k, p in enumerate(words):
            self.term[k, :len(p)] = [number[t] for t in p]
            self.order[k] = np.argsort(np.where(self.term[k] < 0, np.iinfo(np.int64).max, rarity[self.term[k]]), kind="stable")
        self.rarest = self.term[np.arange(len(words)), self.order[:, 0]]


class Postings:
    """Positions of a block's terms in the documents of a piece, sorted by term and position."""

    def __init__(self, words: Words, terms: pa.Array):
        number = np.asarray(pc.index_in(words.vocab, terms).fill_null(-1)).astype(np.int64)
        self.size = max(1, len(words.codes)) + 64
        code = number[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        place = np.flatnonzero(code >= 0)
        self.entry = np.sort(code[place] * self.size + place)
        self.first = np.searchsorted(self.entry, np.arange(len(terms) + 1) * self.size)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings lists of ``terms`` one after the other: which list, and the position."""
        n = self.first[terms + 1] - self.first[terms]
        which = np.repeat(np.arange(len(terms)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[terms], n)
        return which, self.entry[at] - terms[which] * self.size

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        want = terms * self.size + places
        at = np.minimum(np.searchsorted(self.entry, want), max(0, len(self.entry) - 1))
        return self.entry[at] == want if len(self.entry) else np.zeros(len(want), bool)


def find(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Exact places of the block's phrases: phrase number, first word."""
    post = Postings(words, block.terms)
    active = np.flatnonzero(post.first[block.rarest + 1] > post.first[block.rarest])
    which, place = post.of(block.rarest[active])
    phrase = active[which]
    place = place - block.order[phrase, 0]
    doc_of = np.searchsorted(words.start, np.arange(len(words.codes) + 1), "right") - 1
    ok = (place >= 0) & (place + block.length[phrase] <= len(words.codes))
    phrase, place = phrase[ok], place[ok]
    ok = doc_of[place] == doc_of[place + block.length[phrase] - 1]
    phrase, place = phrase[ok], place[ok]
    for k in range(1, block.term.shape[1]):
        offset = block.order[phrase, k]
        term = block.term[phrase, offset]
        ok = (term < 0) | post.holds(np.maximum(term, 0), place + offset)
        phrase, place = phrase[ok], place[ok]
    return phrase, place


def blocks(benchmark: DataFrame, docs: DataFrame, window: int = WINDOW, size: int = BLOCK):
    """The benchmark's phrases, a bounded block at a time."""
    rows = cut_lineage(phrases(benchmark, window))
    parts = max(1, -(-rows.count() // size))
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k)
        counts = {r.term: r.n for r in term_counts(docs, part.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()).collect()}
        yield Block(part.select("phrase", F.col("items").alias("items_")).orderBy("phrase").collect(), counts)


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = BLOCK) -> DataFrame:
    """The documents (as ``row``) with n_words, n_hit, spans (merged hit ranges of words: first, last, first, ...) and items (found)."""
    row = "struct<{}>".format(", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                      F.array().cast("array<int>").alias("spans"), F.array().cast("array<long>").alias("items"))
    schema = f"row {row}, text string, n_words long, n_hit long, spans array<int>, items array<long>"
    for k, block in enumerate(blocks(benchmark, docs, window, size)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = (out if k == 0 else cut_lineage(out)).mapInArrow(_mark(shared), schema)
    return out


def _mark(shared):
    def mark(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                w = Words(piece.column("text"), ALNUM_WORDS)
                spans, items = piece.column("spans").to_pylist(), piece.column("items").to_pylist()
                if len(w.codes):
                    block = shared.value
                    phrase, place = find(w, block)
                    change = np.zeros(len(w.codes) + 1, np.int64)
                    np.add.at(change, place, 1)
                    np.add.at(change, place + block.length[phrase], -1)
                    hit = np.cumsum(change[:-1]) > 0
                    doc = np.searchsorted(w.start, place, "right") - 1
                    for d in np.unique(doc):
                        a, b = w.start[d], w.start[d + 1]
                        mine = hit[a:b].copy()
                        for x, y in zip(spans[d][::2], spans[d][1::2]):
                            mine[x:y + 1] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]).astype(np.int8)))
                        edge[1::2] -= 1
                        spans[d] = edge.tolist()
                        items[d] = sorted({*items[d], *(i for p in np.unique(phrase[doc == d]) for i in block.items[p])})
                covered = [sum(y - x + 1 for x, y in zip(s[::2], s[1::2])) for s in spans]
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("text"), pa.array(w.counts, pa.int64()), pa.array(covered, pa.int64()), pa.array(spans, pa.list_(pa.int32())),
                                                  pa.array(items, pa.list_(pa.int64()))], ["row", "text", "n_words", "n_hit", "spans", "items"])

    return mark


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the matches: spans (word ranges) and items."""
    rows = marked(docs, benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return rows.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
                       dirty(), "spans", "items")


def dirty():
    return ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    rows = marked(docs, benchmark)
    return rows.withColumn("bad", dirty()).where("not bad").select("row.*")


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int = 30) -> DataFrame:
    """doc_id, item_id, first, last: places where all distinct terms of an item's text stand within ``within`` words.

    ``queries`` (item_id, text) is a bounded set of short phrases; per item and document the first of overlapping places.
    """
    rows = [(r.item_id, Words(pa.array([r.text]), ALNUM_WORDS).vocab) for r in queries.select("item_id", "text").toLocalIterator() if r.text]
    shared = docs.sparkSession.sparkContext.broadcast([(i, t) for i, t in rows if len(t)])

    def look(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                w, ids, out = Words(piece.column("text"), ALNUM_WORDS), piece.column("doc_id").to_pylist(), []
                for item, terms in shared.value:
                    post = Postings(w, terms)
                    rare = int(np.argmin(np.diff(post.first)))
                    if post.first[rare + 1] == post.first[rare]:
                        continue
                    every = np.concatenate([np.stack([post.of(np.array([k]))[1], np.full(post.first[k + 1] - post.first[k], k)]) for k in range(len(terms))], axis=1)
                    every = every[:, np.argsort(every[0], kind="stable")]
                    last, done = {}, -1
                    for place, k in every.T.tolist():
                        last[k] = place
                        low = min(last.values()) if len(last) == len(terms) else -1
                        if low > done and place - low < within and (d := int(np.searchsorted(w.start, low, "right")) - 1) == int(np.searchsorted(w.start, place, "right")) - 1:
                            out.append((ids[d], item, low - int(w.start[d]), place - int(w.start[d])))
                            done = place
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "first", "last"), o)) for o in out],
                                                 pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, "doc_id long, item_id long, first long, last long")
