"""Ranked lexical search with bag deduplication.

Documents are cut down to the terms of the items (the queries): a bag is the sorted list of a document's item terms with their
counts.  The score of a document depends on its bag and on m, its length against the mean, only.  So documents are grouped by a
hash of both, which the bytes themselves verify, every class is scored once against all items, and the best classes are expanded into
their members by ascending doc_id.

A task scores its classes a block at a time against all items and keeps the ``top`` best classes for each item, ordered by score and
smallest doc_id: each class has a member, so no later class can reach the result.  Of a class no more than its ``top``
smallest doc_ids can be ranked, and those are picked before anything is shuffled, however many members it has.

The items travel in blocks of at most about ``BLOCK`` terms, which bounds the vocabulary that is broadcast; each further block is one more
pass over the documents.

Null and empty texts have no terms: such documents count neither in N nor in any ranking, such items have no rows.  Items with
equal item_id (a null one included) are one item with the terms of all.  A repeated document is ranked as often as it occurs, a
null doc_id after all others.  Texts of any length are read whole.  Other columns, whatever their names, are not read.  An
empty table on either side gives an empty table.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pulsegrid.session import cut_lineage

from .text import ALNUM_WORDS, Words, slices

TOP = 50
#: Terms of a block of items, about.
BLOCK = 50_000
#: Cells of the table of term scores that a task holds.
CELLS = 4_000_000
#: Ranked rows that a task holds before it drops those that can't be among the best.
HELD = 400_000
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct)."""
    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                w = Words(piece.column("text"), ALNUM_WORDS)
                size = max(1, len(w.vocab))
                pair = np.unique(w.doc * size + w.codes)
                yield pa.RecordBatch.from_arrays([piece.column("item_id").take(pa.array(pair // size)), w.vocab.take(pa.array(pair % size)).cast(pa.string())], ["item_id", "term"])

    rows = items.select("item_id", "text").mapInArrow(cut, "item_id long, term string")
    return rows.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


class Items:
    """A block of items: their ids, the vocabulary, and the term numbers of each."""

    def __init__(self, rows):
        self.ids = pa.array([r.item_id for r in rows], pa.int64())
        terms = sorted({t for r in rows for t in r.terms})
        number = {t: k for k, t in enumerate(terms)}
        self.vocab = pa.array(terms, pa.large_string())
        self.terms = [np.array(sorted(number[t] for t in r.terms), np.int64) for r in rows]


def bags(docs: DataFrame, vocab) -> DataFrame:
    """doc_id, n (terms of the whole text), bag (int32 pairs of term number and count, by term)."""
    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                w = Words(piece.column("text"), ALNUM_WORDS)
                number = np.asarray(pc.index_in(w.vocab.cast(pa.large_string()), vocab.value).fill_null(-1)).astype(np.int64)
                code = number[w.codes] if len(w.codes) else np.zeros(0, np.int64)
                known, size = code >= 0, max(1, len(vocab.value))
                pair, tf = np.unique(w.doc[known] * size + code[known], return_counts=True)
                data = np.column_stack([pair % size, tf]).astype(np.int32)
                at = np.searchsorted(pair, np.arange(piece.num_rows + 1) * size) * 8
                bag = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(w.counts), bag], ["doc_id", "n", "bag"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, n long, bag binary")


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of the bags in a column."""
    size = np.asarray(pc.binary_length(column)).astype(np.int64) // 8
    data = np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(column)), size), data[:, 0], data[:, 1]


def document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the block."""
    def count(batches):
        seen = np.zeros(n_terms, np.int64)
        for b in batches:
            seen += np.bincount(_entries(b.column("bag"))[1], minlength=n_terms)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in rows.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df                                            # a row for each term of the block
    return out


def _best(held: list[tuple], top: int) -> tuple:
    """The rows (item, score, first, cls) that are among the ``top`` of their item, best first."""
    item, score, first, cls = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort([cls, first, -score, item])
    item, score, first, cls = item[order], score[order], first[order], cls[order]
    start = np.searchsorted(item, item)
    keep = np.arange(len(item)) - start < top
    return item[keep], score[keep], first[keep], cls[keep]


def scored(classes: DataFrame, block, weight: np.ndarray, top: int) -> DataFrame:
    """item_id, cls, score, first: the best classes of every task for each item."""
    def run(batches):
        items = block.value
        step = max(1, CELLS // max(1, len(weight)))
        held, size, floor = [], 0, np.ones(len(items.terms), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                row, term, tf = _entries(b.column("bag"))
                m = np.asarray(b.column("m"))
                table = np.zeros((len(weight), b.num_rows), np.int64)
                table[term, row] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                score = np.stack([table[t].sum(axis=0) for t in items.terms])
                item, col = np.nonzero(score >= floor[:, None])
                held.append((item, score[item, col], np.asarray(b.column("first"))[col], np.asarray(b.column("cls"))[col]))
                size += len(item)
                if size > HELD:
                    held = [_best(held, top)]
                    size = len(held[0][0])
                    n = np.bincount(held[0][0], minlength=len(floor))
                    last = n.cumsum() - 1
                    floor = np.where(n == top, held[0][1][np.maximum(last, 0)], 1)
        if size:
            item, score, first, cls = _best(held, top)
            yield pa.RecordBatch.from_arrays([items.ids.take(pa.array(item)), pa.array(cls), pa.array(score), pa.array(first)], ["item_id", "cls", "score", "first"])

    return classes.select("cls", "m", "bag", "first").mapInArrow(run, "item_id long, cls long, score long, first long")


def _ranked(rows: DataFrame, keys: list, order: list, top: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search_block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """The ranking of one block of items."""
    spark = docs.sparkSession
    rows = cut_lineage(bags(docs, spark.sparkContext.broadcast(items.vocab)))
    whole = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = whole.docs, whole.terms or 0
    df = document_counts(rows, len(items.vocab))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df], np.int64)
    m = F.expr(f"100L - 50L + ((50L * n * {n_docs}L) div {max(1, n_terms)}L)")
    held = rows.where(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    classes = held.groupBy("h", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(int(_LAST))).alias("first"), F.count("*").alias("members"))
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()))
    best = scored(classes, spark.sparkContext.broadcast(items), weight, top)
    order = [F.desc("score"), F.asc("first"), F.asc("cls")]
    best = _ranked(best.withColumn("part", F.pmod("cls", F.lit(32))), ["item_id", "part"], order, top).drop("part")
    best = cut_lineage(_ranked(best, ["item_id"], order, top).select("item_id", "cls", "score"))
    # At most top classes for each item of the block: ids and hashes of these may be broadcast.
    chosen = cut_lineage(classes.join(F.broadcast(best.select("cls").distinct()), "cls", "left_semi").select("cls", "h", "m", "bag"))
    near = held.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi")
    members = _ranked(near, ["h", "m", "bag"], [F.asc_nulls_last("doc_id")], top).drop("rank")
    expanded = members.join(chosen, ["h", "m", "bag"]).select("doc_id", "cls").join(best, "cls")
    return _ranked(expanded, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item."""
    spark = docs.sparkSession
    terms = cut_lineage(item_terms(items))
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-total // BLOCK))
    out = []
    for k in range(parts):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id").collect()
        if rows:
            out.append(search_block(docs, Items(rows), top))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
