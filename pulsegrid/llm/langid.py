"""Language identification by words first, then by shorter and shorter character n-grams.

Training counts every word of every labelled text by language, and n-grams of 1 to ``LONGEST`` characters from all words.  The model is two
distributed tables of all words and all n-grams that occur at least ``LEAST`` times.  Their most frequent ``WORDS`` and ``GRAMS`` entries travel
to the tasks; each occurrence of a word that these cannot settle is joined with the whole tables, and its score is added to its text's
sum.  Scores are integers (``UNIT`` to 1), so sums don't depend on order or on what travels.  A known word scores its relative log frequency in each language, with a
penalty below any frequency where a language never has it.  An unseen word, framed by blanks, is cut into n-grams of the
longest order; if a model of that order knows any of them, their mean log frequency is the word's score, else the next shorter order is
tried.  A text's score is the mean over its words.  The answer is the best language; its score is the
share of the best among all languages, by the mean log scores.

``und``: null texts, texts without a letter, and everything when no language was learned.  Rows with a null lang teach nothing;
lang, source and doc_id are never inputs of a prediction.  Repeated rows count as often as they occur.  Equal scores go
to the language first in order.
Texts of any length are scored whole.  Columns of the input, whatever their names, are not mixed up with the
operator's own.  An empty table gives an empty table.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage

from .text import ALNUM_WORDS, Words, held_out, slices

#: Bytes of text that a worker scores at once.
PIECE = 1_000_000

LONGEST, LEAST, WORDS, GRAMS = 4, 2, 100_000, 50_000
#: Natural-log score of a word or n-gram that a language never has; where the corpus is so large that one occurrence counts for less, half of one.
PENALTY = -16.0
#: Fixed point of scores, which count from that lowest one (only their differences matter).
UNIT = 1 << 20
UNKNOWN = "und"
#: Rows that a task's partial counts may hold before they are sent on.
FLUSH = 1_000_000


def lower_words(piece: pa.Array) -> Words:
    """Words with all letters in lower case."""
    w = Words(piece, ALNUM_WORDS)
    w.vocab = pc.utf8_lower(w.vocab)
    return w


def _rows(total: dict) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                       pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])


def _count_words(batches):
    """lang, word, n of a task's texts, merged as far as memory allows."""
    parts, rows = [], 0
    for batch in batches:
        for piece in slices(batch, "text", PIECE):
            w = lower_words(piece.column("text"))
            langs = piece.column("lang").dictionary_encode()
            row_lang = np.asarray(langs.indices).astype(np.int64)
            size = max(1, len(w.vocab))
            pair, n = np.unique(row_lang[w.doc] * size + w.codes, return_counts=True)
            parts.append(pa.table([langs.dictionary.take(pa.array(pair // size)).cast(pa.string()), w.vocab.take(pa.array(pair % size)).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"]))
            rows += len(pair)
            if rows > FLUSH // 2:
                parts = [_merged(parts)]
                rows = parts[0].num_rows
            if rows > FLUSH // 2:
                yield from parts[0].to_batches()
                parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches()


def _merged(parts: list[pa.Table]) -> pa.Table:
    """Counts of equal lang and word added; a few bytes for each row, where a dictionary takes hundreds."""
    out = pa.concat_tables(parts).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
    return out.select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"]).combine_chunks()


def grams(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[k:k + n] for k in range(len(framed) - n + 1)]


def _count_grams(batches):
    total: dict = {}
    for b in batches:
        for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    total[lang, g] = total.get((lang, g), 0) + n
        if len(total) > FLUSH:
            yield _rows(total)
            total = {}
    if total:
        yield _rows(total)


class Model:
    """Scores by language, languages in order: the whole tables, and of each the most frequent entries for the tasks."""

    def __init__(self, langs: list[str], words: DataFrame, grams: DataFrame):
        """``words`` and ``grams`` have columns word, all, s0, s1, ..."""
        self.langs, self.words, self.grams = langs, words, grams
        top, more = _frequent(words, WORDS)
        found, still = _frequent(grams, GRAMS)
        self.hot = Hot(len(langs), top, found, not more, not still)


class Hot:
    """The entries that travel; ``all_words`` and ``all_grams`` tell whether there are no others."""

    def __init__(self, size: int, words: pa.Table, grams: pa.Table, all_words: bool, all_grams: bool):
        self.size, self.all_words, self.all_grams = size, all_words, all_grams
        self.names = pa.concat_arrays([t.column("word").combine_chunks().cast(pa.large_string()) for t in (words, grams)])
        self.n_words = words.num_rows
        self.scores = np.concatenate([np.stack([np.asarray(t.column(f"s{k}")) for k in range(size)], axis=1).astype(np.int32) for t in (words, grams)])
        self.words = None

    def index(self) -> None:
        if self.words is None:
            names = self.names.to_pylist()
            self.words = {w: k for k, w in enumerate(names[:self.n_words])}
            self.grams = {g: k for k, g in enumerate(names[self.n_words:], self.n_words)}
            self.names = None
            self.known: dict[str, np.ndarray] = {}

    def parts(self, word: str):
        """n-gram size, sum of scores and number of what is found here, and what only the whole table can tell."""
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            cut = grams(word, n)
            found = [self.grams[g] for g in cut if g in self.grams]
            yield n, self.scores[found].sum(0, dtype=np.int64), len(found), [] if self.all_grams else [g for g in cut if g not in self.grams]
            if found:
                return

    def by_grams(self, word: str) -> np.ndarray | None:
        """Score of a word that no table of words has; None where the whole table of n-grams is needed."""
        for _, total, n, missing in self.parts(word):
            if missing:
                return None
            if n:
                return np.round(total / n)
        return np.zeros(self.size)

    def score(self, word: str) -> np.ndarray | None:
        """None where the whole tables are needed."""
        k = self.words.get(word)
        if k is not None:
            return self.scores[k]
        return self.by_grams(word) if self.all_words and self.all_grams else None

    def score_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of distinct words, and which are open; scores of words not in the table are kept, up to a bound."""
        self.index()
        if len(self.known) > 300_000:
            self.known = {}
        at = np.array([self.words.get(w, -1) for w in words], np.int64)
        out, is_open = np.zeros((len(words), self.size)), np.zeros(len(words), bool)
        out[at >= 0] = self.scores[at[at >= 0]]
        if not (self.all_words and self.all_grams):
            return out, at < 0
        for k in np.flatnonzero(at < 0).tolist():
            w = words[k]
            s = self.known.get(w)
            if s is None:
                s = self.score(w)
                if s is None:
                    is_open[k] = True
                    continue
                self.known[w] = s
            out[k] = s
        return out, is_open


def _scored(counts: DataFrame, langs: list[str], total, lowest: float) -> DataFrame:
    """word, all, and its score in each language, of all words that occur at least LEAST times; ``total(k)`` is the count of all in language k."""
    wide = counts.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, lang in enumerate(langs)], F.sum("n").alias("all"))
    score = (lambda k: F.when(F.col(f"n{k}") > 0, F.round((F.log(F.col(f"n{k}") / total(k)) - lowest) * UNIT)).otherwise(0).cast("int").alias(f"s{k}"))
    return wide.where(F.col("all") >= LEAST).select("word", "all", *[score(k) for k in range(len(langs))])


def _frequent(table: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """The most frequent entries, and whether there are more."""
    top = table.orderBy(F.desc("all"), "word").limit(most + 1).drop("all").toArrow()
    return top.slice(0, most), top.num_rows > most


def train(docs: DataFrame) -> Model | None:
    """Learn from every row with a text and a lang."""
    counts = (docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), "text").mapInArrow(_count_words, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts = cut_lineage(counts, free_shuffles=True)
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    langs = sorted(totals)
    gram_counts = cut_lineage(counts.mapInArrow(_count_grams, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), free_shuffles=True)
    size = {(r.lang, r.size): r.n for r in gram_counts.groupBy("lang", F.length("word").alias("size")).agg(F.sum("n").alias("n")).collect()}
    of_size = (lambda k: F.element_at(F.array(*[F.lit(float(size.get((langs[k], n), 1))) for n in range(1, LONGEST + 1)]), F.length("word")))
    lowest = min(PENALTY, math.log(0.5 / max(*totals.values(), *size.values())))
    # The words are read twice; only those of the table are shuffled the second time, and the counts of all others can go.
    words = cut_lineage(_scored(counts, langs, lambda k: F.lit(float(totals[langs[k]])), lowest), free_shuffles=True)
    return Model(langs, words, _scored(gram_counts, langs, of_size, lowest))


def settled(opened: DataFrame, model: Model, shared) -> DataFrame:
    """_id, s0, s1, ... of each row of ``opened`` (_id, word), by the whole tables.

    A row moves to its word's entry and its score moves on; only rows that ask for n-grams beyond ``shared`` go to those first.
    """
    each = [f"s{k}" for k in range(len(model.langs))]
    types = ", ".join(f"{c} long" for c in each)

    def run(batches):
        hot = shared.value
        hot.index()
        for b in batches:
            scores, new, words = _looked_up(b, each)
            found = [hot.by_grams(w) for w in words.dictionary.to_pylist()]
            code, is_open = np.asarray(words.indices), np.array([f is None for f in found], bool)
            if len(code):
                scores[new] = np.array([np.zeros(len(each)) if f is None else f for f in found])[code].astype(np.int64)
            kept = np.ones(b.num_rows, bool)
            kept[new] = ~is_open[code]
            yield pa.RecordBatch.from_arrays([b.column("_id").filter(pa.array(kept)), *[pa.array(scores[kept, k]) for k in range(len(each))]], ["_id", *each])

    def ask(batches):
        hot = shared.value
        hot.index()
        for b in batches:
            _, new, words = _looked_up(b, each)
            rows = []
            for i, word in zip(b.column("_id").take(pa.array(new)).to_pylist(), words.to_pylist()):
                if hot.by_grams(word) is None:
                    for size, total, n, missing in hot.parts(word):
                        # What is found here has a key that no n-gram is as long as.
                        rows.append((i, word, size, " " * LONGEST + word, total, n, 1))
                        rows += [(i, word, size, g, np.zeros(len(each), np.int64), 0, 0) for g in missing]
            total = np.array([r[4] for r in rows], np.int64).reshape(len(rows), len(each))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], t) for c, t in ((1, pa.string()), (2, pa.int32()), (3, pa.string()))],
                                              *[pa.array(total[:, k]) for k in range(len(each))], *[pa.array([r[c] for r in rows], pa.int64()) for c in (5, 6)]], ["_id", "of", "size", "word", *each, "n", "times"])

    # Both readers of this join take all its columns, so Spark shuffles it once.
    joined = opened.join(model.words.drop("all"), "word", "left").select("_id", "word", *each)
    direct = joined.mapInArrow(run, f"_id long, {types}")
    if shared.value.all_grams:
        return direct
    asked = joined.mapInArrow(ask, f"_id long, of string, size int, word string, {types}, n long, times long")
    found = asked.join(model.grams.select("word", *[F.col(c).alias(f"g_{c}") for c in each]), "word", "left")
    # A word that a text repeats has its sums and numbers repeated, which leaves their quotient as it is.
    sums = found.groupBy("_id", "of", "size").agg(*[F.sum(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in each], F.sum(F.col("n") + F.col(f"g_{each[0]}").isNotNull().cast("long")).alias("n"), F.sum("times").alias("times"))
    best = sums.groupBy("_id", "of").agg(F.max_by(F.struct(*each, "n"), F.when(F.col("n") > 0, F.col("size"))).alias("b"), F.max("times").alias("times"))
    return direct.unionByName(best.select("_id", *[(F.coalesce(F.rint(F.col(f"b.{c}") / F.col("b.n")).cast("long"), F.lit(0)) * F.col("times")).alias(c) for c in each]))


def _looked_up(b: pa.RecordBatch, each: list[str]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Scores by the table of words, the rows that have none, and the words of these."""
    scores = np.stack([np.asarray(b.column(c).fill_null(0)) for c in each], axis=1).astype(np.int64)
    new = np.flatnonzero(np.asarray(b.column(each[0]).is_null()))
    return scores, new, b.column("word").take(pa.array(new)).dictionary_encode()


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    fields = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    if model is None or not model.langs:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    each = [f"_s{k}" for k in range(len(model.langs))]
    shared = docs.sparkSession.sparkContext.broadcast(model.hot)

    def summed(batches):
        hot = shared.value
        for batch in batches:
            for piece in slices(batch, "_text", PIECE):
                texts = piece.column("_text")
                w = lower_words(texts)
                scores, is_open = hot.score_all(w.vocab.to_pylist())
                total = [np.bincount(w.doc, scores[w.codes, k], len(texts)).astype(np.int64) if len(w.codes) else np.zeros(len(texts), np.int64) for k in range(len(each))]
                at = np.flatnonzero(is_open[w.codes]) if len(w.codes) else np.zeros(0, np.int64)
                start = np.concatenate([[0], np.bincount(w.doc[at], minlength=len(texts)).cumsum()])
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
                rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(start, pa.int32()), w.vocab.take(pa.array(w.codes[at])).cast(pa.string())), " ")
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], *[pa.array(t) for t in total], pa.array(np.where(letters, w.counts, 0)), rest], [*keep, *each, "_n", "_open"])

    def chosen(batches):
        for b in batches:
            n = np.asarray(b.column("_n"))
            total = np.stack([np.asarray(b.column(c)) for c in each], axis=1)
            mean = total / np.maximum(n, 1)[:, None] / UNIT
            share = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
            pred = np.where(n > 0, np.array(model_langs, object)[mean.argmax(1)], UNKNOWN)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(np.where(n > 0, share, 0.0))], [*keep, "lang_pred", "score"])

    model_langs, types = model.langs, ", ".join(f"{c} long" for c in each)
    first = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).mapInArrow(summed, f"{fields}, {types}, _n long, _open string")
    if not (model.hot.all_words and model.hot.all_grams):
        first = cut_lineage(first.withColumn("_id", F.monotonically_increasing_id()), free_shuffles=True)
        opened = first.where("_open <> ''").select("_id", F.explode(F.split("_open", " ")).alias("word"))
        added = settled(opened, model, shared).repartition("_id").groupBy("_id").agg(*[F.sum(f"s{k}").alias(f"a{k}") for k in range(len(each))])
        first = first.drop("_open").join(added, "_id", "left").select(*[F.col(f"`{c}`") for c in keep], *[(F.col(c) + F.coalesce(f"a{k}", F.lit(0))).alias(c) for k, c in enumerate(each)], "_n")
    else:
        first = first.drop("_open")
    return first.mapInArrow(chosen, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; a fifth of them, by checksum of doc_id, teaches nothing."""
    marked = docs.select("doc_id", "lang", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(marked, train(marked.where("not held_out")), ["doc_id", "held_out"])


def recognised(docs: DataFrame) -> DataFrame:
    """The documents whose language is found, unchanged."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    # Equal texts get equal answers, and rows stay where they are; the columns of the input stay apart in a struct.
    names = ["hash_a", "hash_b"]
    key = [F.xxhash64("text").alias(names[0]), F.xxhash64(F.lit(1), "text").alias(names[1])]
    answers = predict(docs.select(*key, "text"), model, names)
    gone = cut_lineage(answers.where(F.col("lang_pred") == UNKNOWN).select(*names).distinct(), free_shuffles=True)
    gone = F.broadcast(gone) if gone.count() <= 500_000 else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    return rows.join(gone, names, "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
