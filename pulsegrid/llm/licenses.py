"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a document, as the set of its distinct words; a template is a set of words.  A block matches when it
holds at least ``THRESHOLD`` of a template's words.  The words of the templates are ordered by the number of blocks of all
documents that hold them, rarest first.  A match must hold one of the first ``m - need + 1`` words of the template
(prefix filter), must have ``need`` template words at all (length filter), and after the first common word both sides must have
enough words left (positional filter).  Survivors are compared exactly.  Only template words are ever moved; texts are not.

Null and empty texts have no words and no labels.  Repeated documents (equal doc_id and text) get equal rows; a null doc_id
is kept.  A block matches every template whose threshold it meets.
Texts of any length are read whole, line by line.  Other columns, whatever their names, are not read.  An empty table gives an
empty table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Customary license notices by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
THRESHOLD = 0.8
_APART = "\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F"


def normal(text: Column, lines: bool) -> Column:
    """Lower-case words with one blank between them; line ends stay if ``lines``."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[{_APART}]+" if lines else f"[{_APART}\\n]+", " ")
    return kept if lines else F.trim(kept)


def words(line: Column) -> Column:
    return F.array_distinct(F.split(F.trim(line), " +"))


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def base_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base (array of labels)."""
    d = docs.select(*_key(docs), normal(F.col("text"), False).alias("t"))
    blanks = (lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))))
    d = d.withColumn("n_words", F.when(F.col("t") == "", 0).otherwise(blanks(F.col("t")) + 1).cast("long"))
    some = F.lit(False)
    for p in PHRASES:
        some = some | F.col("t").contains(p)
    # Every word gets blanks of its own, so that phrases that follow each other don't share one.
    d = d.withColumn("t", F.when(some, F.concat(F.lit(" "), F.replace("t", F.lit(" "), F.lit("  ")), F.lit(" "))))
    total, firsts, lasts, labels = F.lit(0), [], [], []
    for p, label in PHRASES.items():
        spaced = " " + p.replace(" ", "  ") + " "
        n = F.coalesce((F.length("t") - F.length(F.replace("t", F.lit(spaced), F.lit("")))) / len(spaced), F.lit(0)).cast("long")
        total = total + n
        firsts.append(F.when(n > 0, (blanks(F.substring_index("t", spaced, 1)) / 2).cast("long")))
        lasts.append(F.when(n > 0, F.col("n_words") - len(p.split()) - (blanks(F.substring_index("t", spaced, -1)) / 2).cast("long")))
        labels.append(F.when(n > 0, F.lit(label)))
    return d.select("doc_id", "text_hash", "n_words", total.cast("long").alias("n_base"), F.least(*firsts).alias("first_word"),
                    F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, label, words (distinct), m, need."""
    t = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "template int, label string, notice string")
    t = t.withColumn("words", F.array_remove(words(normal(F.col("notice"), False)), ""))
    return t.withColumns({"m": F.size("words"), "need": F.ceil(F.size("words") * THRESHOLD - 1e-9).cast("int")})


def license_blocks(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, line (from 0), block, label, containment: every line that meets the threshold of a template.

    ``notices`` is a bounded table from ``templates``; its words travel as literals.
    """
    spark = docs.sparkSession
    notices = templates(spark) if notices is None else notices
    held = notices.collect()
    vocab = sorted({w for r in held for w in r.words})
    if not vocab:
        return spark.createDataFrame([], docs.select(*_key(docs)).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
                                     + ", line int, block string, label string, containment double")
    lines = F.split(normal(F.col("text"), True), "\n")
    known = F.array(*[F.lit(w) for w in vocab])
    per_block = docs.select(F.explode(lines).alias("line")).select(F.explode(F.array_intersect(words(F.col("line")), known)).alias("word"))
    counts = {r.word: r["count"] for r in per_block.groupBy("word").count().collect()}
    order = sorted(vocab, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index = [(r.template, r.label, r.m, r.need, p, w, sorted(r.words, key=rank.get)) for r in held
             for p, w in enumerate(sorted(r.words, key=rank.get)[:r.m - r.need + 1])]
    prefix = spark.createDataFrame(index, "template int, label string, m int, need int, p int, word string, words array<string>")
    starts = F.array(*[F.lit(w) for w in sorted({r[5] for r in index})])
    ordered = F.array(*[F.lit(w) for w in order])
    cut = docs.select(*_key(docs), F.posexplode(lines).alias("line", "block"))
    cut = cut.withColumn("words", F.split(F.trim("block"), " +")).where(F.arrays_overlap("words", starts))
    # A block's template words in the common order, by intersecting from the ordered side.
    cut = cut.withColumn("words", F.array_intersect(ordered, "words")).where(F.size("words") >= min(r.need for r in held))
    met = cut.select("*", F.posexplode("words").alias("q", "word")).join(F.broadcast(prefix.withColumnRenamed("words", "notice")), "word")
    met = met.where((F.size("words") >= F.col("need")) & (1 + F.least(F.col("m") - F.col("p") - 1, F.size("words") - F.col("q") - 1) >= F.col("need")))
    shared = F.size(F.array_intersect("words", "notice"))
    hit = met.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return (hit.groupBy("doc_id", "text_hash", "line", "block", "label").agg(F.max(F.col("shared") / F.col("m")).alias("containment")))


def scan(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment; 1 for a base phrase)."""
    base = base_phrases(docs)
    found = license_blocks(docs, notices).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "more", "best")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    joined = (lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ","))
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
                       joined(F.concat("base", F.coalesce("more", none))).alias("labels"),
                       F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
