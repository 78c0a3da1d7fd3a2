"""License scans: base phrases by position, and an exact set-similarity join of text windows with license notices.

A document holds a notice if any window of BLOCK consecutive words, wherever it starts, holds at least THRESHOLD of the
notice's distinct words. Words of notices are ordered by their count in all documents, rarest first. A window that
reaches the threshold must hold one of the first n - need + 1 words of the notice (prefix filter), so all windows that
matter lie around the places of those words: the words up to a window's length before and after such a place are
compared. They must hold enough notice words (length filter), also on both sides of the first common one in the global
order (positional filter). What is left is verified on windows: a window can be moved up to its first notice word
without losing any, so those that start at a notice word are all. Nothing is sampled: the filters only drop windows
that cannot reach the threshold. Everything runs in DataFrame operations; the driver sees one count per word of the
notices.

Rows: NULL texts and texts without words have no labels and score 0. Rows that repeat a doc_id are told apart by
their text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import lowered, row_columns, same_row, words_of

BLOCK = 64
THRESHOLD = 0.9

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short public license notices, by label.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
]


@dataclass(frozen=True)
class Notice:
    """A notice with its distinct words in global order and the number of them that a block must hold."""

    number: int
    label: str
    words: tuple[str, ...]
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def ordered_notices(
    counts: dict[str, int], notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD
) -> list[Notice]:
    found = []
    for number, (label, text) in enumerate(notices):
        words = tuple(sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w)))
        found.append(Notice(number, label, words, math.ceil(threshold * len(words) - 1e-9)))
    return found


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the notices stands in all documents."""
    words = docs.select(F.explode(words_of(lowered("text"))).alias("word")).filter(F.col("word").isin(vocabulary))
    return {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}


def _texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def notice_windows(
    docs: DataFrame,
    notices: list[tuple[str, str]] = NOTICES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """_row_id, _row_hash, label, containment: the best window of every notice that reaches the threshold around a place."""
    vocabulary = sorted({w for _, text in notices for w in text.split()})
    counts = word_counts(docs, vocabulary)
    known = ordered_notices(counts, notices, threshold)
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    prefix = sorted({w for n in known for w in n.prefix})
    spark = docs.sparkSession
    docs = docs.select(*row_columns(), words_of(lowered("text")).alias("words"))
    docs = docs.filter(F.arrays_overlap("words", _texts(prefix)))
    places = docs.select("_row_id", "_row_hash", "words", F.posexplode("words").alias("at", "word"))
    places = places.filter(F.col("word").isin(prefix))
    start = F.greatest(F.col("at") - block + 1, F.lit(0))
    around = places.select(
        "_row_id", "_row_hash", "word", (F.col("at") - start).alias("at"),
        F.slice("words", start + 1, F.col("at") - start + block).alias("around"),
    )
    # Of the surroundings only the words of notices count; the intersection returns them in global order.
    around = around.withColumn("held", F.array_intersect(_texts(ordered), "around"))
    rows = [
        (word, n.label, place, len(n.words), n.need, list(n.words))
        for n in known
        for place, word in enumerate(n.prefix)
    ]
    index = spark.createDataFrame(rows, "word string, label string, place int, n int, need int, notice array<string>")
    # One row per notice and prefix word: as large as the list of notices, whatever the input.
    pairs = around.join(F.broadcast(index), "word")
    behind = F.size("held") - F.array_position("held", F.col("word"))
    pairs = pairs.filter(
        (F.size("held") >= F.col("need"))
        & (1 + F.least(F.col("n") - 1 - F.col("place"), behind) >= F.col("need"))
        & (F.size(F.array_intersect("notice", "held")) >= F.col("need"))
    )
    starts = F.filter(F.sequence(F.lit(0), "at"), lambda i: F.array_contains("notice", F.get("around", i)))
    shared = F.transform(starts, lambda i: F.size(F.array_intersect("notice", F.slice("around", i + 1, block))))
    pairs = pairs.withColumn("shared", F.array_max(shared)).filter(F.col("shared") >= F.col("need"))
    return pairs.select("_row_id", "_row_hash", "label", (F.col("shared") / F.col("n")).alias("containment"))


def _places(phrase: str) -> Column:
    """Starts of the phrase in the words, in order."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        met = F.get("words", i) == parts[0]
        for step, part in enumerate(parts[1:], 1):
            met = met & F.coalesce(F.get("words", i + step) == part, F.lit(False))
        return met

    indexes = F.sequence(F.lit(0), F.size("words") - 1)
    none = F.array().cast("array<int>")
    return F.when(F.array_contains("words", parts[-1]), F.filter(indexes, stands)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a notice found, 1 where a base phrase stands, 0 where nothing is found.
    """
    low = docs.select(*row_columns(), lowered("text").alias("low"))
    rows = low.select("_row_id", "_row_hash", words_of("low").alias("words"))
    places = {phrase: f"p{i}" for i, phrase in enumerate(sorted(PHRASES, key=lambda p: (PHRASES[p], p)))}
    rows = rows.withColumns({name: _places(phrase) for phrase, name in places.items()})
    every = F.concat(*places.values())
    labels = F.array_distinct(
        F.array_compact(F.array(*(F.when(F.size(name) > 0, F.lit(PHRASES[p])) for p, name in places.items())))
    )
    rows = rows.select(
        "_row_id",
        "_row_hash",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base"),
    )
    found = notice_windows(docs).groupBy("_row_id", "_row_hash").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    out = rows.join(found, same_row(rows, found), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        rows["_row_id"].alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", more))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
