"""Benchmark decontamination: a hash set of test n-grams is scanned for in the windows of all documents.

Test items give windows of ten consecutive words (an item of fewer words gives one window of them all). Their 64-bit
hashes are broadcast while there are at most BROADCAST_WINDOWS of them, 16 bytes each; a larger set is joined by
shuffle, for which a window is its row, place, length and hash, and words are joined back by row for the hits alone.
Documents' windows are hashed and probed in the scan itself. Hits are then verified: word for word, against
the windows of the items. Everything runs in DataFrame operations.

Rows: NULL texts and texts without words have no windows and are clean. Rows that repeat a doc_id are told apart by
their text; repeated rows get the same result. Items that share a window all count; an item without id marks words
but is not listed. Empty tables give no rows, or clean rows. Other columns of documents are kept by clean_documents
and without_spans, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import lowered, row_columns, same_row, words_of
from tidemark.operators.ordering import settle

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000


def _runs(words: str, length: int) -> Column:
    """All runs of length words, in order; an empty array where the text has fewer."""
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    return F.when(F.size(words) >= length, F.transform(starts, lambda i: F.slice(words, i, length))).otherwise(
        F.array().cast("array<array<string>>")
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, gram (the words), length and hash of every distinct window of every item."""
    words = items.select("item_id", words_of(lowered("text")).alias("words")).filter(F.size("words") > 0)
    grams = F.when(F.size("words") < window, F.array("words")).otherwise(_runs("words", window))
    grams = words.select("item_id", F.explode(grams).alias("gram")).distinct()
    return grams.select("item_id", "gram", F.size("gram").alias("length"), F.xxhash64("gram").alias("hash"))


def _hashes(words: str, length: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    return F.when(
        F.size(words) >= length, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, length)))
    ).otherwise(F.array().cast("array<bigint>"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """_row_id, _row_hash, start, length, item_id of every place where a window of an item stands in a document."""
    grams = settle(item_windows(items, window))
    # At most window lengths, and the number of hashes: two small facts about the items.
    facts = grams.agg(F.collect_set("length").alias("lengths"), F.count_distinct("hash").alias("n")).first()
    lengths = sorted(facts["lengths"], reverse=True)
    if not lengths:
        lengths = [window]
    hashes = grams.select("hash", "length").distinct()
    shuffled = facts["n"] > BROADCAST_WINDOWS
    if not shuffled:
        hashes = F.broadcast(hashes)

    words = docs.select(*row_columns(), words_of(lowered("text")).alias("words"))
    words = words.withColumn("n_words", F.size("words"))
    # One array holds the windows of all lengths in use; a place in it gives back length and start.
    place, start, length = F.col("place"), F.col("place"), F.lit(lengths[0])
    before = F.greatest(F.col("n_words") - (lengths[0] - 1), F.lit(0))
    for n in lengths[1:]:
        start = F.when(place >= before, place - before).otherwise(start)
        length = F.when(place >= before, n).otherwise(length)
        before = before + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    # A broadcast join probes in the scan, where a window only points to its document's words.
    carried = ["_row_id", "_row_hash", "n_words"] if shuffled else ["_row_id", "_row_hash", "n_words", "words"]
    scanned = words.select(
        *carried, F.posexplode(F.concat(*(_hashes("words", n) for n in lengths))).alias("place", "hash")
    )
    scanned = scanned.withColumns({"start": start, "length": length}).drop("place", "n_words")
    found = scanned.join(hashes, ["hash", "length"], "left_semi")
    if shuffled:
        # One row per document with a hit meets its words; windows are cut out of them in the same task.
        window_at = F.struct("start", "length", "hash")
        places = found.groupBy("_row_id", "_row_hash").agg(F.collect_set(window_at).alias("places"))
        places = places.withColumnsRenamed({"_row_id": "_hit_id", "_row_hash": "_hit_hash"})
        same = F.col("_row_id").eqNullSafe(F.col("_hit_id")) & (F.col("_row_hash") == F.col("_hit_hash"))
        met = words.join(places, same).select("_row_id", "_row_hash", "words", F.explode("places").alias("at"))
        found = met.select("_row_id", "_row_hash", "words", "at.start", "at.length", "at.hash")
    found = found.select(
        "_row_id", "_row_hash", "start", "length", "hash", F.expr("slice(words, start + 1, length)").alias("gram")
    )
    return found.join(grams, ["hash", "length", "gram"]).select("_row_id", "_row_hash", "start", "length", "item_id")


def _covered(spans: str) -> Column:
    """Words under sorted (start, stop) spans."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["stop"]).alias("upto"),
            (a["n"] + F.greatest(s["stop"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and item_ids and spans as evidence."""
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))))
    found = hits(docs, items, window).groupBy("_row_id", "_row_hash").agg(
        spans.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    found = found.withColumn("n_hit", _covered("spans"))
    rows = docs.select(*row_columns(), F.size(words_of(lowered("text"))).cast("long").alias("n_words"))
    out = rows.join(found, same_row(rows, found), "left").drop(found["_row_id"]).drop(found["_row_hash"])
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("_row_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        ids.alias("item_ids"),
        "spans",
        "_row_hash",
    )


def _row_is(docs: DataFrame, marked: DataFrame) -> Column:
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs["doc_id"].eqNullSafe(marked["_row_id"]) & (text_hash == marked["_row_hash"])


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, all columns."""
    marked = hits(docs, items, window).select("_row_id", "_row_hash").distinct()
    return docs.join(marked, _row_is(docs, marked), "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents; words under a hit are taken out of their text, what stands between words stays."""
    spans, gaps, words = (_free(name, docs.columns) for name in ("spans", "gaps", "words"))
    marked = hits(docs, items, window).groupBy("_row_id", "_row_hash").agg(
        F.collect_set(F.struct("start", "length")).alias(spans)
    )
    joined = docs.join(marked, _row_is(docs, marked), "left")
    # Between the words: one piece more than there are words.
    cased = r"\x30-\x39\x41-\x5A\x61-\x7A"
    text = docs["text"]
    joined = joined.withColumns(
        {
            gaps: F.split(text, rf"[{cased}[^\x00-\x7F]]+"),
            words: F.array_remove(F.split(text, rf"[\x00-\x7F&&[^{cased}]]+"), ""),
        }
    )
    under = lambda i: F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["length"]))
    pieces = F.transform(words, lambda w, i: F.concat(F.get(gaps, i), F.when(under(i), "").otherwise(w)))
    rebuilt = F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))
    whole = F.when(F.col(spans).isNull(), text).otherwise(rebuilt)
    return joined.select(*(whole.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
