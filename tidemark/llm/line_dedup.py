"""Line dedup over all documents: range-partitioned line hashes, first occurrences, and a keep bitmap per document.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least MIN_CHARS code points that
occur in at least MIN_DOCS documents keep their lines in the largest doc_id only. Keys travel as two 64-bit hashes with
different seeds; keys equal in both count as equal. They are dealt to tasks by equal ranges of the hash (hashes are uniform, so no sample is needed) and
sorted there by key and document, largest first, and position: the first document in that order keeps its lines, and
what follows goes once a third document is seen.

A key that holds more than one of SLICES lines would make one task the slowest. Such keys are told from a sample of one
row in SAMPLE; whether one is found changes the plan, not the result. Lines of these keys are kept aside, their
documents are counted in two steps, both pre-aggregated, and their few facts are broadcast to the lines.

What comes back is no text but the gaps of the keep bitmap: the number of kept lines before each dropped one, and after
the last. `kept_lines` applies them.

Rows: NULL text is one empty line. Rows that share a doc_id are one document; NULL is a doc_id of its own, below all
others. Equal rows are shuffled once and given back as often as they came. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.skew import SLICES
from tidemark.llm.text import BLANKS, lowered
from tidemark.operators.ordering import settle

MIN_CHARS = 20
MIN_DOCS = 3
#: One row in this many is looked at to find keys that a single task should not get.
SAMPLE = 64
#: Bits of a hash that number its range.
RANGE_BITS = 16
_KEY = ["h1", "h2"]


def lines_of(text: str | Column) -> Column:
    """The lines of a whole text; one empty line for NULL."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.split(whole, "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, _row_id, _row_hash, at: hashes, document, text hash and position of each line long enough."""
    rows = docs.select(
        F.col("doc_id").alias("_row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row_hash"), "text"
    )
    lines = rows.select("_row_id", "_row_hash", F.posexplode(lines_of("text")).alias("at", "line"))
    inner = lines.select("_row_id", "_row_hash", "at", F.btrim("line", F.lit(BLANKS)).alias("inner"))
    inner = inner.filter(F.length("inner") >= min_chars)
    # Where every character is ASCII, plain lower-casing is the same and much cheaper.
    plain = F.octet_length("inner") == F.length("inner")
    key = inner.select("_row_id", "_row_hash", "at", F.when(plain, F.lower("inner")).otherwise(lowered("inner")).alias("key"))
    return key.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "_row_id", "_row_hash", "at"
    )


def hot_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Keys that hold more than one of SLICES sampled lines: at most SLICES rows, for balance alone."""
    counts = line_keys(docs.sample(1 / SAMPLE, 1), min_chars).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    # With few sampled lines everything looks hot; a key needs more than a handful.
    return counts.filter((F.col("n") * SLICES > total) & (F.col("n") > 8)).orderBy(F.desc("n")).limit(SLICES).select(*_KEY)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_row_id, _row_hash, at of the lines that go."""
    lines, pick = line_keys(docs, min_chars), ["_row_id", "_row_hash", "at"]
    hot = settle(hot_keys(docs, min_chars))
    some_hot = not hot.isEmpty()
    cold = lines.join(F.broadcast(hot), _KEY, "left_anti") if some_hot else lines

    # A range of hashes lies in one task; the windows work along its sorted rows.
    cold = cold.withColumn("range", F.shiftrightunsigned("h1", 64 - RANGE_BITS).cast("int")).repartition("range")
    key = Window.partitionBy("range", *_KEY)
    seen = cold.withColumn("nth", F.dense_rank().over(key.orderBy(F.col("_row_id").desc_nulls_last())))
    seen = seen.withColumn("docs", F.max("nth").over(key))
    drops = seen.filter((F.col("nth") > 1) & (F.col("docs") >= min_docs)).select(*pick)
    if not some_hot:
        return drops

    ours = settle(lines.join(F.broadcast(hot), _KEY))
    holders = ours.groupBy(*_KEY, "_row_id").agg(F.lit(1).alias("one"))
    facts = holders.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("_row_id").alias("last"))
    # As many rows as there are hot keys.
    facts = F.broadcast(settle(facts.filter(F.col("docs") >= min_docs)))
    hot_drops = ours.join(facts, _KEY).filter(~F.col("_row_id").eqNullSafe(F.col("last")))
    return drops.unionByName(hot_drops.select(*pick))


def kept_lines(lines: Column, gaps: Column) -> Column:
    """The kept lines of a document from all its lines and the gaps of its bitmap."""
    bits = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False)))))
    pairs = F.arrays_zip(lines.alias("line"), bits.alias("keep"))
    return F.transform(F.filter(pairs, lambda z: z["keep"]), lambda z: z["line"])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, keep_gaps, kept_sha256."""
    drops = dropped_lines(docs, min_chars, min_docs).groupBy("_row_id", "_row_hash").agg(
        F.array_sort(F.collect_set("at")).alias("drops")
    )
    # Equal rows meet in the map tasks; what is shuffled holds each of them once.
    texts = docs.select(
        F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    texts = texts.groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    same = texts["doc_id"].eqNullSafe(drops["_row_id"]) & (texts["hash"] == drops["_row_hash"])
    found = texts.join(drops, same, "left").select("doc_id", "text", "copies", "drops")
    found = found.withColumn("lines", lines_of("text")).withColumn("n", F.size("lines"))
    # A gap lies between neighbours among -1, the dropped places and the number of lines.
    places = F.coalesce("drops", F.array().cast("array<int>"))
    gaps = F.zip_with(
        F.concat(places, F.array("n")), F.concat(F.array(F.lit(-1)), places), lambda end, start: end - start - 1
    )
    found = found.withColumn("keep_gaps", gaps)
    cut = F.array_join(kept_lines(F.col("lines"), F.col("keep_gaps")), "\n")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(cut)
    out = found.select(
        "doc_id", F.col("n").cast("long").alias("n_lines"), (F.size("keep_gaps") - 1).cast("long").alias("n_dropped"),
        "keep_gaps", F.sha2(kept, 256).alias("kept_sha256"), "copies",
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
