"""Exact dedup with an extendible-hash index in the shared folder.

Keys are 64-bit hashes of the lower-cased text. A directory of hash prefixes starts with one bucket and doubles as
long as a bucket holds more keys than its capacity; only overfull buckets split, so local depths differ. The directory
routes every document: its texts go to the entry of their bucket and hash, where bytes are compared (the text itself is
a key of the aggregate, so copies meet in the map tasks before anything is shuffled), and different texts of one hash
become a chain of entries, each with the id that stays, its size and the SHA-256 of its bytes. The index is stored, a
range of buckets per owner task. A document is looked up through the directory again: bucket, hash, then along the
chain by the digest. Everything runs in DataFrame operations.

A text that many documents share is one entry; its documents find it by a broadcast of the few hot entries, so no task
gets all of them.

Rows: NULL text counts as empty. A NULL doc_id ranks below all others. Rows that repeat a doc_id and a text are one
document and share its decision. An empty table gives an empty index and no rows. Columns beyond doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.skew import join_facts
from tidemark.llm.text import lowered
from tidemark.operators.ordering import settle

Hash = Callable[[Column], Column]

#: Keys in a bucket before it splits, and the most prefix bits of the directory (2**16 slots at most).
CAPACITY = 50_000
MAX_DEPTH = 16


def keys(docs: DataFrame, hasher: Hash = F.xxhash64) -> DataFrame:
    """doc_id, hash and SHA-256 of the normalised text."""
    low = docs.select("doc_id", lowered("text").alias("low"))
    return low.select("doc_id", hasher(F.col("low")).alias("hash"), F.unhex(F.sha2("low", 256)).alias("sha"))


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """(first slot, slot after the last, local depth) of each bucket, in key order, from the keys per slot.

    A slot is a prefix of max_depth bits. A bucket splits while it holds more than capacity keys and prefix bits are
    left; a bucket that cannot split any further keeps its keys as a longer chain.
    """
    level, buckets, depth = {0: sum(counts.values())}, [], 0
    while level:
        overfull = {p for p, n in level.items() if n > capacity and depth < max_depth}
        width = max_depth - depth
        buckets += [(p << width, (p + 1) << width, depth) for p in level if p not in overfull]
        depth += 1
        doubled: Counter[int] = Counter({2 * p + bit: 0 for p in overfull for bit in (0, 1)})
        if overfull:
            for slot, n in counts.items():
                if slot >> width in overfull:
                    doubled[slot >> (width - 1)] += n
        level = doubled
    return sorted(buckets)


def _slot(max_depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - max_depth).cast("int")


def build_directory(found: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """slot, bucket, local_depth: one row per slot, 2**max_depth of them (1 MB with the default).

    found holds keys(docs). The driver sees one count per slot, whatever the input.
    """
    counts = found.select("hash").distinct().groupBy(_slot(max_depth).alias("slot")).count()
    buckets = directory({r["slot"]: r["count"] for r in counts.collect()}, capacity, max_depth)
    rows = [(number, low, high, depth) for number, (low, high, depth) in enumerate(buckets)]
    entries = found.sparkSession.createDataFrame(rows, "bucket int, low int, high int, local_depth int")
    return settle(entries.select("bucket", "local_depth", F.explode(F.sequence("low", F.col("high") - 1)).alias("slot")))


def routed(rows: DataFrame, slots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """rows with the bucket that the directory holds for their hash."""
    known = F.broadcast(slots.select("slot", "bucket"))
    return rows.withColumn("slot", _slot(max_depth)).join(known, "slot").drop("slot")


def build_index(docs: DataFrame, slots: DataFrame, max_depth: int = MAX_DEPTH, hasher: Hash = F.xxhash64) -> DataFrame:
    """bucket, hash, chain, sha, keep_id, group_size: an entry per distinct text, in the shared folder.

    Entries of a bucket lie with its owner. chain numbers the different texts of a hash.
    """
    texts = docs.select("doc_id", lowered("text").alias("low")).withColumn("hash", hasher(F.col("low")))
    # The text is a key: two documents share an entry if bucket, hash and all bytes are equal.
    entries = routed(texts, slots, max_depth).groupBy("bucket", "hash", "low").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    entries = entries.select("bucket", "hash", F.unhex(F.sha2("low", 256)).alias("sha"), "keep_id", "group_size")
    chain = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("sha")) - 1
    return settle(entries.repartition("bucket").withColumn("chain", chain))


def exact_dedup(
    docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hasher: Hash = F.xxhash64
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its bucket and chain number."""
    found = settle(keys(docs, hasher))
    slots = build_directory(found, capacity, max_depth)
    index = build_index(docs, slots, max_depth, hasher)
    looked_up = join_facts(routed(found, slots, max_depth), index, ["bucket", "hash", "sha"], "group_size")
    return looked_up.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat a doc_id and a text, one.

    Rows are told apart by doc_id and the SHA-256 of the normalised text, whatever the data hold: different texts that
    share a doc_id, or have none, all stay.
    """
    kept = exact_dedup(docs).filter("kept").select(
        F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")
    )
    kept, sha = settle(kept), "_sha"
    keep = settle(kept.distinct())
    repeats = kept.count() > keep.count()
    while sha in docs.columns:
        sha += "_"
    rows = docs.withColumn(sha, F.sha2(lowered("text"), 256))
    same = rows["doc_id"].eqNullSafe(keep["_keep_id"]) & (rows[sha] == keep["_keep_sha"])
    left = rows.join(keep, same, "left_semi")
    # Texts are shuffled once more only where rows repeat a doc_id and a text.
    return (left.dropDuplicates(["doc_id", sha]) if repeats else left).drop(sha)
