"""Stupid-backoff scores of all documents, from n-gram counts over all documents.

S(w | context) = count(context w) / count(context) if the n-gram occurs at least KEEP times in the corpus, else ALPHA
times the score with a context shorter by one word, down to count(w) / N. A document's score is the sum of log S over
its words, its mean the sum per word.

Documents are dealt to blocks by hash; equal rows are kept apart by the part of the input that holds them, and go on to
another block whenever they fill one. Each block explodes its texts into n-grams of orders 1 to ORDER and sends every
distinct n-gram hash once, with its count, to the part of the count table that its hash names: the same n-gram in a
third of all documents is one row per block, so no part gets more of it than there are blocks. The parts sum the
counts and return, to each block and in the order in which it asked, the corpus counts. The block joins them to its
n-grams again, backs off, and sums per document. Tables travel packed: arrays of a block and part per row. Everything
a block needs is derived from its texts and the sorted distinct hashes, so lost tasks repeat exactly.

Memory: a block holds BLOCK bytes of text (or one longer text) and about 100 bytes per word of it; a part at most about
PART_GRAMS n-grams. Numbers of blocks and parts grow with the input.

Rows: NULL texts and texts without words have no words, score and mean NULL. Rows that repeat a doc_id are told apart
by their text; repeated rows each give a row, and each counts. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packed import mixed, parts_of, runs_of

ORDER = 3
ALPHA = 0.4
KEEP = 2
BLOCK = 8 << 20
PART_GRAMS = 2_000_000
_ORDER_BITS = np.uint64(7)
_CODEC = pa.Codec("zstd", compression_level=1)
_EMPTY = b"\0" * 8


def _block_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Text of each word, and per order the hash of the n-gram that ends in it; 0 where the text has too few words."""
    docs, hashes = [], []
    for words in parts_of(texts):
        docs.append(words.doc + words.first)
        hashes.append(words.hash)
    doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
    word = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    grams = []
    for n in range(1, order + 1):
        runs = np.zeros(len(word), np.uint64)
        if len(word) >= n:
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            # The last bits tell the order: n-grams of all orders share the count table.
            values = (mixed(runs_of(word, n)) & ~_ORDER_BITS) | np.uint64(n)
            runs[n - 1 :] = np.where(inside, values, np.uint64(0))
        grams.append(runs)
    return doc, grams


def _distinct(grams: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]:
    """Sorted distinct n-gram hashes of a block, and their counts or the place of each n-gram in them, -1 for none."""
    every = np.concatenate(grams)
    if not places:
        found, counts = np.unique(every, return_counts=True)
        none = int(len(found) > 0 and found[0] == 0)
        return found[none:], counts[none:], []
    found, place = np.unique(every, return_inverse=True)
    none = int(len(found) > 0 and found[0] == 0)
    return found[none:], None, np.split(place - none, np.cumsum([len(g) for g in grams])[:-1])


def _cuts(found: np.ndarray, parts: int) -> np.ndarray:
    """Where each part starts, and the end: a part is a range of hashes."""
    edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(found, edges), [len(found)]))


def _ask(order: int, parts: int):
    def ask(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        _, grams = _block_grams(_texts(table), order)
        found, counts, _ = _distinct(grams)
        cuts = _cuts(found, parts)
        some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(some), pa.int64()),
                "part": pa.array(some, pa.int64()),
                "grams": pa.array([_packed(found[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()),
                "counts": pa.array([_small(counts[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()),
            }
        )

    return ask


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True) if data else _EMPTY


def _whole(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True) if len(data) > 8 else b""


def _packed(found: np.ndarray) -> bytes:
    """Sorted hashes: their differences, byte by byte, so that the high bytes, mostly 0, stand together."""
    steps = np.diff(found, prepend=np.uint64(0))
    return _squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(_whole(data), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Non-negative whole numbers as bytes, 255 for larger ones, which follow as 64-bit numbers."""
    counts = np.asarray(counts, np.int64)
    large = counts >= 255
    return _squeezed(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].tobytes())


def _large(data: bytes, n: int) -> np.ndarray:
    data = _whole(data)
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, offset=n) if len(data) > n else 0
    return counts


def _answer(keep: int):
    """Corpus counts of a part, to each block in the order of its hashes; n-grams of two words and more with counts
    below keep go back as 0."""

    def answer(table: pa.Table) -> pa.Table:
        asked = [_unpacked(g) for g in table.column("grams").to_pylist()]
        sizes = [len(a) for a in asked]
        counts = np.concatenate([_large(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes)])
        every = np.concatenate(asked)
        order = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        total = np.empty(len(every), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        total[(total < keep) & (every & _ORDER_BITS != 1)] = 0
        cuts = np.cumsum([0, *sizes])
        back = [_small(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(back, pa.binary())})

    return answer


def _score(order: int, parts: int, alpha: float, tokens: int):
    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        n_docs = docs.num_rows
        doc, grams = _block_grams(_texts(docs), order)
        there = [g != 0 for g in grams]
        found, _, places = _distinct(grams, places=True)
        del grams
        cuts = _cuts(found, parts)
        # The last one is for n-grams that a text is too short for.
        total = np.zeros(len(found) + 1, np.int64)
        for part, data in zip(totals.column("part").to_pylist(), totals.column("totals").to_pylist()):
            low, high = cuts[part], cuts[part + 1]
            total[low:high] = _large(data, high - low)
        # Corpus count of the n-gram that ends in each word, per order; 0 where it is not kept or not there.
        by_order = [total[place] for place in places]
        del places, found
        logs = np.log(by_order[0] / max(1, tokens))
        used = np.ones(len(doc), np.int64)
        for n in range(2, order + 1):
            # The context of the n-gram ending in a word is the (n-1)-gram that ends in the word before.
            context = np.zeros(len(doc), np.int64)
            context[1:] = by_order[n - 2][:-1]
            kept = by_order[n - 1] > 0
            logs = np.where(there[n - 1] & ~kept, logs + np.log(alpha), logs)
            logs[kept] = np.log(by_order[n - 1][kept] / context[kept])
            used[kept] = n
        words = np.bincount(doc, minlength=n_docs)
        sums = np.bincount(doc, logs, n_docs).astype(np.float64)
        full = np.bincount(doc, used == order, n_docs).astype(np.int64)
        empty = words == 0
        mean = np.divide(sums, words, out=np.zeros(n_docs), where=~empty)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(words.astype(np.int64)),
                "n_full": pa.array(full),
                "log_score": pa.array(sums, mask=empty),
                "mean_log_score": pa.array(mean, mask=empty),
            }
        )

    return score


def _zipped(blocks: int, block: int):
    """Texts, last column, squeezed for the shuffle, and the block of each row, from its place.

    Equal rows of a task share a place; they go on to another block whenever they fill one.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled: dict[int, int] = {}
        for batch in batches:
            packed, dealt = [], []
            for place, text in zip(batch.columns[2].to_pylist(), batch.columns[3].cast(pa.binary())):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                packed.append(_squeezed(data))
                dealt.append((place + filled.get(place, 0) // block) % blocks)
                filled[place] = filled.get(place, 0) + len(data) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(dealt, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "row_hash", "block", "zipped"],
            )

    return squeeze


def _texts(table: pa.Table) -> pa.Array:
    return pa.array([_whole(z) for z in table.column("zipped").to_pylist()], pa.large_binary()).cast(pa.large_string())


def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a block in an order of their own, whatever order a shuffle brought them in."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("row_hash", "ascending")]))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bytes = n_words = 0
        for batch in batches:
            n_bytes += pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
            n_words += sum(len(words.starts) for words in parts_of(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([n_bytes]), pa.array([n_words])], ["n_bytes", "n_words"])

    sums = docs.select("text").mapInArrow(count, "n_bytes bigint, n_words bigint").agg(F.sum("n_bytes"), F.sum("n_words"))
    n_bytes, n_words = sums.first()
    return n_bytes or 0, n_words or 0


def lm_scores(
    docs: DataFrame,
    order: int = ORDER,
    alpha: float = ALPHA,
    keep: int = KEEP,
    block: int = BLOCK,
    part_grams: int = PART_GRAMS,
) -> DataFrame:
    """Per document: doc_id, n_words, n_full (words scored at the full order), log_score, mean_log_score."""
    n_bytes, n_words = corpus_size(docs)
    blocks = max(1, -(-n_bytes // block))
    parts = max(1, -(-n_words * order // part_grams))
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_hash", F.xxhash64("text"))
    # Equal rows of different parts of the input are kept apart.
    place = F.xxhash64("doc_id", "row_hash", F.spark_partition_id())
    rows = rows.select("doc_id", "row_hash", place.alias("place"), "text").mapInArrow(
        _zipped(blocks, block), f"doc_id {key}, row_hash bigint, block bigint, zipped binary"
    )
    rows = rows.repartition(blocks, "block")
    asked = rows.groupBy("block").applyInArrow(
        _ask(order, parts), "block bigint, part bigint, grams binary, counts binary"
    )
    answers = asked.groupBy("part").applyInArrow(_answer(keep), "block bigint, part bigint, totals binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, parts, alpha, n_words),
        f"doc_id {key}, n_words bigint, n_full bigint, log_score double, mean_log_score double",
    )
