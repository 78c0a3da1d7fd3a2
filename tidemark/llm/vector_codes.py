"""Vector codes by a product quantiser whose codebooks a dual-tree Lloyd iteration fits, all in integers.

Each component x becomes floor(1024 * x); a vector is cut into PARTS parts, each with a codebook of its own. Vectors
are packed once into blocks of up to BLOCK, and each block orders its parts as a balanced tree: every node is a run of
the order with a bounding box, and running sums give the sum of any node. Blocks stay in the checkpoint folder, and a
round is one pass over them. In a round the codebook forms a tree as well. Pairs of nodes go down both trees together;
a pair whose least distance exceeds the greatest distance of a rival is pruned. A node with one entry left is assigned
whole by its cached sum. Leaves with several entries left compare in integers, ties to the lower index.

A task adds up one sum and count per part and entry, Spark adds those, and the new codebook (PARTS x ENTRIES vectors)
is all that reaches the driver. Lost tasks read their blocks again.

Rows: a row goes if its vector is NULL or holds a NULL or non-finite component. Shorter vectors, empty ones too, count
as filled with zeros up to the longest, rounded up to a multiple of PARTS. The codebook starts from the smallest
vec_ids, NULL last, and among equal ones from the smaller vector; it has fewer entries where fewer rows are kept.
Repeated rows count each for itself. Labels of any type, NULL one of them. Components too large for exact 64-bit
distances raise an error, as no long could hold the result. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.skew import join_facts
from tidemark.operators.ordering import settle

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors in a block, and points below which a node of its trees is not split.
BLOCK = 4_096
LEAF = 64
#: Integers up to this are exact in doubles, and twice the squared distance of a vector must not pass 63 bits.
_EXACT = 2**52


class Tree(NamedTuple):
    """A balanced tree over ordered points: per level the bounds of its nodes and their boxes; node j has 2j, 2j+1."""

    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]


def split_bounds(n: int, leaf: int) -> list[np.ndarray]:
    """Node bounds per level: all nodes are halved until none holds more than leaf points."""
    bounds = [np.array([0, n])]
    while np.diff(bounds[-1]).max() > max(leaf, 1):
        last = bounds[-1]
        halved = np.empty(2 * len(last) - 1, dtype=last.dtype)
        halved[::2], halved[1::2] = last, (last[:-1] + last[1:]) // 2
        bounds.append(halved)
    return bounds


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of points in which every node of split_bounds halves its widest side."""
    order = np.arange(len(points))
    for bounds in split_bounds(len(points), leaf)[:-1]:
        placed = points[order]
        widest = np.argmax(np.maximum.reduceat(placed, bounds[:-1]) - np.minimum.reduceat(placed, bounds[:-1]), axis=1)
        node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = order[np.lexsort((placed[np.arange(len(points)), widest[node]], node))]
    return order


def boxes(ordered: np.ndarray, leaf: int) -> Tree:
    """The tree over points that are in tree order."""
    bounds = split_bounds(len(ordered), leaf)
    low = [np.minimum.reduceat(ordered, bounds[-1][:-1])]
    high = [np.maximum.reduceat(ordered, bounds[-1][:-1])]
    for _ in bounds[1:]:
        low.append(np.minimum(low[-1][::2], low[-1][1::2]))
        high.append(np.maximum(high[-1][::2], high[-1][1::2]))
    return Tree(bounds, low[::-1], high[::-1])


class Book(NamedTuple):
    """A codebook of one part and the tree over its distinct entries, filled up to a power of two."""

    entries: np.ndarray
    index: np.ndarray
    real: np.ndarray
    tree: Tree


def book_of(entries: np.ndarray) -> Book:
    """Equal entries count once, under their lowest index."""
    distinct, index = np.unique(entries, axis=0, return_index=True)
    full = 1 << (len(distinct) - 1).bit_length()
    slots = np.concatenate([np.arange(len(distinct)), np.full(full - len(distinct), len(distinct) - 1)])
    order = tree_order(distinct[slots], 1)
    real = (np.arange(full) < len(distinct))[order]
    return Book(entries, index[slots][order], real, boxes(distinct[slots][order], 1))


def _leaf_codes(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nearest of entries for each point by exact integer distances, the first among ties."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    # Doubles that hold integers below 2**52 are exact and go through the faster matrix product.
    kind = np.float64 if 4 * points.shape[1] * int(largest) ** 2 < _EXACT else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return np.argmin((e * e).sum(axis=1) - 2 * (p @ e.T), axis=1)


class Assignment(NamedTuple):
    codes: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    whole: int


def assign(points: np.ndarray, book: Book, leaf: int = LEAF) -> Assignment:
    """Codes of points in tree order, sums and counts per entry, and the points assigned with a whole node."""
    points = points.astype(np.int64)
    tree, width = boxes(points, leaf), points.shape[1]
    cached = np.zeros((len(points) + 1, width), dtype=np.int64)
    np.cumsum(points, axis=0, out=cached[1:])
    codes = np.zeros(len(points), dtype=np.int64)
    sums = np.zeros((len(book.entries), width), dtype=np.int64)
    counts = np.zeros(len(book.entries), dtype=np.int64)
    deep_points, deep_entries, whole = len(tree.bounds) - 1, len(book.tree.bounds) - 1, 0
    node, entry = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    at_points = at_entries = 0
    while len(node):
        if at_entries == deep_entries:
            node, entry = node[book.real[entry]], entry[book.real[entry]]
        p_low, p_high = tree.low[at_points][node], tree.high[at_points][node]
        e_low, e_high = book.tree.low[at_entries][entry], book.tree.high[at_entries][entry]
        gap = np.maximum(np.maximum(p_low - e_high, e_low - p_high), 0)
        reach = np.maximum(p_high - e_low, e_high - p_low)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        nearest, farthest = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        sure = np.minimum.reduceat(farthest, starts)
        keep = nearest <= np.repeat(sure, np.diff(np.append(starts, len(node))))
        node, entry = node[keep], entry[keep]
        bounds = tree.bounds[at_points]
        if at_entries == deep_entries:
            _, first, left = np.unique(node, return_index=True, return_counts=True)
            alone = first[left == 1]
            for n, number in zip(node[alone], book.index[entry[alone]]):
                codes[bounds[n] : bounds[n + 1]] = number
            begin, end = bounds[node[alone]], bounds[node[alone] + 1]
            np.add.at(sums, book.index[entry[alone]], cached[end] - cached[begin])
            np.add.at(counts, book.index[entry[alone]], end - begin)
            whole += int((end - begin).sum())
            open_ = np.ones(len(node), dtype=bool)
            open_[alone] = False
            node, entry = node[open_], entry[open_]
            if at_points == deep_points:
                break
        # Entries go down two levels for one of points, so that nodes can be assigned well above the leaves.
        for _ in range(min(2, deep_entries - at_entries)):
            node, entry, at_entries = np.repeat(node, 2), np.repeat(2 * entry, 2), at_entries + 1
            entry[1::2] += 1
        if at_points < deep_points:
            by_node = np.flatnonzero(np.diff(node, prepend=-1))
            sizes = np.diff(np.append(by_node, len(node)))
            # Each node's entries once for its left and once for its right child, children in order.
            twice = np.concatenate([np.arange(s, s + n) for s, n in zip(by_node, sizes) for _ in (0, 1)]) if len(node) else by_node
            side = np.concatenate([np.repeat([0, 1], n) for n in sizes]) if len(node) else by_node
            node, entry, at_points = 2 * node[twice] + side, entry[twice], at_points + 1
    if len(node):
        bounds = tree.bounds[deep_points]
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        for n, choice in zip(node[starts], np.split(book.index[entry], starts[1:])):
            choice = np.sort(choice)
            run = points[bounds[n] : bounds[n + 1]]
            codes[bounds[n] : bounds[n + 1]] = picked = choice[_leaf_codes(run, book.entries[choice])]
            np.add.at(sums, picked, run)
            np.add.at(counts, picked, 1)
    return Assignment(codes, sums, counts, whole)


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(1024 * x) of list values, filled with zeros up to width."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    out[np.repeat(np.arange(len(vectors)), lengths), np.concatenate([[0], np.cumsum(np.ones(len(flat), dtype=int))])[:-1]
        - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lists(column: pa.ChunkedArray | pa.Array, cuts: list[int]) -> pa.Array:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), whole)


def pack(kept: DataFrame, width: int, largest: int, parts: int, block: int) -> DataFrame:
    """One row per block: ids, labels, and per part the tree order and the points in that order."""
    types = {f.name: f.dataType for f in kept.schema}
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(types["vec_id"])), T.StructField("labels", T.ArrayType(types["label"])),
        T.StructField("orders", T.ArrayType(T.BinaryType())), T.StructField("points", T.ArrayType(T.BinaryType())),
    ])
    kind = next(k for k in (np.int16, np.int32, np.int64) if largest < np.iinfo(k).max)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = -(-batch.num_rows // block)
            cuts = [batch.num_rows * i // pieces for i in range(pieces + 1)]
            vectors, orders, points = _integers(batch["embedding"], width), [], []
            for start, end in zip(cuts, cuts[1:]):
                cut = [vectors[start:end, i : i + width // parts] for i in range(0, width, width // parts)]
                placed = [tree_order(p, LEAF) for p in cut]
                orders.append([o.astype(np.int32).tobytes() for o in placed])
                points.append([p[o].astype(kind).tobytes() for p, o in zip(cut, placed)])
            binary = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [_lists(batch["vec_id"], cuts), _lists(batch["label"], cuts), pa.array(orders, binary), pa.array(points, binary)],
                names=["ids", "labels", "orders", "points"],
            )

    return kept.mapInArrow(blocks, schema)


def _parts(batch: pa.RecordBatch, row: int, kind: np.dtype, side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for order, points in zip(batch["orders"][row].as_py(), batch["points"][row].as_py()):
        yield np.frombuffer(order, dtype=np.int32), np.frombuffer(points, dtype=kind).reshape(-1, side)


def next_books(blocks: DataFrame, books: list[np.ndarray], kind: np.dtype) -> list[np.ndarray]:
    """Codebooks after one Lloyd round."""
    side = books[0].shape[1]
    sums_of = [f"s{i}" for i in range(side)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [book_of(b) for b in books]
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for i, (_, points) in enumerate(_parts(batch, row, kind, side)):
                    found = assign(points, trees[i])
                    sums[i] += found.sums
                    counts[i] += found.counts
        for i, n in enumerate(counts):
            used = np.flatnonzero(n)
            columns = [np.full(len(used), i), used, n[used], *sums[i][used].T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["part", "entry", "n", *sums_of]
            )

    schema = ", ".join(f"{c} long" for c in ("part", "entry", "n", *sums_of))
    found = blocks.select("orders", "points").mapInArrow(partial, schema)
    # One row per part and entry.
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums_of]).collect()
    after = [b.copy() for b in books]
    for r in totals:
        after[r["part"]][r["entry"]] = [r[c] // r["n"] for c in sums_of]
    return after


def coded(blocks: DataFrame, books: list[np.ndarray], kind: np.dtype) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    side = books[0].shape[1]
    ids, labels = (blocks.schema[c].dataType.elementType for c in ("ids", "labels"))
    schema = T.StructType([
        T.StructField("vec_id", ids), T.StructField("label", labels),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [book_of(b) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                texts, error = None, 0
                for i, (order, points) in enumerate(_parts(batch, row, kind, side)):
                    found = assign(points, trees[i]).codes
                    off = points.astype(np.int64) - books[i][found]
                    own, far = np.empty_like(found), np.empty_like(found)
                    own[order], far[order] = found, (off * off).sum(axis=1)
                    error = error + far
                    hexed = np.array([f"{c:02x}" for c in range(len(books[i]))])[own]
                    texts = hexed if texts is None else np.char.add(texts, hexed)
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"][row].values, batch["labels"][row].values, pa.array(texts, pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(codes, schema)


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK
) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256, and its label."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", "embedding", "label").filter(F.col("embedding").isNotNull() & finite)
    size = F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))
    longest, largest = kept.agg(F.max(F.size("embedding")), F.max(size)).first()
    if longest is None:
        none = F.lit(None)
        return kept.select(
            "vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"),
            none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"), "label",
        )
    width = max(-(-longest // parts), 1) * parts
    largest = int(abs(largest or 0.0) * SCALE) + 1
    if 8 * width * largest**2 >= 2**63:
        raise ValueError(f"components up to {largest / SCALE:g} are too large for squared distances in 64 bits")

    blocks = settle(pack(kept, width, largest, parts, block))
    kind = next(k for k in (np.int16, np.int32, np.int64) if largest < np.iinfo(k).max)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = np.zeros((len(first), width), dtype=np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["embedding"])] = np.floor(np.array(r["embedding"], dtype=np.float64) * SCALE)
    books = [start[:, i : i + width // parts].copy() for i in range(0, width, width // parts)]
    for _ in range(rounds):
        books = next_books(blocks, books, kind)

    rows = settle(coded(blocks, books, kind))
    labels = settle(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    printed = ",".join(str(x) for b in books for e in b for x in e)
    digest = hashlib.sha256(printed.encode()).hexdigest()
    return join_facts(rows, labels, ["label"], "_n").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label"
    )
