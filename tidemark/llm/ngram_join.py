"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Sketch: every text's set of word n-grams gives a 128-bit name of the set, BANDS x ROWS MinHash values, and one hash
   per band. Band and row counts are chosen for a recall of RECALL at the threshold.
2. Texts with the same set are one class, met by a distinct before anything else is shuffled.
3. Classes are shuffled on band hashes. Buckets are cut into tiles of TILE x TILE classes, so a hot bucket spreads over
   many tasks. In a tile, pairs whose MinHash values agree far less than the threshold asks for (SLACK, four standard
   errors) are left out, and the others are reduced to a spanning forest: edges grow with members, not with pairs.
4. Connected candidates are gathered, in tiles again, with their texts; full sets are intersected within the task
   (products of 0/1 matrices), and each class gets its number of links, with a spanning forest of the links.
5. Components of the links are the near-duplicate classes.

Rows: a text of fewer than NGRAM words has one n-gram of them all; NULL texts and texts without words have none, no
links, and are classes of their own per row. Ties do not arise: classes are named by their smallest doc_id, NULL ids
last. Repeated rows share a class. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.packed import mixed, parts_of, runs_of
from tidemark.llm.skew import join_facts
from tidemark.llm.text import row_columns
from tidemark.operators.ordering import settle

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
#: MinHash values per band.
ROWS = 5
TILE = 256
#: Rows of candidate tiles, and bytes of text in verified tiles, that one task takes at a time.
GROUP_ROWS = 20_000
GROUP_BYTES = 4 << 20
_SLACK = 4.0


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands with which a pair at the threshold meets in one of them with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for words in parts_of(texts):
        bounds = words.bounds()
        runs = words.runs(n)
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high - low >= n:
                yield np.unique(runs[low : high - n + 1])
            else:
                yield runs_of(words.hash[low:high], high - low) if high > low else np.empty(0, np.uint64)


def _sketcher(n: int, bands: int, rows: int):
    count = bands * rows
    rng = np.random.default_rng(7)
    times = rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**63, count, dtype=np.uint64)
    numbers = np.arange(1, bands + 1, dtype=np.uint64)

    def values(grams: np.ndarray) -> np.ndarray:
        low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(grams), 4096):
            part = grams[start : start + 4096]
            np.minimum(low, (times[:, None] * part + plus[:, None]).min(axis=1), out=low)
        return mixed(low)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, keys, signs = [], [], [], []
            for grams in sets_of(batch.column(2), n):
                sizes.append(len(grams))
                if not len(grams):
                    names.append(None), keys.append(None), signs.append(None)
                    continue
                stirred = mixed(grams ^ np.uint64(0x5851F42D4C957F2D))
                names.append(grams.sum(dtype=np.uint64).tobytes() + stirred.sum(dtype=np.uint64).tobytes())
                low = values(grams)
                signs.append((low & np.uint64(255)).astype(np.uint8).tobytes())
                key = mixed(numbers)
                for row in range(rows):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[row::rows])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(names, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(signs, pa.binary()),
                ],
                ["_row_id", "_row_hash", "node", "n_grams", "bands", "sign"],
            )

    return sketch


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of n places under links a - b: the smallest place of its part."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Each row in every tile (lo, hi) of its group that it is part of; half tells which side it is on."""
    cuts = F.ceil(F.col("members") / tile).cast("int")
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    return rows.withColumns({"lo": F.least("cut", "other"), "hi": F.greatest("cut", "other")}).drop("other")


def _candidates(n_signs: int, threshold: float):
    """Spanning edges of the pairs in each tile of a bucket that may reach the threshold."""
    # An eighth of a percent of unlike values agree in their last byte by chance.
    floor = max(0.0, threshold - _SLACK * math.sqrt(threshold * (1 - threshold) / n_signs))

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("node", "ascending")])
        n = table.num_rows
        key, lo, hi, cut, size = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "cut", "n_grams"))
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(n, n_signs)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.cumsum(new)
        left, right, step = [], [], 1
        while step < n:
            a = np.flatnonzero(group[step:] == group[:-step])
            if not len(a):
                break
            b = a + step
            # Off the diagonal only pairs across; sizes alone rule out many.
            ok = (lo[a] == hi[a]) | (cut[a] != cut[b])
            ok &= np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
            a, b = a[ok], b[ok]
            for part in range(0, len(a), 65_536):
                x, y = a[part : part + 65_536], b[part : part + 65_536]
                near = (sign[x] == sign[y]).mean(axis=1) >= floor
                left.append(x[near]), right.append(y[near])
            step += 1
        none = np.empty(0, np.int64)
        root = _forest(n, np.concatenate(left or [none]), np.concatenate(right or [none]))
        moved = np.flatnonzero(root != np.arange(n))
        node = table.column("node").combine_chunks()
        return pa.table({"a": node.take(pa.array(moved)), "b": node.take(pa.array(root[moved]))})

    return find


def _verified(n: int, threshold: float):
    """node, root, links of the classes in each tile, from full n-gram sets. Zero links are left out."""

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("node", "ascending")])
        comp = table.column("comp").to_pylist()
        lo, hi, cut = (table.column(c).to_numpy() for c in ("lo", "hi", "cut"))
        sets = list(sets_of(table.column("text").combine_chunks(), n))
        nodes, roots, links = [], [], []
        start = 0
        while start < len(comp):
            stop = start + 1
            while stop < len(comp) and (comp[stop], lo[stop], hi[stop]) == (comp[start], lo[start], hi[start]):
                stop += 1
            shared, size = _intersections(sets[start:stop])
            enough = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
            np.fill_diagonal(enough, False)
            if lo[start] != hi[start]:
                side = cut[start:stop]
                enough &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(enough))
            root = _forest(stop - start, a, b)
            for i in np.flatnonzero(enough.any(axis=1)):
                nodes.append(start + i), roots.append(start + root[i]), links.append(int(enough[i].sum()))
            start = stop
        node = table.column("node").combine_chunks()
        return pa.table(
            {
                "a": node.take(pa.array(nodes, pa.int64())),
                "b": node.take(pa.array(roots, pa.int64())),
                "links": pa.array(links, pa.int64()),
            }
        )

    return verify


def _intersections(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shared n-grams of all pairs, and set sizes. Exact: counts stay far below 2**24."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column) > 1
    held = many[column]
    owner, column = owner[held], (np.cumsum(many) - 1)[column[held]]
    shared = np.zeros((len(sets), len(sets)))
    width = 4096
    for low in range(0, int(many.sum()), width):
        span = slice(*np.searchsorted(column, [low, low + width]))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[span], column[span] - low] = 1
        shared += part @ part.T
    return shared, size


def near_duplicates(
    docs: DataFrame,
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    rows: int = ROWS,
    tile: int = TILE,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id among the documents linked to it, over any number of
    links), copy_id (smallest doc_id with the same n-gram set), n_copies (documents with that set), n_links (other
    sets at the threshold or above), n_grams; and _row_id, _row_hash, which name the row where ids repeat or are NULL,
    and _class, which names its class (NULL where it has no n-grams).
    """
    bands = bands_for(threshold, recall, rows)
    texts = docs.select(*row_columns(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = texts.schema["_row_id"].dataType.simpleString()
    sketched = settle(
        texts.mapInArrow(
            _sketcher(n, bands, rows),
            f"_row_id {key}, _row_hash bigint, node binary, n_grams int, bands array<bigint>, sign binary",
        )
    )
    classes = sketched.filter("n_grams > 0").dropDuplicates(["node"])
    entries = settle(classes.select("node", "n_grams", "sign", "_row_id", "_row_hash", "bands"))

    # Buckets with company, then tiles of them.
    keyed = entries.select("node", F.explode("bands").alias("key"))
    buckets = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    keyed = join_facts(keyed, buckets, ["key"], "members")
    met = keyed.join(entries.select("node", "n_grams", "sign"), "node")
    tiled = settle(_tiles(met, tile))
    groups = max(1, tiled.count() // GROUP_ROWS)
    dealt = tiled.withColumn("group", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(groups)))
    edges = dealt.groupBy("group").applyInArrow(_candidates(bands * rows, threshold), "a binary, b binary")
    stars = settle(components(edges))

    # Candidates that hang together, with the text of one row each.
    roots = stars.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct()
    member = stars.select("node", F.col("root").alias("comp")).unionByName(roots)
    sizes = member.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    member = join_facts(member, sizes, ["comp"], "members").join(entries.select("node", "_row_id", "_row_hash"), "node")
    # Equal rows meet in the map tasks: one text of them is shuffled.
    texts = texts.groupBy(F.col("_row_id").alias("_text_id"), F.col("_row_hash").alias("_text_hash")).agg(
        F.first("text").alias("text")
    )
    member = member.join(
        texts, member["_row_id"].eqNullSafe(texts["_text_id"]) & (member["_row_hash"] == texts["_text_hash"])
    ).drop("_text_id", "_text_hash", "_row_id", "_row_hash")
    tiled = settle(_tiles(member.dropDuplicates(["node"]), tile))
    weight = tiled.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = tiled.withColumn("group", F.pmod(F.xxhash64("comp", "lo", "hi"), F.lit(max(1, weight // GROUP_BYTES))))
    dealt = dealt.select("group", "comp", "lo", "hi", "cut", "node", "text")
    linked = settle(dealt.groupBy("group").applyInArrow(_verified(n, threshold), "a binary, b binary, links bigint"))

    degrees = linked.groupBy("a").agg(F.sum("links").alias("n_links"))
    found = components(linked.select("a", "b"))
    by_class = sketched.filter("n_grams > 0").groupBy("node").agg(
        F.min("_row_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies")
    )
    labels = by_class.join(degrees, by_class["node"] == degrees["a"], "left").drop("a")
    labels = labels.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").drop("_node")
    labels = settle(labels.withColumn("root", F.coalesce("root", "node")))
    firsts = labels.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    labels = settle(join_facts(labels, firsts, ["root"], "members").drop("members"))
    rows = sketched.select("_row_id", "_row_hash", "node", "n_grams")
    named = join_facts(rows.filter("n_grams > 0"), labels, ["node"], "n_copies")
    found = named.unionByName(rows.filter("n_grams = 0"), allowMissingColumns=True)
    return found.select(
        F.col("_row_id").alias("doc_id"),
        F.coalesce("class_id", "_row_id").alias("class_id"),
        F.coalesce("copy_id", "_row_id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("n_grams").cast("long").alias("n_grams"),
        "_row_id",
        "_row_hash",
        F.col("root").alias("_class"),
    )


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest doc_id of each class, NULL ids last, all columns; rows of a class that share that id go
    by the smallest hash of their text. Repeated rows of it all stay, and so do rows without n-grams.
    """
    found = near_duplicates(docs, n, threshold).filter(F.col("_class").isNotNull())
    found = settle(found.select("_row_id", "_row_hash", "class_id", "_class"))
    # class_id is NULL only where the whole class has no id.
    named = F.col("_row_id").eqNullSafe(F.col("class_id"))
    firsts = found.filter(named).groupBy("_class").agg(F.min("_row_hash").alias("_first"))
    gone = found.join(firsts, "_class").filter(~named | (F.col("_row_hash") != F.col("_first")))
    gone = gone.select("_row_id", "_row_hash").distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(gone["_row_id"]) & (text_hash == gone["_row_hash"])
    return docs.join(gone, same, "left_anti")
