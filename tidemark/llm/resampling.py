"""Importance resampling towards a target distribution of hashed n-grams, with a distributed quickselect.

Features are all runs of 1 to RUNS words; each falls into a bucket by its CRC-32. A bucket's gain is the logarithm of
its smoothed share in the target over its share in the corpus, in thousandths. Documents are turned into arrays of
bucket numbers once; corpus counts and weights both come from those arrays. A document's weight is the mean gain of its
features, its score the weight plus Gumbel noise from a hash of its id, so that the highest scores are a draw without
replacement by weight.

The k-th highest score is found without sorting: random pivot keys are drawn among the open rows, one pass counts the
rows before, at and after each pivot, and the interval that holds place k stays open. With PIVOTS pivots a pass leaves
about 1 / PIVOTS of the rows open. Only the drawn rows are sorted, in blocks, and ranked.

Rows: NULL text has no features and weight 0. A NULL doc_id draws the noise of an empty id and comes after all others
among ties. Ties in score go to the smaller doc_id; rows that share both go by a hash of the text, and equal rows are
told apart by a number that does not show. Repeated rows count each for itself. An empty target has T = 0; an empty
corpus gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import lowered, words_of
from tidemark.operators.ordering import row_numbers, settle

BUCKETS = 10_000
RUNS = 1
SEED = "2024"
#: Documents with fewer words are never drawn.
MIN_WORDS = 20
PERCENT = 10
PIVOTS = 32
#: Features looked up at once, more where a single document holds more.
SLICE = 1_000_000
_HASHES = 4_294_967_296


def feature_buckets(words: Column, runs: int, buckets: int) -> Column:
    """Bucket numbers of all runs of 1 to `runs` words, repeats included."""
    number = "short" if buckets <= 32_768 else "int"

    def of_length(n: int) -> Column:
        last = F.size(words) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    found = [words, *[of_length(n) for n in range(2, runs + 1)]]
    texts = F.concat(*found) if runs > 1 else words
    return F.transform(texts, lambda w: (F.crc32(w) % buckets).cast(number))


def bucket_counts(found: DataFrame) -> DataFrame:
    """bucket and n, its number of features; at most one row per bucket."""
    each = found.select(F.explode("features").alias("bucket"))
    return each.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The array of gains by bucket number, from the counts in corpus and target."""
    # As many rows as there are buckets reach the driver, whatever the input.
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, found in ((s, bucket_counts(corpus)), (t, bucket_counts(target))):
        for r in found.collect():
            counts[r["bucket"]] = r["n"]
    share = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([floor(1000 * log(x)) for x in share], dtype=np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """n_features and weight in place of features: gains are looked up as arrays, a slice of rows at a time."""
    keep = [c for c in found.columns if c != "features"]
    schema = T.StructType([*[found.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in ("n_features", "weight")]])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch["features"].offsets.to_numpy().astype(np.int64)
            numbers = batch["features"].values.to_numpy(zero_copy_only=False)
            sums = np.zeros(batch.num_rows, dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
                upto = np.cumsum(np.concatenate([[0], gain[numbers[ends[first] : ends[last]]]]))
                places = ends[first : last + 1] - ends[first]
                sums[first:last] = upto[places[1:]] - upto[places[:-1]]
                first = last
            n = np.diff(ends)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in keep], pa.array(n), pa.array(weight)], names=[*keep, "n_features", "weight"]
            )

    return found.mapInArrow(weights, schema)


def noise(seed: str) -> Column:
    """Standard Gumbel noise in thousandths, from seed and doc_id alone."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(float(_HASHES))))).cast("long")


def scored(
    docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: str = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and _key: a struct that orders rows from the highest score on."""
    words = words_of(lowered("text"))
    found = docs.select("doc_id", words.alias("words"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    found = settle(
        found.select(
            "doc_id", "hash", F.size("words").cast("long").alias("n_words"),
            feature_buckets(F.col("words"), runs, buckets).alias("features"),
        )
    )
    goal = target.select(words.alias("words")).select(feature_buckets(F.col("words"), runs, buckets).alias("features"))
    rows = weighed(found, gains(found, goal, buckets)).withColumn("score", F.col("weight") + noise(seed))
    key = F.struct(
        (-F.col("score")).alias("score"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"),
        F.col("hash").alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    return settle(rows.select("doc_id", "n_words", "n_features", "weight", "score", key.alias("_key")))


def _literal(key: Any) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("score", "no_id", "id", "hash", "row"), key)])


def kth_key(rows: DataFrame, k: int, n: int, pivots: int = PIVOTS, seed: int = 0) -> Any:
    """The k-th smallest _key, k from 1, of n settled rows.

    Each pass brings about `pivots` keys, drawn by hash, and two counts for each of them to the driver.
    """
    key = F.col("_key")
    low, high, before, upto, turn = None, None, 0, n, 0
    while True:
        left = rows
        if low is not None:
            left = left.filter(key > _literal(low))
        if high is not None:
            left = left.filter(key < _literal(high))
        # Each open row is drawn with the same chance, so that few keys travel however many tasks there are.
        chance = int(min(1.0, pivots / (upto - before)) * _HASHES)
        drawn = left.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "_key"), F.lit(_HASHES)) < chance)
        keys = sorted(tuple(r["_key"]) for r in drawn.select("_key").collect())
        turn += 1
        if not keys:
            continue
        sides = [F.count_if(test) for p in keys for test in (key < _literal(p), key == _literal(p))]
        counts = left.agg(*[c.alias(f"c{i}") for i, c in enumerate(sides)]).first()
        base = before
        for i, p in enumerate(keys):
            less, equal = base + counts[2 * i], counts[2 * i + 1]
            if less < k <= less + equal:
                return p
            if less + equal < k:
                low, before = p, less + equal
            else:
                high, upto = p, less
                break


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    seed: str = SEED,
    pivots: int = PIVOTS,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank; rank is NULL where it is not drawn."""
    rows = scored(docs, target, runs, buckets, seed)
    fit = rows.filter(F.col("n_words") >= min_words)
    n = fit.count()
    k = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last = _literal(kth_key(fit, k, n, pivots))
    won = (F.col("n_words") >= min_words) & (F.col("_key") <= last)
    ranked = row_numbers(rows.filter(won), [], ["_key"], "rank").select(*out, "rank")
    return ranked.unionByName(rows.filter(~won).select(*out, F.lit(None).cast("long").alias("rank")))
