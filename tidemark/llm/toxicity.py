"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first 4, 5 and 6 bytes. The model is fitted on at most SAMPLE labelled documents per label
(those with the smallest hash of doc_id, at least three documents a term; near copies are taken once: an example whose set of word 3-grams
reaches a Jaccard of COPY with a kept one counts through that one's weight, and only kept ones take copies, so nothing chains); the terms that speak for label 1
there (chi-square of at least CHI2 and a lift of at least LIFT, at most TERMS of them) span the vectors. Inverse document frequencies of the terms
are counted over all documents.

Examples are sorted by their strongest term and cut into blocks of BLOCK. The index has, for each term, the largest
weight in each block, and for each block its vectors. A query sums the block maxima of its terms to a bound per block
and scores whole blocks, best bound first, until the K-th best cosine reaches the next bound: the K nearest are exact.
Votes are weighted by cosine, and by how many documents an example stands for; the share for label 1 is turned into a
probability by isotonic regression over the examples themselves, each left out of its own vote. A document without any
of the terms is as far from all examples as can be and gets the rate among such documents.

The index has 2 x SAMPLE examples with TERMS terms at most, whatever the input, so each task holds a copy. Copies are
told apart in one task per label, which holds the 3-grams of at most SAMPLE texts, 8 bytes each.

Rows: NULL texts and texts without words have no terms. Every input row gives one row, repeated ones too. Ties among
neighbours go by the example's place in the index. Without labels the score is 0. Labels other than 0 and 1 are left
out; a document labelled twice counts as toxic if one label says so. Documents without id are never learned from; of texts
that share an id the one with the smallest hash is learned from.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngram_join import bands_for, sets_of
from tidemark.llm.packed import mixed, parts_of
from tidemark.operators.ordering import settle

SAMPLE = 4_000
TERMS = 2_000
CHI2 = 15.0
#: A term must make label 1 this many times likelier; at the usual rate of label 1 that is what THRESHOLD asks for.
LIFT = 4.0
BLOCK = 64
K = 15
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
PREFIXES = (4, 5, 6)
#: Jaccard of 3-gram sets from which on two examples are near copies; MinHash bands of so many rows find candidates.
COPY = 0.8
COPY_RECALL = 0.999
COPY_ROWS = 5


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each part of the column: (text of each term occurrence, term hash, number of texts)."""
    for words in parts_of(texts):
        docs, terms = [words.doc], [words.hash]
        for length in PREFIXES:
            at, hashes = words.prefixes(length)
            docs.append(words.doc[at])
            terms.append(hashes)
        yield words.first + np.concatenate(docs), np.concatenate(terms), words.n_texts


def _counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with the number of occurrences; text is small, term an index or a hash."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


class _Known:
    """Places of known term hashes: a bit table sorts out most others before the search."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = np.zeros(1 << 20, bool)
        self.bits[terms >> np.uint64(44)] = True

    def of(self, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of the term) of the occurrences that are known."""
        likely = np.flatnonzero(self.bits[term >> np.uint64(44)])
        if not len(likely) or not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        doc, term = doc[likely], term[likely]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        same = self.terms[at] == term
        return doc[same], at[same]


@dataclass
class Index:
    """Block-max inverted index over examples, with the vote of each and the curve from votes to probabilities."""

    terms: np.ndarray  # sorted term hashes
    idf: np.ndarray
    starts: np.ndarray  # first entry of each example in place and weight
    place: np.ndarray
    weight: np.ndarray
    label: np.ndarray
    stands_for: np.ndarray
    doc_id: list
    block_start: np.ndarray  # first entry of each term in block and most
    block: np.ndarray
    most: np.ndarray
    no_terms: float  # rate of label 1 among documents without terms
    votes: np.ndarray | None = None
    rates: np.ndarray | None = None

    def nearest(self, place: np.ndarray, weight: np.ndarray, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, exact."""
        n_blocks = -(-len(self.label) // BLOCK)
        bound = np.zeros(n_blocks)
        for t, w in zip(place, weight):
            span = slice(self.block_start[t], self.block_start[t + 1])
            bound[self.block[span]] += w * self.most[span]
        query = np.zeros(len(self.terms))
        query[place] = weight
        found, scores, worst = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(found) >= k and bound[b] < worst - 1e-12):
                break
            low, high = b * BLOCK, min((b + 1) * BLOCK, len(self.label))
            span = slice(self.starts[low], self.starts[high])
            cosine = np.add.reduceat(self.weight[span] * query[self.place[span]], self.starts[low:high] - self.starts[low])
            mine = np.flatnonzero(cosine > 0)
            mine = mine[mine + low != leave_out]
            found, scores = np.append(found, mine + low), np.append(scores, cosine[mine])
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            worst = scores[-1] if len(scores) else 0.0
        return found, scores

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of the votes for label 1; what is missing to a cosine of 1 goes to the rate without terms."""
        power = cosine * self.stands_for[found]
        rest = (1 - cosine[0]) * self.stands_for[found[0]] if len(found) else 1.0
        return float(((power * self.label[found]).sum() + rest * self.no_terms) / (power.sum() + rest))

    def probability(self, vote: float) -> float:
        return vote if self.votes is None else float(np.interp(vote, self.votes, self.rates))


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising rates over votes: neighbours that fall are pooled. Returns the middle vote and rate of each pool."""
    pools: list[list[float]] = []
    for i in np.argsort(votes, kind="stable"):
        pools.append([votes[i] * weights[i], labels[i] * weights[i], weights[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    vote, label, weight = np.array(pools).T
    return vote / weight, label / weight


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic, text of at most `sample` labelled training documents per label, and the documents per label."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = settle(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 x sample ids.
    chosen = F.broadcast(settle(chosen))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    # Of different texts of an id the one with the smallest hash.
    first = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text"))
    return texts.groupBy("doc_id", "toxic").agg(first.alias("_first")).select("doc_id", "toxic", "_first.text"), totals


def _examples(sample: DataFrame) -> DataFrame:
    """doc_id, toxic, grams (distinct word 3-grams), terms, counts of each sampled document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            first = 0
            for doc, term, n_texts in _terms(batch.column(2)):
                doc, term, n = _counted(doc - first, term)
                cuts = np.searchsorted(doc, np.arange(n_texts + 1))
                for i in range(n_texts):
                    terms.append(term[cuts[i] : cuts[i + 1]].view(np.int64))
                    counts.append(n[cuts[i] : cuts[i + 1]])
                first += n_texts
            grams = [g.view(np.int64) for g in sets_of(batch.column(2), 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(grams, pa.list_(pa.int64())),
                    pa.array(terms, pa.list_(pa.int64())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "toxic", "grams", "terms", "counts"],
            )

    key = sample.schema["doc_id"].dataType.simpleString()
    return sample.select("doc_id", "toxic", "text").mapInArrow(
        read, f"doc_id {key}, toxic int, grams array<bigint>, terms array<bigint>, counts array<bigint>"
    )


def leaders(sets: list[np.ndarray], threshold: float = COPY) -> np.ndarray:
    """For each set the first kept one that it reaches the threshold with; a set without one is kept and leads itself.

    MinHash bands find candidates among the kept, the whole sets decide. Empty sets are copies of one another.
    """
    bands = bands_for(threshold, COPY_RECALL, COPY_ROWS)
    count = bands * COPY_ROWS
    rng = np.random.default_rng(11)
    times = rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**63, count, dtype=np.uint64)
    # Sketches four standard errors below the threshold are left out before sets are compared.
    floor = threshold - 4 * math.sqrt(threshold * (1 - threshold) / count)
    low = np.full((len(sets), count), np.iinfo(np.uint64).max, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    leader, kept = np.arange(len(sets)), defaultdict(list)
    for i, grams in enumerate(sets):
        for start in range(0, len(grams), 4096):
            np.minimum(low[i], (times[:, None] * grams[start : start + 4096] + plus[:, None]).min(axis=1), out=low[i])
        keys = [(band, low[i, band * COPY_ROWS : (band + 1) * COPY_ROWS].tobytes()) for band in range(bands)]
        near = np.array(sorted({j for key in keys for j in kept.get(key, ())}), np.int64)
        near = near[np.minimum(size[near], size[i]) >= threshold * np.maximum(size[near], size[i]) - 1e-9]
        near = near[(low[near] == low[i]).mean(axis=1) >= floor]
        for j in near:
            shared = len(np.intersect1d(grams, sets[j], assume_unique=True))
            if shared >= threshold * (size[i] + size[j] - shared) - 1e-9:
                leader[i] = j
                break
        else:
            for key in keys:
                kept[key].append(i)
    return leader


def _kept(table: pa.Table) -> pa.Table:
    """doc_id of the examples that are kept, and how many each stands for, from those of one label."""
    table = table.sort_by("doc_id")
    grams = table.column("grams").combine_chunks()
    values, bounds = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
    leader = leaders([values[low:high] for low, high in zip(bounds[:-1], bounds[1:])])
    places, twins = np.unique(leader, return_counts=True)
    doc_id = table.column("doc_id").combine_chunks().take(pa.array(places))
    return pa.table({"doc_id": doc_id, "twins": pa.array(twins, pa.int64())})


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all of them."""
    known = _Known(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for doc, term, _ in _terms(batch.column(0)):
                doc, place = known.of(doc, term)
                pairs = np.unique(doc * len(terms) + place)
                total += np.bincount(pairs % max(1, len(terms)), minlength=len(terms))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(total[held], n))], ["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms) + 1, np.int64)
    for r in rows.collect():
        out[r["place"]] = r["n"]
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_terms: int = TERMS, chi2: float = CHI2) -> Index:
    sampled, totals = _sample(docs, labels, sample)
    rows = settle(_examples(sampled))
    # Of near copies one example stays; the others count through its weight.
    key = rows.schema["doc_id"].dataType.simpleString()
    kept = rows.select("toxic", "doc_id", "grams").groupBy("toxic").applyInArrow(_kept, f"doc_id {key}, twins bigint")
    rows = settle(rows.drop("grams").join(kept, "doc_id"))
    seen = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum("twins").alias("n")).collect()}
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}

    # Chi-square of each term over examples, from its documents per label.
    n1, n0 = size.get(1, 0), size.get(0, 0)
    with_1, with_0 = F.col("with_1").cast("double"), F.col("with_0").cast("double")
    n = float(n1 + n0)
    per_term = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum(F.col("toxic")).alias("with_1"), F.sum(1 - F.col("toxic")).alias("with_0")
    )
    gap = with_1 * (n0 - with_0) - with_0 * (n1 - with_1)
    spread = (with_1 + with_0) * (n - with_1 - with_0) * float(max(n1, 1)) * float(max(n0, 1))
    per_term = per_term.filter((gap > 0) & (with_1 >= 3)).withColumn("chi2", n * gap * gap / F.greatest(spread, F.lit(1.0)))
    lifted = with_1 * float(n0) >= LIFT * (with_0 + 1) * float(n1)
    best = per_term.filter((F.col("chi2") >= chi2) & lifted).orderBy(F.desc("chi2"), "term").limit(most_terms).collect()
    terms = np.sort(np.array([r["term"] for r in best], np.int64).view(np.uint64))

    n_docs, df = document_frequencies(docs, terms)
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    # Examples leave for the driver with the terms of the model only.
    wanted = docs.sparkSession.createDataFrame([(int(t),) for t in terms.view(np.int64)], "term bigint")
    pairs = rows.select("doc_id", "toxic", "twins", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    pairs = pairs.select("doc_id", "toxic", "twins", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    held = pairs.join(F.broadcast(wanted), "term").groupBy("doc_id", "toxic", "twins").agg(
        F.collect_list(F.struct("term", "tf")).alias("vector")
    )
    examples = held.collect()
    known = _Known(terms)
    stands = {label: totals[label] / seen[label] for label in seen}
    vectors = []
    for e in examples:
        hashes = np.array([v["term"] for v in e["vector"]], np.int64).view(np.uint64)
        _, place = known.of(np.zeros(len(hashes), np.int64), hashes)
        place, weight = _unit(place, np.array([v["tf"] for v in e["vector"]]), idf)
        vectors.append((int(place[np.argmax(weight)]), e["doc_id"], place, weight, e["toxic"], e["twins"] * stands[e["toxic"]]))
    vectors.sort(key=lambda v: v[:2])
    bare = dict(seen)
    for e in examples:
        bare[e["toxic"]] -= e["twins"]
    weighted = {label: max(0, bare.get(label, 0)) * stands.get(label, 0.0) for label in (0, 1)}
    no_terms = weighted[1] / max(1e-9, weighted[0] + weighted[1]) if n else 0.0
    index = _indexed(terms, idf, vectors, no_terms)
    if vectors:
        votes = np.array(
            [index.vote(*index.nearest(v[2], v[3], K, leave_out=i)) for i, v in enumerate(vectors)]
        )
        index.votes, index.rates = isotonic(votes, index.label, index.stands_for)
    return index


def _unit(place: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(place)
    weight = (1 + np.log(tf[order])) * idf[place[order]]
    return place[order], weight / np.sqrt((weight**2).sum())


def _indexed(terms, idf, vectors, no_terms) -> Index:
    starts = np.cumsum([0] + [len(v[2]) for v in vectors])
    place = np.concatenate([v[2] for v in vectors]) if vectors else np.empty(0, np.int64)
    weight = np.concatenate([v[3] for v in vectors]) if vectors else np.empty(0)
    owner = np.repeat(np.arange(len(vectors)) // BLOCK, np.diff(starts))
    order = np.lexsort((owner, place))
    cell = place[order] * (len(vectors) // BLOCK + 1) + owner[order]
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    at = np.flatnonzero(new)
    most = np.maximum.reduceat(weight[order], at) if len(at) else np.empty(0)
    block_start = np.searchsorted(place[order][at], np.arange(len(terms) + 1))
    return Index(
        terms, idf, starts, place, weight, np.array([v[4] for v in vectors], float),
        np.array([v[5] for v in vectors], float), [v[1] for v in vectors], block_start, owner[order][at], most, no_terms,
    )


def score(docs: DataFrame, index: Index, k: int = K) -> DataFrame:
    """doc_id, score, and as evidence the nearest example (its doc_id as text) and its cosine, per row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    rate = index.no_terms

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = _Known(index.terms)
        for batch in batches:
            n = batch.num_rows
            scores, near, cosines = np.full(n, rate), [None] * n, np.zeros(n)
            for doc, term, _ in _terms(batch.column(1)):
                doc, place, tf = _counted(*known.of(doc, term))
                cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                for low, high in zip(cuts, np.append(cuts[1:], len(doc))):
                    found, cosine = index.nearest(*_unit(place[low:high], tf[low:high], index.idf), k)
                    if len(found):
                        row = doc[low]
                        scores[row] = index.probability(index.vote(found, cosine))
                        near[row], cosines[row] = str(index.doc_id[found[0]]), min(1.0, cosine[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(scores, 0, 1)), pa.array(near, pa.string()), pa.array(cosines)],
                ["doc_id", "score", "nearest", "cosine"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        vote, f"doc_id {key}, score double, nearest string, cosine double"
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, nearest, cosine."""
    found = score(docs, fit(docs, labels))
    predicted = (F.col("score") >= threshold).cast("int")
    return found.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"), "nearest", "cosine")
