"""Token counts of whole texts, huge ones by overlapping chunks that are spliced again.

Texts of up to HUGE characters are encoded as they are. Longer ones are cut into chunks that overlap, and the chunks
are encoded apart, in any task. The tokenizer works inside pre-tokens, and where a pre-token starts is decided from
left to right with at most LOOK characters of context to the right. So a start in the left chunk with LOOK characters
behind it is a start in the whole text, and if the right chunk has a start at the same place, both agree from there on:
the right chunk's tokens before it are dropped and so are the left chunk's after it. Where an overlap has no common
start, the document goes again with wider overlaps and chunks, in the end as one chunk.

Counts come from the library on whole pre-tokens, special strings included; ids are not kept.

Rows: NULL counts as empty, 0 tokens. Rows that repeat a doc_id are told apart by their text and each gives a row.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import row_columns, same_row
from tidemark.operators.ordering import settle

HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
#: The longest special string, '<|endoftext|>', has 13 characters; contractions look 3 ahead, runs of blanks 1.
LOOK = 16
LIMIT = 1024
#: Pre-tokens that a worker remembers, about 150 bytes each.
MEMORY = 1_000_000
_AT_ONCE = 256


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Counter:
    """Token counts of texts, with a memory of the counts of pre-tokens.

    Tokens never cross pre-tokens, so a text has as many as its pre-tokens have. Texts of plain characters, on which
    the pre-token pattern means the same everywhere, are cut by the pattern, and only pre-tokens not met before go to
    the library; so does every other text, and every text with a special string, as a whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        import public_tokenizers
        import regex

        self.encode = _tokenizer(path).encode_batch_fast
        config = json.loads(_tokenizer(path).to_str())
        steps = config["pre_tokenizer"] or {}
        self.splits = steps.get("type") == "ByteLevel" and steps["use_regex"] and not steps["add_prefix_space"]
        self.splits = self.splits and not config["normalizer"] and not config["model"].get("ignore_merges")
        special = [regex.escape(t["content"]) for t in config["added_tokens"]]
        self.other = regex.compile("|".join([*special, r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]"]))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}
        self.memory = memory

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.encode(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        odd = [i for i, t in enumerate(texts) if not self.splits or self.other.search(t)]
        for i, n in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = n
        plain = sorted(set(range(len(texts))) - set(odd))
        cut = [self.pattern.findall(texts[i]) for i in plain]
        met = set().union(*cut)
        new = list(met.difference(self.known))
        if len(self.known) + len(new) > self.memory:
            # Start anew: what is common comes back at once.
            self.known = {}
            new = list(met)
        self.known.update(zip(new, self.whole(new)))
        for i, parts in zip(plain, cut):
            out[i] = sum(map(self.known.__getitem__, parts))
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _count_texts(path: str, at_once: int = _AT_ONCE):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts, counts = batch.column(batch.num_columns - 1), []
            for start in range(0, len(texts), at_once):
                counts += counter.counts(texts.slice(start, at_once).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"]
            )

    return count


def chunks_of(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of overlapping chunks that cover a text of that length."""
    step, starts = chunk - overlap, [0]
    while starts[-1] + chunk < length:
        starts.append(starts[-1] + step)
    return [(s, min(s + chunk, length)) for s in starts]


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py()
                spans = chunks_of(len(text), chunk, overlap)
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(row, 1)] * n),
                        pa.concat_arrays([batch.column(1).slice(row, 1)] * n),
                        pa.array(range(n), pa.int32()),
                        pa.array([s for s, _ in spans], pa.int64()),
                        pa.array([i == n - 1 for i in range(n)]),
                        pa.array([text[s:e] for s, e in spans], pa.string()),
                    ],
                    ["_row_id", "_row_hash", "no", "start", "last", "piece"],
                )

    return cut


def starts_in(encoding, start: int) -> list[tuple[int, int]]:
    """(place in the text, tokens of the chunk before it) of every start of a pre-token."""
    found, before = [], object()
    for i, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != before:
            found.append((start + at, i))
        before = word
    return found


def _encode_chunks(path: str, overlap: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            heads, tails, totals = [], [], []
            for start, last, piece in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                encoding = tokenizer.encode(piece, add_special_tokens=False)
                places, stop = starts_in(encoding, start), start + len(piece)
                # The head may be cut into a pre-token: only what the left chunk confirms counts.
                heads.append([p for p in places if start > 0 and p[0] < start + overlap])
                tails.append([p for p in places if not last and stop - overlap <= p[0] <= stop - LOOK])
                totals.append(len(encoding))
            pairs = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            as_rows = lambda lists: pa.array([[{"at": a, "n": n} for a, n in x] for x in lists], pairs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], as_rows(heads), as_rows(tails), pa.array(totals, pa.int64()), batch.column(4)],
                ["_row_id", "_row_hash", "no", "head", "tail", "n", "last"],
            )

    return encode


def _spliced(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """_row_id, _row_hash and n_tokens of each document; NULL where a pair of chunks has no common start."""
    key = docs.schema["_row_id"].dataType.simpleString()
    pieces = docs.select("_row_id", "_row_hash", "text").mapInArrow(
        _cut(chunk, overlap), f"_row_id {key}, _row_hash bigint, no int, start bigint, last boolean, piece string"
    )
    pairs = "array<struct<at: bigint, n: bigint>>"
    parts = pieces.repartition("_row_id", "_row_hash", "no").mapInArrow(
        _encode_chunks(path, overlap),
        f"_row_id {key}, _row_hash bigint, no int, head {pairs}, tail {pairs}, n bigint, last boolean",
    )
    parts = settle(parts)
    left = parts.select("_row_id", "_row_hash", (F.col("no") + 1).alias("no"), "tail")
    joined = parts.alias("r").join(
        left.alias("l"),
        F.col("r._row_id").eqNullSafe(F.col("l._row_id"))
        & (F.col("r._row_hash") == F.col("l._row_hash"))
        & (F.col("r.no") == F.col("l.no")),
        "left",
    )
    common = F.array_min(F.array_intersect(F.col("tail.at"), F.col("head.at")))
    n_at = lambda side: F.get(F.filter(side, lambda p: p["at"] == F.col("common")), 0)["n"]
    joined = joined.select("r._row_id", "r._row_hash", "r.no", "r.head", "l.tail", "r.n", "r.last")
    joined = joined.withColumn("common", common)
    gained = F.when(F.col("no") == 0, 0).otherwise(n_at("tail") - n_at("head"))
    gained = gained + F.when(F.col("last"), F.col("n")).otherwise(0)
    whole = F.bool_and((F.col("no") == 0) | F.col("common").isNotNull())
    return joined.groupBy("_row_id", "_row_hash").agg(F.when(whole, F.sum(gained)).alias("n_tokens"))


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    rows = docs.select(*row_columns(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = rows.schema["_row_id"].dataType.simpleString()
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.filter(F.length("text") <= huge).select("_row_id", "n_bytes", "text")
    short = short.mapInArrow(_count_texts(path), f"_row_id {key}, n_bytes bigint, n_tokens bigint")

    long = rows.filter(F.length("text") > huge)
    # A repeated row needs its chunks once.
    open_, done = long.dropDuplicates(["_row_id", "_row_hash"]), []
    while True:
        found = settle(_spliced(open_, path, chunk, overlap))
        done.append(found.filter("n_tokens IS NOT NULL"))
        failed = found.filter("n_tokens IS NULL").select("_row_id", "_row_hash")
        if failed.isEmpty():
            break
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
        open_ = open_.join(failed, same_row(open_, failed), "left_semi")
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    long = long.select("_row_id", "_row_hash", "n_bytes")
    long = long.join(counts, same_row(long, counts)).select(long["_row_id"], "n_bytes", "n_tokens")
    return short.unionByName(long).select(
        F.col("_row_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
