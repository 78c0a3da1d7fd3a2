"""Language ID by rank-order profiles of character n-grams.

Letters are lower-cased, everything else is a break; words are padded with one blank. A text's PROFILE most frequent
n-grams of one to three characters are ranked and compared to each language's profile by out-of-place distance: the
sum of rank differences, with the profile's length for n-grams it lacks. The nearest language wins; the score is one
minus the distance as a share of the largest possible one.

Profiles are counted over all labelled texts of the training part and cut to PROFILE n-grams per language; these few
rows are all that the driver and the tasks hold in memory. n-gram counting runs on Arrow batches with numpy, whole
texts at a time.

Rows: NULL texts and texts without a letter give `und` and score 0, and so does everything if there is nothing to
learn from. Ties of n-grams go by their code points, ties of languages by name. Every input row gives one row, repeated
ones too. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
#: One in FOLDS of the labelled documents is held out.
FOLDS = 5
_SHIFT = 21
#: n-grams of a language that a task gathers before it counts them.
_AT_ONCE = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code of each code point: 1 for a break, else the code point plus 2."""
    known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(known, np.arange(2, 0x110002), 1).astype(np.int64)


def grams_of(text: str) -> np.ndarray:
    """All n-grams of one to three characters of a text as 64-bit keys; empty without a letter."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    codes = _letters()[points]
    letter = codes > 1
    codes = codes[letter | np.concatenate(([True], letter[:-1]))]
    if len(codes) < 2:
        return np.empty(0, np.int64)
    ones, inner = codes[codes > 1], codes[1:-1] > 1
    twos = (codes[:-1] << _SHIFT) | codes[1:]
    threes = ((codes[:-2] << 2 * _SHIFT) | (codes[1:-1] << _SHIFT) | codes[2:])[inner]
    return np.concatenate((ones, twos, threes))


def ranked(keys: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys, ties by key."""
    found, counts = np.unique(keys, return_counts=True)
    if len(found) > most:
        # Keys below the count at the cut cannot be among the first.
        cut = np.partition(counts, len(counts) - most)[len(counts) - most]
        found, counts = found[counts >= cut], counts[counts >= cut]
    return found[np.argsort(-counts, kind="stable")][:most]


def distances(own: np.ndarray, profiles: list[np.ndarray], most: int = PROFILE) -> list[int]:
    places = np.arange(len(own))
    order = np.argsort(own)
    out = []
    for profile in profiles:
        found = np.searchsorted(own, profile, sorter=order)
        at = order[np.minimum(found, len(own) - 1)]
        same = own[at] == profile
        ranks = np.flatnonzero(same)
        out.append(int(np.abs(places[at[ranks]] - ranks).sum()) + most * (len(own) - len(ranks)))
    return out


def counted(texts: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of texts (lang, text): counted per batch, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[np.ndarray]] = {}
        done: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, int] = {}

        def close(lang: str) -> None:
            found, n = np.unique(np.concatenate(open_.pop(lang)), return_counts=True)
            waiting[lang] = 0
            if lang in done:
                old, old_n = done[lang]
                found, at = np.unique(np.concatenate((old, found)), return_inverse=True)
                n = np.bincount(at, np.concatenate((old_n, n))).astype(np.int64)
            done[lang] = found, n

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                if text:
                    held = open_.setdefault(lang, [])
                    held.append(grams_of(text))
                    waiting[lang] = waiting.get(lang, 0) + len(held[-1])
                    if waiting[lang] >= _AT_ONCE:
                        close(lang)
        for lang in list(open_):
            close(lang)
        for lang, (found, n) in done.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n, pa.int64())], ["lang", "gram", "n"]
            )

    parts = texts.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of each language of texts (lang, text): at most `most` n-grams each, in rank order."""
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counted(texts.filter("lang IS NOT NULL")).withColumn("place", F.row_number().over(top))
    profiles: dict[str, list[int]] = {}
    for r in rows.filter(F.col("place") <= most).orderBy("lang", "place").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


def identify(
    docs: DataFrame,
    profiles: dict[str, np.ndarray],
    most: int = PROFILE,
    keep_text: bool = True,
    unknown: str | None = "und",
) -> DataFrame:
    """All columns of docs, or all but the text, and _lang_pred and _lang_score of the whole text.

    unknown is the prediction for texts with letters where no language was learned.
    """
    names = sorted(profiles)
    known = [profiles[n] for n in names]
    columns = [c for c in docs.columns if c not in ("_lang_pred", "_lang_score")]
    at = columns.index("text")
    kept = [i for i in range(len(columns)) if keep_text or i != at]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for value in batch.column(at):
                own = ranked(grams_of(value.as_py() or ""), most)
                if not len(own) or not known:
                    found.append(unknown if len(own) else "und")
                    scores.append(0.0)
                    continue
                far = distances(own, known, most)
                best = int(np.argmin(far))
                found.append(names[best])
                scores.append(1.0 - far[best] / (most * len(own)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*(columns[i] for i in kept), "_lang_pred", "_lang_score"],
            )

    source = docs.select(*(f"`{c}`" for c in columns))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in (source.schema.fields[i] for i in kept)]
    return source.mapInArrow(predict, ", ".join([*fields, "_lang_pred string", "_lang_score double"]))


def held_out(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0


def training_part(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Documents with a language outside the held-out part; documents without id can't be told apart and stay out."""
    return docs.filter(F.col("lang").isNotNull() & ~F.coalesce(held_out(folds), F.lit(True)))


def languages(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    profiles = learn(training_part(docs, folds))
    found = identify(docs.select("doc_id", "text"), profiles, keep_text=False)
    return found.select(
        "doc_id",
        F.coalesce(held_out(folds), F.lit(True)).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_lang_score").alias("score"),
    )


def in_a_language(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The documents whose text has a letter, all columns; lang is filled with the prediction where it is NULL.

    Without anything to learn from, documents keep the lang they have.
    """
    profiles = learn(training_part(docs, folds))
    marked = identify(docs, profiles, unknown=None).filter("_lang_pred IS NULL OR _lang_pred <> 'und'")
    return marked.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*(f"`{c}`" for c in docs.columns))
