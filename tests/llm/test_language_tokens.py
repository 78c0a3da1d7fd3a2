import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)


def test_profiles_by_hand():
    keys = language.grams_of("Ab, a")
    assert len(keys) == 3 + 5 + 3  # a b a; _a ab b_ _a a_; _ab ab_ _a_
    ranks = language.ranked(keys)
    assert len(ranks) == 9 and language.distances(ranks, [ranks, ranks[::-1][:0]]) == [0, 9 * language.PROFILE]
    assert len(language.grams_of("12 !? \n")) == 0 and len(language.grams_of("")) == 0


def _counts(text):
    found, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f" {word} "
            found.update(word)
            for n in (2, 3):
                found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
            word = ""
    return found


def _ranks(counts, most):
    code = lambda gram: tuple([0] * (3 - len(gram)) + [1 if c == " " else ord(c) + 2 for c in gram])
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]


def test_predictions_equal_brute_force(spark):
    """Profiles, distances and scores in plain Python, on the documents of the small tables and odd texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10_001, "Ünïcode façade ДОМ дом", None), (10_002, "a", "en"), (10_003, "1 a 2 b", None), (10_004, None, "en"), (10_005, "x" * 5_000, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    rows, most, totals = docs.collect(), language.PROFILE, {}
    for r in rows:
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % language.FOLDS:
            totals.setdefault(r["lang"], Counter()).update(_counts(r["text"] or ""))
    profiles = {lang: {g: i for i, g in enumerate(_ranks(n, most))} for lang, n in totals.items() if n}
    want = {}
    for r in rows:
        own = _ranks(_counts(r["text"] or ""), most)
        if not own:
            want[r["doc_id"]] = ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else most for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[r["doc_id"]] = (best, 1 - far[best] / (most * len(own)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(docs).collect()}
    assert got.keys() == want.keys()
    for doc_id, (lang, score) in want.items():
        assert got[doc_id][0] == lang and got[doc_id][1] == pytest.approx(score), doc_id


def test_stage_without_anything_to_learn_keeps_its_texts(docs):
    rows = docs([(1, "some text"), (2, "1 2 3"), (3, None), (4, "ещё текст"), (5, "")])
    kept = {r["doc_id"]: r["lang"] for r in language.in_a_language(rows).collect()}
    assert kept == {1: None, 4: None}
    learned = docs([(i, "the and of with that", "en") for i in range(10)] + [(20, "the of and", None), (21, "?", "en")])
    assert {r["lang"] for r in language.in_a_language(learned).collect()} == {"en"}
    assert language.in_a_language(learned).count() == 11


def test_language_of_odd_rows(docs):
    rows = [(i, "der die das und nicht", "de") for i in range(10)] + [(20 + i, "the and of with that", "en") for i in range(10)]
    rows += [(100, None, "de"), (101, "1 2 3"), (102, ""), (103, "the of and " * 30_000), (None, "und das"), (104, "ДОМ")]
    rows += [(105, "nicht das"), (105, "nicht das")]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.languages(docs(rows)).collect()]
    assert len(got) == len(rows)
    by = {d: p for d, p, _ in got}
    assert (by[100], by[101], by[102], by[103], by[None], by[105]) == ("und", "und", "und", "en", "de", "de")
    assert by[104] in ("de", "en") and all(0 <= s <= 1 for *_, s in got)
    kept = language.in_a_language(docs(rows).withColumns({"lang_pred": F.lit(1), "_lang_score": F.lit("x"), "score": F.lit(2)}))
    assert {r["doc_id"] for r in kept.collect()} == set(by) - {100, 101, 102} and "lang_pred" in kept.columns


def test_language_without_anything_to_learn(docs):
    assert language.languages(docs([])).count() == 0
    assert [r["lang_pred"] for r in language.languages(docs([(1, "text"), (2, None)])).collect()] == ["und", "und"]


def _texts():
    rng = random.Random(5)
    letters = list("ab 1,'\n\té½  -.sßtñ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    texts += ["", "a<|endoftext|>b" * 9, "x\x1cy \x85z", "日本語 テキスト" * 20, "it's we'll" * 30, "q" * 700, " " * 300]
    return texts


@pytest.mark.parametrize("huge, chunk, overlap", [(32_768, 16_384, 256), (90, 80, 24), (60, 50, 17)])
def test_counts_equal_the_library(docs, huge, chunk, overlap):
    rows = [*enumerate(_texts()), (None, "one more text " * 20), (900, None), (901, "same " * 60), (901, "same " * 60)]
    library = Tokenizer.from_file(PATH)
    want = sorted((str(d), len(library.encode(t or "", add_special_tokens=False))) for d, t in rows)
    got = tokens.token_counts(docs(rows), PATH, huge=huge, chunk=chunk, overlap=overlap).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_chunks_cover_the_text_and_small_memory_forgets(docs):
    assert tokens.chunks_of(100, 40, 10) == [(0, 40), (30, 70), (60, 100)] and tokens.chunks_of(5, 40, 10) == [(0, 5)]
    counter = tokens.Counter(PATH, memory=3)
    library = Tokenizer.from_file(PATH)
    texts = [t for t in _texts() for _ in range(2)]
    assert counter.counts(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.token_counts(docs([]), PATH).count() == 0
