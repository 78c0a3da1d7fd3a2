import random

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, lm_score, ngram_join


def _near(n, seed=3):
    """Groups of near copies, copies, unrelated and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc_id = [], 0
    for group in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((doc_id, " ".join(w)))
            doc_id += 1
    return rows + [(doc_id, None), (doc_id + 1, ""), (doc_id + 2, "!?"), (doc_id + 3, "one two"), (doc_id + 4, "ONE, two")]


@pytest.mark.parametrize("tile", [256, 3])
def test_join_against_all_pairs(docs, tile):
    rows = _near(40)
    found = ngram_join.near_duplicates(docs(rows), tile=tile).collect()
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in found}
    assert len(found) == len(rows) and got == brute.near_duplicates(rows)


def test_one_document_of_each_group_stays(docs):
    rows = _near(12, seed=8)
    rows += [(5000, rows[0][1]), (5000, rows[0][1]), (None, "a b c d e f g"), (None, None)]
    frame = docs(rows).withColumns({"node": F.lit(1), "class_id": F.lit("x"), "_gone": F.lit(0)})
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns
    classes = {c for c, *_ in brute.near_duplicates([r for r in rows if r[0] is not None and r[0] != 5000]).values()}
    assert {r["doc_id"] for r in kept.collect()} == classes | {None}
    assert ngram_join.near_duplicates(docs([])).count() == 0


def test_rows_of_one_id_are_told_apart_by_their_text(docs):
    text = lambda name, last: " ".join(f"{name}{i}" for i in range(60)) + f" {last}"
    rows = [
        (1, text("a", "x")), (5, text("a", "y")),  # 5 goes here ...
        (5, text("b", "x")), (6, text("b", "y")), (5, text("c", "x")),  # ... stays for its class and where it is alone
        (9, text("d", "x")), (9, text("d", "y")), (9, text("d", "z")),  # one row of a class of one id
        (None, text("e", "x")), (None, text("e", "y")), (None, text("f", "x")), (4, text("f", "y")), (None, text("g", "x")),
        (4, None), (None, ""),
    ]
    kept = ngram_join.one_of_each(docs(rows)).collect()
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:1]) for r in kept)
    assert got == [
        ("1", "a"), ("4", ""), ("4", "f"), ("5", "b"), ("5", "c"), ("9", "d"), ("None", ""), ("None", "e"), ("None", "g"),
    ]


def test_bands_reach_the_recall():
    for rows in (3, 5, 8):
        bands = ngram_join.bands_for(0.8, 0.999, rows)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    pairs += [(500, i) for i in range(501, 560)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    frame = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(frame).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("order, keep, block", [(3, 2, 8 << 20), (3, 2, 500), (2, 3, 2000), (1, 2, 1000)])
def test_backoff_against_brute_force(docs, order, keep, block):
    rows = _near(25, seed=order) + [(None, "w1 w2 w3"), (9000, "w1 w2 w3 w4"), (9000, "w1 w2 w3 w4")]
    got = lm_score.lm_scores(docs(rows), order=order, keep=keep, block=block, part_grams=300).collect()
    want = brute.backoff([t for _, t in rows], order, lm_score.ALPHA, keep)
    key = lambda x: (str(x[0]), round(x[3], 6))
    have = sorted(((r["doc_id"], r["n_words"], r["n_full"], r["log_score"] or 0.0) for r in got), key=key)
    for one, other in zip(have, sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key), strict=True):
        assert one[:3] == other[:3] and one[3] == pytest.approx(other[3], abs=1e-6)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)
    assert lm_score.lm_scores(docs([])).count() == 0


def test_half_of_the_rows_equal_and_a_hub_without_adaptive_skew_handling(spark, docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    own = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(60)]
    same = (7, " ".join(rng.choice(words) for _ in range(50)))
    rows = own + [same] * 60
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        found = ngram_join.near_duplicates(docs(rows).repartition(4)).collect()
        scores = lm_score.lm_scores(docs(rows).repartition(4), block=2_000).collect()
        hub = [("hub", f"n{i}") for i in range(3_000)] + [(f"n{i}", f"m{i}") for i in range(0, 3_000, 7)]
        edges = spark.createDataFrame(hub, "a string, b string")
        roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    copies = [r for r in found if r["copy_id"] == 7 and r["n_copies"] == 60]
    assert len(found) == 120 and len(copies) == 60 and {r["class_id"] for r in copies} == {7}
    want = sorted((d, n, full) for (d, _), (n, full, _) in zip(rows, brute.backoff([t for _, t in rows], 3, 0.4, 2)))
    assert sorted((r["doc_id"], r["n_words"], r["n_full"]) for r in scores) == want
    assert set(roots.values()) == {"hub"} and len(roots) == 3_000 + len(range(0, 3_000, 7))


def test_equal_rows_fill_several_blocks():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 50 + [2]), pa.array([9] * 50 + [8]), pa.array([5] * 50 + [-4]), pa.array(["x" * 99] * 50 + [None])],
        ["doc_id", "row_hash", "place", "text"],
    )
    out = next(lm_score._zipped(10, 1_000)(iter([batch])))
    sizes = [out.column(2).to_pylist()[:50].count(b) for b in range(10)]
    assert sizes == [0, 0, 0, 0, 0, 10, 10, 10, 10, 10] and out.column(2)[50].as_py() == 6
