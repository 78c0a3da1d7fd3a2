"""Operators 11 to 13 against plain Python versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import floor, log

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, resampling, skew, vector_codes

VEC = "vec_id long, embedding array<float>, label int"


# --- vector codes ---------------------------------------------------------------------


def lloyd(rows, parts, entries, rounds):
    """vec_id -> (code, error) and the codebooks, by comparing all pairs."""
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = max(-(-max(len(v) for _, v in kept) // parts), 1) * parts
    ints = [[floor(1024 * float(np.float32(x))) for x in v] + [0] * (width - len(v)) for _, v in kept]
    side = width // parts
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    cut = [[v[p * side : (p + 1) * side] for v in ints] for p in range(parts)]
    books = [[list(cut[p][n]) for n in order] for p in range(parts)]

    def nearest(p, v):
        far = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]]
        return min(range(len(far)), key=lambda i: (far[i], i)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in cut[p]:
                members[nearest(p, v)[0]].append(v)
            for i, own in members.items():
                books[p][i] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for n, (vec_id, _) in enumerate(kept):
        found = [nearest(p, cut[p][n]) for p in range(parts)]
        out.append((vec_id, "".join(f"{i:02x}" for i, _ in found), sum(f for _, f in found)))
    return out, books


def _check_codes(spark, rows, entries=8, block=16, **more):
    df = spark.createDataFrame(rows, VEC).repartition(3)
    got = vector_codes.vector_codes(df, entries=entries, block=block, **more).collect()
    want, books = lloyd(rows, 4, entries, vector_codes.ROUNDS)
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got) == sorted((str(i), c, e) for i, c, e in want)
    printed = ",".join(str(x) for b in books for e in b for x in e)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(printed.encode()).hexdigest()}
    sums = Counter()
    for r in got:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_codes_of_clusters_ties_copies_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25)) + rng.random() / 50 for _ in range(8)], rng.choice((1, 2, None))) for i in range(120)]
    rows += [(500 + i, list(rows[0][1]), 1) for i in range(60)]
    rows += [(3, [0.1] * 8, 1), (3, [0.1] * 8, 1), (None, [0.2] * 8, None), (None, [-0.2] * 8, 2)]
    rows += [(900, None, 1), (901, [0.1, None] + [0.0] * 6, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1)]
    rows += [(904, [], 1), (905, [0.3], None), (906, [0.1] * 7, 2)]
    _check_codes(spark, rows)


def test_codes_of_few_and_equal_vectors(spark):
    _check_codes(spark, [(1, [0.5, 0.25, -0.1, 0.0], 1)])
    _check_codes(spark, [(i, [0.5, 0.25, -0.1, 0.0], 1) for i in range(40)])
    _check_codes(spark, [(i, [1.0 * i], None) for i in range(30)], entries=256)


def test_codes_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], VEC)
    assert vector_codes.vector_codes(empty).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], VEC)).count() == 0
    more = spark.createDataFrame([(1, [0.5] * 4, 1)], VEC).withColumns({"code": F.lit(1), "error": F.lit("x"), "part": F.lit(0)})
    assert [r["error"] for r in vector_codes.vector_codes(more).collect()] == [0]


def test_too_large_components_raise(spark):
    with pytest.raises(ValueError, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1)], VEC))


def test_tree_assigns_as_brute_force_does_and_whole_nodes():
    rng = np.random.default_rng(3)
    centers = rng.integers(-4000, 4000, (32, 4))
    points = centers[rng.integers(0, 32, 2000)] + rng.integers(-20, 20, (2000, 4))
    points = points[vector_codes.tree_order(points, 16)]
    found = vector_codes.assign(points, vector_codes.book_of(np.concatenate([centers, centers[:5]])), leaf=16)
    far = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (found.codes == far.argmin(axis=1)).all()
    assert found.whole > 1000
    sums = np.zeros_like(found.sums)
    np.add.at(sums, found.codes, points)
    assert (sums == found.sums).all() and found.counts.sum() == 2000
    # Distances beyond exact doubles are compared as integers.
    big = np.array([[2**28, 1], [2**28, 2]])
    assert vector_codes._leaf_codes(big, np.array([[2**28 - 1, 0], [2**28, 2], [2**28, 2]])).tolist() == [1, 1]


# --- importance resampling -------------------------------------------------------------


def draw(docs, target, percent=10, min_words=20, runs=1, buckets=10_000, seed="2024"):
    """(doc_id, n_features, weight, score, rank) by sorting all documents."""

    def feats(text):
        w = brute.words(text)
        grams = [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(g.encode()) % buckets for g in grams]

    found = [feats(t) for _, t in docs]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in feats(x))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for (doc_id, text), f in zip(docs, found):
        gain = [floor(1000 * log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, len(brute.words(text)) >= min_words])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def _texts(n, rng, names):
    return [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(10, 40)))) for i in range(n)]


@pytest.mark.parametrize("runs", [1, 2])
def test_resampling_equals_a_full_sort(spark, docs, runs):
    rng = random.Random(runs)
    rows = _texts(300, rng, "red Green blue été 東京 x1 y-z don't".split())
    rows += [(301, None), (302, ""), (303, "..."), (None, "red " * 30), (5, "blue " * 25), (7, "red green " * 200_000)]
    goal = spark.createDataFrame([(1, "red green red"), (2, None), (3, "unseen words")], "item_id long, text string")
    frame = docs(rows).withColumns({"score": F.lit("x"), "rank": F.lit(1), "features": F.lit(0), "hash": F.lit(2)})
    for pivots in (1, 32):
        got = resampling.resample(frame.repartition(5), goal, percent=20, runs=runs, pivots=pivots).collect()
        want = draw(rows, ["red green red", "", "unseen words"], percent=20, runs=runs)
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_resampling_with_half_of_the_rows_equal(spark, docs):
    rows = [(9, "same words " * 20)] * 150 + _texts(150, random.Random(2), "a b c d".split())
    goal = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = [tuple(r) for r in resampling.resample(docs(rows).repartition(7), goal, percent=50, min_words=1).collect()]
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 151))
    assert sorted(map(str, got)) == sorted(map(str, draw(rows, ["same"], percent=50, min_words=1)))


def test_resampling_of_nothing(spark, docs):
    goal = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs([]), goal).count() == 0
    assert [r["rank"] for r in resampling.resample(docs([(1, "few words")]), goal).collect()] == [None]


def test_kth_key_is_that_of_a_sort(spark, docs):
    rows = resampling.scored(docs(_texts(200, random.Random(8), "a b".split())), docs([]))
    keys = sorted(tuple(r["_key"]) for r in rows.collect())
    for k in (1, 77, 200):
        assert resampling.kth_key(rows, k, 200, pivots=3) == keys[k - 1]


# --- line dedup ---------------------------------------------------------------------------


def strip_lines(rows, min_chars=20, min_docs=3):
    blank = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = brute.low(line.strip(blank))
            if len(key) >= min_chars:
                held[key].add(doc_id)
    rank = lambda d: (d is not None, d or 0)
    last = {k: max(v, key=rank) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := brute.low(x.strip(blank))) not in last or last[k] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


PICK = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_lines_equal_brute_force(docs):
    rng = random.Random(6)
    common = [f"  Common line number {i} of all\t" for i in range(12)] + ["short", "", " ", "exactly twenty chars", "nineteen chars long"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"own line {i} {k} of document" for k in range(rng.randrange(1, 12)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, common[0] + "\n" + common[1]), (None, common[2]), (1, rows[1][1])]
    rows += [(303, "COMMON LINE NUMBER 0 OF ALL\r\n" + "é" * 20), (304, "É" * 20), (305, "é" * 20), (306, "é" * 20)]
    rows += [(307, "\n".join(common[:3] * 20_000))]
    frame = docs(rows).withColumns({"at": F.lit(1), "h1": F.lit("x"), "lines": F.lit(2), "copies": F.lit(9)})
    got = line_dedup.line_dedup(frame.repartition(5)).select(PICK).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, strip_lines(rows)))


def test_common_lines_and_equal_rows_take_the_other_path(spark, docs):
    rows = [(i, f"the very same line in all documents\nown text of {i} which is long") for i in range(600)]
    rows += [(7, "one row that comes again and again\nthe very same line in all documents")] * 600
    frame = docs(rows).repartition(6)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        line_dedup.SAMPLE, before = 1.5, line_dedup.SAMPLE
        assert line_dedup.hot_keys(frame, 20).count() >= 1
        got = line_dedup.line_dedup(frame).select(PICK).collect()
    finally:
        line_dedup.SAMPLE = before
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, strip_lines(rows)))


def test_bitmaps_give_the_kept_text_back(docs):
    line = "a line that is in three documents"
    rows = [(1, f"x\n{line}\ny\n{line}"), (2, f"{line}\nz"), (3, f"{line}\n\n{line}"), (4, f"{line}"), (5, "")]
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(rows)).collect()}
    assert [found[i]["keep_gaps"] for i in range(1, 6)] == [[1, 1, 0], [0, 1], [0, 1, 0], [1], [1]]
    text = docs(rows).join(line_dedup.line_dedup(docs(rows)).select("doc_id", "keep_gaps"), "doc_id")
    kept = text.select("doc_id", F.array_join(line_dedup.kept_lines(line_dedup.lines_of("text"), F.col("keep_gaps")), "\n").alias("t"))
    assert {r["doc_id"]: r["t"] for r in kept.collect()} == {1: "x\ny", 2: "z", 3: "", 4: line, 5: ""}


def test_lines_of_nothing(docs):
    assert line_dedup.line_dedup(docs([])).count() == 0


# --- joins to facts of a hot key ------------------------------------------------------------


def test_rows_of_hot_and_other_keys_meet_their_facts(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 100)
    keys = [None] * 5_000 + [1] * 3_000 + list(range(2, 3_000))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i long").repartition(5).checkpoint()
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s")).checkpoint()
    got = skew.join_facts(rows, facts, ["k"], "n").collect()
    sums = Counter()
    for i, k in enumerate(keys):
        sums[k] += i
    assert len(got) == len(keys) and all(r["s"] == sums[r["k"]] for r in got)
    plan = skew.join_facts(rows, facts, ["k"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2
    monkeypatch.setattr(skew, "LEAST", 10_000)
    assert sorted(map(str, got)) == sorted(map(str, skew.join_facts(rows, facts, ["k"], "n").collect()))
