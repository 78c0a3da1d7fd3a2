import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, skew
from tidemark.llm.exact_dedup import directory


def test_copies_differ_only_in_ascii_case(docs):
    rows = [(1, "Éa b"), (2, "éa b"), (3, "éA B"), (4, None), (5, ""), (6, "x" * 200_000), (7, "X" * 200_000)]
    found = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(rows)).collect()}
    assert {k: (r["keep_id"], r["group_size"], r["kept"]) for k, r in found.items()} == {
        1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True),
        6: (7, 2, False), 7: (7, 2, True),
    }
    assert found[3]["text_sha256"] == hashlib.sha256("éa b".encode()).hexdigest()


def test_null_ids_repeats_and_clashing_columns(docs):
    rows = docs([(None, "a"), (1, "A"), (2, "b"), (2, "b"), (None, "c")])
    rows = rows.withColumns({"hash": F.lit("x"), "bucket": F.lit(1), "kept": F.lit("no")})
    kept = exact_dedup.without_copies(rows)
    assert kept.columns == rows.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "A"), ("2", "b"), ("None", "c")]


def test_different_texts_of_one_id_all_stay(docs):
    rows = [(None, "a"), (None, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e"), (7, "E"), (8, "f")]
    frame = docs(rows).withColumns({"_sha": F.lit("x"), "_keep_id": F.lit(1)})
    kept = exact_dedup.without_copies(frame)
    assert kept.columns == frame.columns
    got = sorted((str(r["doc_id"]), r["text"].lower()) for r in kept.collect())
    assert got == [("7", "d"), ("7", "e"), ("8", "f"), ("None", "a"), ("None", "b"), ("None", "c")]


def test_empty_table(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    assert exact_dedup.without_copies(docs([])).count() == 0


def test_directory_doubles_only_where_full():
    counts = {0: 5, 1: 5, 2: 1, 7: 1}
    assert directory(counts, 6, 3) == [(0, 1, 3), (1, 2, 3), (2, 4, 2), (4, 8, 1)]
    assert directory({3: 100}, 6, 2) == [(0, 2, 1), (2, 3, 2), (3, 4, 2)]
    assert directory({}, 6, 2) == [(0, 4, 0)]


def test_small_buckets_give_the_same_decisions(docs):
    rows = docs([(i, f"text {i % 37}") for i in range(300)])
    pick = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    few = exact_dedup.exact_dedup(rows)
    many = exact_dedup.exact_dedup(rows, capacity=2, max_depth=8)
    assert many.select("bucket").distinct().count() > 10
    assert sorted(few.select(pick).collect()) == sorted(many.select(pick).collect())


def test_texts_of_one_hash_form_a_chain_and_bytes_decide(docs):
    rows = [(i, f"{'x' * (i % 5)} same length {i % 7}") for i in range(200)] + [(900, "A b"), (901, "a B"), (None, None), (902, "")]
    pick = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    plain = exact_dedup.exact_dedup(docs(rows))
    for hasher in (lambda low: F.shiftleft(F.length(low).cast("long"), 58), lambda low: F.lit(7).cast("long")):
        forced = exact_dedup.exact_dedup(docs(rows), capacity=3, max_depth=6, hasher=hasher)
        assert sorted(map(str, forced.select(pick).collect())) == sorted(map(str, plain.select(pick).collect()))
        assert forced.agg(F.max("chain")).first()[0] >= 6
    found = exact_dedup.keys(docs(rows))
    slots = exact_dedup.build_directory(found, capacity=4, max_depth=8)
    assert slots.count() == 256 and slots.agg(F.max("local_depth")).first()[0] >= 3
    index = exact_dedup.build_index(docs(rows), slots, max_depth=8)
    # Every entry lies in the bucket of its slot, and no bucket that could split holds more than its capacity.
    routed = exact_dedup.routed(index.drop("bucket"), slots, max_depth=8).select("bucket", "hash", "sha")
    assert routed.exceptAll(index.select("bucket", "hash", "sha")).count() == 0
    full = index.groupBy("bucket").agg(F.countDistinct("hash").alias("n")).join(slots.dropDuplicates(["bucket"]), "bucket")
    assert full.filter("n > 4 AND local_depth < 8").count() == 0


def test_half_of_the_rows_equal_without_adaptive_skew_handling(spark, docs):
    rows = [(5, "one text again and again")] * 3_000 + [(i, f"text {i % 1500}") for i in range(3_000)]
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        got = exact_dedup.exact_dedup(docs(rows).repartition(4)).collect()
        mixed = mixing.mix(docs(rows).repartition(4)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    same = [r for r in got if r["doc_id"] == 5]
    assert len(got) == 6_000 and len(same) == 3_001
    assert sum(r["group_size"] == 3_000 for r in got) == 3_000
    assert len(mixed) == 6_000 and sum(r["taken"] for r in mixed) == pytest.approx(sum(r["size"] for r in mixed), abs=5)


def _sources(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, source_size long")


@pytest.mark.parametrize(
    "sizes",
    [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, None: 50}, {"a": 0, "b": 7}, {"a": 0}, {"x": 5}, {}],
)
def test_targets_share_all_words(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(_sources(spark, sizes)).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    while free:
        left = sum(sizes.values()) - sum(target[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        target.update({s: 3.0 * sizes[s] if s in above else share[s] for s in free})
        if not above:
            break
        free -= above
    assert got == pytest.approx(target)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_takes_epochs_then_a_fraction(docs):
    rows = [(i, "w " * (1 + i % 7), "en", "big" if i < 300 else "small") for i in range(330)]
    rows += [(400, None, None, None), (401, "", None, None), (402, "one", None, None), (None, "two words", "en", "big")]
    for buckets in (1, 16, 4096):
        got = mixing.mix(docs(rows), buckets=buckets).collect()
        assert len(got) == len(rows)
        for source in ("big", "small", None):
            own = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7
            epochs = int(own[0]["target"] // max(1, own[0]["source_size"]))
            assert all(r["taken"] in (r["size"] * epochs, r["size"] * (epochs + 1)) for r in own)
        assert all(r["taken"] <= 3 * r["size"] for r in got)
        again = mixing.mix(docs(rows), buckets=buckets).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_weights_move_the_order_and_labels_may_repeat(spark, docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert {r["doc_id"]: r["weight"] for r in mixing.label_weights(labels).collect()} == {1: 2.0, 2: 0.5}
    rows = docs([(i, "a b c", "en", s) for i, s in enumerate(["x", "y"] * 400)])
    good = spark.createDataFrame([(i, 50.0) for i in range(0, 800, 4)], "doc_id long, weight double")
    mixed = mixing.mix(rows, good).filter("source = 'x'").collect()
    share = lambda pick: sum(r["taken"] for r in mixed if pick(r)) / sum(r["size"] for r in mixed if pick(r))
    assert share(lambda r: r["weight"] > 1) > share(lambda r: r["weight"] == 1)


def test_rows_without_id_are_drawn_whatever_their_size(docs):
    """A third of the rows has no id; each size is taken at about the same share."""
    rows = [(None, " ".join(f"w{i}" for i in range(i % 9 + 1)) + f" t{i}", "en", "s") for i in range(900)]
    rows += [(i, "a b c d e", "en", "s") for i in range(900)] + [(i, "x", "en", "other") for i in range(900, 1000)]
    taken = [r for r in mixing.mix(docs(rows), seed="t").collect() if r["source"] == "s" and r["doc_id"] is None]
    shares = {}
    for r in taken:
        shares.setdefault(r["size"], []).append(r["taken"] % (r["size"] * 2) > 0)
    rate = sum(map(sum, shares.values())) / len(taken)
    assert len(shares) == 9 and 0 < rate < 1
    for own in shares.values():
        assert abs(sum(own) / len(own) - rate) <= 3 * (rate * (1 - rate) / len(own)) ** 0.5
    equal = docs([(None, "a b c", "en", "s")] * 400 + [(1, "x", "en", "t")] * 100)
    part = [r["taken"] for r in mixing.mix(equal).collect() if r["source"] == "s"]
    assert len(set(part)) == 2 and sorted(part) == sorted(r["taken"] for r in mixing.mix(equal.repartition(7)).collect() if r["source"] == "s")


def test_pieces_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "PIECE", 10)
    rows = spark.createDataFrame([("a", 1), ("b", 10), ("c", 11), ("d", 35)], "k string, n long")
    got = [(r["k"], r["i"]) for r in skew.repeated(rows, "n", "i").collect()]
    assert sorted(got) == [(k, i) for k, n in (("a", 1), ("b", 10), ("c", 11), ("d", 35)) for i in range(1, n + 1)]


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs([(1, ""), (2, None)])).collect()] == [0, 0]
