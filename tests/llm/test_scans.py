import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, licenses

TWELVE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def _leaks(text, items, window=10):
    w, hit, found = brute.words(text), set(), set()
    for item_id, item in items:
        v = brute.words(item)
        runs = [v[i : i + window] for i in range(len(v) - window + 1)] if len(v) >= window else [v] if v else []
        for run in runs:
            for i in range(len(w) - len(run) + 1):
                if w[i : i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_windows_against_brute_force(docs, items):
    bench = [(1, TWELVE), (2, TWELVE.upper() + "!"), (3, "Only four words here"), (4, "x"), (5, None), (6, "..."), (None, "y z")]
    rows = [
        (1, f"before {TWELVE} after {TWELVE}"), (2, TWELVE.replace(" ", ", ")[:-8]), (3, "only  FOUR-words here x"),
        (4, None), (5, ""), (6, "clean text é"), (7, "x " * 30), (8, "a " * 50_000 + TWELVE), (9, "y z"),
        (None, TWELVE), (10, "x"), (10, "no"), (10, "no"),
    ]
    got = decontaminate.contamination(docs(rows), items(bench)).collect()
    key = lambda r: tuple(map(str, r))
    have = sorted((key((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in got))
    assert have == sorted(key((d, *_leaks(t, bench))) for d, t in rows)


def test_more_windows_than_may_be_broadcast(docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    got = decontaminate.contamination(docs([(1, TWELVE), (2, "no")]), items([(1, TWELVE)])).collect()
    assert {r["doc_id"]: r["n_hit"] for r in got} == {1: 12, 2: 0}


def _nodes(node):
    yield node
    for i in range(node.children().size()):
        yield from _nodes(node.children().apply(i))


def test_shuffled_windows_carry_no_text(spark, docs, items, monkeypatch):
    """A row per window with all words of its document would grow with the square of the text."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        long = " ".join(f"w{i}" for i in range(200_000))
        bench = [(1, TWELVE), (2, "only four words here"), (3, "w100 w101 w102"), (None, "y z")]
        rows = [(1, f"{long} {TWELVE}"), (2, long), (2, long), (3, "no"), (None, f"y z {TWELVE}"), (3, "only four words here"), (4, None)]
        found = decontaminate.hits(docs(rows), items(bench))
        joins = [n for n in _nodes(found._jdf.queryExecution().sparkPlan()) if "Join" in n.nodeName()]
        semi = [n for n in joins if n.joinType().toString() == "LeftSemi"]
        assert len(semi) == 1
        output = semi[0].children().apply(0).output()
        assert not [a for a in (output.apply(i) for i in range(output.size())) if a.dataType().typeName() in ("array", "string")]
        got = decontaminate.contamination(docs(rows), items(bench)).collect()
        key = lambda r: tuple(map(str, r))
        have = sorted(key((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"])) for r in got)
        want = [(1, 200_012, 15, 2), (2, 200_000, 3, 1), (2, 200_000, 3, 1), (3, 1, 0, 0), (None, 14, 14, 1), (3, 4, 4, 1), (4, 0, 0, 0)]
        assert have == sorted(map(key, want))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_items_and_no_documents(docs, items):
    got = decontaminate.contamination(docs([(1, TWELVE), (2, None)]), items([])).collect()
    assert [r["contaminated"] for r in got] == [False, False]
    assert decontaminate.contamination(docs([]), items([(1, TWELVE)])).count() == 0


def test_documents_and_spans_are_removed(docs, items):
    rows = docs([(1, f"Ünd, {TWELVE}! Ènd."), (2, "clean"), (None, None), (3, "clean"), (3, "clean")])
    rows = rows.withColumns({"gram": F.lit(1), "_spans": F.lit("s"), "_row_id": F.lit(2)})
    bench = items([(1, TWELVE)])
    left = decontaminate.clean_documents(rows, bench)
    assert left.columns == rows.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "3", "3", "None"]
    spans = decontaminate.without_spans(rows, bench)
    assert spans.columns == rows.columns
    text = {str(r["doc_id"]): r["text"] for r in spans.collect()}
    assert text["1"] == "Ünd, " + " " * 11 + "! Ènd." and text["2"] == "clean" and text["None"] is None


def test_base_phrases(docs):
    rows = [
        (1, "Released under the MIT License."), (2, "mit-license MIT LICENSE general public license"), (3, "general license"),
        (4, None), (5, ""), (6, "license mit license"), (6, "license mit license"), (7, "apache\nlicense " + "w " * 60_000 + "apache license"),
        (None, "apache license"),
    ]
    got = {}
    for r in licenses.scan(docs(rows)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:6])
    assert got == {
        1: [(5, 1, 3, 3, "mit")], 2: [(7, 3, 0, 4, "gpl,mit")], 3: [(2, 0, None, None, "")], 4: [(0, 0, None, None, "")],
        5: [(0, 0, None, None, "")], 6: [(3, 1, 1, 1, "mit")] * 2, 7: [(60_004, 2, 0, 60_002, "apache")],
        None: [(2, 1, 0, 0, "apache")],
    }
    assert licenses.scan(docs([])).count() == 0


def _best_windows(text, threshold=0.9, block=64):
    """label -> largest share of a notice in any window of the text."""
    w, best = brute.words(text), {}
    for label, notice in licenses.NOTICES:
        words = set(notice.split())
        for start in range(len(w)):
            share = len(words & set(w[start : start + block])) / len(words)
            if share >= threshold - 1e-9:
                best[label] = max(best.get(label, 0), share)
    return best


def test_windows_against_all_sets(docs):
    notices = [n.split() for _, n in licenses.NOTICES]
    rows = []
    for i, (_, notice) in enumerate(licenses.NOTICES):
        w = notice.split()
        for cut in range(3):
            rows.append((10 * i + cut, "pad " * (7 * i) + " ".join(w[cut:]).title() + " and\nmore" * (5 * cut + 1)))
        # Spread over up to a window and one word more.
        for wide in (60, 64, 65):
            rows.append((10 * i + wide % 7 + 3, "pad " * i + " ".join(w[:3]) + " x" * (wide - len(w)) + " " + " ".join(w[3:])))
    rows.append((999, " ".join(w for n in notices for w in n) * 3))
    rows.append((998, "the terms of the software " * 200))
    got = {}
    for r in licenses.notice_windows(docs(rows)).collect():
        own = got.setdefault(r["_row_id"], {})
        own[r["label"]] = max(own.get(r["label"], 0), r["containment"])
    want = {doc_id: best for doc_id, text in rows if (best := _best_windows(text))}
    assert got == want and len(want) > 12


def test_labels_do_not_depend_on_what_stands_before(docs):
    notice = licenses.NOTICES[5][1].split()
    spread = " ".join(f"{w} x x x x" for w in notice[:-1]) + f" {notice[-1]}"
    assert len(spread.split()) <= 64
    rows = [(n, "pad " * n + spread) for n in range(130)]
    assert {r["labels"] for r in licenses.scan(docs(rows)).collect()} == {"lgpl"}
