"""Decontamination and top-k search, against brute force."""

import re

import numpy as np
import pytest

from tallyhouse.llm import decontamination, topk_search


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(texts, items, window=13):
    windows = {}
    for item, text in items:
        words = _words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    out = []
    for text in texts:
        words, hit, held = _words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                found = windows.get(tuple(words[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    held |= found
        out.append((len(words), len(hit), sorted(held), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize("pass_words", [1, 1 << 19])
def test_decontamination_equals_brute_force(spark, monkeypatch, pass_words):
    monkeypatch.setattr(decontamination, "PASS_WORDS", pass_words)
    monkeypatch.setattr(decontamination, "RECORD_BYTES", 700)
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "été"], n))
    items = [(k, text(int(rng.integers(1, 20)))) for k in range(8)] + [(8, None), (9, "?!"), (10, "a"), (11, "zz y")]
    texts = [text(int(n)) for n in rng.integers(0, 80, 30)] + [None, "", items[0][1], items[1][1], "a", "x zz", "y q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.decontaminate(df, bench).collect()}
    got = [(rows[k]["n_words"], rows[k]["n_hit"], list(dict.fromkeys(rows[k]["items"])), rows[k]["contaminated"]) for k in range(len(texts))]
    assert got == _brute(texts, items)


def test_proximity_matches_allow_words_between(spark):
    item = " ".join(f"q{k}" for k in range(13))
    texts = ["x " + item, item.replace("q6", "q6 extra"), item.replace("q6", "other"), "q0 q1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontamination.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"), slack=2)
    rows = {r["doc_id"]: (r["items"], r["near_items"]) for r in found.collect()}
    assert rows == {0: (["1"], ["1"]), 1: ([], ["1"]), 2: ([], []), 3: ([], [])}


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(100, 160))), (None, "no id here")], "item_id long, text string")
    rows = decontamination.decontaminate(odd_docs, bench).collect()
    assert len(rows) == 13 and sum(r["contaminated"] for r in rows) == 6
    kept = decontamination.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    assert decontamination.drop_contaminated(no_docs, bench).count() == 0
    assert decontamination.drop_contaminated(odd_docs, bench.limit(0)).count() == 13


def _scores(vectors, k):
    out = set()
    for q, (qid, x) in enumerate(vectors):
        if qid % 20 == 0:
            others = [(-int(np.dot(x, y)), i) for i, y in vectors if i != qid and len(y) == len(x)]
            out |= {(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(others)[:k])}
    return out


@pytest.mark.parametrize("big", [1, 10**6, 10**8])
def test_top_k_equals_brute_force(spark, big):
    rng = np.random.default_rng(4)
    vectors = [(k, rng.integers(-9, 9, 6).astype(object) * big) for k in range(300)]
    vectors[40:90] = [(k, vectors[7][1]) for k in range(40, 90)]
    vectors += [(400, np.array([1, 2], object)), (401, np.array([3, 1], object))]
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in vectors], "vec_id long, x array<double>")
    found = topk_search.top_k(df, df.filter("vec_id % 20 = 0"), 5)
    assert {tuple(r) for r in found.collect()} == _scores(vectors, 5)


def test_top_k_of_repeated_query_ids(spark):
    rng = np.random.default_rng(5)
    vectors = [(k, rng.integers(-9, 9, 6)) for k in range(200)]
    vectors += [(20, vectors[20][1])] * 3 + [(40, rng.integers(-9, 9, 6)) for _ in range(2)] + [(60, vectors[60][1])] * 30
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in vectors], "vec_id long, x array<double>").repartition(3)
    expected = []
    for qid, x in vectors:
        if qid % 20 == 0:
            others = sorted((-int(np.dot(x, y)), i) for i, y in vectors if i != qid)
            expected += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(others[:20])]
    found = topk_search.top_k(df, df.filter("vec_id % 20 = 0"), 20)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_vectors_that_take_no_part(spark):
    data = [(0, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = topk_search.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk_search.top_k(df, df.filter("vec_id % 20 = 0")).collect()] == [(0, 1, 5, 64 * 32 * 2)]
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_reading_stops_when_outsiders_cannot_qualify(spark):
    rng = np.random.default_rng(8)
    vectors = [(k, rng.integers(-40, 40, 8)) for k in range(2000)]
    # in each direction, few vectors stand far out
    vectors = [(k, x * 30 if k % 100 == 0 else x) for k, x in vectors]
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in vectors], "vec_id long, x array<double>").repartition(2)
    found = topk_search.top_k(df, df.filter("vec_id % 20 = 0"), 3, share_read=True).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == _scores(vectors, 3)
    assert all(0 < r["share_read"] < 0.75 for r in found)


def test_scores_beyond_a_long_raise(spark):
    df = topk_search.quantised(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="leave"):
        topk_search.top_k(df, df.filter("vec_id % 20 = 0")).collect()
