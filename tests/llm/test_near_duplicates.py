"""Near-duplicate join, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import jaccard_join
from tallyhouse.llm.components import components


def _shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def _brute(texts):
    sets = [_shingles(t) for t in texts]
    n = len(texts)
    similar = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    linked = [[j for j in range(n) if i != j and similar(sets[i], sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in linked[i])]) for i in range(n)]
    return [(label[i], len(linked[i])) for i in range(n)]


def _texts():
    rng = np.random.default_rng(8)
    out = []
    for family in range(6):
        base = [f"f{family}x{k}" for k in rng.integers(0, 500, 120)]
        for _ in range(8):
            words = list(base)
            for place in rng.integers(0, 120, int(rng.integers(0, 5))):
                words[place] = f"new{rng.integers(10**6)}"
            out.append(" ".join(words))
    return [*out, out[0], out[0].upper(), None, "", "", "a b", "A, b!", "a b c"]


@pytest.mark.parametrize("texts_at_once", [3, 500])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, texts_at_once):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", texts_at_once)
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar_classes(df).collect()}
    assert [rows[k] for k in range(len(texts))] == _brute(texts)


def test_prefixes_are_shortened_until_the_target():
    lengths = [jaccard_join.prefix_length(target=t) for t in (0.5, 0.99, 0.9999, 0.9999999)]
    assert lengths == sorted(lengths, reverse=True)
    k = jaccard_join.prefix_length()
    assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= jaccard_join.TARGET_RECALL


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_odd_rows_and_one_of_each_class(spark, odd_docs, no_docs):
    rows = jaccard_join.similar_classes(odd_docs).collect()
    links = Counter((r["doc_id"], r["n_links"]) for r in rows)
    assert links[(5, 4)] == 2 and links[(4, 4)] == 1 and links[(3, 0)] == 1 and links[(1, 0)] == 1
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8] and ids.count(None) == 2
    assert jaccard_join.keep_one(no_docs).count() == 0


def test_repeated_rows_that_stand_for_a_class_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")], "doc_id long, text string")
    assert [r["doc_id"] for r in jaccard_join.keep_one(df).collect()] == [1]


def test_texts_whose_words_alternate_by_parity_are_two(spark):
    """Sums of powers modulo 2^64 cannot tell these apart, whatever the base."""
    parity = [bin(k).count("1") % 2 for k in range(2048)]
    texts = [" ".join("ab"[p] for p in parity), " ".join("ba"[p] for p in parity)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_copies"] for r in jaccard_join.similar_classes(docs).collect()] == [1, 1]


def test_texts_longer_than_a_block(spark):
    long = " ".join(f"word{k}" for k in range(120_000))
    texts = [long, long.replace("word7 ", "other "), long.upper(), "word1 word2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in jaccard_join.similar_classes(docs).collect()}
    assert [rows[k]["class_id"] for k in range(4)] == [0, 0, 0, 3] and [rows[k]["n_links"] for k in range(4)] == [2, 2, 2, 0]
