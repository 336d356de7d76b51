"""Removal of repeated strings and passages, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import phrases, regions, substrings
from tallyhouse.llm.induced_sorting import repeated_starts
from tallyhouse.llm.queries import QUERIES


def _brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + window] for b in data for k in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _brute_words(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bound", [4, 64, 1 << 20])
def test_induced_sorting_finds_what_repeats(tmp_path, bound):
    rng = np.random.default_rng(bound)
    for trial in range(60):
        text = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 250))).astype(np.uint8)
        text = np.concatenate([text, text[len(text) // 3 :]]) if trial % 2 else text
        length = int(rng.integers(1, 12))
        raw = text.tobytes()
        seen = Counter(raw[k : k + length] for k in range(len(raw) - length + 1))
        marks = repeated_starts(text, length, str(tmp_path), bound)
        for k in range(len(raw) - length + 1):
            assert marks[k] == (seen[raw[k : k + length]] > 1)
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]


def _texts(rng, n):
    alphabet = np.array(list("ab cd"))
    base = ["".join(rng.choice(alphabet, 200)) for _ in range(4)]
    out = []
    for k in range(n):
        parts = [base[rng.integers(4)][int(rng.integers(0, 90)) : int(rng.integers(100, 200))] for _ in range(rng.integers(1, 5))]
        out.append("".join(parts) if k % 7 else None)
    return [*out, out[1], out[2], "", "aaaa" * 60, "é" * 50 + "aaaa" * 30]


def _check_bytes(spark, texts, window, gram):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = substrings.remove_repeated(df, window, gram)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
    assert [rows[k] for k in range(len(texts))] == _brute_bytes(texts, window)


def test_bytes_equal_brute_force(spark):
    _check_bytes(spark, _texts(np.random.default_rng(2), 40), 30, 9)


def test_a_split_anchor_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT_FROM", 2)
    monkeypatch.setattr(substrings, "SPLIT_WINDOWS", 4)
    _check_bytes(spark, _texts(np.random.default_rng(3), 40), 30, 9)


def test_every_window_is_in_one_region_of_a_stretch(monkeypatch):
    monkeypatch.setattr(regions, "STRETCH", 25)
    texts = _texts(np.random.default_rng(4), 30)
    hashes = [substrings._BYTES[np.frombuffer((t or "").encode(), np.uint8)] for t in texts]
    found = [list(regions.find_all(h, h, np.zeros(len(h), np.int32), 30, 9)) for h in hashes]
    assert sum(int(part[2].sum()) for parts in found for part in parts) == sum(max(0, len(h) - 29) for h in hashes)


def test_words_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join((t or "").replace(" ", "\n").replace("", " ").split(" ")) for t in _texts(rng, 40)]
    texts[3] = None
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: tuple(r)[1:] for r in phrases.remove_repeated(df, 12, 4).collect()}
    assert [rows[k] for k in range(len(texts))] == _brute_words(texts, 12)


def test_automata_mark_rows_that_passages_were_not_taken_from():
    automata = phrases._Automata(3)
    automata.add(b"a b c d e f g", 0b10011)
    rows = [b"x a b c d y e f g".split(), b"a b c".split(), b"c d e".split(), [], b"b c d e f g".split()]
    marked = ["".join("01"[int(g)] for g in gone) for gone in automata.located(rows)]
    assert marked == ["011110111", "000", "000", "", "000111"]


@pytest.fixture
def spread(spark):
    """Every exchange keeps its partitions, so that identical rows meet other texts in tasks of their own."""
    given = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    old = {key: spark.conf.get(key) for key in given}
    for key, value in given.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("copies", [2, 3, 5])
def test_rows_that_repeat_with_the_least_id(spread, copies):
    words = [f"w{k}" for k in range(70)]
    whole, part = " ".join(words[:45]), " ".join(["x", *words[3:62], "y"])
    rows = [(1, whole)] * copies + [(5, part), (0, "z " + whole), (9, None), (1, "other words")]
    docs = spread.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted(tuple(r)[1:] for r in phrases.remove_repeated(docs).collect())
    assert got == sorted(_brute_words([t for _, t in rows], 35))
    got = sorted(tuple(r)[1:5] for r in substrings.remove_repeated(docs, 60, 20).collect())
    assert got == sorted(_brute_bytes([t for _, t in rows], 60))


def test_bounds_that_numbers_cannot_hold_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="mask"):
        phrases.remove_repeated(docs, 80, 4)
    with pytest.raises(ValueError, match="16"):
        repeated_starts(np.zeros(3, np.uint8), 1 << 15, str(tmp_path))


def test_blocks_and_automata_of_a_small_size(spark, monkeypatch):
    monkeypatch.setattr(phrases, "AUTOMATON_WORDS", 60)
    monkeypatch.setattr(phrases, "HELD_BYTES", 100)
    monkeypatch.setattr(phrases, "BLOCK_REGIONS", 9)
    text = " ".join(f"w{k}" for k in range(400))
    texts = [text, "start " + text, text[:900] + " end", "w1 w2 w3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in phrases.remove_repeated(df).collect()}
    assert [rows[k] for k in range(4)] == _brute_words(texts, 35)


def test_whole_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip([r["doc_id"] for r in docs], _brute_bytes([r["text"] for r in docs], 400)))
    rows = QUERIES["op1_substrings"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == expected


def test_odd_rows(spark, odd_docs, no_docs):
    texts = [r["text"] for r in odd_docs.select("text").collect()]
    rows = substrings.remove_repeated(odd_docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == sorted(_brute_bytes(texts, 400))
    rows = phrases.remove_repeated(odd_docs).collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(_brute_words(texts, 35))
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert substrings.remove_repeated(no_docs).count() == 0 and phrases.remove_repeated(no_docs).count() == 0
