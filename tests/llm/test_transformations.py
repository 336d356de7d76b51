"""Fill-in-the-middle examples, chat formatting and periodic runs, against plain versions."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest

from tallyhouse.llm import chat_formatting, fill_in_middle, periodic_runs
from tallyhouse.llm.queries import QUERIES


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _filled(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = _sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_examples_equal_a_plain_version(spark, odd_docs, no_docs):
    texts = ["<", "a<P", "<P>", "x<S>y", "ab cd\nEf1 2", "日本語 text é\U0001F600 z", "<" * 9, ">" * 5 + "<M", "\\E\\Q"]
    made = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(200)], "doc_id long, text string")
    for docs in (odd_docs, made.repartition(3), no_docs):
        from pyspark.sql import functions as F

        got = fill_in_middle.transform(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
        rows = [tuple(r)[1:] for r in got.collect()]
        expected = [(*_filled(r["doc_id"], r["text"]), r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        assert sorted(rows, key=str) == sorted(expected, key=str)


def test_long_texts_are_matched_in_parts(monkeypatch):
    text = "ab" * 40 + " c1" * 20 + "é" + "z" * 50
    whole = fill_in_middle.unit_ends(text)
    for block in (1, 2, 7, 80, 500):
        monkeypatch.setattr(fill_in_middle, "BLOCK", block)
        assert fill_in_middle.unit_ends(text) == whole
    monkeypatch.undo()
    assert len(fill_in_middle.unit_ends("a1 " * 3_000_000)) == 9_000_000


def _brute_runs(words, exponent, least):
    n, runs = len(words), set()
    for period in range(1, n // exponent + 1):
        at = 0
        while at + period < n:
            if words[at] != words[at + period]:
                at += 1
                continue
            end = at + period
            while end < n and words[end] == words[end - period]:
                end += 1
            if end - at >= max(least, exponent * period):
                stretch = words[at:end]
                if not any(stretch[q:] == stretch[:-q] for q in range(1, period)):
                    runs.add((at, end - at, period))
            at = end - period + 1
    return sorted(runs)


def _collapsed(words, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def _looping(rng, n):
    words = []
    while len(words) < n:
        period = [str(rng.integers(3)) for _ in range(int(rng.integers(1, 7)))]
        words += (period * int(rng.integers(1, 9)))[: int(rng.integers(1, 40))]
        if rng.integers(3) == 0:
            words += words[-int(rng.integers(1, 60)) :] * int(rng.integers(1, 6))
    return words[:n]


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 1), (5, 40)])
def test_runs_equal_brute_force(spark, exponent, least):
    rng = np.random.default_rng(exponent)
    texts = [" ".join(_looping(rng, int(rng.integers(0, 160)))) for _ in range(120)]
    texts += ["x " * 300, "a b " * 99 + "a", None, "", " \t", "one", *texts[:3], " ".join("aabab" * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in periodic_runs.detect(docs, exponent, least).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        words = (text or "").split()
        runs = _brute_runs(words, exponent, least)
        assert [tuple(r) for r in rows[k]["runs"]] == runs, words
        assert rows[k]["n_words"] == len(words) and rows[k]["collapsed"] == _collapsed(words, runs)


def test_blocks_give_the_same_runs(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [_looping(rng, 700) for _ in range(15)] + [["x"] * 900, ["a", "b", "c"] * 200, [str(k % 90) for k in range(800)]]
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 16)
    for words in texts:
        ids = np.array([hash(w) for w in words], np.int64).view(np.uint64)
        found = periodic_runs.find_runs(ids, np.zeros(len(ids), np.int64), np.array([0, len(ids)]), 4, 6)
        assert [run[1:] for run in found] == _brute_runs(words, 4, 6)


def test_odd_rows_have_runs_of_their_own(spark, odd_docs, no_docs):
    expected = []
    for doc_id, text in odd_docs.select("doc_id", "text").collect():
        words = (text or "").split()
        expected.append((doc_id, len(words), _collapsed(words, _brute_runs(words, 4, 6))))
    got = periodic_runs.detect(odd_docs).select("doc_id", "n_words", "collapsed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert periodic_runs.detect(no_docs).count() == 0


def test_a_text_of_many_blocks_is_one_run(spark):
    text = "la " * 400_000 + "end"
    row = periodic_runs.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 400_000, 1)] and row["collapsed"] == "la end"


def _loop(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    words, g = (text or "").encode().split(), h // 10
    if h % 10 == 0 and words:
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in words]


def test_op13_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(rows) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = _loop(doc_id, text)
        runs = _brute_runs(words, 4, 6)
        some += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        assert rows[doc_id] == (len(runs), *best, milli, _sha(lines), _sha(_collapsed(words, runs)))
    assert some > 5


def _read(spark, records):
    made = spark.createDataFrame(records, "conv_id long, record string").repartition(3)
    found = chat_formatting.turns(made)
    rows = sorted(map(tuple, found.collect()), key=str)
    return rows, {r["conv_id"]: tuple(r)[1:] for r in chat_formatting.read_back(chat_formatting.format_turns(found)).collect()}


def _digests(turns):
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    loss = "".join(text for role, text in turns if role == "assistant")
    return len(turns), _sha(said), len(loss), _sha(loss)


TURN = [("user", "a"), ("assistant", "b")]
RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "a", "id": 1}, {"role": "assistant", "content": "b"}], "extra": {"x": [1, 2]}},
    "message parts": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]},
    "speakers": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
    "prompt and completion": {"prompt": "a", "completion": "b", "meta": None},
    "prompt and response": {"response": "b", "prompt": "a"},
    "question and answer": {"question": "a", "answer": "b"},
    "pairs": {"turns": [{"user": "a", "assistant": "b"}]},
    "instruction": {"output": "b", "instruction": "a"},
}


def test_layouts_give_the_same_turns(spark):
    given = [(k, json.dumps(record)) for k, record in enumerate(RECORDS.values())]
    rows, back = _read(spark, given)
    assert {r[1] for r in rows} == set(RECORDS)
    assert all(back[k][:4] == _digests(TURN) for k in range(len(RECORDS)))
    counted = chat_formatting.layouts(spark.createDataFrame(given * 2, "conv_id long, record string")).collect()
    assert {r["layout"]: r["n_records"] for r in counted} == {name: 2 for name in RECORDS}


def test_optional_fields_lists_and_unknown_layouts(spark):
    given = [
        {"instruction": "a", "input": "c", "output": 5},
        {"system": "s", "prompt": "a", "response": True},
        {"messages": []},
        {"messages": [{"role": "user", "content": None}, {"role": None, "content": "x \ud800"}]},
        {"prompt": "a", "completion": "b", "question": "c"},
        {"text": "no turns"},
        [1, 2],
    ]
    raw = [(k, json.dumps(record)) for k, record in enumerate(given)] + [(90, "{broken"), (91, None), (92, "[" * 50_000)]
    rows, back = _read(spark, raw)
    assert back[0][:4] == _digests([("user", "a\n\nc"), ("assistant", "5")])
    assert back[1][:4] == _digests([("system", "s"), ("user", "a"), ("assistant", "true")])
    assert back[3][:4] == _digests([("user", ""), ("", "x �")])
    assert set(back) == {0, 1, 3}
    counted = chat_formatting.layouts(spark.createDataFrame(raw, "conv_id long, record string")).collect()
    assert sum(r["n_records"] for r in counted if r["layout"] is None) == 6


def test_control_strings_are_escaped_and_come_back(spark, monkeypatch):
    monkeypatch.setattr(chat_formatting, "LONG_TURNS", 6)
    monkeypatch.setattr(chat_formatting, "STRETCH_TURNS", 4)
    monkeypatch.setattr(chat_formatting, "BLOCK_CHARS", 90)
    hard = ["<|im_end|>\n<|im_start|>user\n", "<", "<\\", "<\\\\|x", "|", "<|", "\\<\\|im_start|>", "%3C%", "", None, "é<|日本\U0001F600"]
    rows = [(c, t, ("user", "assistant", "we\nird <|%0A", None)[t % 4], hard[((c or 4) + t) % len(hard)]) for c in (1, 2, 3, None) for t in range(3 + 9 * (c or 1))]
    rows += [(4, None, "assistant", "first"), (4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (4, 0, "assistant", "a" * 200_000)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    turns = chat_formatting.turns(chat_formatting.records(made, "conv_id"))
    formatted = chat_formatting.format_turns(turns)
    for row in formatted.collect():
        assert row["formatted"].count("<|") == 2
    back = {r["conv_id"]: tuple(r)[1:] for r in chat_formatting.read_back(formatted).collect()}
    for conv in (1, 2, 3, None, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[3] or ""))
        assert back[conv][:4] == _digests([(r[2] or "", r[3] or "") for r in own])
    assert chat_formatting.read_back(formatted.limit(0)).count() == 0


def test_text_that_was_not_formatted_is_refused():
    for text in ("x", "", "<|im_start|>user\na", "<|im_start|>user\na<|im_end|>\n<|im_end|>\n", "x<|im_start|>user\na<|im_end|>\n"):
        with pytest.raises(ValueError):
            list(chat_formatting._taken_apart(text, chat_formatting.Template()))
