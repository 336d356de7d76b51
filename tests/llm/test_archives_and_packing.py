"""WARC round trips, packing, and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import packing, warc
from tallyhouse.llm.packing import Limits, Packer, Piece
from tallyhouse.llm.queries import tokenizer_path
from tallyhouse.llm.tokens import Encoder, encoder
from tallyhouse.session import scratch_path


def test_archives_give_back_the_pages(spark):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 200
    pages = [(1, "http://a/x y", big), (2, None, big), (3, "http://b/\n", big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (7, "u", "small"), (None, "u", big), (8, "u", "x" * 10**6)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    index = warc.write_archives(warc.mark_revisits(df), scratch_path(spark, "warc"))
    assert index.count() == len(pages)
    rows = warc.read_records(index).collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows)
    expected = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        revisit = html == big and page_id != 3
        expected.append((str(page_id), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", "3" if revisit else "None"))
    assert got == sorted(expected)
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    few = warc.read_records(index.filter("page_id = 6"))
    assert [(r["page_id"], bytes(r["payload"])) for r in few.collect()] == [(6, b"small")]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_neighbouring_ranges_are_read_together():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES, 5), ("a", 26 + 3 * warc.GAP_BYTES, 5), ("b", 0, 5)]
    assert [len(g) for g in warc._ranges(rows)] == [3, 1, 1]


def test_ids_are_the_tokenizers():
    encode = Encoder(tokenizer_path())
    texts = ["It's I'LL 'Sx don't 12 3½ ²x ß ſt Ǆ ñÑ a­b", "日本 テスト", "éx", "Σας", "İx", "a\x1cb c d", "", "x" * 99, "<|endoftext|> !!!a...b'''s", "ŉ ǰ ÀÉ'S"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def _check_pieces(rows, docs):
    encode = Encoder(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in docs:
        ids = encode(text or "") + np.array([1], "<u4").tobytes()
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids) // 4)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, sum(r["length"] for r in rows))


def test_pieces_hold_every_id_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs.repartition(3), tokenizer_path()).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _check_pieces(rows, texts) < 0.01


def test_packing_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, tokenizer_path()).collect()
    assert sum(r["start"] == 0 for r in rows) == 13
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_all_limits_hold_at_once():
    rng = np.random.default_rng(3)
    limits = Limits(tokens=64, segments=4, loss_tokens=30)
    packer, done, total = Packer(limits), [], 0
    for k in range(9000):
        n = int(rng.integers(1, 100))
        done += packer.add(Piece(k, 0, bytes(4 * n), int(rng.integers(0, n + 1))))
        total += n
    done += packer.finish()
    assert sum(p.tokens for s in done for p in s) == total
    for s in done:
        assert sum(p.tokens for p in s) <= 64 and len(s) <= 4 and sum(p.loss for p in s) <= 30


def _check_conversations(rows, turns, limits, loss_roles=("assistant",)):
    """Every id and mark once and in order, whatever task packed it; all limits; how many sequences meet each."""
    encode = encoder(tokenizer_path())
    wanted, sequences = {}, {}
    for conv, turn, role, text in turns:
        head, body = encode((role or "") + "\n"), encode(text or "") + np.array([1], "<u4").tobytes()
        ids, mask = wanted.setdefault((conv, turn), (b"", b""))
        wanted[conv, turn] = ids + head + body, mask + bytes(len(head) // 4) + bytes([role in loss_roles]) * (len(body) // 4)
    given = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        given.setdefault(r["conv_id"], []).append(r)
        assert r["length"] == len(r["loss_mask"]) == len(r["ids"]) // 4 and r["loss_tokens"] == sum(r["loss_mask"])
    for conv in {c for c, _ in wanted}:
        order = sorted((k for k in wanted if k[0] == conv), key=lambda k: (k[1] is not None, k[1] or 0))
        base, ids, mask = {}, b"", b""
        for k in order:
            base[k[1]] = len(mask)
            ids, mask = ids + wanted[k][0], mask + wanted[k][1]
        at = 0
        for r in sorted(given[conv], key=lambda r: base[r["turn"]] + r["start"]):
            assert base[r["turn"]] + r["start"] == at
            assert r["ids"] == ids[4 * at : 4 * (at + r["length"])] and r["loss_mask"] == mask[at : at + r["length"]]
            at += r["length"]
        assert at == len(mask)
    bound = [0, 0, 0]
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        used = at, len(pieces), sum(r["loss_tokens"] for r in pieces)
        assert all(u <= m for u, m in zip(used, (limits.tokens, limits.segments, limits.loss_tokens)))
        bound = [b + (u == m) for b, u, m in zip(bound, used, (limits.tokens, limits.segments, limits.loss_tokens))]
    return bound


def test_conversations_under_three_limits(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()]
    limits = Limits(tokens=512, segments=2, loss_tokens=200)
    packed = packing.pack_conversations(turns.repartition(5), tokenizer_path(), limits).collect()
    assert all(_check_conversations(packed, rows, limits))
    usual = packing.pack_conversations(turns, tokenizer_path()).collect()
    assert _check_conversations(usual, rows, Limits())[0]


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "yes " * 900), (1, 2, None, ""), (None, 0, "assistant", "no id")]
    rows += [(2, k, "assistant" if k % 2 else "user", f"word {k} " * 20) for k in range(400)] + [(3, None, "user", "no number")]
    schema = "conv_id long, turn int, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumn("ids", F.lit("clash")).repartition(6)
    limits = Limits(tokens=256, segments=3, loss_tokens=90)
    packed = packing.pack_conversations(df, tokenizer_path(), limits).collect()
    met = _check_conversations(packed, rows, limits)
    assert met[0] and met[2]
    assert packing.pack_conversations(df.limit(0), tokenizer_path()).count() == 0
    twice = packing.pack_conversations(df.unionAll(df), tokenizer_path(), limits).collect()
    assert sum(r["length"] for r in twice) == 2 * sum(r["length"] for r in packed)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        kept[name] = after
        if name != "packing":
            assert after.columns == docs.columns
            assert after.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        before = after
    assert kept["secrets"].count() == kept["decontamination"].count()
    assert kept["near_duplicates"].groupBy("text").count().filter("count > 1 and length(text) > 0").isEmpty()
    final = kept["secrets"].select("doc_id", "text").collect()
    assert _check_pieces(kept["packing"].collect(), [tuple(r) for r in final]) < 0.01
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first() == kept["packing"].agg(F.sum("length")).first()
