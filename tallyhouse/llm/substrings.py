"""Removal of repeated byte strings by sorting suffixes in shards, with external induced sorting.

1. Windows of ``window`` bytes are put into regions by anchors (see ``regions``): equal windows have equal anchors, so
   each shard of anchors can be judged alone.
2. Regions of one content that stands several times are repeated as a whole. Where the regions of an anchor differ, one of
   each content goes to the anchor's shard.
3. A shard's regions are sorted by suffix (``induced_sorting``); a place is repeated if its suffix shares ``window`` bytes
   with a neighbour in the order.
4. What was found goes back to all documents with those regions, where the bytes are removed.

An anchor with very many different regions is split further by the bytes that neighbouring windows have in common, so
that it does not make one shard; what a shard cannot hold goes to files in the shared folder.

Defined cases: null texts are empty; texts shorter than a window lose nothing; repeated rows are copies of each other and
lose all their windows; texts of any length are judged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import regions
from tallyhouse.llm.induced_sorting import SEPARATOR, repeated_starts
from tallyhouse.llm.shipping import ship
from tallyhouse.llm.words import mix, row_blocks, text_bytes
from tallyhouse.session import scratch_path, stage

WINDOW = 400
GRAM = 128

#: Bytes of text that are put into regions at a time (some 150 bytes of memory each).
SCAN_BYTES = 512 << 10

#: Bytes that one shard sorts at a time; more only if one anchor needs it.
SHARD_BYTES = 1 << 20

#: Bytes of all shards of a task.
TASK_BYTES = 16 << 20

#: Different regions of an anchor from which on it is split, and windows of one of its parts.
SPLIT_FROM = 2048
SPLIT_WINDOWS = 32

_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_OTHER = mix(_BYTES)


def _scan(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, hashes = (batch.column(c).to_numpy() for c in (0, 1))
            for a, b in row_blocks(offsets, SCAN_BYTES):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                rows = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(bounds))
                for found in regions.find_all(_BYTES[part], _OTHER[part], rows, window, gram):
                    yield regions.region_batch(ids[a:b], hashes[a:b], found[1] - bounds[found[0]], found)

    return scan


PIECE_SCHEMA = "shard long, anchor long, c1 long, c2 long, place int, n int, piece binary"


def _pieces(window: int):
    """The bytes of each listed region; those of split anchors in parts whose windows share most of their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            rows, size = [], 0
            for k in range(batch.num_rows):
                data = regions.unpacked(columns["z"][k].as_py(), columns["size"][k].as_py())
                for r in columns["listed"][k].as_py():
                    start, n = r["place"], r["n"]
                    if not r["split"]:
                        parts = [(0, n, r["anchor"])]
                    else:
                        parts = []
                        # windows are dealt by their place before the anchor, alike in all regions
                        first = 0
                        while first < n:
                            klass = (r["lead"] - first) // SPLIT_WINDOWS
                            least, most = klass * SPLIT_WINDOWS, (klass + 1) * SPLIT_WINDOWS - 1
                            end = min(n, r["lead"] - least + 1)
                            core = data[start + r["lead"] - least : start + r["lead"] - most + window]
                            key = hashlib.blake2b(core, digest_size=8, salt=klass.to_bytes(4, "little", signed=True))
                            key = int.from_bytes(key.digest(), "little", signed=True) ^ r["anchor"]
                            parts.append((first, end - first, key))
                            first = end
                    for first, count, shard in parts:
                        piece = data[start + first : start + first + count + window - 1]
                        rows.append((shard, r["anchor"], r["c1"], r["c2"], first, count, piece))
                        size += len(piece)
                if size >= SHARD_BYTES:
                    yield _table(rows)
                    rows, size = [], 0
            yield _table(rows)

    return cut


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


RUN_SCHEMA = "anchor long, c1 long, c2 long, first int, count int"


def _sort_shards(window: int, folder: str):
    """Runs of repeated windows of each region; pieces come sorted by shard, and a shard is never cut."""

    def judge(pieces: list[tuple]) -> pa.RecordBatch:
        separator = bytes([SEPARATOR])
        text = np.frombuffer(separator.join(p[5] for p in pieces) + separator, np.uint8)
        marks = repeated_starts(text, window, folder)
        runs, at = [], 0
        for anchor, c1, c2, place, n, piece in pieces:
            edge = np.diff(np.concatenate([[0], marks[at : at + n].view(np.int8), [0]]))
            for first, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                runs.append((anchor, c1, c2, place + first, end - first))
            at += len(piece) + 1
        columns = list(zip(*runs)) or [()] * 5
        kinds = [*[pa.int64()] * 3, pa.int32(), pa.int32()]
        names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size, last = [], 0, None
        for batch in batches:
            columns = batch.columns
            for k in range(batch.num_rows):
                shard = columns[0][k].as_py()
                if size >= SHARD_BYTES and shard != last:
                    yield judge(pieces)
                    pieces, size = [], 0
                pieces.append(tuple(c[k].as_py() for c in columns[1:]))
                size += len(pieces[-1][-1])
                last = shard
        if pieces:
            yield judge(pieces)

    return sort


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of windows that stand elsewhere too: ``keyed`` row, first place, number."""
    spark = docs.sparkSession
    found = regions.recurring(docs, _scan(window, gram))
    chosen = stage(regions.representatives(found), "representatives")
    many = chosen.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= SPLIT_FROM)
    # read back, so that the join's own exchange lets anchors of many regions be split
    many = stage(many.select("anchor", F.lit(True).alias("many")), "many")
    marked = chosen.join(many, "anchor", "left")
    entry = F.struct("anchor", "c1", "c2", "place", "n", "lead", F.col("many").isNotNull().alias("split"))
    listed = marked.groupBy(*regions.KEY).agg(F.collect_list(entry).alias("listed"))
    pieces = regions.with_texts(docs, listed).select("z", "size", "listed").mapInArrow(_pieces(window), PIECE_SCHEMA)

    total = chosen.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0)).alias("b")).first()["b"]
    shards = pieces.repartition(max(1, -(-total // TASK_BYTES)), "shard").sortWithinPartitions("shard")
    runs = shards.mapInArrow(_sort_shards(window, scratch_path(spark, "induced")), RUN_SCHEMA)
    copied = chosen.filter(F.col("copies") > 1).select(
        "anchor", "c1", "c2", F.lit(0).alias("first"), F.col("n").alias("count")
    )
    in_regions = stage(runs.unionAll(copied), "runs")
    mixed = found.filter("mixed").join(in_regions, ["anchor", "c1", "c2"])
    settled = found.filter(~F.col("mixed")).withColumns({"first": F.lit(0), "count": F.col("n")})
    run = [*regions.KEY, (F.col("place") + F.col("first")).alias("place"), F.col("count").cast("long").alias("count")]
    return mixed.select(*run).unionAll(settled.select(*run))


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(window: int, with_kept: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            rows = []
            for k in range(batch.num_rows):
                doc_id, size = columns["doc_id"][k].as_py(), columns["size"][k].as_py()
                data = regions.unpacked(columns["z"][k].as_py(), size)
                spans: list[list[int]] = []
                listed = columns["listed"][k].as_py() or []
                for run in sorted((r["place"], r["place"] + r["count"] + window - 1) for r in listed):
                    if spans and run[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], run[1])
                    else:
                        spans.append(list(run))
                edges = [0, *(x for span in spans for x in span), size]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                digest = hashlib.sha256(kept).hexdigest()
                row = (None if doc_id == regions.NO_ID else doc_id, size, size - len(kept), len(spans), digest)
                rows.append((*row, kept if with_kept else None))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            names = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return remove


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document.

    A byte goes if a string of ``window`` bytes that stands elsewhere too covers it; touching runs are one span.
    """
    ship(docs.sparkSession)
    texts = regions.keyed(docs)
    marked = repeated_windows(texts, window, gram)
    listed = marked.groupBy(*regions.KEY).agg(F.collect_set(F.struct("place", "count")).alias("listed"))
    joined = regions.with_texts(texts, listed, "left").select("doc_id", "z", "size", "listed")
    return joined.mapInArrow(_remove(window, with_kept), RESULT_SCHEMA)
