"""Repeated windows over a whole corpus, found through anchors that depend on content alone.

Every window (of bytes or words) has an anchor: the leftmost of its grams with the smallest hash. The windows of a text
with the same anchor form a region; each window is in one region. Equal windows have equal anchors at equal places, so
only regions with equal anchors are compared. Regions with equal contents are counted and stand for each other; anchors
whose regions all have one content are settled by that, and of the others one region for each content is looked at.

Rows of a text are known by (doc_id, row_hash); identical rows share it and are told apart by their number only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.words import owners, prefix_hash, span_hash
from tallyhouse.session import stage

REGION_SCHEMA = "doc_id long, row_hash long, place long, n int, lead int, anchor long, c1 long, c2 long"
KEY = ["doc_id", "row_hash"]

#: Texts that are compressed before the next ones are taken.
PACKED_ROWS = 500

#: Windows that are put into regions at once.
STRETCH = 2 << 20

#: Given to null ids, so that they can be joined on; they come back as null.
NO_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash and text; null texts are empty."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    row_hash = F.xxhash64(doc_id, text)
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), row_hash.alias("row_hash"), text.alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """``keyed`` rows with the text compressed, for a shuffle of half the size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PACKED_ROWS) for b in batches for at in range(0, b.num_rows, PACKED_ROWS)):
            raw = [text.as_py().encode() for text in batch.column(2)]
            packed = pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())
            sizes = pa.array([len(r) for r in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed, sizes], ["doc_id", "row_hash", "z", "size"])

    return docs.mapInArrow(pack, "doc_id long, row_hash long, z binary, size long")


def unpacked(z: bytes, size: int) -> bytes:
    return pa.decompress(z, size, "zstd", asbytes=True) if size else b""


def find(hashes: np.ndarray, others: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Regions of the windows of ``window`` neighbours that lie within one row.

    ``hashes`` and ``others`` are two independent hashes of each unit (byte or word). Returns, for each region, its row,
    first window, number of windows, units from there to the anchor, anchor, and two hashes of its units.
    """
    if len(hashes) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    first_prefix, other_prefix = prefix_hash(hashes), prefix_hash(others)
    at = np.arange(len(hashes) - gram + 1)
    grams = span_hash(first_prefix, at, at + gram)
    anchor, first, last = owners(grams, window - gram + 1)
    whole = rows[: len(hashes) - window + 1] == rows[window - 1 :]
    before = np.concatenate([[0], np.cumsum(whole)])
    n = before[last] - before[first]
    keep = n > 0
    anchor, n = anchor[keep], n[keep]
    start = np.flatnonzero(whole)[before[first[keep]]]
    end = start + n + window - 1
    content = span_hash(first_prefix, start, end), span_hash(other_prefix, start, end)
    return rows[start], start, n, anchor - start, grams[anchor], *content


def find_all(hashes: np.ndarray, others: np.ndarray, rows: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """``find`` over stretches of windows, so that neither its memory nor its anchors' places have a limit."""
    for at in range(0, len(hashes) - window + 1, STRETCH):
        end = at + STRETCH + window - 1
        row, start, *rest = find(hashes[at:end], others[at:end], rows[at:end], window, gram)
        yield row, start + at, *rest


def region_batch(ids: np.ndarray, hashes: np.ndarray, place: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """``found`` regions as rows, for rows with these ids and row hashes, at ``place`` within their rows."""
    row, _, n, lead, *marks = found
    columns = [ids[row], hashes[row], place, n.astype(np.int32), lead.astype(np.int32)]
    arrays = [pa.array(c) for c in [*columns, *(m.view(np.int64) for m in marks)]]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in REGION_SCHEMA.split(", ")])


def recurring(docs: DataFrame, scan: Callable) -> DataFrame:
    """Regions whose anchor stands at least twice, written once; ``mixed`` where its regions differ.

    ``scan`` maps batches of ``keyed`` rows to ``REGION_SCHEMA``. The first count travels as two numbers an anchor; the
    second scan is cheaper than keeping all regions.
    """
    regions = docs.mapInArrow(scan, REGION_SCHEMA)
    several = regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1).select("anchor")
    # read back, so that the join's own exchange lets hot anchors be split
    several = stage(several, "anchors")
    found = stage(regions.join(several, "anchor"), "regions")
    kinds = found.groupBy("anchor").agg(
        ((F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))).alias("mixed")
    )
    return stage(found.join(stage(kinds, "kinds"), "anchor"), "regions")


def representatives(found: DataFrame) -> DataFrame:
    """One region for each content of the anchors with several: where it stands, and how often its content does."""
    return (
        found.filter("mixed")
        .groupBy("anchor", "c1", "c2")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "place", "n", "lead")).alias("at"))
        .select("anchor", "c1", "c2", "copies", "at.*")
    )


def with_texts(docs: DataFrame, listed: DataFrame, how: str = "inner") -> DataFrame:
    """Compressed texts joined to the rows of ``listed``, one row a text there."""
    return packed(docs).join(listed, KEY, how)
