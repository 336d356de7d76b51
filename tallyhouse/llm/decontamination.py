"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores one record per block of documents: every term's sorted positions, and where each document's
positions lie. ``find_items`` reads the records: the windows of the benchmark are looked up from their rarest term on
(rarest over all documents), the offset-adjusted position lists are intersected term by term, and what remains after the
last term is an exact phrase match. With a slack, each list may also give a position near the exact one: a proximity
match.

Nothing is shuffled but the result's rows: an index record holds whole documents, so matches never cross records. The
benchmark travels to the tasks; its size is checked, and a larger one is sent in parts that each read the index once.

Defined cases: null texts and texts without words have no words, no hits, and are not contaminated; an item of fewer
than ``window`` words is one window; an item without words has none. Repeated rows are judged one by one. Equal items
are separate items. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.shipping import ship
from tallyhouse.llm.words import alphanumeric_words, row_blocks, text_bytes
from tallyhouse.session import scratch_path, stage

WINDOW = 13

#: Words of the benchmark that one pass over the index carries to its tasks (about 60 bytes a word there).
PASS_WORDS = 1 << 19

#: Bytes of text that one index record covers; a longer text has a record alone.
RECORD_BYTES = 1 << 20

INDEX_SCHEMA = "record string, rows binary, n_words binary, terms binary, starts binary, gaps binary, n int, n_terms int"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(scalar: pa.Scalar, kind: type, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(scalar.as_buffer(), size, codec="zstd"), kind) if n else np.zeros(0, kind)


def _arrow_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def build_index(docs: DataFrame, text: str, keep: list[str], path: str) -> DataFrame:
    """Write the positional index of ``docs[text]`` to ``path`` and return it.

    A record holds the ``keep`` columns of its documents, their word counts, the distinct terms in order, where each
    term's list starts, and the lists as gaps. Positions run on from document to document.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_blocks(offsets, RECORD_BYTES):
                words = alphanumeric_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.argsort(words.hash, kind="stable").astype(np.int32)
                terms, starts = np.unique(words.hash[order], return_index=True)
                gaps = np.diff(order, prepend=np.int32(0))
                gaps[starts] = order[starts]
                rows = batch.slice(a, b - a).select(list(range(1, batch.num_columns)))
                values = [
                    [f"{TaskContext.get().partitionId()}-{serial}"],
                    [_arrow_rows(rows)],
                    [np.diff(words.first).astype(np.int32).tobytes()],
                    [_packed(terms)],
                    [_packed(starts.astype(np.int32))],
                    [_packed(gaps)],
                    [len(order)],
                ]
                serial += 1
                arrays = [pa.array(v, k) for v, k in zip(values, [pa.string(), *[pa.binary()] * 5, pa.int32()])]
                names = ["record", "rows", "n_words", "terms", "starts", "gaps", "n"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(terms)], pa.int32())], [*names, "n_terms"])

    docs.select(text, *keep).mapInArrow(index, INDEX_SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


class _Record:
    """One index record: sorted terms, where their lists start, and all lists end to end."""

    def __init__(self, batch: pa.RecordBatch, k: int, lists: bool = True):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[k]
        n, n_terms = get("n").as_py(), get("n_terms").as_py()
        self.terms = _unpacked(get("terms"), np.uint64, n_terms)
        self.starts = np.append(_unpacked(get("starts"), np.int32, n_terms), n)
        self.n = n
        if lists:
            gaps = _unpacked(get("gaps"), np.int32, n).astype(np.int64)
            run = np.cumsum(gaps)
            lengths = np.diff(self.starts)
            before = np.repeat(run[self.starts[:-1]] - gaps[self.starts[:-1]], lengths) if n else run
            self.positions = run - before
            #: (term, position) as one sorted number, in which a list is searched
            self.keys = np.repeat(np.arange(n_terms, dtype=np.int64), lengths) * (n + 1) + self.positions
            self.n_words = np.frombuffer(get("n_words").as_buffer(), np.int32).astype(np.int64)
            self.rows = pa.ipc.open_stream(get("rows").as_buffer()).read_next_batch()
            self.id = get("record").as_py()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the terms, and whether it is there."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at, self.terms[at] == hashes


class _Windows:
    """The windows of some items: term hashes, one row a window, shorter items padded, and the item of each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.ids = [i for i, _ in items]
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        words = alphanumeric_words(data, offsets)
        found: list[tuple[int, int, int]] = []
        for item, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            size = min(width, b - a)
            found += [(item, start, size) for start in range(a, b - size + 1)] if size else []
        self.item, self.start, self.size = (np.array([f[k] for f in found], np.int64) for k in range(3))
        self.hash = words.hash
        self.terms = np.unique(words.hash)


def _item_parts(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in parts of a bounded number of words; items without an id have the id ''."""
    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    part, size = [], 0
    chosen = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"), n_bytes.alias("n")
    )
    for row in chosen.toLocalIterator():
        part.append((row["i"], (row["t"] or "").encode()))
        size += row["n"]
        if size >= 4 * PASS_WORDS:
            yield part
            part, size = [], 0
    yield part


def term_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences of each of ``terms`` over the whole index; one row a term comes back, bounded by the benchmark."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                record = _Record(batch, k, lists=False)
                at, present = record.find(wanted.value)
                if len(record.terms):
                    total += np.where(present, np.diff(record.starts)[at], 0)
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(total[got])], ["term", "n"])

    counted = index.select("terms", "starts", "n", "n_terms").mapInArrow(count, "term int, n long")
    return {int(terms[r["term"]]): r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _matches(windows: _Windows, order: np.ndarray, record: _Record, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of every place where each term stands within ``slack`` of its offset.

    The rarest term's list gives the candidates; each further list keeps those that it has a position for.
    """
    if not len(windows.item):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, present = record.find(windows.hash)
    lead = windows.start + order[:, 0]
    live = np.flatnonzero(present[lead])
    list_start = record.starts[at[lead[live]]].astype(np.int64)
    lengths = record.starts[at[lead[live]] + 1] - list_start
    window = np.repeat(live, lengths)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    begin = record.positions[np.repeat(list_start, lengths) + within] - order[window, 0]
    for rank in range(1, order.shape[1]):
        if not len(window):
            break
        step = order[window, rank]
        word = windows.start[window] + np.maximum(step, 0)
        base = at[word] * (record.n + 1)
        place = begin + step
        low = np.clip(place - slack, 0, record.n)
        near = np.minimum(np.searchsorted(record.keys, base + low), record.n - 1)
        there = (record.keys[near] >= base + low) & (record.keys[near] <= base + np.clip(place + slack, -1, record.n))
        keep = (step < 0) | (present[word] & there)
        window, begin = window[keep], begin[keep]
    return window, begin


def _rarest_first(windows: _Windows, counts: dict[int, int]) -> np.ndarray:
    """For each window its word places, rarest term first; -1 after a short window's last."""
    width = int(windows.size.max()) if len(windows.size) else 1
    place = np.arange(width)[None, :]
    inside = place < windows.size[:, None]
    word = np.minimum(windows.start[:, None] + place, max(len(windows.hash) - 1, 0))
    of_term = np.array([counts.get(int(t), 0) for t in windows.terms], np.int64)
    n = of_term[np.searchsorted(windows.terms, windows.hash)] if len(windows.hash) else np.zeros(1, np.int64)
    weight = np.where(inside, n[word], np.iinfo(np.int64).max)
    order = np.argsort(weight, axis=1, kind="stable")
    return np.where(np.take_along_axis(inside, order, 1), order, -1)


def find_items(
    index: DataFrame,
    keep: T.StructType,
    items: DataFrame,
    item_id: str,
    text: str,
    window: int = WINDOW,
    slack: int = 0,
) -> DataFrame:
    """Per document: its ``keep`` columns, ``n_words``, and what was found.

    ``hit_runs`` are the runs of words inside exact occurrences of windows, as (first word, number); ``items`` the ids
    of the items with such; ``near_items`` of those with a window whose words all stand within ``slack`` words of their
    place (exact ones included), if ``slack`` is set.
    """
    run = T.StructType([T.StructField("first", T.LongType()), T.StructField("length", T.LongType())])
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_runs", T.ArrayType(run)),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("near_items", T.ArrayType(T.StringType())),
        ]
    )
    place = T.StructType([T.StructField("__record", T.StringType()), T.StructField("__row", T.IntegerType())])
    passes = []
    for part in _item_parts(items, item_id, text):
        windows = _Windows(part, window)
        order = _rarest_first(windows, term_counts(index, windows.terms))
        shared = index.sparkSession.sparkContext.broadcast((windows, order))
        out = T.StructType([*place.fields, *added.fields, *keep.fields])
        passes.append(index.mapInArrow(_matcher(shared, slack), out))
    if len(passes) == 1:
        return passes[0].select(*keep.names, *added.names)
    together = functools.reduce(DataFrame.unionAll, passes).groupBy(*place.names).agg(
        *[F.first(c).alias(c) for c in [*keep.names, "n_words"]],
        F.array_sort(F.flatten(F.collect_list("hit_runs"))).alias("hit_runs"),
        *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near_items")],
    )
    return together.select(*keep.names, *added.names)


def hit_words(runs: str) -> Column:
    """Number of words in sorted runs that may overlap."""
    end = lambda r: r["first"] + r["length"]
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    add = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), end(r) - F.greatest(acc["upto"], r["first"]))).alias("n"),
        F.greatest(acc["upto"], end(r)).alias("upto"),
    )
    return F.aggregate(runs, zero, add, lambda acc: acc["n"])


def _per_row(rows: np.ndarray, items: np.ndarray, ids: list[str], n: int) -> pa.Array:
    held: list[set[int]] = [set() for _ in range(n)]
    for r, i in zip(rows.tolist(), items.tolist()):
        held[r].add(i)
    return pa.array([sorted(ids[i] for i in h) for h in held], pa.list_(pa.string()))


def _matcher(shared, slack: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, order = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                record = _Record(batch, k)
                n_rows = len(record.n_words)
                ends = np.cumsum(record.n_words)
                first_of = ends - record.n_words

                def within_rows(found, begin):
                    row = np.searchsorted(ends, np.maximum(begin, 0), "right")
                    good = (begin >= 0) & (begin + windows.size[found] <= record.n)
                    good[good] = (begin + windows.size[found])[good] <= ends[row[good]]
                    return found[good], begin[good], row[good]

                found, begin, row = within_rows(*_matches(windows, order, record, 0))
                change = np.zeros(record.n + 1, np.int32)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + windows.size[found], -1)
                hit = np.cumsum(change)[:-1] > 0
                edge = np.diff(np.concatenate([[False], hit, [False]]).view(np.int8))
                cut = first_of[(first_of > 0) & (first_of < record.n) & (record.n_words > 0)]
                cut = cut[hit[cut] & hit[cut - 1]]
                run_start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
                run_end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
                runs: list[list[dict]] = [[] for _ in range(n_rows)]
                for r, s, e in zip(np.searchsorted(ends, run_start, "right").tolist(), run_start.tolist(), run_end.tolist()):
                    runs[r].append({"first": s - int(first_of[r]), "length": e - s})
                items = _per_row(row, windows.item[found], windows.ids, n_rows)
                near = items
                if slack:
                    found, _, row = within_rows(*_matches(windows, order, record, slack))
                    near = _per_row(row, windows.item[found], windows.ids, n_rows)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
                arrays = [
                    pa.array([record.id] * n_rows, pa.string()),
                    pa.array(np.arange(n_rows, dtype=np.int32)),
                    pa.array(record.n_words),
                    pa.array(runs, kind),
                    items,
                    near,
                    *record.rows.columns,
                ]
                names = ["__record", "__row", "n_words", "hit_runs", "items", "near_items", *record.rows.schema.names]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return match


def _judged(docs: DataFrame, keep: list[str], benchmark: DataFrame, window: int, slack: int) -> DataFrame:
    path = scratch_path(ship(docs.sparkSession), "positions")
    index = build_index(docs, "text", keep, path)
    kept = T.StructType([docs.schema[c] for c in keep])
    found = find_items(index, kept, benchmark, "item_id", "text", window, slack)
    return found.withColumn("n_hit", hit_words("hit_runs")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 2) -> DataFrame:
    """``contamination`` of whole documents: doc_id, n_words, n_hit, items and whether a twentieth of the words is hit."""
    found = _judged(docs.select("doc_id", "text"), ["doc_id"], benchmark, window, slack)
    return found.select("doc_id", "n_words", "n_hit", "items", "near_items", "hit_runs", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those of which a twentieth of the words stands in windows of the benchmark."""
    row_hash = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    hashed = docs.select("doc_id", "text", row_hash.alias("__row_hash"))
    judged = _judged(hashed, ["doc_id", "__row_hash"], benchmark, window, 0).filter("contaminated")
    gone = judged.select(F.col("doc_id").alias("__doc_id"), F.col("__row_hash").alias("__gone"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (row_hash == F.col("__gone"))
    return docs.join(stage(gone, "contaminated"), same, "left_anti")
