"""Exact top-k inner products by no-random-access aggregation over sorted component lists.

Every component has a list of the candidates sorted by value. For a query, a list is read from the end that its weight
favours: from the largest value for a positive weight, from the smallest for a negative one. Lists are read in rounds, a
stretch of each list a round, and what is read is added to the scores of the candidates that stand there. After a round a
candidate has a lower bound (what was read, plus the worst that its unread components can give) and an upper bound (what
was read, plus the value at which the reading of its unread lists stands). Candidates whose upper bound is below the
k-th largest lower bound cannot qualify. Reading goes on for those that can, and their final scores are what the last
stretches complete; no vector is looked up. Tasks do this for a few queries at a time, a stretch being a matrix in which
entries that are not in it are zero. ``share_read`` tells which part of the lists' entries was read.

The candidates are dealt into partitions of a bounded number of rows. The queries are written once and streamed by each
partition, so neither side passes through the driver and no pairs are made; a partition returns k rows a query, and
those are cut to k again.

Defined cases: vectors that are null or hold null, NaN or infinite components are no queries and no candidates; a query's
candidates are the vectors of its own length, every row but its own (rows that repeat its id count as its own); rows that
repeat another id are candidates each, and as queries they are numbered and each has k rows of its own; null ids take no
part. Components are exact up to 2^53 after scaling; larger ones, or a score that would leave 64 bits, raise an error, as a
long can't hold the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.shipping import ship
from tallyhouse.session import arrow_uri, scratch_path

SCALE = 64

#: Components that a partition of candidates holds; its matrices take about ten times as much.
PARTITION_COMPONENTS = 1 << 20

#: Queries that read their lists together, and queries that are loaded at a time.
TOGETHER = 32
QUERY_BLOCK = 128

#: Shares of each list that are read after each round.
DEPTHS = (0.5, 0.7, 0.85, 0.95, 1.0)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Integer vectors ``x``: floor(scale * component), of the rows that take part."""
    value = F.col(vector).cast("array<double>")
    sound = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    kept = vectors.filter(F.col(vec_id).isNotNull() & value.isNotNull() & sound)
    whole = F.transform(value, lambda v: F.floor(F.lit(float(scale)) * v).cast("double"))
    return kept.select(F.col(vec_id).alias("vec_id"), whole.alias("x"))


@dataclass
class Stretch:
    """What a round reads. Columns are the lists from the top, then those from the bottom; rows are candidates."""

    entries: np.ndarray  # marks
    values: np.ndarray  # zero where there is no entry
    unread: np.ndarray  # marks of what is still unread after it
    front: np.ndarray  # value at which each list stands


class SortedLists:
    """The sorted lists of one partition's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.size = float(np.abs(x).max()) if x.size else 0.0
        n = len(x)
        self.order = np.argsort(x, axis=0, kind="stable")
        ordered = np.take_along_axis(x, self.order, axis=0)
        self.worst = np.concatenate([ordered[0], ordered[-1]]) if n else np.zeros(0)
        self.ends = sorted({max(1, round(share * n)) for share in DEPTHS}) if n else []
        self.fronts = [np.concatenate([ordered[n - end], ordered[end - 1]]) for end in self.ends]
        self.stretches: dict[type, list[Stretch]] = {}

    def typed(self, kind: type) -> list[Stretch]:
        if kind not in self.stretches:
            rank = np.empty_like(self.order)
            np.put_along_axis(rank, self.order, np.arange(len(self.x))[:, None], axis=0)
            place = np.hstack([len(self.x) - 1 - rank, rank])
            both, start, made = np.hstack([self.x, self.x]), 0, []
            for end, front in zip(self.ends, self.fronts):
                entries = (place >= start) & (place < end)
                made.append(Stretch(entries, (both * entries).astype(kind), (place >= end).astype(kind), front.astype(kind)))
                start = end
            self.stretches = {kind: made}
        return self.stretches[kind]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each query: its id, the ids and scores of its k best, ties to the smaller id, and how many entries it read."""
        bound = float(np.abs(queries).max(initial=0)) * self.size * max(1, queries.shape[1])
        if bound >= 2**63:
            raise OverflowError("inner products leave 64 bits")
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        for first in range(0, len(queries), TOGETHER):
            some = slice(first, first + TOGETHER)
            yield from self._read(query_ids[some], queries[some], k, kind)

    def _read(self, query_ids, queries, k, kind):
        none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        weights = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
        worst = weights * self.worst.astype(kind)
        columns = np.arange(len(self.x))  # candidates that some query still reads for
        alive = self.ids[None, :] != query_ids[:, None]
        known = np.zeros(alive.shape, kind)
        n_read = np.zeros(len(queries), np.int64)
        for stretch in self.typed(kind):
            whole = len(columns) == len(self.x)
            part = (lambda m: m) if whole else (lambda m: m[columns])
            known += weights @ part(stretch.values).T
            n_read += (weights != 0) @ part(stretch.entries).sum(axis=0)
            if len(columns) <= k or stretch is self.typed(kind)[-1]:
                continue
            unread = part(stretch.unread).T
            lower = known + worst @ unread
            lower[~alive] = none
            least = np.partition(lower, len(columns) - k, axis=1)[:, len(columns) - k]
            alive &= known + (weights * stretch.front) @ unread >= least[:, None]
            wanted = alive.any(axis=0)
            if wanted.mean() < 0.9:
                columns, alive, known = columns[wanted], alive[:, wanted], known[:, wanted]
        for i, query_id in enumerate(query_ids):
            left = np.flatnonzero(alive[i])
            score, left = known[i, left], columns[left]
            if len(left) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                left, score = left[score >= least], score[score >= least]
            order = np.lexsort((self.ids[left], -score))[:k]
            yield int(query_id), self.ids[left[order]], score[order].astype(np.int64), int(n_read[i])


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: (row numbers, matrix)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        at = (ends[rows] - d)[:, None] + np.arange(d)[None, :]
        out[int(d)] = (rows, flat[at])
    return out


def _as_whole(x: np.ndarray) -> np.ndarray:
    if x.size and np.abs(x).max() >= 2**53:
        raise OverflowError("components leave the range of exact doubles")
    return x.astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, share_read: bool = False) -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query row's k best among ``vectors``; both are ``quantised``.

    ``share_read`` adds the part of all lists' entries that was read for the query row.
    """
    spark = ship(vectors.sparkSession)
    path = scratch_path(spark, "queries")
    numbered = queries.select("vec_id", "x", F.monotonically_increasing_id().alias("query_row"))
    numbered.write.parquet(path)
    stored = arrow_uri(path)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = table.column(0).to_numpy()
        lists = {
            d: SortedLists(ids[at], _as_whole(x)) for d, (at, x) in _vectors(table.column(1).chunk(0)).items()
        }
        system, place = pafs.FileSystem.from_uri(stored)
        for asked in pads.dataset(place, filesystem=system, format="parquet").to_batches(batch_size=QUERY_BLOCK):
            if not asked.num_rows:
                continue
            query_ids, query_rows = asked.column(0).to_numpy(), asked.column(2).to_numpy()
            for d, (at, q) in _vectors(asked.column(1)).items():
                if d not in lists:
                    continue
                found = list(lists[d].best(query_ids[at], _as_whole(q), k))
                sizes = [len(f[1]) for f in found]
                # a query's first row from a partition holds what it read there
                heads = np.concatenate([[0], np.cumsum(sizes)])[:-1][np.array(sizes) > 0]
                n_read, n_all = np.zeros(sum(sizes), np.int64), np.zeros(sum(sizes), np.int64)
                n_read[heads] = [f[3] for f in found if len(f[1])]
                n_all[heads] = lists[d].x.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_rows[at], sizes)),
                        pa.array(np.repeat([f[0] for f in found], sizes).astype(np.int64)),
                        pa.array(np.concatenate([f[1] for f in found])),
                        pa.array(np.concatenate([f[2] for f in found])),
                        pa.array(n_read),
                        pa.array(n_all),
                    ],
                    ["query_row", "query_id", "vec_id", "score", "n_read", "n_all"],
                )

    sized = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()
    n, d = sized["n"], max(1, sized["d"])
    parts = max(-(-n * d // PARTITION_COMPONENTS), min(spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    schema = "query_row long, query_id long, vec_id long, score long, n_read long, n_all long"
    found = vectors.repartition(parts).mapInArrow(search, schema)
    row = Window.partitionBy("query_row")
    ranked = found.withColumn("rank", F.row_number().over(row.orderBy(F.desc("score"), "vec_id")))
    ranked = ranked.withColumn("share_read", F.sum("n_read").over(row) / F.sum("n_all").over(row))
    named = ["query_id", "rank", "vec_id", "score", *(["share_read"] if share_read else [])]
    return ranked.filter(F.col("rank") <= k).select(*named)
