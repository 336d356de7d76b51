"""Exact nearest vectors by cosine distance, for dense and for sparse vectors.

The queries are written once to the shared folder. Every corpus task holds some rows and streams the queries past them,
a block at a time: one pass over the corpus for any number of queries, and nothing in the driver. A task returns k rows
per query and slice, and those are ranked again. Slices are bounded in rows and in numbers, so that long vectors make more
slices, not larger ones; queries of many different buckets meet a slice in smaller blocks.

A vector that is missing, zero, or holds null or non-finite numbers has no distance, nor have dense vectors of unequal
length; such rows are left out. Distances are compared at 12 digits, so that equal vectors tie however the rows were
batched, and ties are broken by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.batches import row_cuts
from tallyhouse.session import arrow_uri, scratch_path

#: Corpus rows that meet the queries at once, queries of a block, and numbers of one dense slice.
ROWS, BLOCK, SLICE = 16_384, 256, 4_000_000

#: Numbers of the corpus rows that meet the queries at once (some 80 bytes of memory each); a longer vector stands alone.
NUMBERS = 1 << 20


def nearest(corpus: DataFrame, query: DataFrame, k: int, *, key: str, vector: str) -> DataFrame:
    """The ``k`` corpus rows nearest to the one vector that ``query`` returns, ties broken by key."""
    column = query.columns[0]
    one = F.assert_true(F.count(F.lit(1)) <= 1, F.lit("more than one query vector"))
    single = query.agg(F.first(column).alias(column), one.alias("_one"))
    asked = single.select(F.coalesce(F.col("_one").cast("long"), F.lit(0).cast("long")).alias("_query"), column)
    found = nearest_for_each(corpus, asked, k, key=key, vector=vector, query_key="_query", query_vector=column)
    return found.select(key, "distance").orderBy("distance", key).limit(k)


def nearest_for_each(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    key: str,
    vector: str,
    query_key: str,
    query_vector: str,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest corpus rows of every query, as (query_key, key, distance).

    Vectors are arrays of numbers, or sparse: an array of buckets and one of their weights.
    """
    spark = corpus.sparkSession
    path = scratch_path(spark, "queries")
    queries.select(query_key, query_vector).write.parquet(path)
    schema = T.StructType(
        [
            T.StructField(query_key, queries.schema[query_key].dataType),
            T.StructField(key, corpus.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    sparse = isinstance(corpus.schema[vector].dataType, T.StructType)
    usable = corpus.select(key, vector).filter(F.col(vector).isNotNull())
    if not sparse:
        usable = usable.select(key, F.col(vector).cast("array<double>").alias(vector))
    partial = usable.mapInArrow(_search(arrow_uri(path), k, sparse, block, schema.names), schema)
    ranked = Window.partitionBy(query_key).orderBy("distance", key)
    return partial.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k).drop("_rank")


def smallest_in_rows(k: int):
    """A function from distances to the (query, row) of exactly k rows a query; of equal distances the first columns."""

    def smallest(distances):
        import numpy as np

        if distances.shape[1] > k:
            edge = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
            below, ties = distances < edge, distances == edge
            room = k - below.sum(axis=1, keepdims=True)
            return np.nonzero(below | (ties & (np.cumsum(ties, axis=1) <= room)))
        return np.nonzero(np.ones(distances.shape, bool))

    return smallest


def _search(stored: str, k: int, sparse: bool, block: int, names: list[str]):
    # A closure with local imports only, so that executors need no installed copy of this package.
    rows_at_once, numbers_at_once, slice_numbers = ROWS, NUMBERS, SLICE
    smallest, cut = smallest_in_rows(k), row_cuts(NUMBERS)

    def search(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as pads
        import pyarrow.fs as pafs

        def dense_groups(column):
            """(rows, unit vectors) of each length."""
            lists = column.cast(pa.list_(pa.float64()))
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype("int64")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for d in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == d)
                values = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                norms = np.linalg.norm(values, axis=1)
                sound = np.isfinite(norms) & (norms > 0)
                yield int(d), rows[sound], values[sound] / norms[sound, None]

        def sparse_rows(column):
            """(rows with a direction, row and bucket and unit weight of each entry)."""
            buckets, weights = column.flatten()
            lengths = np.nan_to_num(buckets.value_lengths().to_numpy(zero_copy_only=False)).astype("int64")
            bucket = buckets.flatten().to_numpy(zero_copy_only=False).astype("int64")
            weight = weights.flatten().to_numpy(zero_copy_only=False).astype("float64")
            row = np.repeat(np.arange(len(column)), lengths)
            norms = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(column)))
            sound = np.isfinite(norms) & (norms > 0)
            keep = sound[row]
            return np.flatnonzero(sound), row[keep], bucket[keep], weight[keep] / norms[row[keep]]

        def result(asked, query_rows, ids, id_rows, distances):
            distances = np.round(distances, 12)
            order = np.argsort(ids[id_rows], kind="stable")
            distances, id_rows = distances[:, order], id_rows[order]
            query, row = smallest(distances)
            arrays = [
                asked.column(0).take(pa.array(query_rows[query])),
                keys.take(pa.array(id_rows[row])),
                pa.array(distances[query, row]),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def dense(table, asked, ids):
            queries = {d: (rows, vectors) for d, rows, vectors in dense_groups(asked.column(1))}
            for d, rows, points in table:
                if d in queries and len(rows) and len(queries[d][0]):
                    query_rows, targets = queries[d]
                    yield result(asked, query_rows, ids, rows, 1.0 - targets @ points.T)

        def sparse_match(table, asked, ids):
            rows, row, bucket, weight = table
            query_rows, q_row, q_bucket, q_weight = sparse_rows(asked.column(1))
            if not len(query_rows) or not len(rows):
                return
            vocabulary = np.unique(q_bucket)
            if asked.num_rows > 1 and asked.num_rows * len(vocabulary) > slice_numbers:
                half = asked.num_rows // 2
                yield from sparse_match(table, asked.slice(0, half), ids)
                yield from sparse_match(table, asked.slice(half), ids)
                return
            targets = np.zeros((asked.num_rows, len(vocabulary)))
            np.add.at(targets, (q_row, np.searchsorted(vocabulary, q_bucket)), q_weight)
            targets = targets[query_rows]
            at = np.minimum(np.searchsorted(vocabulary, bucket), len(vocabulary) - 1)
            hit = vocabulary[at] == bucket
            row, at, weight = row[hit], at[hit], weight[hit]
            similarity = np.zeros((len(query_rows), len(ids)))
            step = max(1, slice_numbers // len(vocabulary))
            for first in range(0, len(ids), step):
                low, high = np.searchsorted(row, [first, first + step])
                part = np.zeros((min(step, len(ids) - first), len(vocabulary)))
                np.add.at(part, (row[low:high] - first, at[low:high]), weight[low:high])
                similarity[:, first : first + len(part)] = targets @ part.T
            yield result(asked, query_rows, ids, rows, 1.0 - similarity[:, rows])

        def slices():
            held, n, numbers = [], 0, 0
            for batch in batches:
                lists = batch.column(1).flatten()[0] if sparse else batch.column(1)
                lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype("int64")
                for start, end in cut(lengths):
                    for first in range(start, end, rows_at_once):
                        part = batch.slice(first, min(rows_at_once, end - first))
                        size = int(lengths[first : first + part.num_rows].sum())
                        if n and (n + part.num_rows > rows_at_once or numbers + size > numbers_at_once):
                            yield pa.Table.from_batches(held).combine_chunks()
                            held, n, numbers = [], 0, 0
                        held.append(part)
                        n, numbers = n + part.num_rows, numbers + size
            if n:
                yield pa.Table.from_batches(held).combine_chunks()

        system, place = pafs.FileSystem.from_uri(stored)
        for part in slices():
            keys, column = part.column(0).chunk(0), part.column(1).chunk(0)
            ids = keys.to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            table = sparse_rows(column) if sparse else list(dense_groups(column))
            asked_blocks = pads.dataset(place, filesystem=system, format="parquet").to_batches(batch_size=block)
            for asked in asked_blocks:
                if asked.num_rows:
                    yield from (sparse_match if sparse else dense)(table, asked, ids)

    return search
