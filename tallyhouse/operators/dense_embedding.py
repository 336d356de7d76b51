"""Dense text vectors of a fixed width: the sparse embedding projected on its strongest directions.

A randomised range finder works through the sparse vectors a few times. Each pass turns every text into a short row (its
words' rows added up, weighted) and adds the rows up again by word bucket, in each task first: a pass has a task for each
core, which sends at most one row a bucket, so that what is shuffled is bounded by ``dim`` rows a core for any number of
texts. Sums of products of the short rows, a small square matrix, keep the directions apart. Texts are neither
collected nor compared. The directions, one row a bucket, stay in the shared folder, and tasks load them.

Defined cases: a null text has a null vector; a text without weighty words has zeros; a table with fewer independent texts
than directions has zeros in the last places; signs are fixed by the largest entry of a direction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.embedding import DIM, Embedder, embed_corpus
from tallyhouse.session import arrow_uri, scratch_path, stage

#: Directions that are sought beyond those kept, and passes that sharpen them.
EXTRA = 16
PASSES = 2

#: Bucket rows that a task sends at once.
ROWS = 4096


@dataclass(frozen=True)
class DenseEmbedder:
    """Directions (bucket, x) in the shared folder; ``captured`` is their share of the squared weights of all texts."""

    embedder: Embedder
    width: int
    stored: str
    captured: float

    def transform(self, df: DataFrame, key: str, text: str, vector: str) -> DataFrame:
        """(key, vector) for every row, an array of ``width`` numbers; row-local, no shuffle."""
        return self.project(self.embedder.transform(df, key, text, "_sparse"), key, "_sparse", vector)

    def project(self, sparse: DataFrame, key: str, vector: str, out: str) -> DataFrame:
        """The same of rows that hold sparse vectors already."""
        rows = _short_rows(sparse.select(key, vector), self.embedder.dim, arrow_uri(self.stored), self.width)
        return rows.select(F.col("k").alias(key), F.col("x").alias(out))


def fit_dense(df: DataFrame, key: str, text: str, width: int, dim: int = DIM) -> tuple[DenseEmbedder, DataFrame]:
    """Directions fitted on all texts, and the texts' vectors (key, ``vector``)."""
    embedder, weighed = embed_corpus(df, key, text, "_sparse", dim)
    sparse = stage(weighed, "sparse")
    wide = width + EXTRA
    stored = None
    for _ in range(PASSES + 1):
        stored = _orthonormal(_by_bucket(sparse, dim, stored and arrow_uri(stored), wide), wide)
    total = sparse.select(F.explode("_sparse.weight").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0
    # of the space that was found, the directions along which texts spread most
    values, turn = np.linalg.eigh(_gram(_short_rows(sparse, dim, arrow_uri(stored), wide).select("x"), wide))
    best = np.argsort(values)[::-1][:width]
    values, turn = np.maximum(values[best], 0.0), turn[:, best]
    turn = turn * (values > 1e-9 * max(values.max(initial=0.0), 1e-300))
    largest = np.abs(turn).argmax(axis=0)
    turn = turn * np.where(turn[largest, np.arange(width)] < 0, -1.0, 1.0)
    path = _turned(sparse.sparkSession.read.parquet(stored), turn)
    dense = DenseEmbedder(embedder, width, path, float(values.sum() / total) if total else 0.0)
    return dense, dense.project(sparse, key, "_sparse", "vector")


def _row_sums(dim: int, stored: str | None, width: int):
    """A function that loads the buckets' rows and returns one from batches to their texts' (buckets, weights, sum of rows).

    Without stored rows, they are random signs that the bucket's number gives. A null text has None for all three.
    """

    def load():
        import numpy as np
        import pyarrow.dataset as pads
        import pyarrow.fs as pafs

        if stored is None:
            # the same signs in every task, whatever it holds
            table = np.random.default_rng(514).integers(0, 2, (dim, width), dtype=np.int8).astype(np.float32)
            table *= 2
            table -= 1
        else:
            table = np.zeros((dim, width), np.float32)
            system, place = pafs.FileSystem.from_uri(stored)
            for part in pads.dataset(place, filesystem=system, format="parquet").to_batches(columns=["bucket", "x"]):
                if part.num_rows:
                    rows = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    table[part.column(0).to_numpy()] = rows.reshape(-1, width)

        def add_up(vectors):
            buckets, weights = vectors.field(0), vectors.field(1)
            known = np.array(vectors.is_valid())
            lengths = np.where(known, np.nan_to_num(buckets.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
            ends = np.cumsum(lengths)
            places, values = (c.flatten().to_numpy(zero_copy_only=False) for c in (buckets, weights))
            for k in range(len(lengths)):
                at = slice(ends[k] - lengths[k], ends[k])
                yield (places[at], values[at], values[at] @ table[places[at]]) if known[k] else (None, None, None)

        return add_up

    return load


def _short_rows(sparse: DataFrame, dim: int, stored: str, width: int) -> DataFrame:
    """(k, x): x adds up the rows of the text's buckets by weight."""
    kind = sparse.schema[sparse.columns[0]].dataType.simpleString()
    load = _row_sums(dim, stored, width)

    def shorten(batches):
        import numpy as np
        import pyarrow as pa

        add_up = load()
        for batch in batches:
            x, known = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, bool)
            for k, (_, _, row) in enumerate(add_up(batch.column(1))):
                if row is not None:
                    x[k], known[k] = row, True
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            rows = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["k", "x"])

    return sparse.mapInArrow(shorten, f"k {kind}, x array<double>")


def _partial_sums(sparse: DataFrame, dim: int, stored: str | None, width: int) -> DataFrame:
    """(bucket, x): the texts' short rows added up by weight at each of their buckets; a row for each core and bucket."""
    load, rows_at_once = _row_sums(dim, stored, width), ROWS

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        add_up, sums, met = load(), np.zeros((dim, width)), np.zeros(dim, bool)
        for batch in batches:
            for places, values, row in add_up(batch.column(0)):
                if row is not None and len(places):
                    sums[places] += values[:, None] * row  # a text has a bucket once
                    met[places] = True
        held = np.flatnonzero(met).astype(np.int32)
        for first in range(0, len(held), rows_at_once):
            some = held[first : first + rows_at_once]
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
            rows = pa.ListArray.from_arrays(offsets, pa.array(sums[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), rows], ["bucket", "x"])

    # a task for each core, however many files there are: each sends a row for every bucket that it met
    vectors = sparse.select("_sparse").coalesce(sparse.sparkSession.sparkContext.defaultParallelism)
    return vectors.mapInArrow(partial, "bucket int, x array<double>")


def _by_bucket(sparse: DataFrame, dim: int, stored: str | None, width: int) -> DataFrame:
    """(bucket, x): the texts' short rows added up by weight at each of their buckets."""
    found = _partial_sums(sparse, dim, stored, width).repartition("bucket")
    summed = found.groupBy("bucket").agg(*[F.sum(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(width)])
    return stage(summed.select("bucket", F.array(*[f"x{k}" for k in range(width)]).alias("x")), "sums")


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the products of every row with itself: a small matrix from each task."""

    def products(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        place = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], ["place", "value"])

    parts = rows.mapInArrow(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(width * width)
    for row in parts.collect():
        out[row["place"]] = row["value"]
    return out.reshape(width, width)


def _turned(rows: DataFrame, turn: np.ndarray) -> str:
    """Rows times ``turn``, written to the shared folder."""
    width = len(turn)

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) @ turn
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * turn.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["bucket", "x"])

    path = scratch_path(rows.sparkSession, "directions")
    rows.select("bucket", "x").mapInArrow(multiply, "bucket int, x array<double>").write.parquet(path)
    return path


def _orthonormal(rows: DataFrame, width: int) -> str:
    """The rows' columns made orthonormal by the eigenvectors of their products, twice for accuracy; null directions go."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(rows.select("x"), width))
        kept = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        scale = np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)
        path = _turned(rows, vectors * scale)
        rows = rows.sparkSession.read.parquet(path)
    return path
