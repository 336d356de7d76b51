"""Text embedding: hashed word counts weighted by rarity, scaled to unit length.

A lexical stand-in for a remote embedding model: texts are near when they share uncommon words. Vectors are sparse: the
buckets that a text has words in and their weights, as two arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.batches import row_cuts
from tallyhouse.functions.text import word_buckets
from tallyhouse.session import arrow_uri, scratch_path, stage

#: Buckets that words are hashed to; their weights are the only fitted numbers (8 bytes each).
DIM = 1 << 18

#: Words that a task counts at once (some 100 bytes of memory each); a longer text is counted alone.
WORDS_AT_ONCE = 1 << 18
BUCKETS = "_buckets"
SPARSE = T.StructType(
    [T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.DoubleType()))]
)


@dataclass(frozen=True)
class Embedder:
    """Word buckets and their fitted weights, a table (bucket, weight) in the shared folder that tasks load.

    It has at most ``dim`` rows, whatever the size of the corpus. A bucket that it lacks has the weight ``unseen``.
    """

    dim: int
    table: DataFrame
    stored: str
    unseen: float

    @property
    def weights(self) -> dict[int, float]:
        return {row["bucket"]: row["weight"] for row in self.table.collect()}

    def transform(self, df: DataFrame, key: str, text: str, vector: str) -> DataFrame:
        """(key, vector) for every row, NULL for a NULL text; row-local, no shuffle. Weights of 0 are left out."""
        return self.weigh(bucket_words(df, key, text, self.dim), key, vector)

    def weigh(self, bucketed: DataFrame, key: str, vector: str) -> DataFrame:
        """Vectors of rows whose words are bucketed already.

        Counting runs on Arrow batches of bucket numbers, over the buckets that occur: a JVM count would explode and
        regroup every word.
        """
        schema = T.StructType([bucketed.schema[key], T.StructField(vector, SPARSE)])
        count = _count_words(self.dim, arrow_uri(self.stored), self.unseen, key, vector)
        return bucketed.select(key, BUCKETS).mapInArrow(count, schema)


def bucket_words(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket number of every word), split and hashed in the JVM."""
    return df.select(key, word_buckets(F.col(text), dim).alias(BUCKETS))


def fit_embedder(bucketed: DataFrame, dim: int) -> Embedder:
    """Weights ``ln((n + 1) / (df + 1))`` per bucket, from one aggregation whose result stays in the shared folder."""
    spark = bucketed.sparkSession
    n = bucketed.count()
    held = bucketed.select(F.explode(F.array_distinct(BUCKETS)).alias("bucket")).groupBy("bucket").count()
    path = scratch_path(spark, "weights")
    held.select("bucket", F.log((n + 1) / (F.col("count") + 1)).alias("weight")).write.parquet(path)
    return Embedder(dim, spark.read.schema("bucket int, weight double").parquet(path), path, math.log(n + 1))


def embed_corpus(df: DataFrame, key: str, text: str, vector: str, dim: int = DIM) -> tuple[Embedder, DataFrame]:
    """Fit on all texts and embed them.

    The bucket numbers are written to the shared folder once: fitting and embedding read about a byte per word
    instead of splitting every text twice.
    """
    bucketed = stage(bucket_words(df, key, text, dim), "buckets")
    embedder = fit_embedder(bucketed, dim)
    return embedder, embedder.weigh(bucketed, key, vector)


def _count_words(dim: int, stored: str, unseen: float, key: str, vector: str):
    # A closure with local imports only, so that executors need no installed copy of this package.
    cut = row_cuts(WORDS_AT_ONCE)

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as pads
        import pyarrow.fs as pafs

        system, place = pafs.FileSystem.from_uri(stored)
        fitted = pads.dataset(place, filesystem=system, format="parquet").to_table()
        values = np.full(dim, unseen)
        if fitted.num_rows:
            values[fitted.column("bucket").to_numpy()] = fitted.column("weight").to_numpy()
        for whole in batches:
            sizes = np.nan_to_num(whole.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype("int64")
            for first, end in cut(sizes):
                batch, n, lengths = whole.slice(first, end - first), end - first, sizes[first:end]
                lists = batch.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("int64")
                pairs, times = np.unique(np.repeat(np.arange(n), lengths) * dim + flat, return_counts=True)
                row, bucket = pairs // dim, pairs % dim
                weight = values[bucket] * times
                row, bucket, weight = (x[weight != 0] for x in (row, bucket, weight))
                norms = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype("int32"))
                arrays = [pa.ListArray.from_arrays(offsets, x) for x in (bucket.astype("int32"), weight / norms[row])]
                vectors = pa.StructArray.from_arrays(arrays, names=["bucket", "weight"], mask=lists.is_null())
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, vector])

    return count
