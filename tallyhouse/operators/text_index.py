"""Posting lists of embedded texts, for exact nearest-text queries that skip what cannot matter.

An index has the fitted weights, the vectors by key, and for each word bucket the list of (key, weight) of the texts that
hold it, with its length and its largest weight. A list lies in blocks, one for each batch of texts, so that building sorts
blocks, not entries. Blocks are sorted by bucket and long lists span several files, so that a query reads its own lists only. For each query, lists are ordered by the most that they can add to a score, the query's
weight times the largest of the list:

1. The first lists, up to half of what all can add, are added up. The k-th best sum is a score that must be beaten.
2. Lists are read on until all unread ones together cannot lift a text that none of the read ones holds to that score.
   These essential lists tend to be the short ones of rare words.
3. Texts whose sum plus the unread rest can still reach the k-th best sum get the rest from their own vectors.

Weights are not negative, so a text without a word of the query is at distance 1; such texts fill up results with fewer
than k others, by key. Defined cases and ties are those of ``vector_search``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.batches import row_cuts
from tallyhouse.operators.embedding import DIM, Embedder, bucket_words, fit_embedder
from tallyhouse.session import broadcast_within, stage
from tallyhouse.sources.files import write_clustered

#: Share of what all lists can add that the first round reads, and what rounding may take from a sum.
FIRST_SHARE, SLACK = 0.5, 1e-9

#: Entries of the texts that building puts into blocks at once (some 60 bytes of memory each).
ENTRIES = 1 << 20

#: Buckets that are named in a scan's filter.
MOST_LITERALS = 2000


def _block_schema(vectors: DataFrame, key: str) -> T.StructType:
    kinds = {"bucket": T.IntegerType(), "key": T.ArrayType(vectors.schema[key].dataType), "weight": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _by_bucket():
    # A closure with local imports only, so that executors need no installed copy of this package.
    cut = row_cuts(ENTRIES)

    def turn(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(1).flatten()[0].value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            for first, end in cut(sizes):
                part = batch.slice(first, end - first)
                buckets, weights = (c.flatten().to_numpy(zero_copy_only=False) for c in part.column(1).flatten())
                order = np.argsort(buckets, kind="stable")
                held, starts = np.unique(buckets[order], return_index=True)
                offsets = pa.array(np.concatenate([starts, [len(order)]]).astype("int32"))
                keys = part.column(0).take(pa.array(np.repeat(np.arange(end - first), sizes[first:end])[order]))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys, pa.array(weights[order]))]
                yield pa.RecordBatch.from_arrays([pa.array(held), *lists], names=["bucket", "key", "weight"])

    return turn


@dataclass(frozen=True)
class TextSearch:
    """``found`` has (query_key, key, distance); ``touched`` the texts that each query gave a sum."""

    found: DataFrame
    touched: DataFrame
    queries: DataFrame

    def share_scored(self, index: TextIndex) -> float:
        """Texts that were given a sum, over all pairs of a query and a text."""
        return self.touched.count() / max(self.queries.count() * index.vectors.count(), 1)


class TextIndex:
    """An index that lies at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        facts = json.loads(spark.read.text(f"{self.path}/facts").first()["value"])
        self.key = facts["key"]
        weights = spark.read.schema("bucket int, weight double").parquet(f"{self.path}/weights")
        self.embedder = Embedder(facts["dim"], weights, f"{self.path}/weights", facts["unseen"])
        self.vectors = spark.read.parquet(f"{self.path}/vectors")
        self.postings = spark.read.parquet(f"{self.path}/postings")
        self.lists = spark.read.parquet(f"{self.path}/lists")

    @classmethod
    def build(cls, texts: DataFrame, path: str, *, key: str, text: str, dim: int = DIM) -> TextIndex:
        """Index every text; a row-local pass for the vectors, and one exchange that sorts their entries by bucket."""
        spark = texts.sparkSession
        bucketed = stage(bucket_words(texts, key, text, dim), "buckets")
        fitted = fit_embedder(bucketed, dim)
        fitted.table.write.parquet(f"{path}/weights")
        vectors = fitted.weigh(bucketed, key, "_vector").filter(F.size("_vector.bucket") > 0)
        vectors.write.parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors").select(key, "_vector")
        blocks = stored.mapInArrow(_by_bucket(), _block_schema(stored, key))
        write_clustered(blocks, f"{path}/postings", "bucket", "key")
        postings = spark.read.parquet(f"{path}/postings").select("bucket", F.size("key").alias("n"), F.array_max("weight").alias("most"))
        lists = postings.groupBy("bucket").agg(F.sum("n").alias("length"), F.max("most").alias("most"))
        lists.write.parquet(f"{path}/lists")
        facts = json.dumps({"key": key, "dim": dim, "unseen": fitted.unseen})
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{path}/facts")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, *, query_key: str, text: str) -> TextSearch:
        """The ``k`` nearest texts of every query row, as (query_key, key, distance)."""
        numbered = stage(
            queries.select(F.monotonically_increasing_id().alias("_query"), F.col(query_key), F.col(text).alias("_text")),
            "queries",
        )
        asked = self.embedder.transform(numbered, "_query", "_text", "_asked").filter(F.size("_asked.bucket") > 0)
        asked = stage(asked, "asked")
        wanted = self._by_bound(asked)
        sums = self._added(wanted.filter("first"))
        must = self._kth(sums, k)
        judged = stage(wanted.join(must, "_query", "left"), "judged")
        # essential: without this list and the later ones, what they can add would still reach the score
        reached = F.col("before") >= F.coalesce(F.col("kth"), F.lit(0.0)) - SLACK
        further = judged.filter(~F.col("first") & reached)
        unread = stage(judged.filter(~F.col("first") & ~reached).select("_query", "bucket", "weight", "bound"), "unread")
        sums = stage(self._summed(sums.unionAll(self._added(further))), "sums")
        rest = unread.groupBy("_query").agg(F.sum("bound").alias("rest"))
        limits = asked.select("_query").join(self._kth(sums, k), "_query", "left").join(rest, "_query", "left")
        limits = limits.select("_query", F.coalesce("kth", F.lit(0.0)).alias("kth"), F.coalesce("rest", F.lit(0.0)).alias("rest"))
        left = sums.join(broadcast_within(stage(limits, "limits")), "_query")
        left = left.filter(F.col("score") + F.col("rest") >= F.col("kth") - SLACK).select("_query", self.key, "score")
        scored = self._summed(left.unionAll(self._remainder(stage(left, "left"), unread)))
        best = stage(self._best(scored.withColumn("distance", F.round(1 - F.col("score"), 12)).drop("score"), k), "best")
        ranked = self._best(best.unionAll(self._filling(asked, best, k)), k)
        found = numbered.join(ranked, "_query").select(query_key, self.key, "distance")
        return TextSearch(found, sums, asked)

    def _by_bound(self, asked: DataFrame) -> DataFrame:
        """Each query's lists: what each can add, what it and the later ones can, and whether the first round reads it."""
        entries = asked.select("_query", F.inline(F.arrays_zip("_asked.bucket", "_asked.weight")))
        bound = (F.col("weight") * F.col("most")).alias("bound")
        known = entries.join(broadcast_within(self.lists), "bucket").select("_query", "bucket", "weight", bound)
        order = Window.partitionBy("_query").orderBy(F.desc("bound"), "bucket")
        later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        whole = Window.partitionBy("_query")
        ranked = known.withColumn("before", F.sum("bound").over(later)).withColumn("all", F.sum("bound").over(whole))
        return stage(ranked.withColumn("first", F.col("before") > (1 - FIRST_SHARE) * F.col("all")).drop("all"), "wanted")

    def _added(self, wanted: DataFrame) -> DataFrame:
        """(query, key, score) summed over the lists of ``wanted``, which are a few buckets of a few queries."""
        asked = wanted.select("_query", "bucket", F.col("weight").alias("_weight"))
        named = asked.select("bucket").distinct()
        # as literals for a bounded number of lists, so that files without them are not read
        few = [r["bucket"] for r in named.limit(MOST_LITERALS + 1).collect()]
        lists = self.postings if len(few) > MOST_LITERALS else self.postings.filter(F.col("bucket").isin(few))
        met = lists.join(broadcast_within(asked), "bucket")
        met = met.select("_query", "_weight", F.inline(F.arrays_zip(F.col("key").alias(self.key), "weight")))
        parts = met.select("_query", self.key, (F.col("_weight") * F.col("weight")).alias("score"))
        return stage(self._summed(parts), "added")

    def _summed(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("_query", self.key).agg(F.sum("score").alias("score"))

    def _kth(self, sums: DataFrame, k: int) -> DataFrame:
        """(query, kth): the k-th best sum of the queries that have k."""
        order = Window.partitionBy("_query").orderBy(F.desc("score"))
        ranked = sums.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
        return ranked.groupBy("_query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))

    def _remainder(self, left: DataFrame, unread: DataFrame) -> DataFrame:
        """What the unread lists add to the texts of ``left``, from those texts' own vectors."""
        pairs = left.select("_query", self.key)
        held = self.vectors.join(broadcast_within(pairs), self.key)
        entries = held.select("_query", self.key, F.inline(F.arrays_zip("_vector.bucket", "_vector.weight")))
        asked = unread.select("_query", "bucket", F.col("weight").alias("_weight"))
        met = entries.join(broadcast_within(asked), ["_query", "bucket"])
        return met.select("_query", self.key, (F.col("_weight") * F.col("weight")).alias("score"))

    def _best(self, scored: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("_query").orderBy("distance", self.key)
        return scored.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")

    def _filling(self, asked: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """The least keys at distance 1 for the queries that fewer than ``k`` texts share a word with."""
        counts = best.groupBy("_query").agg(F.count(F.lit(1)).alias("n"))
        short = asked.join(counts, "_query", "left").filter(F.coalesce("n", F.lit(0)) < k).select("_query")
        least = [r[self.key] for r in self.vectors.select(self.key).orderBy(F.asc_nulls_last(self.key)).limit(2 * k).collect()]
        if not least:
            return best.limit(0)
        offered = short.select("_query", F.explode(F.array(*[F.lit(x) for x in least])).alias(self.key))
        return offered.join(best, ["_query", self.key], "left_anti").withColumn("distance", F.lit(1.0))
