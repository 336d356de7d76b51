"""An index of dense vectors that answers exact nearest-vector queries from a part of its files.

Vectors are scaled to unit length, where the cosine distance is half the square of the Euclidean one, and every vector
belongs to its nearest centre. A cluster is a folder; the table of clusters holds each one's centre, number of rows and
the least and largest distance of a row to the centre. A search works in two rounds:

1. Each query reads the clusters nearest to it that hold k rows together. Its k-th distance there is its limit.
2. By the triangle inequality, a cluster can only hold a nearer row if the query's distance to the centre, plus or minus
   the limit, meets the distances of the cluster's rows. Those clusters are read, and of each only the rows whose own
   distance to the centre lies within that range are compared.

Centres come from at most ``SAMPLE_ROWS`` rows, the least by a hash of the key; all rows are indexed, and results do not
depend on the centres. Vectors of a length that the sample lacks share one cluster per length, which is always read.

A vector that is missing, zero, or holds null or non-finite numbers is not indexed and has no results, as in
``vector_search``; distances are compared at 12 digits and ties broken by key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.vector_search import smallest_in_rows
from tallyhouse.session import arrow_uri, scratch_path, stage
from tallyhouse.sources.files import write_partitioned

#: Rows that centres are fitted on, centres at most, and rounds of the fit.
SAMPLE_ROWS, MOST_CLUSTERS, ROUNDS = 8192, 4096, 6

#: Rows of a cluster that meet queries at once, and queries of a block.
ROWS, BLOCK = 16_384, 64

#: What rounding may take from a distance, cosine and Euclidean.
COSINE_SLACK, SLACK = 2e-12, 1e-9

CLUSTERS = "cluster long, dim int, n_rows long, inner double, outer double"
VISITS = "_query long, cluster long, away double, reach double, unit array<double>"


@dataclass(frozen=True)
class Search:
    """``found`` has (query_key, key, distance); ``visits`` the clusters that each query read, with their rows."""

    found: DataFrame
    visits: DataFrame
    queries: DataFrame

    def share_read(self, index: DenseIndex) -> float:
        """Rows of the clusters read, over all pairs of a query and a row."""
        pairs = self.visits.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
        rows = index.clusters().agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
        return pairs / max(rows * self.queries.count(), 1)


class DenseIndex:
    """An index that lies at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        facts = json.loads(spark.read.text(f"{self.path}/facts").first()["value"])
        self.schema = T.StructType.fromJson(facts["schema"])
        self.key, self.centres = self.schema.names[0], list(enumerate(facts["centres"]))

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str, *, key: str, vector: str, clusters: int | None = None, sample: int = SAMPLE_ROWS
    ) -> DenseIndex:
        """Index every row of ``corpus``; ``clusters`` is by default the square root of the rows, at most 4,096."""
        spark = corpus.sparkSession
        given = corpus.select(key, F.col(vector).cast("array<double>").alias("unit")).filter(F.col("unit").isNotNull())
        units = given.mapInArrow(_scaled(), given.schema)
        rows = units.orderBy(F.xxhash64(key), key).limit(sample).toPandas()
        wanted = min(clusters or max(1, round(corpus.count() ** 0.5)), MOST_CLUSTERS)
        centres = _fit_centres(rows["unit"], wanted)
        schema = T.StructType([*units.schema.fields, *_fields("away double, cluster long")])
        facts = json.dumps({"schema": schema.jsonValue(), "centres": centres})
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{path}/facts")
        assigned = units.mapInArrow(_assign(list(enumerate(centres)), schema.names), schema)
        write_partitioned(assigned, f"{path}/rows", "cluster")
        index = cls(spark, path)
        summary = index._rows().groupBy("cluster").agg(
            F.first(F.size("unit")).alias("dim"),
            F.count(F.lit(1)).alias("n_rows"),
            F.min("away").alias("inner"),
            F.max("away").alias("outer"),
        )
        summary.coalesce(1).write.parquet(f"{path}/clusters")
        return index

    def clusters(self) -> DataFrame:
        """One row a cluster; at most ``MOST_CLUSTERS``, and one for each length that the sample lacked."""
        return self.spark.read.schema(CLUSTERS).parquet(f"{self.path}/clusters")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, *, query_key: str, query_vector: str) -> Search:
        """The ``k`` nearest rows of every query row, as (query_key, key, distance)."""
        given = queries.select(
            F.monotonically_increasing_id().alias("_query"),
            F.col(query_key),
            F.col(query_vector).cast("array<double>").alias("unit"),
        )
        # numbered once, before anything is read from it
        numbered = stage(given, "queries")
        asked = numbered.select("_query", "unit").filter(F.col("unit").isNotNull())
        units = stage(asked.mapInArrow(_scaled(), asked.schema), "units")
        table = [tuple(r) for r in self.clusters().collect()]
        near = units.mapInArrow(_nearest_clusters(table, self.centres, k), VISITS)
        first, first_found = self._visit(near, k)
        reach = first_found.groupBy("_query").agg(
            F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("distance")
        )
        limits = units.join(reach, "_query", "left")
        further, found = self._visit(limits.mapInArrow(_further_clusters(table, self.centres, k), VISITS), k)
        ranked = self._ranked(first_found.unionAll(found), k)
        result = numbered.join(ranked, "_query").select(query_key, self.key, "distance")
        visits = first.unionAll(further).join(F.broadcast(self.clusters().select("cluster", "n_rows")), "cluster")
        return Search(result, visits.select("_query", "cluster", "n_rows"), units)

    def _visit(self, visits: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query, cluster) of ``visits``, and the ``k`` best rows that each query found there, once written."""
        path = scratch_path(self.spark, "visits")
        write_partitioned(visits, path, "cluster")
        stored = self.spark.read.schema(VISITS).parquet(path).select("_query", "cluster")
        # as literals, so that the folders of other clusters are not listed
        named = [r["cluster"] for r in stored.select("cluster").distinct().collect()]
        rows = self._rows().filter(F.col("cluster").isin(named)).select(self.key, "unit", "away", "cluster")
        schema = T.StructType([*_fields("_query long"), self.schema[self.key], *_fields("distance double")])
        found = rows.mapInArrow(_compare(arrow_uri(path), k, schema.names, smallest_in_rows(k)), schema)
        return stored, stage(self._ranked(found, k), "found")

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("_query").orderBy("distance", self.key)
        return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _fit_centres(units, wanted: int) -> list[list[float]]:
    """Centres of the sample's vectors, per length in proportion to its share; some rounds of spherical k-means."""
    import numpy as np

    lengths = np.array([len(u) for u in units], dtype=int)
    centres = []
    for d in np.unique(lengths):
        points = np.array([u for u, n in zip(units, lengths) if n == d])
        count = min(len(points), max(1, round(wanted * len(points) / len(lengths))))
        means = points[np.linspace(0, len(points) - 1, count).astype(int)]
        for _ in range(ROUNDS):
            nearest = (points @ means.T).argmax(axis=1)
            sums = np.zeros_like(means)
            np.add.at(sums, nearest, points)
            norms = np.linalg.norm(sums, axis=1)
            means = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], means)
        centres += np.unique(means, axis=0).tolist()
    return centres


def _scaled():
    """Rows with a direction, with their vectors at unit length."""

    def scale(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype("int64")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
            row = np.repeat(np.arange(len(lists)), lengths)
            most = np.zeros(len(lists))
            np.maximum.at(most, row, np.abs(flat))
            with np.errstate(all="ignore"):
                # in two steps, so that squares neither overflow nor vanish
                flat = flat / most[row]
                norms = np.sqrt(np.bincount(row, weights=flat * flat, minlength=len(lists)))
                keep = np.isfinite(norms) & np.isfinite(most) & (norms > 0)
                flat = (flat / norms[row])[keep[row]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths[keep])]).astype("int32"))
            kept = batch.column(0).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept, pa.ListArray.from_arrays(offsets, flat)], names=batch.schema.names)

    return scale


def _assign(centres, names: list[str]):
    """Each row's nearest centre and the distance to it; a length without centres has the cluster -1 - length."""

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        by_length = {}
        for cluster, centre in centres:
            by_length.setdefault(len(centre), []).append((cluster, centre))
        by_length = {d: (np.array([c for c, _ in own]), np.array([x for _, x in own])) for d, own in by_length.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                cluster, away = -1 - lengths, np.ones(len(lengths))
                for d in np.unique(lengths):
                    if int(d) in by_length:
                        numbers, means = by_length[int(d)]
                        rows = np.flatnonzero(lengths == d)
                        points = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                        nearest = (points @ means.T).argmax(axis=1)
                        cluster[rows] = numbers[nearest]
                        away[rows] = np.linalg.norm(points - means[nearest], axis=1)
                arrays = [*part.columns, pa.array(away), pa.array(cluster.astype("int64"))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return assign


def _in_order(table, centres):
    """A function from a query to (distance to the centre, cluster, rows, inner, outer) of its length, nearest first."""
    known = dict(centres)

    def prepare():
        import numpy as np

        lengths = {}
        for cluster, d, n_rows, inner, outer in table:
            lengths.setdefault(d, []).append((cluster, n_rows, inner, outer, known.get(cluster, [0.0] * d)))
        held = {d: ([c[:4] for c in own], np.array([c[4] for c in own])) for d, own in lengths.items()}

        def of(unit):
            if len(unit) not in held:
                return []
            clusters, means = held[len(unit)]
            away = np.linalg.norm(means - np.array(unit), axis=1)
            return [(float(away[k]), *clusters[k]) for k in np.argsort(away, kind="stable")]

        return of

    return prepare


def _visit_rows():
    def rows_of(rows):
        import pyarrow as pa

        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        names = ["_query", "cluster", "away", "reach", "unit"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows_of


def _first_clusters(k: int):
    """How many of the nearest clusters hold ``k`` rows together."""

    def first(listed):
        total = 0
        for n, entry in enumerate(listed):
            if total >= k:
                return n
            total += entry[2]
        return len(listed)

    return first


def _nearest_clusters(table, centres, k: int):
    prepare, first, rows_of = _in_order(table, centres), _first_clusters(k), _visit_rows()

    def visit(batches):
        order = prepare()
        for batch in batches:
            rows = []
            for query, unit in zip(*(c.to_pylist() for c in batch.columns)):
                listed = order(unit)
                rows += [(query, e[1], e[0], 3.0, unit) for e in listed[: first(listed)]]
            yield rows_of(rows)

    return visit


def _further_clusters(table, centres, k: int):
    prepare, first, rows_of = _in_order(table, centres), _first_clusters(k), _visit_rows()
    cosine_slack, slack = COSINE_SLACK, SLACK

    def visit(batches):
        order = prepare()
        for batch in batches:
            rows = []
            for query, unit, distance in zip(*(c.to_pylist() for c in batch.columns)):
                # no two unit vectors are further apart than 2
                reach = 3.0 if distance is None else (2 * (max(distance, 0.0) + cosine_slack)) ** 0.5 + slack
                listed = order(unit)
                for away, cluster, _, inner, outer in listed[first(listed) :]:
                    if inner - reach <= away <= outer + reach:
                        rows.append((query, cluster, away, reach, unit))
            yield rows_of(rows)

    return visit


def _compare(stored: str, k: int, names: list[str], smallest):
    rows_at_once, queries_at_once = ROWS, BLOCK

    def compare(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as pads
        import pyarrow.fs as pafs

        system, place = pafs.FileSystem.from_uri(stored)

        def slices():
            """(cluster, rows of it), bounded."""
            for batch in batches:
                cluster = batch.column(3).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]
                for a, b in zip(cuts, cuts[1:]):
                    for at in range(a, b, rows_at_once):
                        yield int(cluster[at]), batch.slice(at, min(rows_at_once, b - at))

        def matrix(lists):
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(lists), -1)

        for cluster, part in slices():
            away = part.column(2).to_numpy()
            order = np.argsort(away, kind="stable")
            away, points, keys = away[order], matrix(part.column(1))[order], part.column(0).take(pa.array(order))
            ids = keys.to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            asking = pads.dataset(f"{place}/cluster={cluster}", filesystem=system, format="parquet")
            for asked in asking.to_batches(batch_size=queries_at_once):
                if not asked.num_rows:
                    continue
                fields = {name: asked.column(name) for name in ("_query", "away", "reach", "unit")}
                low = np.searchsorted(away, fields["away"].to_numpy() - fields["reach"].to_numpy())
                high = np.searchsorted(away, fields["away"].to_numpy() + fields["reach"].to_numpy(), "right")
                first, end = int(low.min()), int(high.max())
                if first >= end:
                    continue
                # all queries of the block meet the rows that any of them needs: more rows change nothing
                distances = np.round(1.0 - matrix(fields["unit"]) @ points[first:end].T, 12)
                by_id = np.argsort(ids[first:end], kind="stable")
                query, row = smallest(distances[:, by_id])
                arrays = [
                    fields["_query"].take(pa.array(query)),
                    keys.take(pa.array(first + by_id[row])),
                    pa.array(distances[query, by_id[row]]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return compare
