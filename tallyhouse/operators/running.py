"""Summaries that are kept up from a table's commits, each of which is read once.

For every key a summary holds mergeable states of some measures: number, sum, mean and sum of squared deviations from it. An
update reads the rows that were added since the last one, aggregates them to one state a key, and appends those to a
versioned table with the source's snapshot as its batch, so that an update that is run again adds nothing. States of a
key are merged when the summary is read; after ``FOLD_AFTER`` updates they are folded to one a key. A source whose
rows were changed or replaced is summarised anew.

Distinct values are counted by HyperLogLog sketches, which states hold beside the measures and which are united when the
summary is read. An estimate's standard error is about 1.04 / sqrt(2^``SKETCH_BITS``), 0.8 %; few values are counted exactly.

Null measures don't count; a null key is a key; a measure without values has null results, and a deviation needs two.
Null values are not counted as distinct ones, and a key without values has none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.sources.versions import VersionedTable

#: Updates after which states are folded.
FOLD_AFTER = 32

#: Binary logarithm of a sketch's registers: at most 16 KB for a key, less for one of few values.
SKETCH_BITS = 14


class RunningSummary:
    """The summary at ``path`` by ``keys`` of ``measures``, named columns of the source.

    Of ``distinct``, named columns too (whole numbers, strings or binary), different values are estimated.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Mapping[str, Column],
        measures: Mapping[str, Column],
        distinct: Mapping[str, Column] | None = None,
    ):
        self.keys, self.measures, self.distinct = dict(keys), dict(measures), dict(distinct or {})
        self.states = VersionedTable(spark, path)

    @classmethod
    def create(
        cls,
        source: VersionedTable,
        path: str,
        keys: Mapping[str, Column],
        measures: Mapping[str, Column],
        distinct: Mapping[str, Column] | None = None,
    ) -> RunningSummary:
        summary = cls(source.spark, path, keys, measures, distinct)
        VersionedTable.create(source.spark, path, summary._partial(source.read()).schema)
        return summary

    def update(self, source: VersionedTable) -> int:
        """Take in what was committed since the last update; returns how many rows were read."""
        now = source.current_snapshot_id()
        batches = [e["batch"] for e in self.states.entries() if e["batch"] is not None]
        last = batches[-1] if batches else None
        if now is None or now == last:
            return 0
        try:
            added = source.added_since(last, now)
        except ValueError:
            added = source.read(now)
            self.states.replace(self._partial(added), batch=now)
        else:
            self.states.append(self._partial(added), batch=now)
            if len(batches) >= FOLD_AFTER and self._commits() > FOLD_AFTER:
                self.states.replace(self._merged(), "fold", batch=now)
        return added.count()

    def read(self) -> DataFrame:
        """The keys, of each measure m ``m_n``, ``m_sum``, ``m_mean`` and ``m_stddev`` (of a sample), and of each distinct
        column d ``d_distinct``."""
        columns = [F.col(k) for k in self.keys]
        for m in self.measures:
            deviation = F.when(F.col(f"{m}_n") > 1, F.sqrt(F.col(f"{m}_m2") / (F.col(f"{m}_n") - 1)))
            columns += [F.col(f"{m}_n"), F.col(f"{m}_sum"), F.col(f"{m}_mean"), deviation.alias(f"{m}_stddev")]
        columns += [F.hll_sketch_estimate(f"{d}_sketch").alias(f"{d}_distinct") for d in self.distinct]
        return self._merged().select(*columns)

    def _commits(self) -> int:
        """Commits since the states were last folded."""
        n = 0
        for entry in self.states.entries():
            n = 0 if entry["replaces"] else n + (entry["folder"] is not None)
        return n

    def _partial(self, rows: DataFrame) -> DataFrame:
        """One state a key; rows are folded in each task before they are exchanged."""
        named = rows.select(*[c.alias(k) for k, c in self._columns().items()])
        states = []
        for m in self.measures:
            n = F.count(m)
            squares = F.coalesce(F.var_pop(m), F.lit(0.0)) * n
            states += [n.alias(f"{m}_n"), F.sum(m).alias(f"{m}_sum"), F.avg(m).alias(f"{m}_mean"), squares.alias(f"{m}_m2")]
        states += [F.hll_sketch_agg(f"_distinct_{d}", F.lit(SKETCH_BITS)).alias(f"{d}_sketch") for d in self.distinct]
        return named.groupBy(*self.keys).agg(*states)

    def _columns(self) -> dict[str, Column]:
        """A distinct column may bear the name of a key or measure."""
        return {**self.keys, **self.measures, **{f"_distinct_{d}": c for d, c in self.distinct.items()}}

    def _merged(self) -> DataFrame:
        """One state a key, of all its states; a key has at most one for each commit since the last fold."""
        whole, states = Window.partitionBy(*self.keys), self.states.read()
        # deviations of the means from the mean of all are squared as such: no difference of large squares is taken
        for m in self.measures:
            known = F.coalesce(f"{m}_mean", F.lit(0.0)) * F.col(f"{m}_n")
            count = F.nullif(F.sum(f"{m}_n").over(whole), F.lit(0))
            states = states.withColumn(f"_{m}", F.sum(known).over(whole) / count)
        merged = []
        for m in self.measures:
            n, apart = F.col(f"{m}_n"), F.coalesce(F.col(f"{m}_mean") - F.col(f"_{m}"), F.lit(0.0))
            merged += [
                F.sum(n).alias(f"{m}_n"),
                F.sum(f"{m}_sum").alias(f"{m}_sum"),
                F.first(f"_{m}").alias(f"{m}_mean"),
                F.sum(F.col(f"{m}_m2") + n * apart * apart).alias(f"{m}_m2"),
            ]
        merged += [F.hll_union_agg(f"{d}_sketch").alias(f"{d}_sketch") for d in self.distinct]
        return states.groupBy(*self.keys).agg(*merged)
