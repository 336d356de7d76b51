"""Searches of an index equal the exhaustive ones and read a part of the rows."""

import re

import numpy as np
import pytest

from tallyhouse import session
from tallyhouse.operators.embedding import embed_corpus
from tallyhouse.operators.text_index import TextIndex
from tallyhouse.operators.vector_index import DenseIndex
from tallyhouse.operators.vector_search import nearest_for_each


def _clustered(rng, n, d=16, groups=40, width=0.08):
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(groups, size=n)] + width * rng.normal(size=(n, d))


def _tables(spark, points, asked):
    corpus = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, v array<double>")
    queries = spark.createDataFrame([(f"q{k}", p.tolist()) for k, p in enumerate(asked)], "q string, w array<double>")
    return corpus.repartition(4), queries


def _both(spark, corpus, queries, k, **options):
    exact = nearest_for_each(corpus, queries, k, key="id", vector="v", query_key="q", query_vector="w")
    index = DenseIndex.build(corpus, session.scratch_path(spark, "index"), key="id", vector="v", **options)
    search = index.search(queries, k, query_key="q", query_vector="w")
    return sorted(map(tuple, exact.collect())), sorted(map(tuple, search.found.collect())), search.share_read(index)


@pytest.mark.parametrize(("k", "clusters"), [(1, None), (7, 50), (400, 10)])
def test_clustered_vectors(spark, k, clusters):
    rng = np.random.default_rng(k)
    points = _clustered(rng, 3000)
    corpus, queries = _tables(spark, points, points[rng.integers(3000, size=30)] + 0.02 * rng.normal(size=(30, 16)))
    exact, found, share = _both(spark, corpus, queries, k, clusters=clusters)
    assert found == exact and len(found) == 30 * k
    assert share < 0.2 or k == 400


def test_unclustered_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(300, 5)), np.tile(rng.normal(size=(1, 5)), (200, 1)), -np.ones((30, 5))])
    corpus, queries = _tables(spark, points, [points[310], points[0], 3 * np.ones(5), -points[310]])
    exact, found, _ = _both(spark, corpus, queries, 40)
    assert found == exact and len(found) == 160


def test_odd_vectors_and_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 1.0, 1.0])]
    rows += [(8, [float("inf"), 1.0]), (9, [1e300, 1e300]), (10, [1e-300, 2e-300]), (10, [1e-300, 2e-300]), (None, [0.5, 0.1])]
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame(
        [("a", [1.0, 0.1]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 1.0, 0.9]), ("e", [1.0] * 9), (None, [0.0, 1.0])],
        "q string, w array<double>",
    )
    for sample in (100, 1):
        index = DenseIndex.build(corpus, session.scratch_path(spark, "index"), key="id", vector="v", sample=sample)
        got = index.search(queries, 9, query_key="q", query_vector="w").found.collect()
        by_query = {}
        for r in sorted(got, key=lambda r: (r["distance"], r["id"] or 0)):
            by_query.setdefault(r["q"], []).append(r["id"])
        assert sorted(by_query["a"], key=str) == [1, 10, 10, 9, None]
        assert by_query["d"] == [7] and len(by_query[None]) == 5 and set(by_query) == {"a", "d", None}


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.0])], "q string, w array<double>")
    for corpus, queries in ((nothing, asked), (some, asked.limit(0))):
        index = DenseIndex.build(corpus, session.scratch_path(spark, "index"), key="id", vector="v")
        search = index.search(queries, 3, query_key="q", query_vector="w")
        assert search.found.count() == 0 and search.share_read(index) == 0


def test_a_query_reads_the_folders_of_its_clusters_only(spark):
    points = _clustered(np.random.default_rng(5), 2000)
    corpus, queries = _tables(spark, points, points[:1])
    path = session.scratch_path(spark, "index")
    DenseIndex.build(corpus, path, key="id", vector="v", clusters=30)
    index = DenseIndex(spark, path)
    visits = index.search(queries, 3, query_key="q", query_vector="w").visits
    read = {r["cluster"] for r in visits.collect()}
    assert 0 < len(read) < 10 < index.clusters().count()
    rows = index._rows().filter(f"cluster IN ({', '.join(map(str, read))})")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cluster#", plan)


def _texts(rng, n):
    """Words of very different frequency, as in prose."""
    share = 1 / np.arange(1, 801)
    return [" ".join(f"w{w}" for w in rng.choice(800, int(rng.integers(0, 40)), p=share / share.sum())) for _ in range(n)]


def test_posting_lists_equal_the_exhaustive_search(spark):
    rng = np.random.default_rng(6)
    texts = _texts(rng, 600)
    texts += [texts[5], texts[5], None, "", "only here twice", "only here twice"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    asked = [texts[5], texts[40] + " w3 w799", "w1 w2", "only here", "nowhere", "", None, "w0", "w700 w701 w702 w1"]
    queries = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(asked)], "q string, words string")
    embedder, vectors = embed_corpus(corpus, "id", "t", "v")
    index = TextIndex.build(corpus, session.scratch_path(spark, "texts"), key="id", text="t")
    for k in (2, 25):
        sought = embedder.transform(queries, "q", "words", "w")
        exact = nearest_for_each(vectors, sought, k, key="id", vector="v", query_key="q", query_vector="w")
        search = index.search(queries, k, query_key="q", text="words")
        got = sorted((r["q"], r["id"], round(r["distance"], 9)) for r in search.found.collect())
        assert got == sorted((r["q"], r["id"], round(r["distance"], 9)) for r in exact.collect())
        assert search.share_scored(index) < 0.6
    again = TextIndex(spark, index.path).search(queries.limit(1), 2, query_key="q", text="words")
    assert [r["id"] for r in again.found.orderBy("distance", "id").collect()] == [5, 600]


def test_a_text_index_of_nothing(spark):
    nothing = spark.createDataFrame([], "id long, t string")
    index = TextIndex.build(nothing, session.scratch_path(spark, "texts"), key="id", text="t")
    queries = spark.createDataFrame([("a", "some words")], "q string, words string")
    search = index.search(queries, 3, query_key="q", text="words")
    assert search.found.count() == 0 and search.share_scored(index) == 0


def test_posting_lists_lie_in_blocks(spark):
    """Building sorts a block for each bucket and batch of texts, not a row for each word of each text."""
    texts = _texts(np.random.default_rng(8), 400) + [None, ""]
    corpus = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(texts)], "id string, t string").repartition(2)
    index = TextIndex.build(corpus, session.scratch_path(spark, "texts"), key="id", text="t")
    entries = {
        (b, r["id"]): w for r in index.vectors.collect() for b, w in zip(r["_vector"]["bucket"], r["_vector"]["weight"])
    }
    blocks = index.postings.collect()
    assert {(r["bucket"], k): w for r in blocks for k, w in zip(r["key"], r["weight"])} == entries
    assert sum(len(r["key"]) for r in blocks) == len(entries) and len(blocks) < len(entries) / 3
    lists = {r["bucket"]: (r["length"], r["most"]) for r in index.lists.collect()}
    assert {b: n for b, (n, _) in lists.items()} == {b: sum(c == b for c, _ in entries) for b in lists}
    assert all(most == max(w for (c, _), w in entries.items() if c == b) for b, (_, most) in list(lists.items())[:20])
