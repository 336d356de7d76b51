"""Dense vectors against a direct singular value decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import dense_embedding
from tallyhouse.operators.dense_embedding import fit_dense


@pytest.fixture
def texts():
    rng = np.random.default_rng(7)
    topics = [[f"{t}{k}" for k in "abcdefghij"] for t in ("sea", "hill", "road", "loom")]
    return [" ".join(rng.choice(topics[k % 4], 30)) for k in range(200)] + [None, "", "sea"]


def _matrix(dense, df, n, dim):
    matrix = np.zeros((n, dim))
    for r in dense.embedder.transform(df, "id", "text", "v").collect():
        if r["v"] is not None:
            matrix[r["id"], r["v"]["bucket"]] = r["v"]["weight"]
    return matrix


def test_directions_are_those_of_a_direct_decomposition(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    dense, vectors = fit_dense(df, "id", "text", 8, dim=512)
    matrix = _matrix(dense, df, len(texts), 512)
    values = np.linalg.svd(matrix, compute_uv=False) ** 2
    best = values[:8].sum() / values.sum()
    assert best - 0.02 <= dense.captured <= best + 1e-6
    found = {r["id"]: r["vector"] for r in vectors.collect()}
    assert found[200] is None and found[201] == [0.0] * 8 and len(found) == len(texts)
    x = np.array([found[k] or [0.0] * 8 for k in range(len(texts))])
    assert (x**2).sum() == pytest.approx(dense.captured * (matrix**2).sum(), rel=1e-4)
    # texts of a topic are nearest to one another
    near = (x[:200] @ x[:200].T) - 2 * np.eye(200)
    assert (near.argmax(axis=1) % 4 == np.arange(200) % 4).mean() > 0.95
    again = {r["id"]: r["vector"] for r in dense.transform(df, "id", "text", "vector").collect()}
    assert np.allclose([again[k] for k in range(200)], x[:200])


def test_few_or_no_texts(spark):
    df = spark.createDataFrame([(0, "one two three"), (1, "one two four"), (2, "five six")], "id long, text string")
    dense, vectors = fit_dense(df, "id", "text", 8, dim=64)
    assert dense.captured == pytest.approx(1.0)
    x = np.array([r["vector"] for r in vectors.orderBy("id").collect()])
    assert np.allclose((x**2).sum(axis=1), 1.0, atol=1e-5) and x[0] @ x[1] > 0.1 and abs(x[0] @ x[2]) < 1e-5
    none, vectors = fit_dense(df.limit(0), "id", "text", 4, dim=64)
    assert none.captured == 0.0 and vectors.count() == 0
    nulls, vectors = fit_dense(df.withColumn("text", F.lit(None).cast("string")), "id", "text", 4, dim=64)
    assert [r["vector"] for r in vectors.collect()] == [None] * 3


def test_sums_by_bucket_are_sent_once_a_core(spark):
    """However many files the texts lie in, a pass sends at most a row a bucket from each core, and the sums are right."""
    rng, dim, width = np.random.default_rng(9), 64, 4
    texts = [(k, sorted(rng.choice(dim, 5, replace=False).tolist()), rng.random(5).tolist()) for k in range(400)]
    schema = "id long, _sparse struct<bucket:array<int>,weight:array<double>>"
    df = spark.createDataFrame([(k, (b, w)) for k, b, w in texts] + [(400, None), (401, ([], []))], schema).repartition(32)
    sums = dense_embedding._by_bucket(df, dim, None, width)
    signs = np.random.default_rng(514).integers(0, 2, (dim, width), dtype=np.int8) * 2.0 - 1
    matrix = np.zeros((400, dim))
    for k, b, w in texts:
        matrix[k, b] = w
    got = np.zeros((dim, width))
    for r in sums.collect():
        got[r["bucket"]] = r["x"]
    assert np.allclose(got, matrix.T @ (matrix @ signs)) and sums.count() == dim
    sent = dense_embedding._partial_sums(df, dim, None, width)
    assert sent.count() <= spark.sparkContext.defaultParallelism * dim
