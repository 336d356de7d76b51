import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import literal_rows as rows
from tallyhouse.functions.text import preview, word_buckets, words
from tallyhouse.functions.vectors import cosine_distance
from tallyhouse.operators.embedding import bucket_words, embed_corpus, fit_embedder
from tallyhouse.operators.vector_search import nearest, nearest_for_each
from tallyhouse.plans.surveys import search_texts, search_texts_for_each


def _distance(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def test_cosine_distance(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 2.0])],
        "a array<float>, b array<double>",
    )
    got = [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.0) and got[2:] == [None, None, None]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 8))
    points[50:150] = points[0]  # a third of the vectors are copies of one
    points[200] = 0
    data = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    data.append((300, None))
    return spark.createDataFrame(data, "id long, v array<double>").repartition(5), points


def test_nearest(spark, corpus):
    df, points = corpus
    target = [float(x) for x in points[7]]
    query = spark.createDataFrame([(target,)], "q array<double>")
    got = [(r["id"], r["distance"]) for r in nearest(df, query, 4, key="id", vector="v").collect()]
    usable = [i for i in range(300) if i != 200]
    best = sorted(usable, key=lambda i: (round(_distance(points[i], target), 12), i))[:4]
    assert [i for i, _ in got] == best
    assert got[0][1] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("block", [2, 100])
def test_nearest_for_each_matches_brute_force(spark, corpus, block):
    df, points = corpus
    asked = {f"q{i}": points[i] for i in (0, 9, 60, 250)}
    queries = spark.createDataFrame(
        [(k, [float(x) for x in v]) for k, v in asked.items()] + [("none", None), ("zero", [0.0] * 8)],
        "q string, qv array<double>",
    )
    found = nearest_for_each(df, queries, 5, key="id", vector="v", query_key="q", query_vector="qv", block=block)
    got = sorted((r["q"], r["id"]) for r in found.collect())
    usable = [i for i in range(300) if i != 200]
    expected = [
        (k, i) for k, v in asked.items() for i in sorted(usable, key=lambda i: (round(_distance(points[i], v), 12), i))[:5]
    ]
    assert got == sorted(expected)


def test_no_queries(spark, corpus):
    df, _ = corpus
    queries = spark.createDataFrame([], "q string, qv array<double>")
    assert nearest_for_each(df, queries, 5, key="id", vector="v", query_key="q", query_vector="qv").count() == 0


def test_words(spark):
    df = spark.createDataFrame([("Été, l'ÉTÉ 2024!\nÜber-all",), ("",), ("?!",), (None,)], "t string")
    got = [r[0] for r in df.select(words(F.col("t"))).collect()]
    assert got == [["été", "l", "été", "2024", "über", "all"], [], [], None]
    assert df.select(preview(F.col("t"), 4)).first()[0] == "Été,"


def _bucket(word, dim):
    return zlib.crc32(word.encode()) % dim


def _embed(texts, dim):
    lists = [[_bucket(w, dim) for w in re.findall(r"[^\W_]+", t.lower())] for t in texts]
    n = len(texts)
    weights = [math.log((n + 1) / (sum(b in x for x in lists) + 1)) for b in range(dim)]
    vectors = np.array([[x.count(b) * weights[b] for b in range(dim)] for x in lists])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return weights, np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def test_embedding_matches_plain_python(spark):
    texts = [t for _, t in rows.TEXTS] + ["", "walkway walkway walkway metal"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, t string")
    dim = 32
    buckets = df.select(word_buckets(F.col("t"), dim)).first()[0]
    assert buckets == [_bucket(w, dim) for w in re.findall(r"[^\W_]+", texts[0].lower())]
    embedder, vectors = embed_corpus(df, "id", "t", "v", dim)
    weights, _ = _embed(texts, dim)
    n = len(texts) + 1  # the NULL text counts as a row without words
    full = [embedder.weights.get(b, embedder.unseen) for b in range(dim)]
    assert full == pytest.approx([w + math.log((n + 1) / n) for w in weights])
    got = {r["id"]: _dense(r["v"], dim) for r in vectors.collect()}
    assert got[99] is None and got[4] == [0.0] * dim
    raw = np.array([[_count(texts[i], b, dim) * full[b] for b in range(dim)] for i in range(6)])
    for i in (0, 1, 2, 3, 5):
        assert got[i] == pytest.approx(raw[i] / np.linalg.norm(raw[i]))
    again = {r["id"]: _dense(r["v"], dim) for r in embedder.transform(df, "id", "t", "v").collect()}
    assert again == got


def _dense(entries, dim):
    if entries is None:
        return None
    out = [0.0] * dim
    for bucket, weight in zip(entries["bucket"], entries["weight"]):
        out[bucket] = weight
    return out


def _count(text, bucket, dim):
    return sum(_bucket(w, dim) == bucket for w in re.findall(r"[^\W_]+", text.lower()))


def test_empty_corpus(spark):
    embedder = fit_embedder(bucket_words(spark.createDataFrame([], "id long, t string"), "id", "t", 8), 8)
    assert embedder.weights == {} and embedder.unseen == 0.0


def test_text_search_finds_shared_words(spark):
    df = spark.createDataFrame(rows.TEXTS, "survey_filename string, content string")
    found = search_texts(df, "puddles of hydraulic fluid on the aisle", 2, key="survey_filename", text="content")
    got = found.collect()
    assert got[0]["survey_filename"] == "summit-foundry"
    assert len(got) == 2 and got[0]["cosine_distance"] < got[1]["cosine_distance"]
    questions = spark.createDataFrame([(1, "dual interlock safety switches"), (2, "footwear tread depth")], "q long, words string")
    each = search_texts_for_each(df, questions, 1, key="survey_filename", text="content", question_key="q", question="words")
    assert {r["q"]: r["survey_filename"] for r in each.collect()} == {1: "atlas-forging", 2: "precision-castings"}


def test_long_texts_keep_their_neighbours(spark):
    """Many distinct words: no bucket is common to all texts, so that weights stay above zero."""
    long = [" ".join(f"w{i}x{j}" for j in range(3000)) + f" shared{i // 2}" * 20 for i in range(20)]
    df = spark.createDataFrame(list(enumerate(long)), "id long, t string")
    found = search_texts(df, "shared3 shared3", 2, key="id", text="t")
    assert [r["id"] for r in found.collect()] == [6, 7]


def test_unequal_lengths_and_unsound_numbers_have_no_distance(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [0.5, 0.5]), (6, [])],
        "id long, v array<double>",
    )
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [r["id"] for r in nearest(df, query, 9, key="id", vector="v").collect()] == [1, 5]
    with pytest.raises(Exception, match="more than one"):
        nearest(df, query.union(query), 1, key="id", vector="v").collect()


def test_words_are_counted_in_bounded_pieces(tmp_path):
    """A batch of long texts takes the memory of a piece, not that of the batch, and gives the same vectors."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tallyhouse.operators import embedding

    dim, rng = 1 << 12, np.random.default_rng(3)
    pq.write_table(pa.table({"bucket": pa.array(range(dim), pa.int32()), "weight": np.linspace(0.5, 2.0, dim)}), f"{tmp_path}/w.parquet")
    lengths = [0, 300_000, 3, *[40_000] * 60, 0]
    flat = rng.integers(0, dim, sum(lengths)).astype("int32")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32")), pa.array(flat))
    keys = pa.array(range(len(lengths)), pa.int64())
    mask = [k == len(lengths) - 1 for k in range(len(lengths))]
    lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(mask))
    count = embedding._count_words(dim, f"file://{tmp_path}", 3.0, "id", "v")
    tracemalloc.start()
    parts = list(count(iter([pa.RecordBatch.from_arrays([keys, lists], names=["id", "words"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35_000_000  # some 100 bytes a word of the longest text
    got = {r["id"]: r["v"] for part in parts for r in part.to_pylist()}
    assert list(got) == list(range(len(lengths))) and got[0] == {"bucket": [], "weight": []} and got[63] is None
    weights, ends = np.linspace(0.5, 2.0, dim), np.cumsum(lengths)
    for k in (1, 2, 30):
        expected = np.bincount(flat[ends[k] - lengths[k] : ends[k]], minlength=dim) * weights
        dense = np.zeros(dim)
        dense[got[k]["bucket"]] = got[k]["weight"]
        assert np.allclose(dense, expected / np.linalg.norm(expected))


def test_long_sparse_vectors_meet_queries_in_bounded_slices(tmp_path):
    """Long vectors, and queries of many buckets, take the memory of a slice, and the nearest are those of a direct product."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tallyhouse.operators import vector_search

    dim, rng = 1 << 15, np.random.default_rng(4)

    def sparse(n, each):
        buckets = np.sort(np.argsort(rng.random((n, dim)), axis=1)[:, :each], axis=1).astype("int32")
        offsets = pa.array(np.arange(n + 1, dtype="int32") * each)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (buckets, rng.random((n, each)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int64()), pa.StructArray.from_arrays(lists, names=["bucket", "weight"])], names=["id", "v"]
        )

    corpus, asked = sparse(250, 16_000), sparse(160, 300)
    pq.write_table(pa.Table.from_batches([asked]), f"{tmp_path}/q.parquet")
    search = vector_search._search(f"file://{tmp_path}", 2, True, 256, ["q", "id", "distance"])
    tracemalloc.start()
    parts = list(search(iter([corpus])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000  # all 4 million entries at once take over 250 MB

    def dense(batch):
        out = np.zeros((batch.num_rows, dim))
        for k, v in enumerate(batch.column(1).to_pylist()):
            out[k, v["bucket"]] = v["weight"]
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    distances = 1 - dense(asked) @ dense(corpus).T
    found = sorted((r["q"], round(r["distance"], 9), r["id"]) for part in parts for r in part.to_pylist())
    for q in (0, 1, 80, 159):
        best = np.argsort(distances[q])[:2]
        assert [r[2] for r in found if r[0] == q][:2] == best.tolist()
