import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and short texts, repeated rows, equal texts, and extra columns with names that are used inside."""
    long = " ".join(f"w{i}" for i in range(900)) + " idiot password=8f3a9c1d7e5b2a4f60 Licensed under CC BY-NC 4.0"
    rows = [
        (1, None), (2, ""), (3, "one"), (4, long), (5, long), (5, long), (6, "  \t\n "), (7, "Äpfel über日本 \U0001F600"),
        (None, "no id here"), (None, None), (8, "x" * 5000), (9, long + " tail"), (10, long.replace("w450", "other")),
    ]
    extra = "node long, place string, n string, score string, row string, tokens string, source string, lang string"
    data = [(i, t, 1, "p", "n", "s", "r", None if k % 2 else "t", None, "en") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)
