import pytest

from tests.oracle import ROOT

SF = f"{ROOT}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, seed int, pii int, score double, h long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names the operators use themselves."""
    texts = [None, "", " ", "a", "Ünïcode 😀 text", "same text here for you", "same text here for you", "long word " * 30_000, "x" * 200_000]
    rows = [(i, t, "en" if i % 2 else None, None, None, "w", 1, 2, 0.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
