import os

import pytest
from by_hand import DATA


@pytest.fixture(scope="session")
def data(spark):
    if not os.path.isdir(DATA):
        pytest.skip("sample tables absent")
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text) with columns whose names clash with what operators use inside."""
    def make(rows):
        kind = "doc_id long, text string, id long, h string, sha string, lang string, source string, n_chars long"
        return spark.createDataFrame([(i, t, 99, "x", "y", None, None, None) for i, t in rows], kind)
    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One word"), (4, "One word"), (5, "x " * 3000), (None, "null id"), (7, None)]


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, repeated rows."""
    return docs(ODD)
