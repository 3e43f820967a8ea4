"""Small tables for the training-data operators."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Build documents from texts; ids count from 0 unless given."""
    def build(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = [None] * len(texts) if langs is None else langs
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    from conftest import DATA

    return spark.read.parquet(f"{DATA}/documents.parquet")
