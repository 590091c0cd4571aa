from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, bucket string, blob string, score string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of documents, with columns whose names clash with inner ones."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in zip(ids, texts, strict=True)], DOCS)

    return make
