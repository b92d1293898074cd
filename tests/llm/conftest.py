from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rk string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of documents from texts; two extra columns clash with names the operators use."""

    def make(texts, ids=None, lang="en", source="s"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, source, len(t or ""), "own", "own") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make
