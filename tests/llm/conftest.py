from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Rows with everything awkward: nulls, empty texts, repeated rows, ties, and columns of clashing names."""

    def make(texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        schema = "doc_id long, text string, lang string, source string, n_chars long, label string, times long, spans string, fp string, place string"
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 7, "y", "z", "p") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, schema)

    return make
