from __future__ import annotations

import pytest


@pytest.fixture(scope="module")
def docs(spark):
    """Makes a documents table from texts; ids are their positions unless given, with a clashing extra column."""

    def make(texts, ids=None):
        rows = [(k if ids is None else ids[k], t, "en", "s", None if t is None else len(t), "clash") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")

    return make
