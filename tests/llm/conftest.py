"""Small tables for the tests of the text operators."""

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of texts (ids from 0 on) or of (id, text) pairs."""
    def make(rows):
        rows = [row if isinstance(row, tuple) else (i, row) for i, row in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC_SCHEMA)
    return make


@pytest.fixture
def awkward(documents):
    """Nulls in every column, empty and blank texts, repeated rows and ids."""
    docs = documents([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "other words"), (2, None),
                      (3, ""), (4, " \n\t "), (None, "alpha beta gamma delta"), (None, None),
                      (5, "é ü 日本 🙂 <|endoftext|>")])
    return docs.selectExpr("doc_id", "text", "nullif(lang, 'en') AS lang", "source", "n_chars",
                           "'x' AS score", "1 AS _fp", "2 AS n_units", "3 AS _row")
