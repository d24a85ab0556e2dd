import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from a list of texts, or of (id, text[, source])."""

    def make(rows):
        full = [(i, r, "s") if not isinstance(r, tuple) else (*r, "s")[:3] for i, r in enumerate(rows)]
        df = spark.createDataFrame([(a, b, "en", c, len(b or "")) for a, b, c in full], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumnsRenamed({})

    return make
