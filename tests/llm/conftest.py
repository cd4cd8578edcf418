import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents frame from (doc_id, text) pairs, with an extra column of a clashing name."""
    def make(rows, schema=DOCS + ", n_words string, key string"):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", None) for i, t in rows], schema)
    return make
