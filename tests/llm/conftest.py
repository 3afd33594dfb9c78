import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs or longer rows."""

    def make(*rows):
        full = [(*r, *(None, "s", 0)[len(r) - 2 :]) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
