import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang, source]) tuples."""

    def make(rows, **extra):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make
