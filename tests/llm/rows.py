import pytest

# Imported by the tests that need it: a second conftest would hide the one of the folder above.
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts, (id, text) or (id, text, source) tuples."""
    def make(items, extra=""):
        rows = []
        for i, x in enumerate(items):
            x = x if isinstance(x, tuple) else (i, x)
            text = x[1]
            rows.append((x[0], text, "en", x[2] if len(x) > 2 else "s0", None if text is None else len(text)))
        return spark.createDataFrame(rows, DOC_SCHEMA)
    return make
