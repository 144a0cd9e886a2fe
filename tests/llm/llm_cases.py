import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with names that the operators use inside.
CLASHING = "_row string, n string, node string, label string, score string, left string, token string, size string"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with extra columns of clashing names."""

    def build(*pairs):
        rows = [(i, t, "en", "s", len(t) if t is not None else None, *"abcdefgh") for i, t in pairs]
        return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}")

    return build
