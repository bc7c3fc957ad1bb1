import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, component_id string, key string, node long"


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from rows (doc_id, text[, lang[, source]]), with extra columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", -1, "y", "z", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
