import pytest

#: columns that operators use inside, and more
EXTRA = "sig string, node string, n string, pos int, gone int, row int, k1 int, h string"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text, lang, source) tuples, with columns of clashing names."""

    def make(rows):
        full = [(*r, "en", "src")[:4] if len(r) == 2 else r for r in rows]
        held = [(*r, len(r[1]) if r[1] is not None else None, "x", "y", "z", 1, 2, 3, 4, "h") for r in full]
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
        return spark.createDataFrame(held, schema).repartition(3)

    return make
