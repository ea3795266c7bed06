import pytest

#: The columns of documents, and others whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, n int, id long, _gone string, _starts string, rid long, pos int, `a b` string, _again long, _t double, _EPOCH int, _text string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, with clashing columns, from (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or ""), "k", 1, 2, 3, "g", "s", 4, 5, "x", 6, 7.0, 8, "t") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [(None, "a text without an id, kept as it is"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, words), (6, "é" * 300_000), (7, "same text here"), (8, "same text here"), (8, "same text here"), (9, "x", None, None)]
