import pytest

LONG = "word " * 40_000 + "end"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "The same text here today.", "en", "a", 25, "x", 1, "t"), (2, "The  same\ttext here\ntoday.", "en", "a", 25, "x", 2, "t"),
        (2, "The  same\ttext here\ntoday.", "en", "a", 25, "x", 2, "t"), (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "x", 4, "t"), (5, " \t\n ", "en", None, 4, "x", 5, "t"), (None, "no id at all", "en", "b", 12, "x", 6, "t"),
        (7, LONG, "en", "b", len(LONG), "x", 7, "t"), (8, "kurz", None, "b", None, "x", 8, "t"),
        (9, "Ünïcödé 日本語 😀 text", "de", "c", 20, "x", 9, "t"), (10, "12345 !!", "de", "c", 8, "x", 10, "t"),
        (11, "the SAME text here today.", "fr", "c", 25, "x", 11, "t"), (5, "other text with the same id", "fr", "a", 27, "x", 12, "t"),
    ]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, "
              "norm string, h long, component string")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
