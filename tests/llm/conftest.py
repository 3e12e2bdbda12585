import pytest

LONG = "the quick brown fox jumps over the lazy dog again " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "One plain document of a dozen or so words that nobody repeats anywhere at all.", "en", "a", 78, "x", 1), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "", 3), (None, "a text without an id", "en", None, 20, "y", 4),
        (4, LONG, "en", "b", len(LONG), "z", 5), (5, " \t\n\r\x0b\x0c ", "fr", "b", 7, "w", 6), (6, "twin", "en", "a", 4, "v", 7), (6, "twin", "en", "a", 4, "v", 7), (7, "ligne une\nligne deux\nÉté à Noël", "fr", "c", 31, "u", 8), (None, None, None, None, None, None, None),
    ]
    # column names that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, size long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
