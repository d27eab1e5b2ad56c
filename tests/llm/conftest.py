import pytest

DOCS = "doc_id long, text string, lang string, source string, score double, shard int"


@pytest.fixture
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, with extra columns of clashing names."""
    rows = [(1, None, "en", "a", 0.5, 1), (2, "", None, None, None, None), (3, " \t\n", "en", "a", 1.0, 2), (4, "one two three four five six", "en", "b", 1.0, 2), (4, "one two three four five six", "en", "b", 1.0, 2),
            (None, "one two three four five six", "en", "b", 1.0, 2), (6, "word " * 30_000, "en", None, 1.0, 2), (7, "x" * 50_000, "de", "a", 1.0, 2), (8, "One TWO three four five six", "en", "b", 1.0, 2), (9, "123 456 !!", "en", "c", 1.0, 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
