"""Small tables that hold every odd case at once."""

import pytest

DOCS = "doc_id long, text string, row_hash long, mark string, key string, item string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and repeated rows, a very long text, and columns that clash."""
    long_text = "lorem ipsum dolor sit amet " * 8_000
    rows = [
        (1, "one two three four five six", 1, "m", "k", "i"),
        (1, "one two three four five six", 1, "m", "k", "i"),
        (2, "", None, None, None, None),
        (3, None, 5, "m", None, "i"),
        (None, "alpha beta gamma delta epsilon", 5, "m", "k", None),
        (None, None, None, None, None, None),
        (4, " \t\n ", 7, "m", "k", "i"),
        (5, long_text, 8, "m", "k", "i"),
        (6, "one two three four five six", 9, "m", "k", "i"),
        (-7, "É ünï 日本   x", 9, "m", "k", "i"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
