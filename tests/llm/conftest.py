import sys

import pytest

LONG = "The quick auditor did not review item 12. " * 3000


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows and column names that operators use inside."""
    rows = [
        (1, "One line here.\nAnother line there.", "a", "en", 1, "w", "x"),
        (1, "One line here.\nAnother line there.", "a", "en", 1, "w", "x"),
        (2, None, "a", None, None, None, None),
        (3, "", "a", "en", 3, "w", "x"),
        (4, " \n\t ", None, "EN", 4, "w", None),
        (5, LONG, "b", "en", 5, "w", "x"),
        (None, "a null id", "b", "de", 6, None, "x"),
        (6, "x" * 20000, "b", "en", 7, "w", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, block int, word string, key string")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string, block int, word string, key string")
