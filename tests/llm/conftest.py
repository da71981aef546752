"""Frames with the awkward cases that every operator must take."""

import pytest

LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
FOX = "the quick brown fox jumps over the lazy dog while seven wizards mix a strong potion for the old king today"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, FOX, "en", "a"), (2, FOX, "en", "a"), (2, FOX, "en", "a"), (3, None, "en", "b"), (4, "", None, None),
        (None, FOX + " again", "fr", "b"), (None, None, None, None), (5, " \n\t ", "de", "b"), (6, "12 34!", "de", None),
        (7, LONG, "en", "a"), (8, "one two", "en", "a"), (9, "ONE two", "en", "c"),
    ]
    rows = [(i, t, lang, s, 0, "clash", 7.5, [1], "k") for i, t, lang, s in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double, "
              "items array<int>, key string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
