from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 997}" for i in range(40_000)) + "."
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, position string, tokens string, rank string, _n int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "A clean sentence about the weather in the north of the country.", "en", "a"),
        (1, "A clean sentence about the weather in the north of the country.", "en", "a"),
        (2, "A clean sentence about the weather in the north of the country.", "en", "b"),
        (3, "", "en", "a"),
        (4, " \n\t ", "en", "a"),
        (5, None, "en", "a"),
        (None, "A text without a number of its own stands here.", "en", "a"),
        (None, None, None, None),
        (6, "Another text, of no language and no source.", None, None),
        (7, LONG, "en", "b"),
        (8, "x", "en", "b"),
        (9, "ж" * 70 + " \U0001f600 end.", "ru", "c"),
        (1, "The same number but another text.", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", "p", "t", "r", 0) for r in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
