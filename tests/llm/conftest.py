from __future__ import annotations

import random

import pytest

#: Rows that every text operator must take: nulls, blanks, long and odd texts, repeated rows and ids.
ODD = [
    (1, "The cat sat on the mat and looked at the dog.\nThe cat sat on the mat and looked at the dog.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, " \t\n \x0b\x0c\r ", "fr", None),
    (5, "word " * 30_000, "en", "a"),
    (6, "Ünïcödé  ŁÓDŹ naïve　日本語 emoji 😀 İstanbul", "de", "b"),
    (6, "Ünïcödé  ŁÓDŹ naïve　日本語 emoji 😀 İstanbul", "de", "b"),
    (7, "one\n\ntwo \n three  \n", "en", "b"),
    (7, "another text under the same number", "en", "b"),
    (None, "a text without a number", None, None),
    (9, "x", "en", "a"),
    (10, "two words", "en", "a"),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, fp string, key string, part int, h1 int, score int"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 1, 2, "x", "y", 3, 4, 5) for r in ODD]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def rng():
    return random.Random(7)
