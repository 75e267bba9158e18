from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _row long, bucket string"


def make_docs(spark, rows):
    """documents with further columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None, 5, 0.1, 7, "x") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(n))


@pytest.fixture
def odd_docs(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, a null source."""
    base = words(60, 1)
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " tail", "b"), (4, words(50, 2), None), (5, None, "b"), (6, "", "b"), (7, "  \n ", "c"), (None, words(40, 3), "c"), (None, None, None), (8, words(20_000, 4), "a"), (9, "one two", "a"), (9, "one two", "a"), (10, "é " * 30, "b")]
    return make_docs(spark, rows)


@pytest.fixture
def no_docs(spark, odd_docs):
    return odd_docs.where("false")
