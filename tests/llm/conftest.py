"""Awkward documents that every operator must get through."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, kept string, row string, leaks string, quality_score string"


@pytest.fixture(scope="session")
def awkward(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    texts = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, long + " end"), (7, "one two three four five six"),
             (7, "one two three four five six"), (None, "one two  three\nfour five six"), (8, "word"), (9, "é " * 50), (None, None)]
    rows = [(i, t, "en", [None, "a", "b"][k % 3], 0, 1, "x", "y", "z", "q") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
