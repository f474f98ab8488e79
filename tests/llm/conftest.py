import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the smallest table."""
    import duckdb

    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


# Rows that every operator must stand: null ids and texts, empty, blank, repeated and very long texts.
HARD = [
    (5, "The same words in this text, twice and twice again: mail a.b@mail.example.com now"),
    (7, "The same words in this text, twice and twice again: mail a.b@mail.example.com now"),
    (7, "The same words in this text, twice and twice again: mail a.b@mail.example.com now"),
    (None, "The same words in this text, twice and twice again: mail a.b@mail.example.com now"),
    (8, None),
    (9, ""),
    (10, " \n\t "),
    (11, "x" * 300_000),
    (12, "word " * 30_000),
    (None, None),
    (13, "Ünïcode 🙂 日本語 text, with mixed letters ΑΣ and marks…"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows with extra columns whose names clash with those of results."""
    rows = [(i, t, "en" if n % 2 else None, "s", n, 1, "c") for n, (i, t) in enumerate(HARD)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score int, key string"
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)
