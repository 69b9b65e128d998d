import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, copies string, hash string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and columns whose names clash."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door of the house", "en", "a", None, "x", "y", "z"),
        (1, "the cat sat on the mat and the dog lay by the door of the house", "en", "a", None, "x", "y", "z"),
        (2, None, "en", "a", 3, None, None, None),
        (3, "", None, None, None, None, None, None),
        (4, " \n\t\x0b\f\r ", "de", "b", None, None, None, None),
        (None, "one two", None, "b", None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (5, "the cat sat on the mat and the dog lay by the door of the HOUSE", "en", None, 1, None, None, None),
        (6, long, "en", "c", len(long), None, None, None),
        (7, long + " more", "en", "c", None, None, None, None),
        (8, "é" * 200 + " 好 🙂\x00﻿   <|endoftext|> \\n \\<|", "xx", "d", None, None, None, None),
        (9, "und " * 500, "de", "b", None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    from tests.conftest import DATA

    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
