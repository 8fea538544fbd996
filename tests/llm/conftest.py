from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A small table with copies, nulls, empty and long texts, repeated rows and columns of clashing names."""
    words = [f"w{i % 97}x{i % 13}" for i in range(3000)]
    rows = [
        (1, "Alpha beta gamma delta", "en", "a", 22), (2, "Alpha beta gamma delta", "en", "b", 22), (3, "alpha beta gamma delta", "en", None, 22),
        (4, None, "en", "a", None), (5, "", None, "b", 0), (6, " \n\t ", "de", "c", 4), (7, " ".join(words), "fr", "c", 9), (8, "one", "fr", None, 3),
        (9, "dérè üß\u00a0x <|endoftext|> \n\n tail  ", "de", "a", 5), (9, "dérè üß\u00a0x <|endoftext|> \n\n tail  ", "de", "a", 5), (None, "one", "es", "a", 3),
        (11, " ".join(words[:400]), "en", "a", 1), (12, " ".join(words[:399] + ["changed"]), "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' AS content", "'y' AS key", "0 AS bucket", "'z' AS host", "1 AS piece", "'q' AS __part")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
