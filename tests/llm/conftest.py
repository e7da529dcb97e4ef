from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows; extra columns with taken names."""
    def build(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        if clash:
            df = df.selectExpr("*", "1 AS score", "'x' AS bucket", "2 AS n_shingles", "3 AS key",
                               "4 AS size", "5 AS position", "6 AS n_bytes", "'y' AS words",
                               "7 AS h", "8 AS item_id", "9 AS start", "10 AS label")
        return df

    return build


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "the", "re", "tion", "ou", "st", "ing", "ea", "ly", "wh", "é", "ß"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Rows that an operator must bear: nulls, empties, blanks, repeats, marks, long words and texts."""
    long = prose(1, 6000)
    base = prose(2, 120)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "two words"), (6, base), (7, base),
        (7, base), (8, base + " end"), (9, "x" * 5000), (10, long), (11, long[:20000] + " changed"),
        (12, "the " * 300), (13, "the " * 200), (None, base), (None, None), (14, "€\U0001f600 " * 40),
        (15, "€\U0001f600 " * 41), (16, "nul \x00 inside " * 9), (17, base.upper(), None),
    ]
