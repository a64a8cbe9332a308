"""Documents that hold every awkward case: nulls, empty and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, n_tokens long"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"), (2, "The quick brown fox jumps over the lazy dog.", "en", "a"), (3, "", "en", "a"), (4, None, None, None), (5, "   \n\t ", "fr", "b"),
        (6, long, "en", "a"), (7, "Un deux trois, quatre!\n\nCinq  six", "fr", "b"), (8, "日本語のテキスト ²³ <|endoftext|> x\x1cy", None, "b"), (None, "no id here at all", "en", "a"), (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (9, "word", "de", "c"), (10, "!!! ??? ...", "de", "c"), (11, "Released under the MIT License.", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None, 0.5, 7, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
