"""Small tables with the awkward rows that every corpus operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, slot int, whole int, last string, `a.b` int, _n int, _domain string, _leak long, _kept long, _best int, __slot int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing column names."""
    long_text = " ".join(f"word{i % 977} and more" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "src1", 33),
        (1, "one two three four five six seven", "en", "src1", 33),
        (2, None, "en", "src1", None),
        (3, "", None, "src2", 0),
        (4, " \t\n ", "de", None, 4),
        (None, "no identifier here at all", "en", "src1", 25),
        (None, None, None, None, None),
        (5, long_text, "fr", "src9", len(long_text)),
        (6, "One Two three four FIVE six seven", "en", "src1", 33),
        (7, "Ünïcödé \u3000 words \x00 and a nul, 日本語 テキスト", "ja", "", 40),
        (2**60 + 1, "big identifier", "en", "srcX", 14),
    ]
    return spark.createDataFrame([(*r, "s", "c", 1, 2, "l", 3, 4, "d", 5, 6, 7, 8) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
