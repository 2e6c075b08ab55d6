"""The encoder's batches, and that it is asked for nothing twice."""

import numpy as np
import pytest

from fablespark.operators.encoding import batches_of, encode_missing, unit_rows


def test_batches_are_bounded():
    texts = ["w " * n for n in (9, 1, 30, 2, 0, 4, 4, 1, 1, 1, 1)]
    found = list(batches_of(texts, 4, 10))
    assert sorted(i for b in found for i in b) == list(range(len(texts)))
    assert all(len(b) <= 4 and (len(b) == 1 or sum(len(texts[i].split()) for i in b) <= 10) for b in found) and [2] in found


def test_only_rows_without_a_vector(spark):
    def counting(texts):
        assert len(texts) <= 4 and (len(texts) == 1 or sum(len(t.split()) for t in texts) <= 10)
        return np.array([[t.count("a"), t.count("b")] for t in texts], float)

    rows = [(1, "a a b", None), (2, "kept", [9.0, 9.0]), (3, None, None), (4, "b " * 25, None), (1, "a a b", None)]
    df = spark.createDataFrame(rows, "`id.x` int, text string, embedding array<double>")
    found = encode_missing(df, counting, most_texts=4, most_tokens=10)
    assert found.columns == ["id.x", "text", "embedding"]
    got = sorted((r[0], [round(v, 6) for v in r[2]]) for r in found.collect())
    assert got == [(1, [0.894427, 0.447214]), (1, [0.894427, 0.447214]), (2, [9.0, 9.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])]
    again = encode_missing(found, lambda texts: pytest.fail("asked again"))
    assert again.count() == 5 and encode_missing(df.select("text").limit(0), counting).count() == 0


def test_unit_rows():
    assert unit_rows([[3, 4], [0, 0], [np.nan, 1]]).tolist() == [[0.6, 0.8], [0, 0], [0, 0]]
