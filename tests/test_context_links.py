"""Average-link clusters against merging the nearest pair first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablespark.operators import context_links
from fablespark.operators.context_links import average_link, cluster_contexts


def greedy(v, threshold):
    """Clusters as sets of rows; ties to the first pair."""
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        sim, a, b = max((round(np.mean([v[i] @ v[j] for i in x for j in y]), 10), -n, -m) for n, x in enumerate(groups) for m, y in enumerate(groups) if n < m)
        if sim < threshold:
            break
        groups[-a] += groups.pop(-b)
    return {tuple(sorted(g)) for g in groups}


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_average_link():
    v = unit(np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]], float))
    assert average_link(v, np.ones(4), 0.9).tolist() == [0, 0, 2, 2] and len(set(average_link(v, np.ones(4), 0.9999))) == 4


def test_average_link_is_that_of_greedy_merging():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        v = unit(rnd.normal(size=(rnd.integers(1, 40), rnd.integers(2, 8))))
        threshold = rnd.uniform(-0.2, 0.9)
        label = average_link(v, np.ones(len(v)), threshold)
        assert {tuple(np.flatnonzero(label == k)) for k in set(label)} == greedy(v, threshold)


def clusters(spark, rows, threshold):
    df = spark.createDataFrame(rows, "label string, id long, x array<double>").repartition(3)
    found = cluster_contexts(df, "label", "id", "x", threshold).collect()
    assert len(found) == len(rows)
    out = {}
    for r in found:
        out.setdefault((r["label"], r["cluster"]), []).append(r["id"])
    assert all(cluster == min(ids) for (_, cluster), ids in out.items())
    return {(label, tuple(sorted(ids))) for (label, _), ids in out.items()}


@pytest.mark.parametrize("chunk", [7, 1000])
def test_rounds_over_chunks_give_the_same(spark, monkeypatch, chunk):
    """Labels over ONE_TASK go round by round, others in one task."""
    rnd = np.random.default_rng(chunk)
    rows, want = [], set()
    for label, n in (("big", 40), (None, 31), ("small", 9), ("one", 1)):
        centres = unit(rnd.normal(size=(5, 6)))
        v = unit(centres[rnd.integers(0, 5, n)] + rnd.normal(size=(n, 6)) * 0.25)
        first = len(rows)
        rows += [(label, first + i, x.tolist()) for i, x in enumerate(v)]
        want |= {(label, tuple(first + i for i in g)) for g in greedy(v, 0.6)}
    monkeypatch.setattr(context_links, "ONE_TASK", 10)
    monkeypatch.setattr(context_links, "CHUNK", chunk)
    assert clusters(spark, rows, 0.6) == want


def test_equal_vectors_and_empty_ones(spark, monkeypatch):
    monkeypatch.setattr(context_links, "ONE_TASK", 2)
    rows = [("a", i, [3.0 * (i + 1), 0.0]) for i in range(50)] + [("a", 50, [0.0, 1.0]), ("a", 51, None), ("a", 52, [0.0, 0.0]), ("b", 53, [1.0, 0.0]), ("a", 54, [0.0, 2.0])]
    assert clusters(spark, rows, 1.0) == {("a", tuple(range(50))), ("a", (50, 54)), ("a", (51,)), ("a", (52,)), ("b", (53,))}


def test_a_vector_goes_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """what a round shuffles doesn't grow with the square of a label."""
    monkeypatch.setattr(context_links, "CHUNK", 2)
    monkeypatch.setattr(context_links, "GRID", 3)
    monkeypatch.setattr(context_links, "HELD", 50)
    assert spark.range(1).select(*[context_links._chunks(F.lit(n)) for n in (1, 4, 5, 900)]).first()[:] == (1, 2, 3, 3)
    monkeypatch.setattr(context_links, "ONE_TASK", 10)
    rnd = np.random.default_rng(5)
    v = unit(unit(rnd.normal(size=(6, 6)))[rnd.integers(0, 6, 14)] + rnd.normal(size=(14, 6)) * 0.25)
    assert clusters(spark, [("a", i, x.tolist()) for i, x in enumerate(v)], 0.6) == {("a", g) for g in greedy(v, 0.6)}


def test_empty_table(spark):
    assert cluster_contexts(spark.createDataFrame([], "label string, id long, x array<double>"), "label", "id", "x", 0.5).count() == 0
