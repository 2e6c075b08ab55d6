import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from fablespark.llm import topk_search


def plain(rows, step, k):
    """All rows that take part against each other; repeated ids are rows of their own."""
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, q) in enumerate(sound):
        if a % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, c, strict=False)), b) for m, (b, c) in enumerate(sound) if m != n)[:k]
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v int, score int")
    return sorted(tuple(r) for r in topk_search.top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect())


def test_random_vectors_in_many_blocks(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 0.2, (400, 12)).astype("float32")
    x[50:90] = x[50]  # ties
    rows = [(i, [float(c) for c in v], 0, 1, 2) for i, v in enumerate(x)]
    want = plain([(r[0], r[1]) for r in rows], 20, 5)
    assert run(spark, rows, query_step=20, candidate_block=70, query_block=6) == want
    assert run(spark, rows, query_step=20) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.5]), (1, [0.5, nan]), (2, [inf, 0.0]), (3, None), (4, []), (5, [0.5, None]), (None, [1.0, 1.0]), (50, [-0.5, 0.25]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (7, [0.25, 1.0]), (50, []), (8, [0.5, 0.5, 0.1]), (9, [0.0, 0.0]), (10, [1.0])]
    rows = [(*r, None, None, None) for r in rows]
    assert run(spark, rows, query_step=50) == plain([r[:2] for r in rows], 50, 5)
    assert run(spark, [], query_step=50) == []
    assert run(spark, [(0, [1.0], 0, 0, 0)], query_step=50) == []  # no candidate but itself


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.1, 0.1]), (1, [2.0, 1.0]), (0, [1.0, 0.5]), (0, [0.5, 0.0])]
    got = run(spark, [(*r, None, None, None) for r in rows], query_step=50)
    assert got == plain(rows, 50, 5) and (0, 1, 1, 256 * 512 + 128 * 256) in got and sum(r[:2] == (0, 1) for r in got) == 3


@pytest.mark.parametrize("size,dims", [(3000, 32), (6000, 64)])
def test_stops_early_with_proof(size, dims):
    """On vectors of one length in all directions, the hardest ones, and the result is that of a full scan."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(size, dims))
    x = np.floor(256 * x / np.sqrt((x**2).sum(axis=1))[:, None]).astype(np.int64)
    x[1234] = x[0] * 2
    ids = np.arange(size)
    index = topk_search.ImpactIndex(ids, ids, x)
    shares = []
    for q in range(0, size, size // 20):
        found, scores, processed, rescored = index.top(x[q], q, 5)
        exact = x @ x[q]
        exact[q] = -(2**60)
        full = np.lexsort((ids, -exact))[:5]
        assert found.tolist() == full.tolist() and scores.tolist() == exact[full].tolist()
        shares.append((processed, rescored))
    assert max(p for p, _ in shares) < 0.9 and np.mean([p for p, _ in shares]) < 0.7
    assert max(r for _, r in shares) <= 1 / topk_search.FEW_SHARE


def test_stops_on_the_documents_vectors(sf):
    """The share of postings processed before the proof, and of rows rescored, on the driver's vectors."""
    table = pq.read_table(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    x = np.floor(256 * np.array(table["embedding"].to_pylist(), dtype=np.float64)).astype(np.int64)
    ids = table["vec_id"].to_numpy()
    index = topk_search.ImpactIndex(np.arange(len(ids)), ids, x)
    shares = np.array([index.top(x[i], i, 5)[2:] for i in range(0, len(ids), 50)])
    assert (shares[:, 0] < 1).all() and shares[:, 0].mean() < 0.7 and shares[:, 1].mean() <= 0.2
