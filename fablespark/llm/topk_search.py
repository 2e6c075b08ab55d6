"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Components become integers, floor(256 x). A block of candidate vectors is
indexed by posting segments: per dimension, the rows whose component falls in
one of ``LEVELS`` quantised levels. For a query, a segment's impact is the
greatest absolute product that any of its rows can have with the query's
component. Segments are processed from the highest impact down. Each posting adds
the squared difference of the two unit vectors' components to its row's
accumulator: the inner product is |q| |x| (1 - D / 2) with D the sum of these over
all dimensions, and no difference is negative, so with the sum so far the formula
is an upper bound that only falls. A row whose bound is under the k-th exact score
found so far is proven out. Processing stops when one row in ``FEW_SHARE`` or fewer
are possible members; these are rescored exactly, in integers. Nothing is skipped
without that proof, so the result is that of a full scan.

Queries and candidates meet block by block: a stated query set against all
rows, each task holding one block of either kind, both of bounded size. Each
pair of blocks returns k rows a query, and a last step ranks these.

Cases: vectors that are null, or hold null or non-finite components, take no
part, nor do rows with a null vec_id; an empty vector scores 0 with all others;
rows that repeat a vec_id are rows of their own, as candidates and as queries, and
a query is not its own candidate but another row of its vec_id is; vectors of
different length are compared as if the shorter were filled up with zeros; ties
go to the smaller vec_id; an empty table gives an empty result; other columns are
not read. Integers are 64 bits wide; components up to 2**50 / dimensions are safe.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.llm.common import checkpointed

K = 5
QUERY_STEP = 50
SCALE = 256
LEVELS = 24
CANDIDATE_BLOCK = 6000
QUERY_BLOCK = 1024
#: Processing stops when one row of so many is a possible member.
FEW_SHARE = 5
#: Shares of the postings after which the proof is tested.
STEPS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: What rounding (unit vectors have 32-bit components) could take from a bound, as a share of |q| |x|.
SLACK = 1e-4


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v array<long>) of the vectors that take part; ``row`` tells rows apart."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _norm(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=-1))


class ImpactIndex:
    """Posting segments of one block of integer vectors. ``rows`` tell them apart, ``ids`` rank ties."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> None:
        order = np.argsort(ids, kind="stable")
        self.row_ids, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.norms = _norm(self.vectors)
        unit = self.vectors / np.where(self.norms > 0, self.norms, 1)[:, None]
        postings, values, dims, tops = [np.zeros(0, np.int64)], [np.zeros(0)], [], []
        for d in range(self.vectors.shape[1]):
            col = self.vectors[:, d]
            by_value = np.argsort(col, kind="stable")
            ordered = col[by_value]
            width = max(1, -(-(int(ordered[-1]) - int(ordered[0]) + 1) // levels))
            cuts = np.flatnonzero(np.diff(ordered // width)) + 1
            for part, value in zip(np.split(by_value, cuts), np.split(ordered, cuts), strict=True):
                postings.append(part)
                values.append(unit[part, d])
                dims.append(d)
                tops.append(max(abs(int(value[0])), abs(int(value[-1]))))
        self.rows, self.values = np.concatenate(postings).astype(np.int32), np.concatenate(values).astype(np.float32)
        self.sizes = np.fromiter(map(len, postings[1:]), np.int64, len(postings) - 1)
        self.ends = np.cumsum(self.sizes)
        self.dims, self.tops = np.array(dims, np.int64), np.array(tops, np.float64)

    def top(self, query: np.ndarray, own_row: int, k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Ids and scores of the k best rows but the query's own, best first; shares of the postings processed and of the rows rescored."""
        n, norm = len(self.ids), float(_norm(query))
        unit = (query / (norm or 1.0)).astype(np.float32)
        order = np.argsort(-np.abs(query[self.dims]) * self.tops, kind="stable")
        # Parts of about equal numbers of postings.
        parts = np.searchsorted(np.cumsum(self.sizes[order]), len(self.rows) * np.array(STEPS)) + 1
        apart, least, done, used = np.zeros(n), None, 0, 0
        for part in np.minimum(parts, len(order)):
            now = order[done:part]
            done = max(done, int(part))
            if len(now):
                sizes = self.sizes[now]
                at = np.repeat((self.ends[now] - np.cumsum(sizes)).astype(np.int32), sizes) + np.arange(sizes.sum(), dtype=np.int32)
                gap = np.repeat(unit[self.dims[now]], sizes) - self.values[at]
                apart += np.bincount(self.rows[at], gap * gap, n)
                used += len(at)
            bound = norm * self.norms * (1 + SLACK - apart / 2)
            likely = np.argpartition(-bound, 4 * k)[: 4 * k + 1] if n > 4 * k + 1 else np.arange(n)
            likely = likely[self.row_ids[likely] != own_row]
            if len(likely) >= k:
                here = int(np.sort(self.vectors[likely] @ query)[-k])
                least = here if least is None else max(least, here)
            possible = np.flatnonzero(bound >= least) if least is not None else np.arange(n)
            if len(possible) * FEW_SHARE <= n:
                break
        possible = possible[self.row_ids[possible] != own_row]
        score = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible][best], score[best], used / max(1, len(self.rows)), len(possible) / max(1, n)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """Top k of one block of candidates for one block of queries."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "query_id", "vec_id", "score")})
    if not len(queries) or not len(candidates):
        return empty
    width = max(map(len, [*queries["v"], *candidates["v"]]))
    index = ImpactIndex(candidates["row"].to_numpy(np.int64), candidates["vec_id"].to_numpy(np.int64), _matrix(candidates["v"], width))
    parts = []
    for row, qid, q in zip(queries["row"], queries["vec_id"], _matrix(queries["v"], width), strict=True):
        ids, scores, _, _ = index.top(q, int(row), k)
        parts.append(pd.DataFrame({"row": np.full(len(ids), row, np.int64), "query_id": np.full(len(ids), qid, np.int64), "vec_id": ids, "score": scores}))
    return pd.concat(parts, ignore_index=True) if parts else empty


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose vec_id is divisible by ``query_step``."""
    rows = checkpointed(quantised(vectors))  # from here on a row's number is fixed
    # Counts choose the number of blocks, so a block's size does not follow the input.
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_step == 0)).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-n_queries // query_block))
    block = lambda count, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count)).cast("int")
    candidates = rows.select("row", "vec_id", "v", block(c_blocks, 1).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    queries = rows.filter(F.col("vec_id") % query_step == 0).select("row", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"), block(q_blocks, 2).alias("q"))
    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInPandas(lambda a, b: search_block(a, b, k), "row long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH sound AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % {QUERY_STEP} = 0 AND c.r <> q.r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
