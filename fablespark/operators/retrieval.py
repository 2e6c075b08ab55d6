"""Vector, lexical and hybrid search, graph-constrained retrieval and grounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.functions.text import cosine

K1, B = 1.2, 0.75
RRF = 60


def vector_top(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest by cosine, exactly. A running top k: no global sort and no shuffle of vectors."""
    rows = vectors.filter(F.col(vector).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc_nulls_last("similarity"), key).limit(k)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def postings(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf, doc_len): the inverted index, to be written partitioned by a term hash."""
    rows = chunks.select(key, tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    return rows.select(key, F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("term", key, "doc_len").agg(F.count("*").alias("tf"))


def _times(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(word)))


def bm25_top(chunks: DataFrame, query: str, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best by BM25. Only the query's terms are counted in a chunk; nothing is exploded."""
    terms = sorted({w for w in query.lower().split() if w})
    # The one-element array binds the words to a name, so that a text is cut once and not for each term.
    bound = F.transform(F.array(tokens(F.col(text))), lambda t: F.struct(F.size(t).alias("doc_len"), *[_times(t, w).alias(f"tf{i}") for i, w in enumerate(terms)]))
    counted = chunks.filter(F.col(text).isNotNull()).select(key, F.inline(bound))
    stats = counted.agg(F.count_if(F.col("doc_len") > 0).alias("n"), F.avg(F.when(F.col("doc_len") > 0, F.col("doc_len"))).alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avg = stats["n"], stats["avg_len"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.lit(float(avg))))
    return counted.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k).filter("score > 0")


def ranked(top: DataFrame, score: str, key: str, out: str) -> DataFrame:
    """Ranks of a top-k list; a window without partitions is right here, as k rows are all there are."""
    return top.withColumn(out, F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(dense: DataFrame, lexical: DataFrame, key: str, limit: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two lists (key, dense_rank) and (key, lexical_rank)."""
    both = dense.join(lexical, key, "full")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("dense_rank") + part("lexical_rank")).orderBy(F.desc("score"), key).limit(limit)


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query_text: str, query_vector: list[float], key: str = "doc_id", vector_key: str = "vec_id", arm: int = 50, limit: int = 20) -> DataFrame:
    """Dense and lexical arms of ``arm`` each, fused."""
    dense = ranked(vector_top(vectors, query_vector, arm, vector_key), "similarity", vector_key, "dense_rank").select(F.col(vector_key).alias(key), "similarity", "dense_rank")
    lexical = ranked(bm25_top(chunks, query_text, arm, key), "score", key, "lexical_rank").select(key, F.col("score").alias("bm25"), "lexical_rank")
    return fuse(dense, lexical, key, limit)


def constrained_retrieval(evidence: DataFrame, entity_chunks: DataFrame, project_hits: DataFrame, key: str, limit: int) -> DataFrame:
    """Chunks by tier: evidence of the resolved entities, hits among their chunks, hits of the project; a chunk keeps its best tier."""
    tiers = [(1, evidence.select(key, F.lit(1.0).alias("score"))), (2, project_hits.join(entity_chunks.select(key).distinct(), key, "left_semi").select(key, "score")), (3, project_hits.select(key, "score"))]
    rows = None
    for t, df in tiers:
        part = df.withColumn("tier", F.lit(t))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(key).agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("b"))
    return best.select(key, F.col("b.tier").alias("tier"), (-F.col("b.s")).alias("score")).orderBy("tier", F.desc("score"), key).limit(limit)


def ground(claims: DataFrame, evidence: DataFrame, question: str = "question_id") -> DataFrame:
    """Per question: claims with evidence, claims without, and whether to abstain."""
    backed = evidence.select("claim_id").distinct().withColumn("_ok", F.lit(True))
    marked = claims.join(backed, "claim_id", "left")
    return marked.groupBy(question).agg(F.count_if("_ok").alias("n_grounded"), F.count_if(F.col("_ok").isNull()).alias("n_dropped"), (F.count_if("_ok") == 0).alias("abstained"))


def answer_context(top: DataFrame, texts: DataFrame, key: str, order: str, separator: str = ",") -> DataFrame:
    """The texts of a top-k list as one string, in its order."""
    rows = texts.join(top, key)  # the optimiser broadcasts the list if its size allows
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col(order)).alias("o"), F.col(key).alias("k"), F.col("text").alias("t")))), lambda x: x["t"]), separator).alias("context"))


def rerank(top: DataFrame, scorer: Column, limit: int, key: str, enabled: bool = True) -> DataFrame:
    """A second score over a top-k list; off, the list stays as it is."""
    if not enabled:
        return top.limit(limit)
    return top.withColumn("rerank_score", scorer).orderBy(F.desc("rerank_score"), key).limit(limit)
