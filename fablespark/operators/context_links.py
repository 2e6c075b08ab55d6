"""Average-link clusters of context vectors, for labels of any size.

The mean cosine of two clusters is the product of their sum vectors over their sizes, so
a cluster is one vector. Two clusters that are each other's nearest may be merged at
once, wherever the others stand: no later merge brings anything nearer (the mean to a
union lies between the means to its parts), and a cluster without a neighbour at the
threshold never gets one. So rounds of such merges, over all labels together, give
what merging the nearest pair first gives.

A label of at most ``ONE_TASK`` clusters is finished in one task. A larger one is cut in
chunks of ``CHUNK`` clusters; a task holds two chunks, those that look for a neighbour and
those they look at, and returns one neighbour for each. A label is cut in at most ``GRID`` chunks, so what is
shuffled in a round grows with the clusters and not with their square; clusters are copied
for as many chunks as those that ask fill. After a round only merged clusters
and those whose neighbour merged look again. Merges are written down as links; the
clusters are what these connect.

Equal vectors of a label are one cluster from the start, so a text that repeats a
million times is one vector. Similarities are rounded to 12 digits and ties go to the
smaller id, so equal ones are equal from either side.

Cases: ``node`` tells contexts apart; a null or zero vector is like nothing and stands
alone; a null label is a label; an empty table gives an empty result. A threshold is above 0 and at most 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.operators.components import connected_components, written

#: Labels with at most so many clusters left are finished in one task.
ONE_TASK = 2000
#: Clusters that a task compares with as many others; more, where a label would fill over GRID such chunks.
CHUNK = 4000
#: A cluster goes to so many tasks of a round at most on either side, however large its label.
GRID = 16
#: Similarities that a task holds at once.
HELD = 4_000_000
DIGITS = 12


def average_link(sums: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """The first member of each one's cluster, by chains of nearest neighbours."""
    n = len(sums)
    sums, size, label = sums.astype(float).copy(), size.astype(float).copy(), np.arange(n)
    todo = np.ones(n, bool)
    chain: list[int] = []
    while todo.any():
        if not chain:
            chain.append(int(np.argmax(todo)))
        i = chain[-1]
        others = np.flatnonzero(todo)
        others = others[others != i]
        sim = np.round(sums[others] @ sums[i] / (size[others] * size[i]), DIGITS)
        if not len(others) or sim.max() < threshold:
            todo[chain] = False  # similarities rise along a chain, so none before has a neighbour either
            chain.clear()
            continue
        j = int(others[np.argmax(sim)])
        if len(chain) > 1 and sim[np.searchsorted(others, chain[-2])] >= sim.max():
            j = chain[-2]  # of equal neighbours, the one that the chain comes from
        if len(chain) > 1 and j == chain[-2]:
            a, b = min(i, j), max(i, j)
            sums[a] += sums[b]
            size[a] += size[b]
            todo[b] = False
            label[label == b] = a
            del chain[-2:]
        else:
            chain.append(j)
    return label


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in column])


def _finish(clusters: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Links (u, v) of whole labels of clusters (label, id, total, n)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        ids = f["id"].to_numpy()
        first = average_link(_matrix(f["total"]), f["n"].to_numpy(), threshold)
        moved = first != np.arange(len(ids))
        return pd.DataFrame({"u": ids[first[moved]], "v": ids[moved]})

    return clusters.groupBy("label").applyInPandas(run, f"u {kind}, v {kind}")


def _chunks(n: Column) -> Column:
    return F.least(F.ceil(n / CHUNK), F.lit(GRID)).cast("int")


def _neighbours(asking: DataFrame, clusters: DataFrame, threshold: float, kind: str, label_kind: str) -> DataFrame:
    """(label, id, near, sim) for those ``asking`` that have a neighbour at the threshold. Both frames have (label, id, total, n, chunk, chunks)."""
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias(name)
    asked = written(asking.groupBy("label").agg(_chunks(F.count("*")).alias("rows")))  # a row a label
    both = lambda df: df.join(asked.select(F.col("label").alias("l"), "rows"), F.col("label").eqNullSafe(F.col("l"))).drop("l")
    left = both(asking).select("label", "id", "total", "n", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("row"), every("col"))
    right = both(clusters).select(*[F.col(c).alias(c) for c in ("label", "id", "total", "n")], F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.col("chunk").alias("col"))
    keys = ["label", "row", "col"]

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in ("label", "id", "near", "sim")})
        if a.empty or b.empty:
            return none
        b = b.sort_values("id")
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        x, y, m, n = _matrix(a["total"]), _matrix(b["total"]).T, a["n"].to_numpy(float), b["n"].to_numpy(float)
        best, found = np.empty(len(ids), np.int64), np.empty(len(ids))
        step = max(1, HELD // len(others))
        for i in range(0, len(ids), step):
            sim = np.round(x[i : i + step] @ y / np.outer(m[i : i + step], n), DIGITS)
            sim[ids[i : i + step, None] == others[None, :]] = -np.inf
            best[i : i + step] = sim.argmax(axis=1)  # the first of equal ones has the smaller id
            found[i : i + step] = sim.max(axis=1)
        ok = found >= threshold
        return pd.DataFrame({"label": a["label"][ok].to_numpy(), "id": ids[ok], "near": others[best[ok]], "sim": found[ok]})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, f"label {label_kind}, id {kind}, near {kind}, sim double")
    best = found.groupBy("label", "id").agg(F.min(F.struct((-F.col("sim")).alias("far"), "near")).alias("b"))
    return best.select("label", "id", "b.near", (-F.col("b.far")).alias("sim"))


def _sum(column: str) -> Column:
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    return F.aggregate(F.array_sort(F.collect_list(column)), F.array().cast("array<double>"), add)


def cluster_contexts(contexts: DataFrame, block: str, node: str, vector: str, threshold: float) -> DataFrame:
    """(block, node, cluster): average-link clusters within each block (names that share a key), named by their least node."""
    kinds = dict(contexts.dtypes)
    kind, label_kind = kinds[node], kinds[block]
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    rows = contexts.select(F.col(block).alias("label"), F.col(node).alias("node"), x.alias("x")).withColumn("norm", norm)
    rows = written(rows.select("label", "node", F.when(F.col("norm") > 0, F.transform("x", lambda v: v / F.col("norm"))).alias("unit")))
    same = rows.filter("unit is not null").groupBy("label", "unit").agg(F.min("node").alias("id"), F.count("*").alias("n"))
    # Each node is linked to the least one of its own vector.
    links = [rows.filter("unit is not null").join(same.select(F.col("label").alias("l"), F.col("unit").alias("w"), F.col("id").alias("u")), F.col("label").eqNullSafe(F.col("l")) & (F.col("unit") == F.col("w"))).select("u", F.col("node").alias("v")).filter("u <> v")]
    now = written(same.select("label", "id", F.transform("unit", lambda v: v * F.col("n")).alias("total"), "n", F.lit(None).cast(kind).alias("near"), F.lit(None).cast("double").alias("sim")))
    while True:
        sizes = now.groupBy("label").agg(F.count("*").alias("left"))
        joined = now.join(sizes.select(F.col("label").alias("l"), "left"), F.col("label").eqNullSafe(F.col("l"))).drop("l")
        small = joined.filter(F.col("left") <= ONE_TASK).select("label", "id", "total", "n")
        links.append(written(_finish(small, threshold, kind)))
        chunks = _chunks(F.col("left"))
        large = written(joined.filter(F.col("left") > ONE_TASK).select("label", "id", "total", "n", "near", "sim", chunks.alias("chunks"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk")))
        if large.isEmpty():
            break
        found = _neighbours(large.filter("near is null"), large, threshold, kind, label_kind)
        kept = large.filter("near is not null").select("label", "id", "near", "sim")
        near = written(found.unionByName(kept))
        if near.isEmpty():
            break
        back = near.select(F.col("id").alias("near"), F.col("near").alias("id"))
        pairs = near.join(back, ["id", "near"]).filter(F.col("id") < F.col("near")).select("label", F.col("id").alias("u"), F.col("near").alias("v"))
        # Rounding aside, the least pair of the greatest similarity is always such a pair; should rounding part all, it is merged.
        least = near.groupBy("label").agg(F.min(F.struct((-F.col("sim")).alias("far"), F.least("id", "near").alias("u"), F.greatest("id", "near").alias("v"))).alias("p")).select("label", "p.u", "p.v")
        stuck = least.join(pairs.select(F.col("label").alias("l")).distinct(), F.col("label").eqNullSafe(F.col("l")), "left_anti")
        merges = written(pairs.unionByName(stuck))
        links.append(merges.select("u", "v"))
        # Clusters without a neighbour are done; the others go on, the merged ones under the smaller id.
        root = merges.select(F.col("u").alias("id"), F.col("u").alias("root")).unionByName(merges.select(F.col("v").alias("id"), F.col("u").alias("root")))
        alive = large.select("label", "id", "total", "n").join(near.select("id", F.col("near").alias("to"), F.col("sim").alias("at")), "id").join(root, "id", "left")
        gone = root.select(F.col("id").alias("to"), F.lit(True).alias("changed"))
        single = alive.filter("root is null").join(gone, "to", "left").select("label", "id", "total", "n", F.when(F.col("changed").isNull(), F.col("to")).alias("near"), F.when(F.col("changed").isNull(), F.col("at")).alias("sim"))
        merged = alive.filter("root is not null").groupBy("label", F.col("root").alias("id")).agg(_sum("total").alias("total"), F.sum("n").alias("n")).select("*", F.lit(None).cast(kind).alias("near"), F.lit(None).cast("double").alias("sim"))
        now = written(single.unionByName(merged))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    found = connected_components(rows.select("node"), every)
    return rows.select(F.col("label").alias(block), F.col("node").alias(node)).join(found.select(F.col("node").alias("_node"), "cluster"), F.col(node) == F.col("_node")).drop("_node")
