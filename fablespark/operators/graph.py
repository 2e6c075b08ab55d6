"""Reads and maintenance of the edge table. Every read takes a reading position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.functions.position import at_or_before, position
from fablespark.operators.components import cut_lineage
from fablespark.operators.relations import aggregate_edges, require_evidence


def visible(df: DataFrame, limit_book: int, limit_chapter: int | None, book: str = "book_order", chapter: str = "chapter") -> DataFrame:
    """Rows up to the reading position."""
    return df.filter(at_or_before(F.col(book), F.col(chapter), limit_book, limit_chapter))


def edges_at(assertions: DataFrame, limit_book: int, limit_chapter: int | None, **options) -> DataFrame:
    """Edges as known at a position: aggregated from visible assertions only, so nothing later leaks in."""
    return aggregate_edges(visible(assertions, limit_book, limit_chapter), **options)


def subgraph(edges: DataFrame, families: list[str] | None = None, min_confidence: float | None = None, nodes: DataFrame | None = None, evidence: DataFrame | None = None, book_order: int | None = None) -> DataFrame:
    """Edges by family, confidence, node set, and book slice (edges with evidence from that book)."""
    out = edges
    if families is not None:
        out = out.filter(F.col("family").isin(*families))
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    if nodes is not None:
        for side in ("subject", "object"):
            out = out.join(nodes.select(F.col("character_id").alias(side)).distinct(), side, "left_semi")
    if book_order is not None:
        keys = ["subject", "predicate", "object"]
        out = out.join(evidence.filter(F.col("book_order") == book_order).select(*keys).distinct(), keys, "left_semi")
    return out


def truncated(df: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, each with whether more were there."""
    got = cut_lineage(df.limit(limit + 1))  # evaluated once: flag and rows are of one reading
    n = got.agg((F.count("*") > limit).alias("truncated"))
    return got.limit(limit).crossJoin(F.broadcast(n))  # one row with one flag


def neighbourhood(edges: DataFrame, start, depth: int = 2) -> DataFrame:
    """(character_id, hops): nodes within one or two steps, edges taken both ways."""
    if depth not in (1, 2):
        raise ValueError("depth is 1 or 2")
    both = edges.select(F.col("subject").alias("u"), F.col("object").alias("v")).unionByName(edges.select(F.col("object").alias("u"), F.col("subject").alias("v"))).distinct()
    one = both.filter(F.col("u") == F.lit(start)).select(F.col("v").alias("character_id"), F.lit(1).alias("hops"))
    if depth == 1:
        return one.distinct()
    two = both.join(one.select(F.col("character_id").alias("u")), "u").filter(F.col("v") != F.lit(start)).select(F.col("v").alias("character_id"), F.lit(2).alias("hops"))
    return one.unionByName(two).groupBy("character_id").agg(F.min("hops").alias("hops"))


def hop_counts(links: DataFrame, start, max_hops: int = 4) -> DataFrame:
    """(node, hops) of all nodes within ``max_hops`` of the start; a frontier join a hop, visited nodes dropped."""
    # Each hop joins the links again; they are made and dealt by node once, so that a hop moves its frontier only.
    width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cut_lineage(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().repartition(width, "u"))
    seen = links.sparkSession.createDataFrame([(start, 0)], f"node {dict(links.dtypes)['u']}, hops int")
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = both.join(frontier.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start, goal, max_hops: int = 4) -> DataFrame:
    """The shortest path's hops in order, each an edge with its confidence and pages; empty if there is none.

    Of equal paths, the one with the greater least confidence, then the smaller
    ids. Hop distances prune the search to edges that lead towards the goal.
    """
    links = edges.select(F.col("subject").alias("u"), F.col("object").alias("v"))
    far = cut_lineage(hop_counts(links, goal, max_hops).select(F.col("node").alias("v"), F.col("hops").alias("left")))
    cols = ["predicate", "confidence", "page_refs"]
    both = edges.select(F.col("subject").alias("u"), F.col("object").alias("v"), *cols).unionByName(edges.select(F.col("object").alias("u"), F.col("subject").alias("v"), *cols))
    # Only hops towards the goal are kept, and are made once for all steps.
    near = far.select(F.col("v").alias("u"), F.col("left").alias("from"))
    best = cut_lineage(both.join(far, "v").join(near, "u").filter(F.col("from") == F.col("left") + 1).groupBy("u", "v", "left").agg(F.max(F.struct("confidence", "predicate", "page_refs")).alias("e")))
    kind = dict(edges.dtypes)["subject"]
    total = far.filter(F.col("v") == F.lit(start)).select("left").collect()
    spark = edges.sparkSession
    schema = f"hop int, u {kind}, v {kind}, predicate string, confidence double, page_refs array<int>"
    if not total or total[0][0] == 0:
        return spark.createDataFrame([], schema)
    paths = spark.createDataFrame([(start,)], f"at {kind}").select("at", F.array(F.col("at")).alias("nodes"), F.lit(1.0).alias("least"))
    for left in range(total[0][0] - 1, -1, -1):
        step = paths.join(best.filter(F.col("left") == left), F.col("at") == F.col("u"))
        # One path a node is enough: the best way to get there in this many hops.
        new = step.select(F.col("v").alias("at"), F.concat("nodes", F.array("v")).alias("nodes"), F.least("least", F.col("e.confidence")).alias("least"))
        paths = new.groupBy("at").agg(F.min(F.struct((-F.col("least")).alias("worst"), "nodes")).alias("b")).select("at", F.col("b.nodes").alias("nodes"), (-F.col("b.worst")).alias("least"))
    hops = paths.select(F.posexplode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("u"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("v"))).alias("hop", "z")).select((F.col("hop") + 1).alias("hop"), F.col("z.u").alias("u"), F.col("z.v").alias("v"))
    return hops.join(best.select("u", "v", "e.*"), ["u", "v"]).select("hop", "u", "v", "predicate", "confidence", "page_refs").orderBy("hop")


def evidence_of(assertions: DataFrame, subject, predicate: str, obj, limit_book: int, limit_chapter: int | None) -> DataFrame:
    """The evidence of an edge in reading order."""
    from fablespark.operators.relations import canonical

    rows = visible(canonical(assertions), limit_book, limit_chapter)
    return rows.filter((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == obj)).orderBy(position(F.col("book_order"), F.col("chapter")), "page", "assertion_id")


def remove_book(assertions: DataFrame, mention_rows: DataFrame, book_order: int) -> tuple[DataFrame, DataFrame]:
    """What is left of assertions and mentions; edges and characters are recomputed from these, so none is orphaned."""
    return assertions.filter(F.col("book_order") != book_order), mention_rows.filter(F.col("book_order") != book_order)


def reorder_books(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows with new book orders from (book_order, new_order); all at once, so orders can be swapped. Nothing is extracted anew."""
    return rows.join(order, "book_order", "left").withColumn("book_order", F.coalesce("new_order", "book_order")).drop("new_order")


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edge table after a run: edges with evidence replace those of equal key, a person's verified ones stay, as do others."""
    from fablespark.sources.stores import upsert

    return upsert(edges, require_evidence(new), ["subject", "predicate", "object"], "human_verified")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, counting repeats."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def reset_book(edges: DataFrame, assertions: DataFrame, book_order: int) -> DataFrame:
    """Edges that keep evidence outside the book."""
    keys = ["subject", "predicate", "object"]
    return edges.join(assertions.filter(F.col("book_order") != book_order).select(*keys).distinct(), keys, "left_semi")


def graph_tables(characters: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph's projection: node and edge tables, rebuilt from characters and edges at any time."""
    return characters.select(F.col("character_id").alias("id"), "*").drop("character_id"), edges.select(F.sha2(F.concat_ws("|", "subject", "predicate", "object"), 256).alias("id"), "*")
