"""Connected components of match links by least-label spreading with jumps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder in local sessions without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fablespark-"))
    return sc.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, through a table; for loops, as a checkpoint keeps the constraints of its plan, and these multiply."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with ``out``: each row's place (from 0) in the order of ``key``, whatever their partitions. One number a partition goes to the driver."""
    # Sorted and written once, as the places hold for these very partitions.
    parts = written(rows.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    before, start = 0, {}
    for r in sorted(parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        start[r["_part"]] = before
        before += r["n"]
    if not start:
        return parts.select(*rows.columns, F.col("_at").alias(out))
    offset = F.create_map(*[F.lit(x) for p, n in start.items() for x in (p, n)])
    return parts.select(*rows.columns, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + offset[F.col("_part")]).cast("long").alias(out))


def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, cluster) for all ``nodes`` (node): the least node that the links (u, v) reach.

    Each round takes the least label among the neighbours, then the label of
    that label, so that long chains settle in few rounds. Nodes without a link
    take no part in the rounds.
    """
    both = written(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    linked = nodes.join(both.select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    now = written(linked.select("node", F.col("node").alias("cluster")).distinct())
    for _ in range(max_rounds):
        seen = both.join(now.select(F.col("node").alias("v"), "cluster"), "v").groupBy(F.col("u").alias("node")).agg(F.min("cluster").alias("near"))
        spread = now.join(seen, "node", "left").select("node", F.least("cluster", F.coalesce("near", "cluster")).alias("mid"), F.col("cluster").alias("old"))
        jump = now.select(F.col("node").alias("mid"), F.col("cluster").alias("far"))
        after = written(spread.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("cluster"), "old"))
        moved = after.filter("cluster <> old").limit(1).count()
        now = after.select("node", "cluster")
        if not moved:
            found = now.select(F.col("node").alias("_node"), "cluster")
            return nodes.select("node").join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
