"""Pairs of members of a group, with large groups cut into blocks.

The members of a group with more than ``BLOCK`` of them are dealt into blocks by hash; a
task gets two blocks, each combination of a block with itself or a later one, so a
group of n members is n / BLOCK * (n / BLOCK + 1) / 2 keys of the join and no key has
more than about BLOCK squared pairs. Small groups are one key and are not copied.

Members are few bytes and their pairs many, so Spark, which goes by the bytes it reads, would
broadcast them or put all blocks in one task. The keys are dealt over as many tasks as
give each about ``TASK_PAIRS`` pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 500
#: Pairs that a task makes, more or less.
TASK_PAIRS = 500_000


def pairs_within(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, u, v) with u < v: all pairs of different members of each group, once each. Null keys and members make none."""
    rows = rows.select(*keys, F.col(member).alias("_m")).dropna().distinct()
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    tasks = 1 + int((counts.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0) // TASK_PAIRS)
    sizes = counts.select(*keys, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")).filter("_blocks > 1")
    dealt = rows.join(sizes, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("_m"), F.col("_blocks")).cast("int"))
    left = dealt.select(*keys, F.col("_m").alias("_l"), F.col("_b").alias("_row"), F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_col"))
    right = dealt.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_m").alias("_r"), F.col("_b").alias("_col2"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_row2"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys], (F.col("_row") == F.col("_row2")) & (F.col("_col") == F.col("_col2")))
    left = left.repartition(tasks, *keys, "_row", "_col")
    right = right.repartition(tasks, *[f"_{k}" for k in keys], "_row2", "_col2")
    met = left.hint("merge").join(right, same & ((F.col("_row") != F.col("_col")) | (F.col("_l") < F.col("_r"))))
    return met.select(*keys, F.least("_l", "_r").alias("u"), F.greatest("_l", "_r").alias("v"))
