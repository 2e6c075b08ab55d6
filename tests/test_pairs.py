"""Pairs of group members, blocks or not, against all combinations."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fablespark.operators import pairs
from fablespark.operators.pairs import pairs_within


@pytest.mark.parametrize("block", [4, 500])
def test_every_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    groups = {"a": range(37), "b": range(3), "c": [5], "d": range(4, 9)}
    rows = [(g, m) for g, ms in groups.items() for m in ms] + [("a", 1), (None, 1), (None, 2), ("b", None)]
    found = pairs_within(spark.createDataFrame(rows, "g string, m int"), ["g"], "m").collect()
    assert sorted(map(tuple, found)) == sorted((g, u, v) for g, ms in groups.items() for u, v in combinations(sorted(ms), 2))


def test_no_key_holds_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 50)
    one = spark.range(1000).selectExpr("1 AS g", "id AS m")
    assert pairs_within(one, ["g"], "m").count() == 1000 * 999 // 2


def test_pairs_of_few_bytes_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 20)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 1000)
    found = pairs.pairs_within(spark.range(200).selectExpr("id % 2 g", "id m"), ["g"], "m")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin [g")[0]
    by_task = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(by_task) == 2 * 100 * 99 // 2 and len(by_task) > 5 and max(by_task) < 4000
