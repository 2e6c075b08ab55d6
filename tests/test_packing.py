"""Packing against a plain fold, with groups that fill many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from fablespark.operators import chapters, packing
from fablespark.operators.packing import pack


def fold(items, lookback):
    """Batch numbers of (size, budget)."""
    out, used, most, batch, sizes = [], 0, None, -1, []
    for size, budget in items:
        size, budget = max(0, size or 0), budget or 0
        if most is None or used + size > most:
            batch, used, most = batch + 1, 0, budget - sum(sizes[max(0, len(sizes) - lookback) :] if lookback else [])
        used += size
        out.append(batch)
        sizes.append(size)
    return out


@pytest.fixture
def small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.shuffle.partitions")


@pytest.mark.parametrize("lookback,most", [(0, 12), (5, 40), (0, 400), (3, 9)])
def test_groups_over_many_partitions(spark, small_partitions, lookback, most):
    rng = random.Random(most)
    groups = {"a": 5, "b": 700, None: 60, "c": 1, "d": 2, "e": 300, "zeros": 150}
    rows = []
    for g, n in groups.items():
        for i in range(n):
            size = rng.choice([0, 1, 2, 3, 5, most + 1, None, -4]) if g != "zeros" else 0 if i != 75 else 3
            rows.append((g, i, size, rng.choice([most, most, most - 2, None]) if g == "e" else most))
    found = pack(spark.createDataFrame(rows, "g string, i int, size int, budget int").repartition(5), ["g"], ["i"], "size", "budget", lookback)
    got = {(r["g"], r["i"]): r["batch_no"] for r in found.collect()}
    want = {}
    for g in groups:
        mine = [(i, s, b) for h, i, s, b in rows if h == g]
        want |= {(g, i): n for (i, _, _), n in zip(mine, fold([(s, b) for _, s, b in mine], lookback), strict=True)}
    assert got == want


@pytest.mark.parametrize("size,most", [(1, 7), (3, 10), (1, 100_000), (5, 4)])
def test_one_group_fills_all_partitions(spark, small_partitions, monkeypatch, size, most):
    """Chains that never meet, batches over several partitions, and items that all stand alone."""
    called = []
    real = packing._leads
    monkeypatch.setattr(packing, "_leads", lambda *a: called.append(1) or real(*a))
    rows = spark.range(2000).select(F.lit("x").alias("g"), F.col("id").alias("i"), F.lit(size).alias("size"))
    got = [r["batch_no"] for r in pack(rows, ["g"], ["i"], "size", most).orderBy("i").collect()]
    assert got == fold([(size, most)] * 2000, 0) and called


def test_no_task_holds_a_group(spark, small_partitions):
    """The largest partition of the ordered items is a share of the one group."""
    rows = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.lit(1).alias("size"))
    found = pack(rows, ["g"], ["i"], "size", 10)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 13 and max(sizes) < 600


def test_null_texts_keep_the_budget(spark):
    rows = spark.createDataFrame([("g", 1, None), ("g", 2, "x y"), ("g", 3, "z"), (None, 1, "a b c d e"), (None, 2, "")], "grp string, n int, text string")
    found = chapters.plan_batches(rows, ["grp"], "n", "text", 2).collect()
    got = sorted(((r["grp"] or "", r["n"], r["part_no"], r["part_text"], r["tokens"], r["was_split"], r["batch_no"]) for r in found))
    assert got == [("", 1, 0, "a b", 2, True, 0), ("", 1, 1, "c d", 2, True, 1), ("", 1, 2, "e", 1, True, 2), ("", 2, 0, "", 0, False, 2), ("g", 1, 0, None, 0, False, 0), ("g", 2, 0, "x y", 2, False, 0), ("g", 3, 0, "z", 1, False, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, i int, size int, text string")
    assert pack(none, ["g"], ["i"], "size", 5).count() == 0
    assert chapters.plan_batches(none, ["g"], "i", "text", 5).count() == 0


def test_many_items_are_dealt_by_their_number_and_carry_columns(spark, monkeypatch):
    """partitions hold a bounded number of items, and what is wanted beside needs no join."""
    monkeypatch.setattr(packing, "TASK_ITEMS", 100)
    rows = spark.range(2000).select((F.col("id") % 7).alias("g"), F.col("id").alias("i"), F.lit(3).alias("size"), (F.col("id") * 2).alias("twice"))
    found = pack(rows, ["g"], ["i"], "size", 9, beside=("size", "twice"))
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300
    got = found.collect()
    assert len(got) == 2000 and all(r["twice"] == 2 * r["i"] and r["size"] == 3 and r["batch_no"] == r["i"] // 7 // 3 for r in got)


def test_planned_batches_without_texts(spark):
    """the same batches, and a text is split into words once, not once a part."""
    rows = spark.createDataFrame([("a", 1, "x " * 11), ("a", 2, None), ("a", 3, "y z"), (None, 4, " w  v\nu "), ("a", 5, "")], "g string, n int, text string")
    full = chapters.plan_batches(rows, ["g"], "n", "text", 4)
    sizes = chapters.plan_batches(rows, ["g"], "n", "text", 4, texts=False)
    key = ["g", "n", "part_no", "tokens", "was_split", "batch_no"]
    assert sorted(map(str, full.select(key).collect())) == sorted(map(str, sizes.select(key).collect())) and "part_text" not in sizes.columns
    assert [(r["n"], r["part_text"], r["tokens"]) for r in full.filter("n < 3").orderBy("n", "part_no").collect()] == [(1, "x x x x", 4), (1, "x x x x", 4), (1, "x x x", 3), (2, None, 0)]
    plan = chapters.split_oversized(rows, "text", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") <= 4
