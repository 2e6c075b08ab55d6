"""Positions in overlapping windows against comparing every pair."""

import random

from pyspark.sql import functions as F

from fablespark.operators.intervals import cover, inside_windows


def test_against_every_pair(spark):
    rng = random.Random(10)
    pick = lambda: rng.choice([None, 0, -1, 5, 2**31 - 1, -(2**31), rng.randrange(-50, 50), rng.randrange(0, 10**6)])
    windows = [(rng.choice(["a", "b", None]), i, pick(), pick()) for i in range(120)]
    points = [(rng.choice(["a", "b", None]), pick()) for _ in range(150)]
    found = inside_windows(spark.createDataFrame(points, "k string, at long").withColumn("p", F.lit(1)), spark.createDataFrame(windows, "k string, w int, first_at long, last_at long"), ["k"], "at")
    assert found.columns == ["k", "at", "p", "w", "first_at", "last_at"]
    got = sorted((r["k"], r["at"], r["w"]) for r in found.collect())
    low, high = -(2**31), 2**31 - 1
    want = sorted((k, at, w) for k, at in points for h, w, a, b in windows if k is not None and k == h and at is not None and (low if a is None else a) <= at <= (high if b is None else b))
    assert got == want and len(got) > 1000


def test_covers_are_small_and_apart(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1000), (5, 4), (-(2**31), 2**31 - 1), (3, 10**9)], "a long, b long").select("a", "b", cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        spans = sorted((n << level, (n + 1) << level) for level, n in r["c"])
        assert sum(b - a for a, b in spans) == max(0, r["b"] - r["a"] + 1) and len(spans) <= 62
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_empty(spark):
    none = spark.createDataFrame([], "k string, at long, first_at long, last_at long")
    one = spark.createDataFrame([("a", 1, 0, 2)], "k string, at long, first_at long, last_at long")
    assert inside_windows(none.select("k", "at"), one.select("k", "first_at", "last_at"), ["k"], "at").count() == 0
    assert inside_windows(one.select("k", "at"), none.select("k", "first_at", "last_at"), ["k"], "at").count() == 0
