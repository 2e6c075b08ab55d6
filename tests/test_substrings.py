"""Substring search against a plain one."""

import random

from fablespark.operators.substrings import search_names


def plain(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def test_against_plain_search(spark):
    rng = random.Random(11)
    names = [(i, "".join(rng.choice("abAB c-é") for _ in range(rng.randrange(0, 12)))) for i in range(80)] + [(7, "abab"), (100, None), (None, "ab")]
    needles = [(i, "".join(rng.choice("abAB c-éz") for _ in range(rng.randrange(0, 6)))) for i in range(120)] + [(3, "ab"), (3, "ab"), (200, None), (None, "a"), (201, "?"), (202, "zzz")]
    found = search_names(spark.createDataFrame(needles, "needle_id int, needle string"), spark.createDataFrame(names, "name_id int, name string"))
    got = sorted(tuple(r) for r in found.collect())
    want = sorted((q, n) for q, needle in needles for n, name in names if q is not None and n is not None and needle and name and plain(needle) and plain(needle) in plain(name))
    assert got == want and len(got) > 200


def test_empty(spark):
    names = spark.createDataFrame([(1, "abc")], "name_id int, name string")
    needles = spark.createDataFrame([(1, "b")], "needle_id int, needle string")
    assert search_names(needles.limit(0), names).count() == search_names(needles, names.limit(0)).count() == 0


def test_postings_are_never_broadcast(spark):
    names = spark.range(50).selectExpr("id name_id", "concat('Customer#', 1000 + id) name")
    needles = spark.range(20).selectExpr("id needle_id", "cast(1000 + id % 10 as string) needle")
    found = search_names(needles, names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [gram" in plan and sorted(map(tuple, found.collect())) == [(i, n) for i in range(20) for n in range(50) if n == i % 10]
