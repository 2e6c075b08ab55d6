"""Many substring searches at once against all names, by an index of trigrams.

A name is posted under each of its different trigrams. A needle is looked up under one of
its own: the one with the shortest posting list, as a name that holds the needle is in all
of them. What is found there is verified. Needles of the same text are looked up once, and
postings are merged: by their source's size Spark would broadcast them. A needle of one or two characters is looked up
under itself in an index of that size, which is built only if there is such a needle.

Cases: names and needles are normalised (lower case, runs of anything but letters and
digits one space); a needle without any finds nothing; one with a trigram that no name has
finds nothing; nulls are skipped; repeated rows each count; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.functions.text import normal_name

SIZE = 3


def grams(text: Column, size: Column | int = SIZE) -> Column:
    """The different stretches of ``size`` characters of a text; none if it is shorter."""
    n = F.lit(size) if isinstance(size, int) else size
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, n)))


def search_names(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle_id, name_id): the names (name_id, name) that hold each needle (needle_id, needle)."""
    asked = needles.select("needle_id", normal_name(F.col("needle")).alias("needle")).filter("needle_id is not null and needle <> ''")
    owners = asked.groupBy("needle", "needle_id").agg(F.count("*").alias("times"))
    asked = asked.select("needle").distinct().withColumn("size", F.least(F.length("needle"), F.lit(SIZE)))
    known = names.select("name_id", normal_name(F.col("name")).alias("name")).filter("name_id is not null and name <> ''")
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # three at most
    lists = [grams(F.col("name"), s) for s in sizes] or [F.array().cast("array<string>")]
    postings = known.select("name_id", "name", F.explode(F.flatten(F.array(*lists))).alias("gram"))
    lengths = postings.groupBy("gram").agg(F.count("*").alias("length"))
    looked = asked.select("needle", F.explode(grams(F.col("needle"), F.col("size"))).alias("gram"))
    # A gram that no name has is the shortest list of all.
    rated = looked.join(lengths, "gram", "left").withColumn("list", F.struct(F.coalesce("length", F.lit(0)).alias("length"), "gram"))
    best = rated.groupBy("needle").agg(F.min("list").alias("list")).filter("list.length > 0").select("needle", F.col("list.gram").alias("gram"))
    found = postings.hint("merge").join(best, "gram").filter(F.contains("name", F.col("needle"))).select("needle", "name_id")
    found = found.hint("merge").join(owners, "needle")
    return found.select("needle_id", "name_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).drop("_time")
