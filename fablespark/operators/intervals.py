"""Positions inside windows that may overlap, joined by equal keys.

A window of whole numbers is cut into its canonical cover: the fewest dyadic stretches
(level, number), of which the stretch k of level l is [k * 2**l, (k + 1) * 2**l), at most
two a level. A position lies in one stretch of each level, so it is given a row for each level
that occurs, and equal (keys, level, number) are exactly the pairs of a position and a
window around it, each once. No range is compared, a hot key is spread over its stretches,
and rows grow with the logarithm of the windows' length.

Cases: bounds are inclusive; a null first or last is open; a window whose last is before
its first holds nothing; a null position or key is in no window; repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions lie in [-2**31, 2**31).
_SHIFT, _LEVELS = 1 << 31, 32


def cover(first: Column, last: Column) -> Column:
    """array<struct(level, number)> of a window, positions shifted to be positive."""
    kind = "struct<a:bigint,b:bigint,found:array<struct<level:int,number:bigint>>>"
    start = F.struct((F.coalesce(first.cast("long"), F.lit(-_SHIFT)) + _SHIFT).alias("a"), (F.coalesce(last.cast("long"), F.lit(_SHIFT - 1)) + _SHIFT + 1).alias("b"), F.array().cast("array<struct<level:int,number:bigint>>").alias("found"))

    def step(s: Column, level: Column) -> Column:
        left = (s["a"] < s["b"]) & (s["a"] % 2 == 1)
        a = F.when(left, s["a"] + 1).otherwise(s["a"])
        right = (a < s["b"]) & (s["b"] % 2 == 1)
        b = F.when(right, s["b"] - 1).otherwise(s["b"])
        one = lambda number, take: F.when(take, F.array(F.struct(level.alias("level"), number.alias("number")))).otherwise(F.array().cast("array<struct<level:int,number:bigint>>"))
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(s["found"], one(s["a"], left), one(s["b"] - 1, right)).alias("found")).cast(kind)

    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), start.cast(kind), step, lambda s: s["found"])


def inside_windows(points: DataFrame, windows: DataFrame, keys: list[str], at: str, first: str = "first_at", last: str = "last_at") -> DataFrame:
    """Each row of ``points`` with each window of its keys around ``at``; columns of ``windows`` but its keys follow."""
    rest = [c for c in windows.columns if c not in keys]
    cut = windows.select(*[F.col(k).alias(f"_{k}") for k in keys], *rest, F.explode(cover(F.col(first), F.col(last))).alias("_stretch"))
    levels = [r["level"] for r in cut.select("_stretch.level").distinct().collect()]  # 33 at most
    rows = points.select("*", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level")).withColumn("_number", F.expr(f"shiftright(CAST(`{at}` AS BIGINT) + {_SHIFT}L, _level)"))
    same = (F.col("_level") == F.col("_stretch.level")) & (F.col("_number") == F.col("_stretch.number"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return rows.join(cut, same).select(*points.columns, *rest)
