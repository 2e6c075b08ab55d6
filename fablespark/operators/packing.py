"""Greedy packing of ordered items into batches, whatever the length of a group.

A batch takes items while they fit the budget that held at its first item, so a batch
that begins at item i with P before it ends before the first item whose running sum is
over t = P + budget: the next start is a sorted search for t in the running sums, and
the starts of a group are the chain of these pointers from its first item.

Items are sorted by group and order with a range partitioning. A group within a partition
is followed as a stream. Of a group over several partitions, the first stretch is
followed too; what enters the others is one number, the t of the batch that is open at
their edge. The ends of all partitions (two groups each) tell where a t leads, so only
stretches in the middle of a group need more: each works out, by the sorted search and one
pass backwards, to which t every item leads, and gives the different ones; each of
these is looked up in the stretch that it enters; and pointer doubling marks those that
hang on the first item, in as many rounds as the logarithm of a group's partitions.
There are at most as many such numbers a partition as items in one batch. Then all items
are numbered as a stream. No task holds more than one partition's numbers, texts never
take part, and the driver sees one row a partition.

Cases: a null size or budget counts as 0, a negative size too; an item over the budget stands
alone; null groups are one group; items of a group are told apart by ``at``; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.operators.components import cut_lineage


@dataclass
class Ends:
    """What a partition shows of its first and last group; the last one's batches as if it began here."""

    part: int
    first: tuple
    last: tuple
    one_group: bool
    total: int
    tail: list[int]
    threshold: int
    starts: int


@dataclass
class Entry:
    """What a partition's first group brings along: sum, last sizes and, once known, open batch."""

    offset: int
    tail: list[int]
    run: int
    middle: bool
    end: int | None
    threshold: int | None = None
    batches: int = 0


class Follower:
    """Follows batches along one group."""

    def __init__(self, lookback: int, entry: Entry | None = None) -> None:
        self.total = entry.offset if entry else 0
        self.threshold = entry.threshold if entry else None
        self.batch = (entry.batches if entry else 0) - 1
        self.before = deque(entry.tail if entry else [], maxlen=lookback)
        self.kept = sum(self.before)

    def add(self, size: int, budget: int) -> int:
        """Number of the batch that takes an item."""
        if self.threshold is None or self.total + size > self.threshold:
            self.threshold = self.total + budget - self.kept
            self.batch += 1
        self.total += size
        if self.before.maxlen:
            self.kept += size - (self.before[0] if len(self.before) == self.before.maxlen else 0)
            self.before.append(size)
        return self.batch


#: Items of a partition, more or less.
TASK_ITEMS = 250_000


def _rows(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(size, budget, group...) of columns size, budget, group..., at...; what isn't compared stays in Arrow."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns[: 2 + groups]], strict=True)


def _partition_ends(groups: int, lookback: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, last, follow, one = None, None, None, True
    for size, budget, *keys in _rows(groups, batches):
        group = tuple(keys)
        if follow is None or group != last:
            one = follow is None
            first = group if one else first
            last, follow = group, Follower(lookback)
        follow.add(size, budget)
    if follow is not None:
        ends = (TaskContext.get().partitionId(), first, last, one, follow.total, list(follow.before), follow.threshold, follow.batch + 1)  # as Ends
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ends)], pa.binary())], names=["ends"])


def _entries(found: list[Ends], lookback: int) -> tuple[dict[int, Entry], dict[int, tuple[int, int]]]:
    """Entries of the partitions that go on with a group, and (threshold, batches) of each run of such partitions when it begins."""
    entries: dict[int, Entry] = {}
    roots: dict[int, tuple[int, int]] = {}
    for i, now in enumerate(found[1:], 1):
        last = found[i - 1]
        if last.last != now.first:
            continue
        old = entries.get(last.part) if last.one_group else None
        offset = (old.offset if old else 0) + last.total
        tail = ((old.tail if old else []) + last.tail)[-lookback:] if lookback else []
        run = old.run if old else len(roots)
        if old is None:
            roots[run] = (last.threshold, last.starts)
        middle = now.one_group and i + 1 < len(found) and found[i + 1].first == now.last
        entries[now.part] = Entry(offset, tail, run, middle, offset + now.total if middle else None)
    return entries, roots


class Runs:
    """Where a threshold leads: the first later partition of the run whose running sums pass it."""

    def __init__(self, entries: dict[int, Entry]) -> None:
        self.parts: dict[int, list[int]] = {}
        self.ends: dict[int, list[float]] = {}
        for part, e in sorted(entries.items()):
            self.parts.setdefault(e.run, []).append(part)
            self.ends.setdefault(e.run, []).append(float("inf") if e.end is None else e.end)

    def next(self, run: int, threshold: int, after: int = -1) -> int:
        """The last partition of a run, whose end isn't known, takes what passes the others."""
        return self.parts[run][max(bisect_right(self.ends[run], threshold), bisect_right(self.parts[run], after))]


def _followed(sizes: np.ndarray, budgets: np.ndarray, entry: Entry, lookback: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of a stretch; for each item the threshold with which its chain leaves, and the chain's length."""
    sums = entry.offset + np.cumsum(sizes)
    before = np.concatenate(([0], np.cumsum(np.concatenate((entry.tail, sizes)).astype(np.int64))))
    at = len(entry.tail) + np.arange(len(sizes))
    thresholds = sums - sizes + budgets - (before[at] - before[np.maximum(0, at - lookback)])
    after = np.maximum(np.searchsorted(sums, thresholds, side="right"), np.arange(1, len(sums) + 1))
    leaves, length = thresholds.copy(), np.ones(len(sums), np.int64)
    for i in range(len(sums) - 1, -1, -1):
        if after[i] < len(sums):
            leaves[i] = leaves[after[i]]
            length[i] += length[after[i]]
    return sums, leaves, length


def _leads(ordered: DataFrame, entries: dict[int, Entry], roots: dict[int, tuple[int, int]], lookback: int) -> DataFrame:
    """(part, threshold, starts): the threshold that enters each partition of ``entries``, and the batches that begin in it (null in a last one)."""
    spark = ordered.sparkSession
    runs = Runs(entries)
    middle = {p: e for p, e in entries.items() if e.middle}
    begin = [(runs.next(run, t), t) for run, (t, _) in roots.items()]

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        if part not in middle:
            return
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64()), b.column(0), b.column(1)], names=["part", "i", "size", "budget"])
            at += n

    def numbers(rows: pd.DataFrame, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.sort_values("i")
        return _followed(rows["size"].to_numpy(), rows["budget"].to_numpy(), middle[part], lookback)

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        leaves = np.unique(numbers(rows, part)[1])
        return pd.DataFrame({"part": [runs.next(middle[part].run, t, part) for t in leaves], "threshold": leaves})

    def look_up(rows: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or entering.empty:
            return pd.DataFrame({c: [] for c in ("part", "threshold", "next_part", "next_threshold", "starts")})
        part = int(rows["part"].iloc[0])
        sums, leaves, length = numbers(rows, part)
        at = np.searchsorted(sums, entering["threshold"].to_numpy(), side="right")
        return pd.DataFrame({"part": part, "threshold": entering["threshold"].to_numpy(), "next_part": [runs.next(middle[part].run, t, part) for t in leaves[at]], "next_threshold": leaves[at], "starts": length[at]})

    rows = ordered.mapInArrow(stretch, "part int, i long, size long, budget long")
    start = spark.createDataFrame(begin, "part int, threshold long")
    nodes = rows.groupBy("part").applyInPandas(exits, "part int, threshold long").unionByName(start).distinct()
    steps = cut_lineage(rows.groupBy("part").cogroup(nodes.groupBy("part")).applyInPandas(look_up, "part int, threshold long, next_part int, next_threshold long, starts long"))
    jump = steps.select("part", "threshold", "next_part", "next_threshold")
    reached = start
    for _ in range(len(middle).bit_length() + 1):
        ahead = reached.join(jump, ["part", "threshold"]).select(F.col("next_part").alias("part"), F.col("next_threshold").alias("threshold"))
        reached = cut_lineage(reached.unionByName(ahead).distinct())
        second = jump.select(F.col("part").alias("next_part"), F.col("threshold").alias("next_threshold"), F.col("next_part").alias("far_part"), F.col("next_threshold").alias("far_threshold"))
        jump = cut_lineage(jump.join(second, ["next_part", "next_threshold"]).select("part", "threshold", F.col("far_part").alias("next_part"), F.col("far_threshold").alias("next_threshold")))
    return reached.join(steps, ["part", "threshold"], "left").select("part", "threshold", "starts")


def _numbered(groups: int, lookback: int, entries: dict[int, Entry], names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, follow = None, None
    for b in batches:
        out = []
        for size, budget, *keys in _rows(groups, [b]):
            group = tuple(keys)
            if follow is None or group != last:
                follow = Follower(lookback, entries.get(TaskContext.get().partitionId()) if follow is None else None)
                last = group
            out.append(follow.add(size, budget))
        yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.int32())], names=[*names, "batch_no"])


def pack(items: DataFrame, group: list[str], at: list[str], size: Column | str, budget: Column | str | int, lookback: int = 0, beside: tuple[str, ...] = ()) -> DataFrame:
    """(group, at, beside, batch_no): the items of each group packed greedily in the order of ``at``.

    A batch's budget is that of its first item less the sizes of the ``lookback`` items before it.
    Columns ``beside`` go along, so that nobody need join them again. The items are counted first,
    and if they are many dealt over as many partitions as they need.
    """
    kinds, names = dict(items.dtypes), [*group, *at, *beside]
    number = lambda c: F.greatest(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(0)), F.lit(0))
    most = F.lit(budget) if isinstance(budget, int) else F.col(budget) if isinstance(budget, str) else budget
    keys = [f"k{i}" for i in range(len(names))]
    rows = items.select(number(size).alias("size"), F.coalesce(most.cast("long"), F.lit(0)).alias("budget"), *[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)])
    order = keys[: len(group) + len(at)]
    tasks = 1 + items.count() // TASK_ITEMS
    # A number that is given is kept; else Spark joins partitions by their compressed bytes, and sorts them as rows.
    dealt = rows.repartitionByRange(tasks, *order) if tasks > 1 else rows.repartitionByRange(*order)
    ordered = cut_lineage(dealt.sortWithinPartitions(*order))
    n = len(group)
    found = sorted((Ends(*pickle.loads(r["ends"])) for r in ordered.mapInArrow(lambda b: _partition_ends(n, lookback, b), "ends binary").collect()), key=lambda e: e.part)  # one row a partition
    entries, roots = _entries(found, lookback)
    if any(e.middle for e in entries.values()):
        known = {r["part"]: r for r in _leads(ordered, entries, roots, lookback).collect()}  # one row a partition
    else:
        known = {part: {"threshold": roots[e.run][0], "starts": None} for part, e in entries.items()}
    done = {run: batches for run, (_, batches) in roots.items()}
    last = {run: t for run, (t, _) in roots.items()}
    for part, e in sorted(entries.items()):
        # A partition that nothing enters lies within the batch that is open before it.
        e.threshold, e.batches = (known[part]["threshold"] if part in known else last[e.run]), done[e.run]
        if part in known:
            last[e.run] = e.threshold
            done[e.run] += known[part]["starts"] or 0
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["batch_no int"])
    return ordered.mapInArrow(lambda b: _numbered(n, lookback, entries, names, b), schema)
