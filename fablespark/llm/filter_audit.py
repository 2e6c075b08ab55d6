"""What each filter of a chain removes in every order, from a packed bitmap index.

A filter fails some documents. Applied in an order, a filter removes those of its
failures that no earlier filter has removed. That number depends on the *set* of
earlier filters alone, so n filters need n * 2**(n-1) counts, not n! passes.

Texts are read once, into narrow rows: part, a bit for each filter, a bit for each label.
Every task packs its rows into NumPy bitsets, one for each filter and each label. A
part is a run of whole bytes in them: rows are ordered by part and each run filled up
to eight, with a bitset of what is a row. For each set of earlier filters the bits that
are left (rows AND-NOT the earlier filters) meet those of each other filter; the bits of
each byte are counted and summed over the runs, so one pass counts all parts. Counts of
batches and partitions are summed by a grouped aggregate. Nothing but counts leaves a
task, and no task holds more than one batch and the counts of ``HELD_PARTS`` parts.

Duplicates (a text that a smaller doc_id has too, in the whole table) are found by
text hashes (SHA-256), of which the smallest doc_id is kept by partial aggregation; the
rows that hold such a doc_id are met by (doc_id, hash), so a text that a third of all
documents share falls into no single task.

Cases: a null text is empty and fails like one; a null part is the empty string, and both
are one part; repeated rows are documents of their own,
and are no duplicates of each other while they share their doc_id; a row with a null
doc_id duplicates nothing and has no label; a doc_id that has several label rows counts
as labelled if one of them says so; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.llm.common import checkpointed

#: Parts whose counts a task holds before it sends them on.
HELD_PARTS = 2000
_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_MARKUP = b"#$%&*|"


def text_failures(text: str) -> int:
    """Bits of A (few words), B (repeated words), C (capitals), D (markup characters) for a whole text."""
    data = text.encode()
    words = data.split()  # bytes are split at \x20 and \x09 to \x0D only
    few, repeated = len(words) < 100, 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * len(data.translate(None, _NOT_CAPITALS)) > 10 * len(text)
    markup = len(data.translate(None, _MARKUP)) < len(data)
    return few | repeated << 1 | capitals << 2 | markup << 3


def with_failures(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, part, text) as (doc_id, part, bits, hash)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            bits, hashes = [text_failures(t) for t in texts], [sha256(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int32()), pa.array(hashes, pa.binary())], names=["doc_id", "part", "bits", "hash"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "part", "text").mapInArrow(judge, f"doc_id {kind}, part string, bits int, hash binary")


def _bits(marks: list[Column]) -> Column:
    """Bit k is set if the k-th mark holds."""
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(marks)), F.lit(0)).cast("int")


def with_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` (doc_id, hash, bits, part) with ``bit`` set where a smaller doc_id has the same hash."""
    firsts = rows.filter("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("first")).select(F.col("hash").alias("first_hash"), "first")
    known = rows.filter("doc_id is not null").join(firsts, (F.col("doc_id") == F.col("first")) & (F.col("hash") == F.col("first_hash")), "left")
    flagged = known.select("doc_id", "part", F.when(F.col("first").isNull(), F.col("bits").bitwiseOR(F.lit(1 << bit))).otherwise(F.col("bits")).alias("bits"))
    return flagged.unionByName(rows.filter("doc_id is null").select("doc_id", "part", "bits"))


def with_labels(rows: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """``rows`` with label_bits: bit k is set if the k-th mark holds for a label row of the doc_id."""
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"mark{k}") for k, c in enumerate(marks.values())])
    bits = marked.select(F.col("doc_id").alias("label_id"), _bits([F.col(f"mark{k}") for k in range(len(marks))]).alias("label_bits"))
    known = rows.filter("doc_id is not null").join(bits, F.col("doc_id") == F.col("label_id"), "left").select("part", "bits", F.coalesce("label_bits", F.lit(0)).alias("label_bits"))
    return known.unionByName(rows.filter("doc_id is null").select("part", "bits", F.lit(0).alias("label_bits")))


class BitmapIndex:
    """Bitsets of one batch: of the rows, of each filter and of each label. Parts are runs of whole bytes."""

    def __init__(self, parts: np.ndarray, n_parts: int, bits: np.ndarray, label_bits: np.ndarray, n_filters: int, n_labels: int) -> None:
        order = np.argsort(parts, kind="stable")
        sizes = np.bincount(parts, minlength=n_parts)
        runs = -(-sizes // 8)
        self.starts = np.concatenate(([0], np.cumsum(runs)[:-1])).astype(np.int64)
        place = self.starts[parts[order]] * 8 + np.arange(len(order)) - np.concatenate(([0], np.cumsum(sizes)[:-1]))[parts[order]]
        width = int(runs.sum()) * 8

        def packed(flags: np.ndarray) -> np.ndarray:
            spread = np.zeros(width, dtype=bool)
            spread[place] = flags[order]
            return np.packbits(spread)

        self.rows = packed(np.ones(len(order), dtype=bool))
        self.fails = [packed((bits >> k) & 1 == 1) for k in range(n_filters)]
        self.labels = [packed((label_bits >> k) & 1 == 1) for k in range(n_labels)]

    def count(self, bitset: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), self.starts)

    def subset_counts(self) -> np.ndarray:
        """[part, earlier set, filter, (kept, removed, failing, removed with label 0, ...)]."""
        n = len(self.fails)
        out = np.zeros((len(self.starts), 1 << n, n, 3 + len(self.labels)), dtype=np.int64)
        failing = [self.count(x) for x in self.fails]
        for earlier in range(1 << n):
            left = self.rows.copy()
            for k in range(n):
                if earlier >> k & 1:
                    left &= ~self.fails[k]
            alive = self.count(left)
            for f in range(n):
                if earlier >> f & 1:
                    continue
                gone = left & self.fails[f]
                removed = self.count(gone)
                out[:, earlier, f, 0] = alive - removed
                out[:, earlier, f, 1] = removed
                out[:, earlier, f, 2] = failing[f]
                for k, label in enumerate(self.labels):
                    out[:, earlier, f, 3 + k] = self.count(gone & label)
        return out


def subset_counts(flags: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """(part, earlier, filter, kept, removed, failing, *losses) of rows (part, bits, label_bits), summed over partitions."""
    n, n_labels = len(filters), len(losses)
    names = ["part", "earlier", "filter", "kept", "removed", "failing", *losses]

    def table(held: dict[str, np.ndarray]) -> pd.DataFrame:
        earlier, f = np.array([(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]).T
        counts = np.concatenate([held[p][earlier, f] for p in held])
        columns = {"part": np.repeat(np.array(list(held), dtype=object), len(f)), "earlier": np.tile(earlier, len(held)), "filter": np.tile(f, len(held))}
        return pd.DataFrame(columns | {c: counts[:, k] for k, c in enumerate(names[3:])})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            codes, parts = pd.factorize(batch["part"])
            found = BitmapIndex(codes, len(parts), batch["bits"].to_numpy(), batch["label_bits"].to_numpy(), n, n_labels).subset_counts()
            for part, counts in zip(parts, found, strict=True):
                held[part] = held[part] + counts if part in held else counts
            if len(held) > HELD_PARTS:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    types = ", ".join(f"`{c}` {'string' if c == 'part' else 'int' if c in ('earlier', 'filter') else 'long'}" for c in names)
    counted = flags.select("part", "bits", "label_bits").mapInPandas(count, types)
    return counted.groupBy("part", "earlier", "filter").agg(*[F.sum(c).alias(c) for c in names[3:]])


def order_report(counts: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, *losses, shapley): a row for each step of each order.

    ``shapley`` is what the filter removes summed over all orders; a set of k earlier
    filters comes before it in k! (n-1-k)! of them.
    """
    n = len(filters)
    weight = [factorial(bin(s).count("1")) * factorial(max(0, n - 1 - bin(s).count("1"))) for s in range(1 << n)]
    others = F.element_at(F.array(*[F.lit((1 << n) - 1 - (1 << f)) for f in range(n)]), F.col("filter") + 1)
    whole = counts.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * F.element_at(F.array(*map(F.lit, weight)), F.col("earlier") + 1)).alias("shapley"), F.sum(F.when(F.col("earlier") == others, F.col("removed")).otherwise(0)).alias("unique_fails")
    )
    steps = [("".join(filters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    table = json.dumps([dict(zip(("filter_order", "step", "earlier", "filter"), x, strict=True)) for x in steps])  # n! orders of n steps: a few hundred rows
    orders = counts.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<filter_order:string,step:int,earlier:int,filter:int>>")))
    rows = counts.join(whole, ["part", "filter"]).join(F.broadcast(orders), ["earlier", "filter"])
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *losses, "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The report of the five filters A to E over whole texts, by ``part``; losses are good and toxic documents."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    flags = with_labels(with_repeats(checkpointed(with_failures(rows)), 4), labels, {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1})
    losses = ["good_lost", "toxic_lost"]
    counts = checkpointed(subset_counts(flags, list("ABCDE"), losses))  # used twice: 80 rows a part
    return order_report(counts, list("ABCDE"), losses)


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(first < w.doc_id, false) AS e, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM worded w LEFT JOIN marks m ON w.doc_id = m.doc_id),
kinds AS (
  SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS s, [x[1] FOR x IN [('A', a), ('B', b), ('C', c), ('D', d), ('E', e)] IF x[2]] AS fails, good, toxic, count(*) AS n
  FROM flags GROUP BY ALL),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step-1], '') AS earlier FROM orders, range(1, 6) AS r(step)),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
         CAST(sum(n) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, earlier)) AS BIGINT) AS kept,
         CAST(sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, earlier)) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, earlier)) AS BIGINT) AS redundant,
         CAST(sum(n) FILTER (len(fails) = 1 AND fails[1] = f) AS BIGINT) AS unique_fails,
         CAST(sum(n) FILTER (good = 1 AND list_contains(fails, f) AND NOT list_has_any(fails, earlier)) AS BIGINT) AS good_lost,
         CAST(sum(n) FILTER (toxic = 1 AND list_contains(fails, f) AND NOT list_has_any(fails, earlier)) AS BIGINT) AS toxic_lost
  FROM kinds, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
       coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counted
"""
