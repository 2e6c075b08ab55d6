"""Cheapest repair of the turns of a conversation, as a product of min-plus matrices.

A sound conversation has role initials ``(s?(ua)+)?``: perhaps a system turn, then user
and assistant in turn. That is an automaton of four states: nothing yet, after s, after
u, after a. A turn is kept, given the role user or assistant, or deleted; turns of either
role may be inserted anywhere. All that can happen to one turn is a 4 x 4 matrix of
(cost, audit) elements, audit being the initials of the edits; in front of it stands the
closure of the inserts. Elements add by the minimum (least cost, then ASCII-least audit)
and multiply by adding costs and joining audits, so the product over the turns holds the
cheapest repair from any state to any other. Over the same turns no audit of equal cost
begins with another (what follows would be inserts, which cost something), hence the order
of strings is kept by joining at either side and the product may be bracketed freely.

The other figures of a conversation (faults, gaps, roles that don't follow each other)
are sums with a seam, so they ride in the same associative element (``Stretch``).

Turns are sorted by conversation and place with a range partitioning, which cuts a long
conversation into as many stretches as partitions it fills. Conversations that lie within
a partition are worked out there, each as a tree of products. Of those at a partition's
edge, and of long ones (over ``HELD_TURNS`` turns or ``HELD_CHARS`` characters), the turns
go on to a second pass: repeats are found by the first place of each (role, text), a
stretch becomes one element, and elements are joined over partitions by a tree of
``FAN`` branches. Only the digest of a conversation is worked out in one task, as a stream
in order, as its definition asks; the task's memory doesn't grow with it.

Cases: null ids are one conversation; null roles and texts are one space; a null turn
stands before all others; turns of equal number go by role, the first 64 characters and
the hash of their text; repeated rows are turns of their own and repeats of the first;
empty texts are blank; an initial other than s, u or a can't be kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache, reduce
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.llm.common import checkpointed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A conversation with more turns or characters goes to the second pass.
HELD_TURNS, HELD_CHARS = 20_000, 32_000_000
#: Stretches of a conversation that are joined at a time.
FAN = 16

ROLES = {"u": "user", "a": "assistant"}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. (from, initial, to).
MOVES = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
ENDS = (0, 3)
#: (from, by, to) of all steps along which a state can be reached from another.
_REACH = {i: {0: (0, 1, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (2, 3)}[i] for i in range(4)}
_PATHS = tuple((4 * i + k, 4 * k + j, 4 * i + j) for i in range(4) for k in _REACH[i] for j in _REACH[k])
_SPACES = " \t\n\x0b\x0c\r"

Element = tuple[int, str]
Matrix = tuple[Element | None, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    out: list[Element | None] = [None] * 16
    for ik, kj, ij in _PATHS:
        x, y = a[ik], b[kj]
        if x is not None and y is not None:
            z = (x[0] + y[0], x[1] + y[1])
            if out[ij] is None or z < out[ij]:
                out[ij] = z
    return tuple(out)


def plus(a: Matrix, b: Matrix) -> Matrix:
    return tuple(y if x is None else x if y is None else min(x, y) for x, y in zip(a, b, strict=True))


def _matrix(cells: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(cells.get((i, j)) for i in range(4) for j in range(4))


UNIT = _matrix({(i, i): (0, "") for i in range(4)})


@cache
def inserts() -> Matrix:
    """Any number of inserts. A round back to a state costs something, so paths of three hold all that can be least."""
    one = plus(UNIT, _matrix({(i, j): (INSERT, "I") for i, c, j in MOVES if c in ROLES}))
    return times(times(one, one), one)


@cache
def turn_matrix(initial: str, fault: str) -> Matrix:
    """Inserts before a turn, then what becomes of it. ``fault``: blank, duplicate, truncated or empty."""
    cells: dict[tuple[int, int], Element] = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for i, c, j in MOVES:
            ways = ([(KEEP + more, "K")] if c == initial else []) + ([(REROLE + more, "R")] if c in ROLES else []) + ([cells[i, j]] if (i, j) in cells else [])
            if ways:
                cells[i, j] = min(ways)
    return times(inserts(), _matrix(cells))


class Stretch:
    """Turns that follow each other in a conversation; ``+`` joins two in order."""

    __slots__ = ("n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "matrix")

    def __init__(self, *values) -> None:
        for name, value in zip(self.__slots__, values, strict=True):
            setattr(self, name, value)

    @classmethod
    def of_turn(cls, turn: int | None, role: str, fault: str) -> Stretch:
        return cls(1, *[int(fault == x) for x in ("blank", "duplicate", "truncated")], 0, role[:1], role[:1], turn, turn, int(turn is not None), turn_matrix(role[:1], fault))

    def __add__(self, b: Stretch) -> Stretch:
        if not self.n or not b.n:
            return b if not self.n else self
        return Stretch(
            self.n + b.n, self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated,
            self.illegal + b.illegal + (self.last + b.first not in ("su", "ua", "au")), self.first, b.last,
            b.low if self.low is None else self.low, self.high if b.high is None else b.high,
            self.turns + b.turns - (self.high is not None and self.high == b.low), times(self.matrix, b.matrix),
        )

    def repair(self) -> Element:
        """Cost and audit of the cheapest repair."""
        whole = times(self.matrix, inserts())
        return min(whole[j] for j in ENDS if whole[j] is not None)

    def report(self) -> tuple:
        cost, audit = self.repair()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit

    def dump(self) -> str:
        return json.dumps([getattr(self, x) for x in self.__slots__])

    @classmethod
    def load(cls, text: str) -> Stretch:
        *values, matrix = json.loads(text)
        return cls(*values, tuple(None if x is None else (x[0], x[1]) for x in matrix))


NOTHING = Stretch(0, 0, 0, 0, 0, "", "", None, None, 0, UNIT)


class Joiner:
    """Joins stretches that come one by one, as a tree: two are joined when they are of one size."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Stretch]] = []

    def add(self, x: Stretch) -> None:
        size = 1
        while self.held and self.held[-1][0] == size:
            x, size = self.held.pop()[1] + x, 2 * size
        self.held.append((size, x))

    def whole(self) -> Stretch:
        return reduce(lambda b, a: a + b, (x for _, x in reversed(self.held)), NOTHING)


def own_fault(text: str) -> str:
    """blank, truncated or empty."""
    said = text.rstrip(_SPACES)
    return "blank" if not said else "" if said[-1] in ".!?" else "truncated"


def edits(audit: str) -> Iterator[tuple[str, str, str]]:
    """For each turn: roles inserted before it, its edit and its role initial after that; last, with no edit, the roles inserted at the end.

    The audit says it all: an odd number of turns is left only if a system turn comes first.
    """
    at = -(sum(c != "D" for c in audit) % 2)
    before = ""
    for c in audit:
        initial = "s" if at < 0 else "ua"[at % 2]
        if c != "D":
            at += 1
        if c == "I":
            before += initial
        else:
            yield before, c, initial
            before = ""
    yield before, "", ""


def repaired_lines(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    turns = iter(turns)
    for before, edit, initial in edits(audit):
        for c in before:
            yield ROLES[c], ""
        if edit:
            role, text = next(turns)
            if edit != "D":
                yield role if edit == "K" else ROLES[initial], text


class LineDigest:
    """SHA-256 of ``role:text`` lines, newlines between them."""

    def __init__(self) -> None:
        self.sha, self.begun = sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def hex(self) -> str:
        return self.sha.hexdigest()


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_REPORT_TYPES = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in REPORT)
_REPORT_ARROW = [pa.int64()] * 6 + [pa.string()] * 2
_BATCH = 2000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(v) for v in r if isinstance(v, str))
        if len(held) >= _BATCH or chars > most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def work_out(turns: list[tuple]) -> tuple:
    """Report of a conversation held as (turn, role, text)."""
    seen, joiner = set(), Joiner()
    for turn, role, text in turns:
        fault = own_fault(text)
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        joiner.add(Stretch.of_turn(turn, role, fault))
    report = joiner.whole().report()
    digest = LineDigest()
    for role, text in repaired_lines(((r, t) for _, r, t in turns), report[-1]):
        digest.add(role, text)
    return *report, digest.hex()


def _first_pass(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted turns (conv_id, turn, role, text, copies) to reports (seg null) and turns that go on (seg, idx)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seg = TaskContext.get().partitionId()
        idx, talk, begun, goes_on, held, chars = 0, None, False, True, [], 0
        none = (None,) * len(REPORT)

        def send(conv, x: tuple) -> tuple:
            nonlocal idx
            idx += 1
            return conv, *none, seg, idx, *x

        for conv, turn, role, text, copies in _rows(batches):
            if not begun or conv != talk:
                if begun and not goes_on:
                    yield talk, *work_out(held), None, None, None, None, None
                goes_on = not begun  # the first conversation may have begun in another partition
                talk, begun, held, chars = conv, True, [], 0
                if goes_on:
                    yield send(conv, (None, None, None))  # a mark, so that a conversation without turns is known
            for _ in range(copies):
                if goes_on:
                    yield send(conv, (turn, role, text))
                else:
                    held.append((turn, role, text))
                    chars += len(text)
            if not goes_on and (len(held) > HELD_TURNS or chars > HELD_CHARS):
                goes_on = True
                yield send(conv, (None, None, None))
                yield from (send(conv, x) for x in held)
                held = []
        if begun and not goes_on:  # the last one may go on in another partition
            yield send(talk, (None, None, None))
            yield from (send(talk, x) for x in held)

    names = ["conv_id", *REPORT, "seg", "idx", "turn", "role", "text"]
    types = [id_type, *_REPORT_ARROW, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return lambda batches: _batched(rows(batches), names, types)


def _runs(rows: Iterator[tuple], key: Callable[[tuple], tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows of equal key; a run not read to its end is skipped."""
    from itertools import groupby

    return groupby(rows, key)


def _stretches(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(conv_id, seg, idx, turn, role, text, repeat) in order to (conv_id, seg, start, n, stretch)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, seg), run in _runs(_rows(batches), lambda r: (r[0], r[1])):
            joiner, start = Joiner(), None
            for _, _, idx, turn, role, text, repeat in run:
                if role is None:
                    continue
                start = idx if start is None else start
                fault = own_fault(text)
                joiner.add(Stretch.of_turn(turn, role, "duplicate" if repeat and fault != "blank" else fault))
            whole = joiner.whole()
            yield conv, seg, start, whole.n, whole.dump()

    return lambda batches: _batched(rows(batches), ["conv_id", "seg", "start", "n", "stretch"], [id_type, pa.int32(), pa.int64(), pa.int64(), pa.string()])


def _joined(stretches: DataFrame, kind: str, parts: int) -> DataFrame:
    """One stretch a conversation, by rounds of ``FAN`` neighbours."""

    def join(g: pd.DataFrame) -> pd.DataFrame:
        joiner = Joiner()
        for x in g.sort_values("seg")["stretch"]:
            joiner.add(Stretch.load(x))
        return pd.DataFrame({"conv_id": g["conv_id"].iloc[:1], "seg": [int(g["seg"].iloc[0]) // FAN], "stretch": [joiner.whole().dump()]})

    out = stretches.select("conv_id", "seg", "stretch")
    while parts > 1:
        out = out.groupBy("conv_id", F.floor(F.col("seg") / FAN)).applyInPandas(join, f"conv_id {kind}, seg int, stretch string")
        parts = -(-parts // FAN)
    return out


def _tokens(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, audit in _rows(batches):
            for n, (before, edit, initial) in enumerate(edits(audit)):
                if before or edit:
                    yield conv, n, before, edit, initial

    return lambda batches: _batched(rows(batches), ["conv_id", "n", "before", "edit", "initial"], [id_type, pa.int64()] + [pa.string()] * 3)


def _digests(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(conv_id, n, before, edit, initial, role, text) in order to (conv_id, sha)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), run in _runs(_rows(batches), lambda r: (r[0],)):
            digest = LineDigest()
            for _, _, before, edit, initial, role, text in run:
                for c in before:
                    digest.add(ROLES[c], "")
                if edit and edit != "D":
                    digest.add(role if edit == "K" else ROLES[initial], text)
            yield conv, digest.hex()

    return lambda batches: _batched(rows(batches), ["conv_id", "sha"], [id_type, pa.string()])


def _report_of(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rows = lambda batches: ((conv, *Stretch.load(text).report()) for conv, text in _rows(batches))
    return lambda batches: _batched(rows(batches), ["conv_id", *REPORT[:-1]], [id_type, *_REPORT_ARROW[:-1]])


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation.

    ``rows`` are (conv_id, turn, role, text) and, if there is such a column, copies: how
    often the turn stands there, one after the other; 0 for a turn that is gone but whose
    conversation is still to be reported. ``repaired_lines`` gives a conversation's turns
    after the edits of its audit.
    """
    kind = dict(rows.dtypes)["conv_id"]
    id_type = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    placed = said.select("*", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "head", "hash", "row"]
    sorted_turns = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    passed = checkpointed(sorted_turns.mapInArrow(_first_pass(id_type), f"conv_id {kind}, {_REPORT_TYPES}, seg int, idx long, turn long, role string, text string"))
    whole = passed.filter("seg is null").select("conv_id", *REPORT)
    turns = passed.filter("seg is not null").select("conv_id", "seg", "idx", "turn", "role", "text")

    # A turn repeats another unless it is the first of its conversation, role and text; (seg, idx) names it.
    first = turns.filter("role is not null").groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min(F.struct("seg", "idx")).alias("at"))
    known = turns.join(first.select("at.seg", "at.idx", F.lit(False).alias("repeat")), ["seg", "idx"], "left").select("conv_id", "seg", "idx", "turn", "role", "text", F.coalesce("repeat", F.lit(True)).alias("repeat"))
    stretches = checkpointed(known.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "idx").mapInArrow(_stretches(id_type), f"conv_id {kind}, seg int, start long, n long, stretch string"))
    parts = (stretches.agg(F.max("seg")).first()[0] or 0) + 1
    report = checkpointed(_joined(stretches, kind, max(parts, 2)).select("conv_id", "stretch").mapInArrow(_report_of(id_type), f"conv_id {kind}, {_REPORT_TYPES.rpartition(', ')[0]}"))

    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select(F.col("conv_id").alias("talk"), F.col("seg").alias("part"), "start", F.coalesce(F.sum("n").over(before.partitionBy("conv_id")), F.lit(0)).alias("offset"))
    numbered = turns.filter("role is not null").join(offsets, F.col("conv_id").eqNullSafe(F.col("talk")) & (F.col("seg") == F.col("part"))).select("conv_id", (F.col("offset") + F.col("idx") - F.col("start")).alias("n"), "role", "text")
    tokens = report.select("conv_id", "audit").mapInArrow(_tokens(id_type), f"conv_id {kind}, n long, before string, edit string, initial string")
    said = numbered.select(F.col("conv_id").alias("talk"), F.col("n").alias("place"), "role", "text")
    edited = tokens.join(said, F.col("conv_id").eqNullSafe(F.col("talk")) & (F.col("n") == F.col("place")), "left").select("conv_id", "n", "before", "edit", "initial", "role", "text")
    digests = edited.repartition("conv_id").sortWithinPartitions("conv_id", "n").mapInArrow(_digests(id_type), f"talk {kind}, sha string")
    blank = sha256().hexdigest()
    rest = report.join(digests, F.col("conv_id").eqNullSafe(F.col("talk")), "left").select("conv_id", *REPORT[:-1], F.coalesce("sha", F.lit(blank)).alias(REPORT[-1]))
    return whole.unionByName(rest)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults that crc32 of ``conv_id:turn`` modulo 20 gives: 0 to 4, as a test of the repair."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    copies = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), copies.alias("copies"))


ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
lots AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS lot FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM lots WHERE lot <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
turns AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS former,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
inserts(i, j, put) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
moves(i, c, j) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
steps AS (
  SELECT conv_id, n, i, i AS j, 4 AS cost, 'D' AS edit FROM turns, range(4) AS r(i)
  UNION ALL SELECT conv_id, n, i, j, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K' FROM turns, moves WHERE initial = c AND fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, n, i, j, 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'R' FROM turns, moves WHERE c <> 's' AND fault NOT IN ('blank', 'duplicate')),
ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS best FROM conversations
  UNION ALL
  SELECT w.conv_id, w.n + 1, s.j, min({'cost': w.best.cost + 3 * length(t.put) + s.cost, 'audit': w.best.audit || t.put || s.edit})
  FROM ways w JOIN inserts t ON w.state = t.i JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.n + 1 AND s.i = t.j
  GROUP BY w.conv_id, w.n, s.j),
ends AS (
  SELECT conv_id, n, min({'cost': best.cost + 3 * length(put), 'audit': best.audit || put}) AS best FROM ways JOIN inserts ON state = i WHERE j IN (0, 3) GROUP BY conv_id, n),
found AS (SELECT conv_id, arg_max(best.cost, n) AS cost, arg_max(best.audit, n) AS audit FROM ends GROUP BY conv_id),
letters AS (SELECT conv_id, length(replace(audit, 'D', '')) % 2 AS odd, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p FROM found WHERE audit <> ''),
counted AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w - 1 - odd AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
lines AS (
  SELECT c.conv_id, p, CASE WHEN edit = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM counted c LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.n = c.n WHERE edit <> 'D'),
hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS h FROM lines GROUP BY conv_id),
sums AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id)
SELECT f.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM found f LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN hashes g ON g.conv_id IS NOT DISTINCT FROM f.conv_id
"""
