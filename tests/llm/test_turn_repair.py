"""Turn repair against every possible repair of short conversations, and its second pass against the first."""

import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from fablespark.llm import turn_repair
from fablespark.llm.turn_repair import NOTHING, Joiner, Stretch, damaged, edits, repair_conversations, repaired_lines

SCHEMA = "conv_id long, turn long, role string, text string, seg int, audit string, copies int"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def every_repair(rows):
    """The cheapest of all edits of each turn with up to two inserts in each gap: (cost, audit, lines)."""
    kinds, best = faults(rows), None
    choices = [[("D", None)] if k in ("blank", "duplicate") else [("D", None), ("K", r[1]), ("R", "user"), ("R", "assistant")] for k, r in zip(kinds, rows, strict=True)]
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for picked in product(*choices):
        for put in product(gaps, repeat=len(rows) + 1):
            lines, audit, cost = [], "", 0
            for i, extra in enumerate(put):
                lines += [(x, "") for x in extra]
                audit, cost = audit + "I" * len(extra), cost + 3 * len(extra)
                if i < len(rows):
                    edit, role = picked[i]
                    cost += {"D": 4, "K": 0, "R": 3}[edit] + (3 if edit != "D" and kinds[i] == "truncated" else 0)
                    audit += edit
                    lines += [] if edit == "D" else [(role, rows[i][2])]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def plain(rows, repair):
    turns = [t for t, _, _ in rows if t is not None]
    kinds = faults(rows)
    cost, audit, lines = repair
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def reports(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


ROLES, TEXTS = ["system", "user", "assistant", "user", "assistant", "tool", ""], ["Yes.", "No", "  ", "", "Why? ", "end!", "a.b"]


def talk(rng, n):
    rows = [(rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_every_repair_of_short_conversations(spark):
    rng = random.Random(5)
    talks = {i: talk(rng, 1 + i % 3) for i in range(60)}
    df = spark.createDataFrame([(i, *r, 1, "x", 1) for i, rows in talks.items() for r in rows], SCHEMA)
    found = reports(repair_conversations(df))
    assert found == {i: plain([(a, b, c) for a, b, c in rows], every_repair(rows)) for i, rows in talks.items()}


@pytest.mark.parametrize("held", [0, 3])
def test_long_conversations_across_partitions(spark, monkeypatch, held):
    rng = random.Random(6)
    talks = {i: sorted(((t, rng.choice(ROLES), rng.choice(TEXTS) + str(rng.randrange(9)) + rng.choice(".,")) for t in range(n)), key=lambda r: r[0]) for i, n in enumerate([700, 1, 40, 3, 5, 2, 90])}
    df = spark.createDataFrame([(i or None, *r, 1, "x", 1) for i, rows in talks.items() for r in rows], SCHEMA).repartition(6)
    first = {(i or None): turn_repair.work_out(rows) for i, rows in talks.items()}
    monkeypatch.setattr(turn_repair, "HELD_TURNS", held)
    monkeypatch.setattr(turn_repair, "FAN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert reports(repair_conversations(df)) == first
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_products_may_be_bracketed_freely():
    rng = random.Random(7)
    for _ in range(30):
        turns = [Stretch.of_turn(t, rng.choice("suax"), rng.choice(["", "blank", "truncated", "duplicate"])) for t in range(23)]
        left, joiner = NOTHING, Joiner()
        for t in turns:
            left = left + t
            joiner.add(t)
        right = NOTHING
        for t in reversed(turns):
            right = t + right
        assert left.dump() == right.dump() == joiner.whole().dump() == Stretch.load(left.dump()).dump()


def test_audit_gives_the_lines():
    assert list(repaired_lines(iter([("system", "s"), ("assistant", "b"), ("x", "c")]), "KIKRI")) == [("system", "s"), ("user", ""), ("assistant", "b"), ("user", "c"), ("assistant", "")]
    assert list(edits("")) == [("", "", "")]


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No? Well!") for c in range(12) for t in range(6)] + [(None, None, None, None), (3, None, "user", None)]
    found = {(r[0], r[1]): tuple(r)[2:] for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        assert found[c, t] == ("user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text, {0: 0, 3: 2}.get(lot, 1))


def test_conversations_without_turns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 1, "x", 0), (2, 0, None, None, 1, "x", 1), (3, 0, "user", "x.", 1, "x", 0), (4, 0, "user", "x.", 1, "x", 1)], SCHEMA)
    nothing = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    found = reports(repair_conversations(df))
    assert found[1] == found[3] == nothing and found[2][6] == "D" and found[4][6] == "KI"
    assert repair_conversations(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, 0, "user", long + ".", 1, "x", 1), (1, 1, "assistant", long, 1, "x", 1), (1, 2, "user", long + ".", 1, "x", 1)], SCHEMA)
    assert reports(repair_conversations(df))[1] == turn_repair.work_out([(0, "user", long + "."), (1, "assistant", long), (2, "user", long + ".")])
